"""Tables of the record model, derived from the given ones by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from quillmark.plans.registry import fixture, values

values("kinds", "kind_no BIGINT, fact_type STRING, code STRING, unit STRING, scale DOUBLE, base DOUBLE", [
    (0, "lab_result", "4548-4", "%", 0.25, 0.0), (1, "lab_result", "718-7", "g/dL", 0.3, 0.0), (2, "lab_result", "2345-7", "mg/dL", 10.0, 5.0), (3, "vital_sign", "8310-5", "[degF]", 0.25, 90.0),
    (4, "vital_sign", "8480-6", "mm[Hg]", 4.0, 20.0), (5, "medication", "372567009", None, 1.0, 0.0), (6, "medication", "386864001", None, 1.0, 0.0), (7, "condition", "44054006", None, 0.0, 0.0),
    (8, "allergy", None, None, 0.0, 0.0), (9, "investigation_order", "1558-6", None, 0.0, 0.0), (10, "procedure", "80146002", None, 0.0, 0.0), (11, "vital_sign", "8310-5", "Cel", 0.1, 33.0),
])

#: Facts: one for each event; values, units, days and codes are missing or wrong at fixed steps of the id.
fixture("facts", """SELECT event_id AS fact_id, user_id AS patient_id, CAST(floor(event_id / 6.0) AS BIGINT) AS document_id, k.fact_type, k.code,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'mmol/L' WHEN event_id % 23 = 0 THEN upper(k.unit) ELSE k.unit END AS unit,
 CASE WHEN k.scale = 0 OR event_id % 29 = 0 THEN NULL ELSE k.base + floor(coalesce(value, 0) * k.scale) END AS value_num,
 CASE event_id % 5 WHEN 0 THEN 'unmapped' WHEN 1 THEN 'local_only' WHEN 2 THEN NULL ELSE 'bound' END AS code_status,
 CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN DATE '2999-01-01' WHEN event_id % 41 = 0 THEN DATE '1850-06-01' ELSE CAST(ts AS DATE) END AS effective_on,
 CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN DATE '2019-01-01' ELSE CAST(ts AS DATE) END AS period_start,
 CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST((80 + event_id % 21) / 100.0 AS DOUBLE) END AS confidence,
 CAST(floor(event_id / 6.0) AS BIGINT) % 9 = 0 AS partial, event_id % 11 <> 0 AS is_current,
 CASE event_id % 4 WHEN 0 THEN 'auto_accepted' WHEN 1 THEN 'in_review' WHEN 2 THEN 'corrected' ELSE NULL END AS review_state,
 event_id % 47 <> 0 AS has_provenance, CASE WHEN event_id % 47 = 0 THEN NULL ELSE event_id % 53 <> 0 END AS has_span,
 CASE WHEN CAST(floor(event_id / 6.0) AS BIGINT) % 50 = 0 THEN 'old-model' END AS fallback_model,
 CASE event_id % 8 WHEN 0 THEN 'printed' WHEN 1 THEN 'agree' WHEN 2 THEN 'disagree' WHEN 3 THEN 'single_engine' WHEN 4 THEN 'page_level' WHEN 5 THEN 'legacy' ELSE 'printed' END AS evidence_state,
 CASE WHEN k.fact_type = 'medication' AND event_id % 3 <> 0 THEN CAST(event_id % 4 AS DOUBLE) END AS frequency_per_day,
 CASE WHEN k.fact_type = 'medication' AND event_id % 9 = 0 THEN 'BD' END AS frequency_code,
 CASE WHEN k.fact_type = 'medication' AND event_id % 10 < 7 THEN CAST(event_id % 10 * 400 AS DOUBLE) END AS dose_num,
 CASE WHEN k.fact_type = 'medication' THEN CASE event_id % 3 WHEN 0 THEN 'mg' WHEN 1 THEN 'mcg' END END AS dose_unit,
 CASE WHEN k.fact_type = 'medication' AND event_id % 6 < 4 THEN CAST(event_id % 6 * 5 AS DOUBLE) END AS strength_num,
 CASE WHEN k.fact_type = 'medication' THEN 'g' END AS strength_unit
 FROM {events} JOIN {kinds} k ON event_id % 12 = k.kind_no""")

#: Lines of evidence of each fact, with the states of their readings.
fixture("fact_lines", """SELECT fact_id, line_no, CASE (fact_id * 3 + line_no) % 9 WHEN 0 THEN 'printed' WHEN 1 THEN 'agree' WHEN 2 THEN 'disagree' WHEN 3 THEN 'single_engine' WHEN 4 THEN 'page_level' WHEN 5 THEN 'no_reading' WHEN 6 THEN 'unheard' WHEN 7 THEN NULL ELSE 'printed' END AS state
 FROM {facts} JOIN (VALUES (0), (1), (2)) AS v(line_no) ON line_no <= fact_id % 4""")

#: Blocks of text of a page: boxes and confidences.
fixture("blocks", """SELECT l_orderkey * 10 + l_linenumber AS block_id, l_orderkey AS page_id, CAST(floor(l_orderkey / 3.0) AS BIGINT) AS document_id, min(l_partkey) % 700 AS x0, min(l_suppkey) % 40 * 12 AS y0,
 min(l_partkey) % 700 + 40 + min(l_linenumber) * 9 AS x1, min(l_suppkey) % 40 * 12 + 10 + min(l_linenumber) AS y1,
 CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 2 THEN NULL ELSE CAST(min(l_quantity) / 50 AS DOUBLE) END AS ocr_conf, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_linenumber END AS reading_order FROM {lineitem} GROUP BY l_orderkey, l_linenumber""")

#: Corrections by reviewers, append-only.
fixture("corrections", """SELECT event_id AS correction_id, CAST(floor(event_id / 6.0) AS BIGINT) AS document_id, user_id AS doctor_id, CASE event_id % 3 WHEN 0 THEN 'drug' ELSE 'test' END AS field_type,
 CASE event_id % 7 WHEN 0 THEN 'Telma4O' WHEN 1 THEN 'telma 40' WHEN 2 THEN 'FBS ' WHEN 3 THEN 'f.b.s' ELSE concat('raw ', CAST(event_id % 9 AS STRING)) END AS original,
 CASE WHEN event_id % 7 < 2 THEN 'Telma 40' WHEN event_id % 7 < 4 THEN 'FBS' ELSE concat('name ', CAST(event_id % 4 AS STRING)) END AS corrected, ts FROM {events}""")

#: A document's runs through the stages, append-only.
fixture("runs", """SELECT event_id AS run_id, user_id AS document_id, CASE event_type WHEN 'signup' THEN 'ingest' WHEN 'view' THEN 'recognise' WHEN 'click' THEN 'extract' WHEN 'purchase' THEN 'validate' ELSE 'project' END AS stage,
 CASE event_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'running' ELSE 'ok' END AS status, ts AS started_at, value AS seconds FROM {events}""")

#: Files that a listener polled.
fixture("polled", """SELECT user_id AS file_no, concat('v', CAST(event_id % 3 AS STRING)) AS etag, event_id AS poll, ts, CASE event_id % 5 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.JPG' WHEN 2 THEN '.hidden' WHEN 3 THEN 'c.json' ELSE 'd.docx' END AS name FROM {events}""")

#: Expected and read values of documents, for scoring.
fixture("scored", """SELECT event_id AS value_id, user_id AS document_id, CASE user_id % 3 WHEN 0 THEN 'typed' WHEN 1 THEN 'written' ELSE 'mixed' END AS kind, CASE user_id % 2 WHEN 0 THEN 'en' ELSE 'hi' END AS script,
 CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'S. Lipase' ELSE concat('Value ', CAST(event_id % 13 AS STRING)) END AS expected,
 CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 's lipase' WHEN event_id % 7 = 0 THEN concat('Valve ', CAST(event_id % 13 AS STRING)) ELSE concat('value ', CAST(event_id % 13 AS STRING)) END AS got,
 CASE event_id % 5 WHEN 0 THEN 'needs_check' WHEN 1 THEN 'absent' WHEN 2 THEN 'accepted' ELSE 'checked' END AS status FROM {events}""")
