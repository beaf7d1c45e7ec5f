"""Rules, evidence, policy, gate, conflicts and read models over facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators import rules as R
from quillmark.plans import records  # noqa: F401  (the derived tables)
from quillmark.plans.registry import Tables, fixture, query, values

values("range_table", "fact_type STRING, code STRING, low DOUBLE, high DOUBLE, want STRING", R.RANGES)
values("ceiling_table", "code STRING, ceiling DOUBLE", R.CEILINGS)
AS_OF = "2030-01-01"

#: Every rule in SQL, one row for each finding.
fixture("wanted_findings", """SELECT fact_id, 'info' AS severity, 'unit-normalized' AS code FROM {facts} f JOIN {range_table} r USING (fact_type, code) WHERE code = '8310-5' AND value_num > 45
 UNION ALL SELECT fact_id, 'blocker', 'value-out-of-range' FROM (SELECT *, CASE WHEN code = '8310-5' AND value_num > 45 THEN (value_num - 32) * 5 / 9 ELSE value_num END AS v FROM {facts} JOIN {range_table} r USING (fact_type, code)) WHERE v < low OR v > high
 UNION ALL SELECT fact_id, 'warn', 'unit-mismatch' FROM {facts} JOIN {range_table} r USING (fact_type, code) WHERE value_num IS NOT NULL AND lower(unit) <> lower(want)
 UNION ALL SELECT fact_id, 'warn', 'missing-unit' FROM {facts} WHERE fact_type IN ('lab_result', 'vital_sign') AND value_num IS NOT NULL AND unit IS NULL
 UNION ALL SELECT fact_id, 'blocker', 'fallback-model' FROM {facts} WHERE fallback_model IS NOT NULL
 UNION ALL SELECT fact_id, 'blocker', 'date-in-future' FROM {facts} WHERE effective_on > DATE '2030-01-02'
 UNION ALL SELECT fact_id, 'blocker', 'date-implausible' FROM {facts} WHERE effective_on < DATE '1900-01-01'
 UNION ALL SELECT fact_id, 'warn', 'date-far-from-encounter' FROM {facts} WHERE abs(date_diff('day', period_start, effective_on)) > 400
 UNION ALL SELECT fact_id, 'blocker', 'no-provenance' FROM {facts} WHERE NOT has_provenance
 UNION ALL SELECT fact_id, 'warn', 'weak-evidence' FROM {facts} WHERE has_provenance AND NOT has_span
 UNION ALL SELECT fact_id, 'warn', 'unmapped-concept' FROM {facts} WHERE fact_type IN ('condition', 'medication', 'allergy', 'procedure') AND (code_status IS NULL OR code_status IN ('unmapped', 'local_only'))
 UNION ALL SELECT fact_id, 'blocker', 'med-no-dose' FROM {facts} WHERE fact_type = 'medication' AND dose_num IS NULL AND strength_num IS NULL
 UNION ALL SELECT fact_id, 'blocker', 'med-no-frequency' FROM {facts} WHERE fact_type = 'medication' AND frequency_per_day IS NULL AND frequency_code IS NULL
 UNION ALL SELECT fact_id, 'blocker', 'med-frequency-implausible' FROM {facts} WHERE fact_type = 'medication' AND NOT (frequency_per_day > 0 AND frequency_per_day <= 6)
 UNION ALL SELECT fact_id, 'blocker', 'med-dose-exceeds-ceiling' FROM (SELECT fact_id, ceiling, CASE WHEN dose_num IS NULL OR dose_num = 0 THEN strength_num ELSE dose_num END * frequency_per_day * CASE coalesce(dose_unit, strength_unit) WHEN 'g' THEN 1000 WHEN 'mcg' THEN 0.001 ELSE 1 END AS mg
 FROM {facts} JOIN {ceiling_table} USING (code) WHERE fact_type = 'medication' AND frequency_per_day <> 0) WHERE mg > ceiling * 1.5""")
fixture("wanted_policy", """SELECT fact_id, CASE WHEN evidence_state IN ('no_reading', 'disagree') THEN 'review' WHEN evidence_state = 'single_engine' AND fact_type IN ('medication', 'lab_result', 'vital_sign', 'investigation_order', 'allergy') THEN 'review'
 WHEN evidence_state = 'page_level' AND fact_type IN ('medication', 'lab_result') THEN 'review' ELSE 'gate' END AS action,
 CASE WHEN fact_type = 'medication' AND evidence_state IN ('page_level', 'single_engine') THEN NULL WHEN fact_type = 'lab_result' AND evidence_state IN ('page_level', 'single_engine') THEN NULL
 WHEN fact_type IN ('vital_sign', 'investigation_order') AND evidence_state = 'single_engine' THEN NULL WHEN evidence_state = 'agree' THEN CASE fact_type WHEN 'medication' THEN 0.92 ELSE 0.9 END WHEN evidence_state = 'page_level' THEN 0.95 WHEN evidence_state = 'single_engine' THEN 0.97 END AS min_conf,
 CASE WHEN (fact_type = 'medication' AND evidence_state IN ('agree', 'page_level', 'single_engine')) OR (fact_type = 'lab_result' AND evidence_state IN ('page_level', 'single_engine')) OR (fact_type IN ('vital_sign', 'investigation_order') AND evidence_state = 'single_engine') THEN fact_type ELSE 'default' END AS scope FROM {facts}""")
fixture("wanted_states", """SELECT fact_id, document_id, conf, n_findings, CASE WHEN n_block > 0 OR partial OR action = 'review' OR (min_conf IS NOT NULL AND conf < min_conf) OR conf < 0.85 OR n_med > 0 THEN 'in_review' WHEN conf >= 0.985 AND n_findings = 0 THEN 'auto_accepted' WHEN conf >= 0.95 THEN 'audited' ELSE 'in_review' END AS state FROM
 (SELECT *, round(greatest(0, least(1, CASE WHEN n_block > 0 THEN least(c, 0.5) WHEN n_warn > 0 THEN least(c, 0.9) ELSE c END)), 3) AS conf FROM
 (SELECT f.fact_id, document_id, partial, action, min_conf, coalesce(confidence, 0) - CASE WHEN partial THEN 0.3 ELSE 0 END AS c, coalesce(n_block, 0) AS n_block, coalesce(n_warn, 0) AS n_warn, coalesce(n_findings, 0) AS n_findings, CASE WHEN fact_type = 'medication' THEN coalesce(n_med, 0) ELSE 0 END AS n_med
 FROM {facts} f JOIN {wanted_policy} p ON p.fact_id = f.fact_id LEFT JOIN (SELECT fact_id, count(*) FILTER (WHERE severity = 'blocker') AS n_block, count(*) FILTER (WHERE severity = 'warn') AS n_warn, count(*) AS n_findings, count(*) FILTER (WHERE code LIKE 'med-%') AS n_med FROM {wanted_findings} GROUP BY 1) n ON n.fact_id = f.fact_id))""")


@query("SELECT fact_id, severity, code FROM {wanted_findings}")
def fact_findings(t: Tables):
    """Every finding of every fact."""
    return R.findings(t.facts, F.to_date(F.lit(AS_OF))).select("fact_id", F.explode("findings").alias("f")).select("fact_id", "f.severity", "f.code")


@query("SELECT fact_id, action, CAST(min_conf AS DOUBLE) AS min_conf, scope FROM {wanted_policy}")
def fact_policy(t: Tables):
    """P20: the policy's action, least confidence and scope."""
    return R.policy(t.facts).select("fact_id", "action", "min_conf", "scope")


@query("""SELECT fact_id, CASE WHEN fact_type = 'condition' AND evidence_state = 'agree' THEN 'review' WHEN evidence_state = 'printed' AND fact_type <> 'condition' THEN 'gate' ELSE action END AS action,
 CAST(CASE WHEN fact_type = 'condition' AND evidence_state = 'agree' THEN NULL WHEN evidence_state = 'printed' THEN 0.99 ELSE min_conf END AS DOUBLE) AS min_conf FROM {facts} JOIN {wanted_policy} USING (fact_id)""")
def policy_overlay(t: Tables):
    """The default policy under a site's overrides."""
    return R.policy(t.facts, [("condition", "agree", "review", None), (None, "printed", "gate", 0.99)]).select("fact_id", "action", "min_conf")


@query("SELECT fact_id, CAST(conf AS DOUBLE) AS conf, n_findings, state FROM {wanted_states}")
def fact_gate(t: Tables):
    """Findings, policy, confidence and gate of each fact."""
    return R.validate(t.facts, F.to_date(F.lit(AS_OF))).select("fact_id", "conf", F.size("findings").cast("long").alias("n_findings"), "state")


@query("""SELECT document_id, count(DISTINCT w.fact_id) AS n_held, CASE WHEN count(*) FILTER (WHERE f.code LIKE 'med-%') > 0 THEN 'dose_check' WHEN count(*) FILTER (WHERE f.code IN ('value-out-of-range', 'date-in-future', 'date-implausible')) > 0 THEN 'low_confidence'
 WHEN count(*) FILTER (WHERE f.code = 'unmapped-concept') > 0 THEN 'unmapped_terminology' ELSE 'low_confidence' END AS kind FROM {wanted_states} w LEFT JOIN {wanted_findings} f ON f.fact_id = w.fact_id WHERE state = 'in_review' GROUP BY 1""")
def review_tasks(t: Tables):
    """One task a document with held facts, its kind by the gravest finding."""
    return R.review_tasks(R.validate(t.facts, F.to_date(F.lit(AS_OF)))).select("document_id", "n_held", "kind")


@query("""SELECT fact_id, coalesce(list_extract(['no_reading', 'disagree', 'single_engine', 'page_level', 'agree', 'printed', 'legacy'], min(list_position(['no_reading', 'disagree', 'single_engine', 'page_level', 'agree', 'printed', 'legacy'], state))), 'legacy') AS evidence_state FROM {fact_lines} GROUP BY 1""")
def worst_evidence(t: Tables):
    """The worst known state of a fact's lines."""
    return t.fact_lines.groupBy("fact_id").agg(F.collect_list("state").alias("s")).select("fact_id", R.worst_state(F.col("s")).alias("evidence_state"))


@query("""SELECT patient_id, a.fact_id AS left_id, b.fact_id AS right_id, CASE WHEN a.value_num IS NOT NULL AND b.value_num IS NOT NULL AND abs(a.value_num - b.value_num) > 1e-6 THEN 'value_mismatch' ELSE 'duplicate' END AS kind,
 CASE WHEN a.value_num IS NOT NULL AND b.value_num IS NOT NULL AND abs(a.value_num - b.value_num) > 1e-6 THEN 'blocker' ELSE 'info' END AS severity
 FROM {facts} a JOIN {facts} b USING (patient_id, fact_type, code, effective_on) WHERE a.fact_id < b.fact_id AND ((a.value_num IS NOT NULL AND b.value_num IS NOT NULL) OR (coalesce(a.value_num, 0) = 0 AND coalesce(b.value_num, 0) = 0))""")
def fact_conflicts(t: Tables):
    """Mismatches and duplicates among one patient's facts of a day; a missing value against a known one is neither."""
    return R.conflicts(t.facts)


@query("SELECT review_state IS NOT NULL AND review_state IN ('auto_accepted', 'clinician_confirmed', 'corrected') AND is_current AS is_governed, count(*) AS n FROM {facts} GROUP BY 1")
def governed_split(t: Tables):
    """Governed facts and those held; an unknown state is held."""
    return t.facts.groupBy(R.governed(F.col("review_state"), F.col("is_current")).alias("is_governed")).agg(F.count("*").alias("n"))


@query("""SELECT fact_id, CASE WHEN count(state) FILTER (WHERE state IN ('printed', 'agree')) > 0 THEN 1 ELSE 0 END::BIGINT AS strong, CAST(least(min(CASE state WHEN 'printed' THEN 1.0 WHEN 'agree' THEN 0.98 WHEN 'page_level' THEN 0.55 WHEN 'single_engine' THEN 0.6 WHEN 'disagree' THEN 0.3 WHEN 'no_reading' THEN 0.0 ELSE 0.5 END), coalesce(min(CASE WHEN line_no > 0 THEN 0.5 + line_no / 5.0 END), 0.5)) AS DOUBLE) AS conf FROM {fact_lines} GROUP BY 1""")
def capped_confidence(t: Tables):
    """Confidence capped by the state of a line and the engines' own (.5 if none tells one)."""
    lines = t.fact_lines.withColumn("engine", F.when(F.col("line_no") > 0, 0.5 + F.col("line_no") / 5))
    cap = R.capped(F.col("state"), F.array(F.lit(9.0)))
    own = F.coalesce(F.min("engine"), F.lit(0.5))
    return lines.groupBy("fact_id").agg(F.max(F.when(F.col("state").isin("printed", "agree"), 1).otherwise(0)).cast("long").alias("strong"), F.least(F.min(cap), own).alias("conf"))


@query("SELECT document_id, CASE WHEN bool_or(coalesce(nullif(confidence, 0), 1) < 0.85) THEN 'urgent' ELSE 'routine' END AS priority, count(*) AS n FROM {facts} WHERE is_current GROUP BY 1")
def task_priorities(t: Tables):
    """Z38 at a limit of .85: urgent if any confidence is lower; missing ones and 0 count as 1."""
    low = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)) < 0.85
    return t.facts.where("is_current").groupBy("document_id").agg(F.when(F.bool_or(low), "urgent").otherwise("routine").alias("priority"), F.count("*").alias("n"))


@query("""SELECT document_id, CASE WHEN bool_or(state = 'error' OR fallback) THEN 'failed' WHEN n_review > 0 THEN 'needs_review' WHEN n = n_done THEN 'accepted' ELSE 'partial' END AS status FROM
 (SELECT document_id, 'x' AS state, bool_or(fallback_model IS NOT NULL) AS fallback, count(*) AS n, count(*) FILTER (WHERE review_state = 'in_review') AS n_review, count(*) FILTER (WHERE review_state IN ('auto_accepted', 'corrected')) AS n_done FROM {facts} GROUP BY 1) GROUP BY document_id, n, n_review, n_done""")
def document_status(t: Tables):
    """A document's status from its facts'."""
    g = t.facts.groupBy("document_id").agg(F.bool_or(F.col("fallback_model").isNotNull()).alias("bad"), F.count("*").alias("n"), F.count_if(F.col("review_state") == "in_review").alias("r"), F.count_if(F.col("review_state").isin("auto_accepted", "corrected")).alias("d"))
    return g.select("document_id", F.when(F.col("bad"), "failed").when(F.col("r") > 0, "needs_review").when(F.col("n") == F.col("d"), "accepted").otherwise("partial").alias("status"))


@query("SELECT fact_id, code, unit FROM {facts} WHERE fact_id = 60")
def point_read(t: Tables):
    """One row by its key; the filter reaches the scan."""
    return t.facts.where("fact_id = 60").select("fact_id", "code", "unit")


@query("SELECT block_id, page_id, reading_order, y0, x0 FROM {blocks} WHERE document_id = 7 ORDER BY page_id, reading_order NULLS LAST, block_id")
def child_read(t: Tables):
    """A document's blocks in reading order, unnumbered ones last."""
    return t.blocks.where("document_id = 7").orderBy("page_id", F.asc_nulls_last("reading_order"), "block_id").select("block_id", "page_id", "reading_order", "y0", "x0")


@query("SELECT f.fact_id, f.fact_type FROM {facts} f WHERE f.document_id IN (SELECT document_id FROM {blocks} WHERE ocr_conf < 0.1)")
def semi_join_read(t: Tables):
    """Facts of documents in a list of ids, as a semi join."""
    return t.facts.join(t.blocks.where("ocr_conf < 0.1").select("document_id"), "document_id", "left_semi").select("fact_id", "fact_type")


def tasks(t: Tables, status: str | None = None, doctor: int | None = None, kind: str | None = None):
    """Rows under those filters that are given; a missing one is no filter."""
    out = t.runs
    for name, value in (("status", status), ("document_id", doctor), ("stage", kind)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


@query("SELECT run_id, stage FROM {runs} WHERE status = 'error' AND (stage = 'extract' OR 'extract' IS NULL) AND (CAST(NULL AS BIGINT) IS NULL OR document_id = NULL)")
def dynamic_filters(t: Tables):
    """Optional predicates, decided before the plan is made."""
    return tasks(t, status="error", kind="extract").select("run_id", "stage")


@query(r"SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%r#0000000!_1%' ESCAPE '!' OR c_name ILIKE '%R#00000000%' ESCAPE '!' OR c_name LIKE 'Customer#00000001%'")
def text_search(t: Tables):
    """Contains whatever the case, with the marks of patterns taken as they are; begins with."""
    from quillmark.operators.relational import contains_text

    n = F.col("c_name")
    return t.customer.where(contains_text(n, "r#0000000_1") | contains_text(n, "R#00000000") | n.startswith("Customer#00000001")).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE regexp_replace(c_name, '[^0-9]', '', 'g') = '000000042' OR c_custkey = 7 OR lower(c_name) = lower('CUSTOMER#000000009')")
def any_key_lookup(t: Tables):
    """A person by any of several keys, numbers compared by their digits."""
    return t.customer.where((F.regexp_replace("c_name", "[^0-9]", "") == "000000042") | (F.col("c_custkey") == 7) | (F.lower("c_name") == "customer#000000009")).select("c_custkey")


@query("SELECT event_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS local_day, CAST(ts + INTERVAL 330 MINUTE AS DATE) = CAST((SELECT max(ts) FROM events) + INTERVAL 330 MINUTE AS DATE) AS same_day FROM events")
def local_day(t: Tables):
    """The day in Kolkata (always five and a half hours ahead), and whether it is that of the newest event."""
    local = lambda c: F.to_date(F.from_utc_timestamp(F.col(c).cast("timestamp"), "Asia/Kolkata"))
    end = t.events.agg(F.max("ts").alias("as_of"))
    return t.events.crossJoin(F.broadcast(end)).select("event_id", local("ts").alias("local_day"), (local("ts") == local("as_of")).alias("same_day"))  # one row


@query("SELECT DISTINCT fact_id, code, CASE WHEN code LIKE '%-%' THEN 'LOINC' WHEN code IS NOT NULL THEN 'SNOMED' END AS system, CASE WHEN code LIKE '%-%' THEN code END AS out_code, CASE WHEN code LIKE '%-%' THEN code_status ELSE 'local_only' END AS out_status FROM {facts} WHERE code IS NOT NULL")
def licensed_codes(t: Tables):
    """Codes of systems without a licence are masked; the text stays."""
    from quillmark.operators.relational import licensed_only

    system = F.when(F.col("code").contains("-"), "LOINC").otherwise("SNOMED")
    f = t.facts.where("code is not null").withColumn("system", system)
    return licensed_only(f.withColumn("out_code", F.col("code")).withColumn("out_status", F.col("code_status")), "system", ["out_code"], "out_status", ["LOINC", "UCUM"]).select("fact_id", "code", "system", "out_code", "out_status")


@query("""SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, s.s_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON s.s_suppkey = o.o_orderkey % 200""")
def record_view(t: Tables):
    """A record with the names of its dimensions; rows without one stay."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return o.join(t.supplier, F.col("s_suppkey") == F.col("o_orderkey") % 200, "left").select("o_orderkey", "c_name", "n_name", "r_name", "s_name")


@query("SELECT document_id, n_open, n_open = 0 AS closed FROM (SELECT document_id, count(*) FILTER (WHERE review_state = 'in_review') AS n_open FROM {facts} GROUP BY 1)")
def open_facts(t: Tables):
    """Open facts of a task; it closes at none."""
    g = t.facts.groupBy("document_id").agg(F.count_if(F.col("review_state") == "in_review").alias("n_open"))
    return g.withColumn("closed", F.col("n_open") == 0)


@query("""SELECT page_id, round(coalesce(avg(ocr_conf), 0.5), 6) AS conf, round(0.5 * (0.8 + coalesce(avg(ocr_conf), 0.5)), 6) AS fused, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {blocks} GROUP BY 1""")
def evidence_boxes(t: Tables):
    """Mean confidence of a fact's blocks (.5 without any), fused with the extraction's; the box around them."""
    conf = F.coalesce(F.avg("ocr_conf"), F.lit(0.5))
    return t.blocks.groupBy("page_id").agg(F.round(conf, 6).alias("conf"), F.round(0.5 * (0.8 + conf), 6).alias("fused"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])


@query("SELECT block_id, row_number() OVER (PARTITION BY page_id ORDER BY floor((y0 + y1) / 2.0::DOUBLE / (0.7::DOUBLE * h)), x0, block_id) AS line_no FROM (SELECT *, list_extract(list_sort(list(y1 - y0) OVER (PARTITION BY page_id)), CAST(floor(count(*) OVER (PARTITION BY page_id) / 2.0) AS BIGINT) + 1) AS h FROM {blocks})")
def reading_order(t: Tables):
    """Bands of .7 of the upper median height, then from left to right."""
    page = Window.partitionBy("page_id")
    h = F.element_at(F.sort_array(F.collect_list(F.col("y1") - F.col("y0")).over(page)), (F.floor(F.count("*").over(page) / 2) + 1).cast("int"))
    b = t.blocks.withColumn("h", h).withColumn("band", F.floor((F.col("y0") + F.col("y1")) / 2 / (0.7 * F.col("h"))))
    return b.select("block_id", F.row_number().over(page.orderBy("band", "x0", "block_id")).cast("long").alias("line_no"))


@query("SELECT block_id, row_number() OVER (PARTITION BY document_id ORDER BY page_id, reading_order NULLS LAST, block_id) AS ordinal, 'b' || row_number() OVER (PARTITION BY document_id ORDER BY page_id, reading_order NULLS LAST, block_id) AS label, 'Page ' || dense_rank() OVER (PARTITION BY document_id ORDER BY page_id) AS page FROM {blocks}")
def block_labels(t: Tables):
    """Labels b1 to bN in order, and page names."""
    doc = Window.partitionBy("document_id")
    n = F.row_number().over(doc.orderBy("page_id", F.asc_nulls_last("reading_order"), "block_id"))
    return t.blocks.select("block_id", n.cast("long").alias("ordinal"), F.concat(F.lit("b"), n).alias("label"), F.concat(F.lit("Page "), F.dense_rank().over(doc.orderBy("page_id"))).alias("page"))


@query("""SELECT a.block_id AS inner_id, b.block_id AS outer_id FROM {blocks} a JOIN {blocks} b ON a.page_id = b.page_id AND a.block_id <> b.block_id AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0)""")
def boxes_inside(t: Tables):
    """Boxes of a page of which at least half the area is inside another."""
    from quillmark.operators.layout import inside

    return inside(t.blocks, "page_id", "block_id", 0.5)


@query("""WITH RECURSIVE edges AS (SELECT a.block_id AS x, b.block_id AS y FROM {blocks} a JOIN {blocks} b ON a.page_id = b.page_id AND a.block_id <> b.block_id JOIN (SELECT page_id, least(60, greatest(12, median(y1 - y0))) AS h FROM {blocks} GROUP BY 1) m ON m.page_id = a.page_id
 WHERE greatest(a.y1 - a.y0, b.y1 - b.y0) <= 3 * h AND abs((a.y0 + a.y1) - (b.y0 + b.y1)) / 2.0 <= 1.6 * h AND greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) <= 3 * h),
 walk AS (SELECT block_id AS node, block_id AS seen FROM {blocks} UNION SELECT w.node, e.y FROM walk w JOIN edges e ON e.x = w.seen) SELECT node AS block_id, min(seen) AS group_id FROM walk GROUP BY 1""")
def proximity_groups(t: Tables):
    """Blocks near each other are linked, links make groups (the smallest block names one)."""
    from quillmark.operators.layout import near
    from quillmark.operators.relational import components

    links = near(t.blocks, "page_id", "block_id")
    return components(links, t.blocks.select("block_id")).select(F.col("node").alias("block_id"), F.col("label").alias("group_id"))
