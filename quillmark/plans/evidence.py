"""Binding, evidence tiers, checks, clusters, decisions and results against stated results and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import clinical as C
from quillmark.functions import linkage as L
from quillmark.functions import text as X
from quillmark.operators import evidence as E
from quillmark.operators import linking as K
from quillmark.operators import rules as R
from quillmark.plans import linkage  # noqa: F401  (its fixtures)
from quillmark.plans.registry import Tables, cases, fixture, query, values



def listed(c: str):
    return F.filter(F.split(c, r"\|"), lambda x: x != "")


values("terms", "domain STRING, term STRING, code STRING, unit STRING", [("lab", "hba1c", "4548-4", "%"), ("lab", "creatinine", "2160-0", "mg/dL"), ("vital", "pulse", "8867-4", "/min"), ("drug", "telmisartan", "395892000", None), ("condition", "hypertension", "38341003", None), ("allergen", "milk", "3718001", None)])
cases("term_binding", "C2, J15, F25: facts bound to terms as written or alike; units as codes.", "kind STRING, s STRING, u STRING", "code STRING, status STRING, unit STRING, confidence DOUBLE", [
    ("lab_result", "HbA1c", "", "4548-4", "bound", "%", 0.9), ("lab_result", "HBALC", "%", "4548-4", "bound", "%", 0.9), ("lab_result", "Creatinin", "MG/DL", "2160-0", "bound", "mg/dL", 0.9), ("lab_result", "Unknown", "u/l", None, "local_only", "U/L", 0.4), ("vital_sign", "Pulse", "bpm", "8867-4", "bound", "/min", 0.9),
    ("medication", "Tab Telmisartan 40mg", None, "395892000", "bound", None, 0.9), ("condition", "Hypertention", None, "38341003", "bound", None, 0.9), ("allergy", "milk", None, "3718001", "bound", None, 0.9), ("condition", "milk", None, None, "local_only", None, 0.4), ("condition", "", None, None, "local_only", None, 0.4),
], lambda d: E.bind(d.select(F.col("id").alias("fact_id"), F.col("kind").alias("fact_type"), F.col("s").alias("name"), F.col("u").alias("unit")), Tables(d.sparkSession, "").terms).select(F.col("fact_id").alias("id"), "code", F.col("code_status").alias("status"), "unit", "confidence"))


def _interpreted(d):
    r = d.select(F.col("id").alias("reading_id"), E.reading_text(F.col("s"), F.col("v")).alias("reading"), F.lit("drug").alias("domain"), F.lit(7).cast("bigint").alias("doctor"))
    c = K.alias_candidates(r, Tables(d.sparkSession, "").aliases)
    status = K.plausibility(F.when(F.col("concept").startswith("telma"), F.array(F.lit("cardiac"))), F.array(F.lit("spine")))
    best = K.rerank(c.withColumn("status", status), "reading_id", "status", "score", "concept").where("place = 1")
    picked = best.select(F.col("reading_id").alias("id"), "concept", "level", "status", (~F.col("collision")).alias("selected"))
    return d.select("id").join(picked, "id", "left")


cases("interpretations", "C3, Z14, Z15, W9: a reading's candidates in the document's context; the first is selected unless several collide.", "s STRING, v DOUBLE", "concept STRING, level BIGINT, status STRING, selected BOOLEAN", [
    ("Telma", 40.0, "telma-40", 1, "mismatch", True), ("Telma 40", 20.0, "telma-40", 1, "mismatch", True), ("Pan", 40.0, "pan-40", 1, "unknown", True), ("T40", None, "telma-40", 1, "mismatch", True), ("Xyz", None, None, None, None, None), ("Dolo", 650.5, None, None, None, None),
], _interpreted)


def _tiers(d):
    v = E.grounded_values(F.col("kind"), F.col("drug"), F.col("strength"), F.col("freq"), F.col("num"))
    f = E.tier_findings(F.col("state"), F.col("kind"), v, listed("lines"), F.col("coll"), F.col("level"), F.col("unres"), F.col("plaus"), C.strength_marketed(F.col("strength"), F.array(F.lit(20.0), F.lit(40.0))))
    return d.select("id", F.array_join(F.transform(f, lambda x: F.concat(x.severity, F.lit(":"), x.code)), ",").alias("found"))


cases("evidence_tiers", "C4, Z13: findings of readings, page, candidates, context and strength.", "kind STRING, state STRING, drug STRING, strength DOUBLE, freq STRING, num DOUBLE, lines STRING, coll BOOLEAN, level BIGINT, unres BOOLEAN, plaus STRING", "found STRING", [
    ("medication", "agree", "Telma", 40.0, "1-0-1", None, "Tab Telma 4O 1-0-1", False, 1, False, "fits", ""), ("medication", "disagree", "Telma", 20.0, "OD", None, "Tab Telma 40", False, 3, False, "mismatch", "blocker:engine-disagreement,blocker:grounding-failed,warn:med-fuzzy-resolution,blocker:med-indication-mismatch"),
    ("medication", "single_engine", "Zzz", 30.0, None, None, "Tab Telma 30", True, None, False, "unknown", "warn:single-engine,warn:med-grounding-weak,blocker:candidate-collision,blocker:med-strength-not-marketed"), ("lab_result", "page_level", None, None, None, 7.5, "HbA1c 7.5 %", False, None, True, None, "warn:page-level-evidence,warn:unresolved-reading"),
    ("lab_result", "no_reading", None, None, None, 8.0, "", False, None, False, "mismatch", "blocker:no-reading,warn:indication-mismatch"), ("condition", "printed", None, None, None, None, "x", False, 3, False, None, "warn:fuzzy-resolution"),
], _tiers)

cases("identity_checks", "C6, P24, Z11: identity fields against the page; what a person must look at.", "name STRING, phone STRING, sex STRING, age_text STRING, dob STRING, abha STRING, reg_no STRING, page STRING", "items STRING, statuses STRING", [
    ("Mita Bose", "+91 98111-00022", "F", "36", "12-03-1990", "", "12345", "Mita Bose 36 / F ph 9811100022 DOB 12-03-1990 Reg 12345", "", "checked,checked,checked,checked,checked,absent,checked"),
    ("Mita Bose", "5811100022", "M", "42 y", "12-03-1990", "12 3456 7890 1234", "", "Mita Bose 42 y 12-03-1990", "phone,sex,age,dob,abha", "checked,needs_check,needs_check,needs_check,needs_check,needs_check,absent"),
    ("Someone Else", "", "", "200", "31-02-1990", "", "999", "Mita Bose 200", "name,age,dob,reg", "needs_check,absent,absent,needs_check,needs_check,absent,needs_check"), ("", None, None, None, None, None, None, "x", "", "absent,absent,absent,absent,absent,absent,absent"),
], lambda d: E.field_checks(d, "page", F.to_date(F.lit("2026-10-06"))).select("id", F.array_join(E.review_items(d, ["name", "phone", "sex", "age", "dob", "abha", "reg"]), ",").alias("items"), F.concat_ws(",", *[F.col(f"{f}_check.status") for f in ("name", "phone", "sex", "age", "dob", "abha", "reg")]).alias("statuses")))


@query("""SELECT block_id, CASE kind WHEN 'strong' THEN 'exact' WHEN 'marker' THEN 'marker' WHEN 'weak' THEN 'beside' ELSE 'near' END AS why FROM (SELECT *, count(*) FILTER (WHERE kind = 'strong') OVER w AS s, count(*) FILTER (WHERE kind = 'marker') OVER w AS m, count(*) FILTER (WHERE kind = 'weak') OVER w AS k, count(*) FILTER (WHERE kind = 'near') OVER w AS n FROM
 (SELECT block_id, page_id, CASE block_id % 7 WHEN 0 THEN 'strong' WHEN 1 THEN 'marker' WHEN 2 THEN 'near' ELSE 'weak' END AS kind FROM {blocks}) WINDOW w AS (PARTITION BY page_id)) WHERE kind IN ('strong', 'marker') OR (kind = 'weak' AND s + n + m >= 1) OR (kind = 'near' AND s + m + k + n - 1 >= 1)""")
def test_clusters(t: Tables):
    """Weak and near hits only beside others of their group."""
    b = F.col("block_id") % 7
    return E.clustered(t.blocks.select("block_id", "page_id", F.when(b == 0, "strong").when(b == 1, "marker").when(b == 2, "near").otherwise("weak").alias("kind")), "page_id").select("block_id", "why")


cases("line_labels", "Z9: kinds of lines by coverage, confidence and strokes.", "cov DOUBLE, conf DOUBLE, stroke DOUBLE", "label STRING", [(0.9, 0.95, 0.3, "printed"), (0.9, 0.95, 0.5, "mixed"), (0.1, 0.2, None, "handwritten"), (0.4, 0.9, 0.1, "mixed"), (0.9, 0.5, 0.1, "uncertain"), (0.1, 0.9, None, "uncertain"), (0.7, 0.9, None, "printed")], lambda d: d.select("id", E.line_label(F.col("cov"), F.col("conf"), F.col("stroke")).alias("label")))

cases("name_choices", "Z24: which reading of a name is shown.", "s STRING, reads STRING", "name STRING", [
    ("Nilo Haldar", "Nilu Haldar|Nilu Haldar|Nilu Haldar|X Y", "Nilu Haldar"), ("", "Mita Bose", "Mita Bose"), ("Ghosh Medical", "Mita Bose|Ketan Vyas", "Mita Bose"), ("Mita Bose", "", "Mita Bose"), ("Mita Bose", "Mita Bose Ghoshal", "Mita Bose Ghoshal"), ("null", "", None),
], lambda d: d.select("id", L.over(E.name_choice, "string")("s", listed("reads")).alias("name")))

values("lab_aliases", "alias STRING, canonical STRING", [("TSH", "Thyrotropin"), ("Lipid profile", "Lipid panel"), ("Vitamin D", "25-OH vitamin D"), ("Vitamin K", "Vitamin K")])
values("national_labs", "alias STRING, canonical STRING", [("Lipase", "Lipase"), ("TSH", "TSH national")])


def _labs(d):
    t = Tables(d.sparkSession, "")
    found = E.lab_lookup(d.select("id", "s"), "id", "s", [("mapping", t.lab_aliases), ("national", t.national_labs)])
    return found.join(E.wildcard_fit(d, "id", "s", t.lab_aliases).withColumnRenamed("canonical", "fit"), "id", "left")


cases("lab_resolution", "M12, M6, Z29, Z30: written tests by the site's mapping, the national list, or a reading with unread letters.", "s STRING", "canonical STRING, how STRING, fit STRING", [
    ("tsh", "Thyrotropin", "mapping", None), ("S. Lipase", "Lipase", "national", None), ("LIPIDPROFILE", "Lipid panel", "mapping", None), ("Serum TSH", "Thyrotropin", "mapping", None), ("vitam?? D", None, None, "25-OH vitamin D"), ("vitamin ?", None, None, None), ("x?", None, None, None), ("zzz", None, None, None), ("", None, None, None),
], _labs)


@query("""SELECT coalesce(s.k, o.k) AS k, coalesce(o.v, s.v) AS v FROM (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 3 <> 0) s FULL JOIN (SELECT p_partkey AS k, p_type AS v, p_partkey % 4 <> 0 AS enabled FROM part WHERE p_partkey % 2 = 0) o ON o.k = s.k WHERE coalesce(enabled, TRUE)""")
def overlay_rows(t: Tables):
    """A seed under a site's rows; what is switched off is gone."""
    seed = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    own = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v"), (F.col("p_partkey") % 4 != 0).alias("enabled"))
    return E.overlay(seed, own, "k")


values("lab_readings", "form_no BIGINT, s STRING", [(0, "lipas"), (1, "ts")])
values("lab_names", "name STRING", [("lipase",), ("tsh",), ("trop t",), ("lh",), ("t4",)])


@query("SELECT form_no, place, name, score FROM (VALUES (0, 1, 'lipase', 0.909091::DOUBLE), (1, 1, 'tsh', 0.8::DOUBLE), (1, 2, 't4', 0.5::DOUBLE)) v(form_no, place, name, score)")
def lab_suggestions(t: Tables):
    """The most alike names; of two alike the greater comes first."""
    return E.suggestions(t.lab_readings, "form_no", "s", t.lab_names, "name")


values("view_reads", "doc_id BIGINT, view_no BIGINT, name STRING", [(1, 1, "creatinine"), (1, 2, "creatinin"), (1, 2, "tsh"), (1, 3, "tsh"), (1, 3, "creatinine"), (2, 1, "fbs"), (2, 1, "bloodsugarfbs"), (2, 2, "bloodsugarppbs")])


@query("SELECT * FROM (VALUES (1, 'creatinine', 3), (1, 'creatinin', 3), (1, 'tsh', 2), (2, 'fbs', 1), (2, 'bloodsugarfbs', 1), (2, 'bloodsugarppbs', 1)) v(doc_id, name, support)")
def view_support(t: Tables):
    """In how many views of a page a test was read."""
    return E.view_support(t.view_reads, "doc_id", "view_no", "name")


cases("licence_states", "P27, Z47: software licences, and why a component blocks a release.", "s STRING, decision STRING", "state STRING, problem STRING", [
    ("MIT", None, "allowed", None), ("GPL-3.0", None, "banned", "banned"), ("LGPL v2.1", "approved", "review", None), ("MIT or GPL-3.0", "approved", "banned", None), ("MIT OR MPL 2.0", None, "allowed", None), ("Apache-2.0 AND MPL-2.0", None, "review", "needs a decision"), ("weird", "rejected", "unknown", "rejected"), ("", None, "unknown", "needs a decision"), (None, "proposed", "unknown", None), ("BSD, Apache", None, "allowed", None),
], lambda d: d.select("id", E.licence_state(F.col("s")).alias("state"), E.licence_problem(E.licence_state(F.col("s")), F.col("decision")).alias("problem")))

cases("upload_checks", "P28, F18: what is wrong with an upload; safe file names.", "n BIGINT, size BIGINT, mime STRING, token STRING, phone STRING, name STRING, s STRING", "errors STRING, shown STRING", [
    (1, 100, "image/png", "A-12", "+91 98111 00022", "Mita Bose", "a/b/scan.png", "", "scan.png"), (0, 0, "image/png", "", "98111", "M", "", "no file,token,phone,name", "document"), (11, 100, "text/html", "bad token", "09811100022", "O'Neil D.", "x.pdf", "too many files,file type,token", "x.pdf"),
    (1, 99000000, "application/pdf", "T1", "919811100022", "1 Bose", "C:/y.pdf", "file too large,name", "y.pdf"), (1, 5, "image/jpeg", None, None, None, None, "token,phone,name", "document"),
], lambda d: d.select("id", F.array_join(E.upload_errors(F.when(F.col("n") == 0, F.array().cast("array<struct<size:bigint,mime:string>>")).otherwise(F.array_repeat(F.struct("size", "mime"), F.col("n").cast("int"))), F.col("token"), F.col("phone"), F.col("name")), ",").alias("errors"), E.safe_file_name(F.col("s")).alias("shown")))

SIGNALS = [("lab_report", 4, "reference range"), ("lab_report", 3, "specimen"), ("prescription", 4, r"\brx\b"), ("prescription", 3, r"\btab\b"), ("operative_note", 5, "surgeon")]
PAD = " and more plain words of a page that was read well" * 4
cases("page_types", "A31, Z33: kinds of pages by weighted wordings with a lead; misread notes.", "s STRING, k STRING", "kind STRING, confidence DOUBLE, fixed STRING", [
    ("Specimen serum reference range" + PAD, "lab_report", "lab_report", 0.92, "lab_report"), ("Rx tab one" + PAD, "operative_note", "prescription", 0.92, "prescription"), ("Rx" + PAD, "x", None, None, "x"), ("rx tab specimen reference range" + PAD, "x", None, None, "x"), ("Specimen reference range", "x", None, None, "x"),
    ("surgeon rx tab" + PAD, "operative_note", None, None, "operative_note"), ("Specimen reference range " + "#%! " * 120, "x", None, None, "x"),
], lambda d: d.select("id", E.classified(F.col("s"), SIGNALS).alias("c"), E.overridden_type(F.col("k"), F.col("s"), "surgeon", r"\brx\b").alias("fixed")).select("id", "c.kind", "c.confidence", "fixed"))


@query("""SELECT fact_id, CASE fact_id % 9 WHEN 0 THEN 'clinician_confirmed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'corrected' ELSE review_state END AS review_state, CASE WHEN fact_id % 9 = 2 AND fact_id % 2 = 0 THEN 1.5 ELSE value_num END AS value_num FROM {facts}""")
def review_decisions(t: Tables):
    """Facts after decisions; a correction without a value keeps the proposal."""
    k = F.col("fact_id") % 9
    d = t.facts.where(k < 3).select("fact_id", F.when(k == 0, "accept").when(k == 1, "reject").otherwise("correct").alias("action"), F.when(F.col("fact_id") % 2 == 0, 1.5).alias("value"))
    return E.decided(t.facts, d).select("fact_id", "review_state", "value_num")


@query("""SELECT fact_id, CASE review_state WHEN 'auto_accepted' THEN 'auto_accepted' ELSE 'reviewer' END AS method, code, CAST(value_num AS DOUBLE) AS value, strftime(effective_on, '%Y-%m-%d') AS day FROM {facts} WHERE is_current AND review_state IN ('auto_accepted', 'corrected')""")
def ledger_values(t: Tables):
    """Governed values as JSON in the ledger, read back."""
    g = E.ledger_rows(t.facts.where(R.governed(F.col("review_state"), F.col("is_current"))))
    v = g.withColumn("v", F.from_json("governed_value", "code string, value_num double, effective_on string"))
    return v.select("fact_id", "method", "v.code", F.col("v.value_num").alias("value"), F.col("v.effective_on").alias("day"))


@query("""SELECT CASE fact_type WHEN 'condition' THEN 'cn_condition' WHEN 'lab_result' THEN 'cn_lab_result' WHEN 'vital_sign' THEN 'cn_observation' WHEN 'procedure' THEN 'cn_procedure' WHEN 'allergy' THEN 'cn_allergy' WHEN 'medication' THEN 'cn_medication' ELSE 'cn_order' END AS target, patient_id, count(*) AS n, count(code) AS coded, min(fact_id) AS first_fact
 FROM {facts} WHERE is_current AND review_state IN ('auto_accepted', 'corrected') GROUP BY ALL""")
def canonical_rows(t: Tables):
    """Governed facts promoted to the canonical tables."""
    p = E.promoted(t.facts.where(R.governed(F.col("review_state"), F.col("is_current"))))
    return p.groupBy("target", "patient_id").agg(F.count("*").alias("n"), F.count("code").alias("coded"), F.min("fact_id").alias("first_fact"))


@query("""SELECT document_id, CASE WHEN count(*) FILTER (WHERE review_state IS NULL OR review_state = 'in_review') > 0 THEN 'needs_review' ELSE 'accepted' END AS status, count(*) FILTER (WHERE fact_type = 'medication') AS medications, count(*) FILTER (WHERE fact_type = 'vital_sign' AND review_state IN ('auto_accepted', 'corrected')) AS vitals_accepted FROM {facts} WHERE is_current GROUP BY 1""")
def result_documents(t: Tables):
    """One result JSON per document, read back."""
    r = E.results(t.facts.where("is_current"))
    v = r.withColumn("v", F.from_json("result", "status string, medications array<struct<fact_id:bigint>>, vitals array<struct<status:string>>"))
    return v.select("document_id", "v.status", F.size("v.medications").cast("long").alias("medications"), F.size(F.filter("v.vitals", lambda x: x.status == "accepted")).cast("long").alias("vitals_accepted"))


@query("""SELECT o_orderkey, (['Mita Bose', 'Ketan Vyas', 'Nilu Haldar', 'Asha Sen'])[d1 % 4 + 1] AS name, (['Telma', 'Pan', 'Dolo'])[d2 % 3 + 1] || ' ' || CASE WHEN d4 % 5 = 0 THEN replace((['20', '40', '650'])[d3 % 3 + 1], '0', 'O') ELSE (['20', '40', '650'])[d3 % 3 + 1] END AS shown, CASE WHEN d4 % 5 = 0 THEN 'misread' ELSE 'clean' END AS kind FROM
 (SELECT o_orderkey, ('0x' || left(md5(o_orderkey || '-7-1'), 6))::BIGINT AS d1, ('0x' || left(md5(o_orderkey || '-7-2'), 6))::BIGINT AS d2, ('0x' || left(md5(o_orderkey || '-7-3'), 6))::BIGINT AS d3, ('0x' || left(md5(o_orderkey || '-7-4'), 6))::BIGINT AS d4 FROM orders)""")
def synthetic_cases(t: Tables):
    """C14: labelled cases from a seed."""
    return E.synthetic(t.orders, "o_orderkey").select("o_orderkey", "name", "shown", "kind")


cases("salvaged_json", "F37: answers cut off or wrapped in words, as JSON.", "s STRING", "whole STRING", [
    ('Here: {"a": 1} thanks', '{"a":1}'), ('{"a": [1, 2, 3', '{"a":[1,2,3]}'), ('{"a": "x", "b": "cut off he', '{"a":"x"}'), ('{"a": {"b": 1}, "c": ', '{"a":{"b":1}}'), ("no json", None), ("", None), ('{"a": [{"b": 1}, {"c"', '{"a":[{"b":1}]}'), ("}{", "{}"), ('{"a": "}"}', '{"a":"}"}'),
], lambda d: d.select("id", L.over(E.salvaged, "string")("s").alias("whole")))


@query("""SELECT n_name AS brand, count(DISTINCT p_type) AS n_generics, min(p_type) AS first_generic FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) l ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def brand_chain(t: Tables):
    """Brand to product to generic, the generics collected."""
    l = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    j = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).join(l, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    g = j.groupBy(F.col("n_name").alias("brand")).agg(F.collect_set("p_type").alias("g"))
    return g.select("brand", F.size("g").cast("long").alias("n_generics"), F.array_min("g").alias("first_generic"))


@query("SELECT event_type AS name, n.id FROM (SELECT DISTINCT event_type FROM events) e LEFT JOIN (SELECT lower(k) AS k, min(id) AS id FROM (VALUES ('VIEW', 7), ('view', 5), ('Click', 9)) v(k, id) GROUP BY 1) n ON n.k = lower(e.event_type)")
def find_or_create(t: Tables):
    """Dimension rows by their lower-cased name, the smallest id of several; null: to be created."""
    known = t.sql("SELECT k, CAST(id AS BIGINT) AS id FROM (VALUES ('VIEW', 7), ('view', 5), ('Click', 9)) AS v(k, id)").groupBy(F.lower("k").alias("k")).agg(F.min("id").alias("id"))
    return t.events.select(F.col("event_type").alias("name")).distinct().join(known, F.lower("name") == F.col("k"), "left").select("name", "id")


@query("""SELECT f.fact_id, count(l.line_no) AS n_lines, string_agg(coalesce(l.state, '?'), ',' ORDER BY l.line_no) AS states FROM {facts} f LEFT JOIN {fact_lines} l ON l.fact_id = f.fact_id WHERE f.fact_type = 'medication' GROUP BY 1""")
def fact_details(t: Tables):
    """Facts with their lines of evidence nested, in order."""
    l = t.fact_lines.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("state", F.lit("?")).alias("state")))).alias("lines"))
    f = t.facts.where("fact_type = 'medication'").join(l, "fact_id", "left")
    return f.select("fact_id", F.size("lines").cast("long").alias("n_lines"), F.array_join(F.transform("lines", lambda x: x.state), ",").alias("states"))


@query("SELECT doctor_id, original, corrected, count(*) AS verified, max(ts) AS newest, row_number() OVER (PARTITION BY doctor_id ORDER BY count(*) DESC, original, corrected) AS place FROM {corrections} GROUP BY 1, 2, 3")
def doctor_lexicon(t: Tables):
    """A doctor's corrections, the most often verified first."""
    from pyspark.sql.window import Window

    g = t.corrections.groupBy("doctor_id", "original", "corrected").agg(F.count("*").alias("verified"), F.max("ts").alias("newest"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("doctor_id").orderBy(F.desc("verified"), "original", "corrected")).cast("long"))


fixture("page_quality", "SELECT event_id, CAST(floor(event_id / 4.0) AS BIGINT) AS document_id, event_id % 4 + 1 AS page_no, CASE WHEN event_id % 3 = 0 THEN 'blurred' WHEN event_id % 5 = 0 THEN 'dark' END AS reason FROM {events}")


@query("SELECT document_id, coalesce(string_agg('page ' || page_no || ': ' || reason, '; ' ORDER BY page_no), '') AS reasons, count(reason) > 0 AS held FROM {page_quality} GROUP BY 1")
def quality_holds(t: Tables):
    """Reasons of each page with its number, and whether the document is held."""
    r = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("page_no", "reason"))))
    g = t.page_quality.groupBy("document_id").agg(r.alias("r"))
    return g.select("document_id", F.array_join(F.transform("r", lambda x: F.concat(F.lit("page "), x.page_no, F.lit(": "), x.reason)), "; ").alias("reasons"), (F.size("r") > 0).alias("held"))


@query("SELECT fact_id, unit FROM {facts} WHERE unit IS NOT NULL AND lower(unit) NOT IN ('%', 'mg/dl') AND fact_type = 'lab_result'")
def pending_lookup(t: Tables):
    """Entries without an exact hit in the dictionary, which wait for a person."""
    known = t.terms.select(F.lower("unit").alias("u")).where("u is not null and u <> '/min'").distinct()
    f = t.facts.where("unit is not null and fact_type = 'lab_result'").withColumn("u", F.lower("unit"))
    return f.join(known, "u", "left_anti").select("fact_id", "unit")


cases("accepted_choices", "Z32, Z42: a choice counts only if it was offered and is alike; a confirmed name keeps what was read.", "s STRING, offered STRING, reading STRING", "accepted BOOLEAN, kept STRING", [
    ("Telma", "Telma|Telmikind", "Telmo", True, "Telmo"), ("Pan", "Telma", "Pan", False, "Pan"), ("Telma", "Telma", "xyz", False, "xyz"), ("Telma", "Telma", None, False, "Telma"),
], lambda d: d.select("id", (F.array_contains(listed("offered"), F.col("s")) & (L.over(L.alike, "double")("s", "reading") >= 0.5)).alias("accepted"), F.coalesce("reading", "s").alias("kept")))


@query("SELECT sha256(CASE WHEN doc_id % 2 = 0 THEN 'tenant-a:' || text ELSE text END) AS content_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def scoped_hashes(t: Tables):
    """F36, ST3: a content's hash, within a scope if there is one."""
    scope = F.when(F.col("doc_id") % 2 == 0, "tenant-a")
    h = F.sha2(F.concat_ws(":", scope, "text"), 256)
    return t.documents.where("text is not null").groupBy(h.alias("content_hash")).agg(F.count("*").alias("n"))


cases("number_repairs", "F10, F38, F39: numbers read alike, and labels of evidence as ids.", "s STRING, labels STRING", "nums STRING, ids STRING", [("Telma 4O", "b1|b9", "40", "block-1"), ("SOS", "", "", ""), ("l0O", "b2|b1", "0", "block-2|block-1")], lambda d: d.select("id", F.array_join(X.numbers_repaired(F.col("s")), ",").alias("nums"), F.array_join(F.array_compact(F.transform(listed("labels"), lambda x: F.element_at(F.create_map(F.lit("b1"), F.lit("block-1"), F.lit("b2"), F.lit("block-2")), x))), "|").alias("ids")))
