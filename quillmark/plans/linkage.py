"""Record linkage and evidence: alikeness of texts against stated results, cascades and candidates against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import linkage as L
from quillmark.functions import text as X
from quillmark.functions.similarity import jaro_winkler_udf, ratio_udf, word_edits_udf
from quillmark.operators import linking as K
from quillmark.plans import records  # noqa: F401
from quillmark.plans.registry import Tables, cases, query, values

SURNAMES = ["Sarkar", "Sansar", "Sankar", "Sen", "Saha", "Ghosh"]


def listed(c: str):
    """The items of a text between bars; none of an empty one."""
    return F.filter(F.split(c, r"\|"), lambda x: x != "")


cases("similarities", "M1, M3, F35: Ratcliff-Obershelp, Jaro-Winkler, edits of letters and of words.", "a STRING, b STRING", "ratio DOUBLE, jw DOUBLE, letters BIGINT, words BIGINT", [
    ("creatinine", "creatine", 0.888889, 0.96, 2, 1), ("kitten", "sitting", 0.615385, 0.746032, 3, 1), ("MARTHA", "MARHTA", 0.833333, 0.961111, 2, 1), ("", "", 1.0, 1.0, 0, 0), ("a b c", "a x c d", 0.666667, 0.832381, 3, 2), ("abc", "", 0.0, 0.0, 3, 1),
], lambda d: d.select("id", F.round(ratio_udf("a", "b"), 6).alias("ratio"), F.round(jaro_winkler_udf("a", "b"), 6).alias("jw"), F.levenshtein("a", "b").cast("long").alias("letters"), word_edits_udf("a", "b").cast("long").alias("words")))

cases("engine_agreement", "M9, J20: two engines' readings of one line.", "a STRING, b STRING, failed BOOLEAN", "state STRING, shown STRING", [
    ("Telma 40 1-0-1", "Telma 4O 1-0-1", False, "agree", "Telma 4O 1-0-1"), ("Telma 40", "Telma 20", False, "disagree", "Telma 40 ⟂ Telma 20"), ("Telma 40", "Telma 40", True, "single_engine", "Telma 40"), ("", "Telma 40", True, "no_reading", ""), (" ", "Pan D", False, "single_engine", "Pan D"), ("Pan D", "Dolo", False, "disagree", "Pan D ⟂ Dolo"),
], lambda d: d.select("id", L.over(lambda a, b, failed: L.compare_engines([{"engine": "vlm", "text": a, "error": None}, {"engine": "trocr", "text": b, "error": "x" if failed else None}]), "state string, shown string")("a", "b", "failed").alias("v")).select("id", "v.state", "v.shown"))

cases("grounding", "M8, U2, W12: whether a value stands on one of the lines read, with its numbers.", "s STRING, lines STRING", "grounded BOOLEAN, likeness DOUBLE, line STRING", [
    ("Telma 40", "Tab Telma 4O 1-0-1", True, 1.0, "Tab Telma 4O 1-0-1"), ("Telma 20", "Tab Telma 40 1-0-1", False, 0.875, "Tab Telma 40 1-0-1"), ("Pan D", "Dolo 650|Pan D 40", True, 1.0, "Pan D 40"), ("", "anything", True, 1.0, None), ("Pan D", "", False, 0.0, None), ("Telma40", "Telma 40", True, 1.0, "Telma 40"),
], lambda d: d.select("id", L.over(L.ground, "grounded boolean, likeness double, line string")("s", listed("lines")).alias("v")).select("id", "v.grounded", "v.likeness", "v.line"))

cases("page_support", "M8, P24: values against the page.", "s STRING, page STRING", "there BOOLEAN", [
    ("Salt Lake 12", "12 Salt Lake, Kolkata", True), ("Salt Lake 13", "12 Salt Lake", False), ("Creatinine", "Serum Creatinin 1.1", True), ("", "x", True), ("of to", "nothing", True), ("Telma 40", "Telma 4O mg", False),
], lambda d: d.select("id", L.over(L.on_page, "boolean")("s", "page").alias("there")))

cases("concept_fit", "M10: readings against a concept's names; numbers must be the same.", "s STRING, names STRING", "fits BOOLEAN", [
    ("Telma 40", "Telma 40|Telmisartan", True), ("Telma 40", "Telma 20", False), ("Telma 40", "Telmisartan tablet", False), ("Dolo", "", True), ("HbA1c", "HbA1c", True),
], lambda d: d.select("id", L.over(L.fits_concept, "boolean")("s", listed("names")).alias("fits")))

cases("name_consensus", "G3, G5, Z24: the name that most readings agree on, and the fuller reading of it.", "lines STRING", "name STRING, votes BIGINT, readings BIGINT, fuller STRING", [
    ("Nilu Haldar|Nilo Haldar|Nilu Haldar|Ketan Vyas", "Nilu Haldar", 3, 4, "Nilu Haldar"), ("Mita Bose|Ketan Vyas", "Mita Bose", 1, 2, "Mita Bose"), ("", None, 0, 0, None), ("Mita Bose|Mita Bose Ghoshal|Mr Mita Bose", "Mita Bose", 2, 3, "Mita Bose Ghoshal"), ("123|..", None, 0, 0, None),
], lambda d: d.select("id", L.over(lambda x: {**(c := L.consensus(x)), "fuller": L.fuller(c["name"], x)}, "name string, votes long, readings long, fuller string")(listed("lines")).alias("v")).select("id", "v.*"))

cases("surnames", "G6, M6: surnames to choose from; a question mark stands for one letter.", "lines STRING", "options STRING", [
    ("San?ar", "Sansar,Sankar,Sarkar,Saha,Sen"), ("Gosh", "Gosh,Ghosh,Saha"), ("xx", ""), ("Sen|Sen?", "Sen"),
], lambda d: d.select("id", F.array_join(L.over(lambda x: L.surname_options(x, SURNAMES), "array<string>")(listed("lines")), ",").alias("options")))

cases("test_pairs", "Z25, M7, M2: same tests, abbreviations one slip away, closest terms.", "a STRING, b STRING", "same BOOLEAN, slip STRING, term STRING", [
    ("creatinine", "creatinin", True, None, "creatinine"), ("fas", "fbs", False, "FBS", None), ("bloodsugarfbs", "bloodsugarppbs", False, None, None), ("fbs", "fbs", True, None, "fbs"), ("apt", "aptt", False, "APTT", None), ("fhs", "fbs", False, "FBS", None), ("tsh", "t3", False, None, "tsh"), ("lipase x", "lipase y", True, None, None),
], lambda d: d.select("id", L.over(L.same_test, "boolean")("a", "b").alias("same"), L.over(lambda w: L.one_slip(w, ("fbs", "aptt", "tsh", "rbs")), "string")("a").alias("slip"), L.over(lambda w: L.close_match(w, ("creatinine", "fbs", "tsh")), "string")("a").alias("term")))

cases("note_targets", "Z28: the tests that a preparation note is for.", "s STRING, applies STRING, tests STRING", "found STRING", [
    ("fasting for all tests", "", "FBS|TSH", "all"), ("fasting", "FBS ", "FBS|TSH", "FBS"), ("no biotin before TSH", "", "FBS|TSH", "TSH"), ("fasting", "xyz", "FBS|TSH", "unclear"), ("early", "all", "FBS", "all"), ("x", "TSHH|TSH", "FBS|TSH", "TSH"),
], lambda d: d.select("id", F.array_join(L.over(L.targets, "array<string>")(listed("applies"), "s", listed("tests")), ",").alias("found")))

cases("doctor_scores", "M4, U5: how surely two names are one doctor's, and whether two may be one person's.", "a STRING, b STRING", "score DOUBLE, person BOOLEAN", [
    ("Dr. A. Lal", "Arup Lal", 0.96, False), ("A Lal", "B Lal", 0.8667, True), ("Lal", "Arup Lal", 0.92, True), ("Roy", "Lal", 0.0, False), ("Dr Mita Bose MBBS", "Mita Bose", 1.0, True), ("", "Lal", 0.0, True), ("Mita Rani Bose", "Bose Mita", None, True), ("Ketan Vyas", "Mita Bose", None, False),
], lambda d: d.select("id", L.over(L.doctor_score, "double")(X.doctor_key(F.col("a")), X.doctor_key(F.col("b"))).alias("score"), L.over(L.names_match, "boolean")(X.person_key(F.col("a")), X.person_key(F.col("b"))).alias("person"), "a").select("id", F.when(~F.col("a").isin("Mita Rani Bose", "Ketan Vyas"), F.col("score")).alias("score"), "person"))

values("doctor_masters", "id BIGINT, reg STRING, name STRING, alias_list STRING, word_list STRING", [(1, "23451", "Dr. Arup Lal", "Dr. A. Lal", "General Medicine"), (2, "WB45678", "Dr. Amit Lal", "", "Cardiology"), (3, "777", "Dr. Bimal Roy", "", "Skin")])
DOCTORS = [
    ("Dr. A. Lal", "23451", "", 1, "registration_no", 0.99, True), ("Dr A Lal", "", "", None, "printed_name", 0.89, False), ("Dr Bimal Roy", None, "SKIN clinic", 3, "printed_name", 1.0, True), ("Dr Bimal Roy", "", "", 3, "printed_name", 0.97, True),
    ("Xyz Qqq", "", "", None, "unknown", 0.0, False), ("", "", "Reg. No. 777", 3, "registration_no", 0.99, True), ("Dr X Das", "WB-45678", "", 2, "registration_no", 0.9, True),
]


def _doctors(t):
    m = Tables(t.sparkSession, "").doctor_masters
    masters = m.select("id", "reg", "name", listed("alias_list").alias("aliases"), listed("word_list").alias("words"))
    return K.match_doctors(t.select(F.col("id").alias("doc_id"), "name", "reg", "header"), masters).withColumnRenamed("doc_id", "id")


cases("doctor_match", "J18, M4, Z17: doctors linked to the master list by number, name and specialty; ambiguous ones are not.", "name STRING, reg STRING, header STRING", "practitioner_id BIGINT, method STRING, confidence DOUBLE, linked BOOLEAN", DOCTORS, _doctors)

values("known_people", "person_id BIGINT, health_id STRING, key_ STRING, born_year BIGINT", [(1, "H1", "mita bose", 1980), (2, None, "ketan chowdhury", 1975), (3, None, "rita ghoshal", 1990), (4, None, "rita ghoshal", 1960)])
PEOPLE = [
    ("H1", "someone else", None, 1, "health_id", 1.0), (None, "ketan chowdhuri", 1975, 2, "name", 0.933333), (None, "ketan chowdhuri", 1976, 2, "name", 0.933333), (None, "ketan chowdhuri", 1980, None, "new", None), (None, "rita ghoshal", 1960, 4, "name", 1.0),
    (None, "rita ghoshal", None, 3, "name", 1.0), ("H9", "", None, None, "new", None), (None, "bose mita", None, None, "new", None),
]


def _people(t):
    known = Tables(t.sparkSession, "").known_people
    out = K.resolve_identity(t.select(F.col("id").alias("cand_id"), "health_id", "key_", "born_year"), known)
    return out.select(F.col("cand_id").alias("id"), "matched", "how", F.round("score", 6).alias("score"))


cases("identity_resolution", "J16, J17: the health id decides, else the most alike name; birth years far apart count against it.", "health_id STRING, key_ STRING, born_year BIGINT", "matched BIGINT, how STRING, score DOUBLE", PEOPLE, _people)

values("aliases", "concept STRING, alias STRING, domain STRING, alias_class STRING, doctor BIGINT", [("telma-40", "Telma 40", "drug", "A", None), ("telma-20", "Telma 20", "drug", "A", None), ("telmikind-40", "Telmikind 40", "drug", "B", None), ("telma-40", "T40", "drug", "C", 7), ("pan-40", "Pan 40", "drug", "A", None), ("pan-d", "Pan D", "drug", "A", None), ("pan-t", "Pan T", "drug", "B", None), ("telma", "Telma 40", "lab", "A", None)])
READINGS = [("Telma 40", 1, "telma-40", 1, 1.0, False), ("Tab Telma 40 mg", 1, "telma-40", 2, 0.97, False), ("Telma4O", 1, "telma-40", 3, 0.8312, False), ("Telma 30", 1, None, None, None, None), ("T40", 7, "telma-40", 1, 1.0, False), ("T40", 8, None, None, None, None), ("", 1, None, None, None, None), ("Pan X", 1, None, None, None, None), ("Pan-D", 1, "pan-d", 2, 0.97, False)]


def _aliases(t):
    r = t.select(F.col("id").alias("reading_id"), F.col("s").alias("reading"), F.lit("drug").alias("domain"), "doctor")
    best = K.alias_candidates(r, Tables(t.sparkSession, "").aliases).where("rank_no = 1").select(F.col("reading_id").alias("id"), "concept", "level", "score", "collision")
    return t.select("id").join(best, "id", "left")


cases("alias_cascade", "W7, W8, Z16, J15: a reading's best concept: as written, by key, or alike with the same numbers.", "s STRING, doctor BIGINT", "concept STRING, level BIGINT, score DOUBLE, collision BOOLEAN", READINGS, _aliases)

values("phones", "phone BIGINT, name STRING, n BIGINT", [(9811100022, "Ketan Vyas", 3), (9811100022, "Ketan Vyass", 1), (9811100033, "Ketan Vyas", 1), (9811100022, "Mita Bose", 1), (9811100044, None, 2), (9811100044, "", 1)])
values("phone_groups", "phone BIGINT, name STRING, n BIGINT", [(9811100022, "Ketan Vyas", 4), (9811100033, "Ketan Vyas", 1), (9811100022, "Mita Bose", 1), (9811100044, "", 3)])


@query("SELECT phone, name, n FROM {phone_groups}")
def phone_names(t: Tables):
    """Names read for one phone in greedy groups, the most read first."""
    return K.greedy_names(t.phones, "phone", "name", "n")


values("complaints", "doc_id BIGINT, text STRING, drug_groups STRING", [(1, "Low back-pain since 2 days", "spine"), (2, "lumbar strain", "cardiac"), (3, "fever", "pain_fever"), (4, "nothing", "cardiac"), (5, "paint allergy", "spine")])
values("complaint_groups", "doc_id BIGINT, found STRING, status STRING", [(1, "spine", "fits"), (2, "spine", "mismatch"), (3, "fever", "fits"), (4, "", "unknown"), (5, "", "unknown")])
values("group_words", "code STRING, word_list STRING", [("spine", "back pain|lumbar"), ("fever", "fever"), ("cardiac", "chest pain")])


@query("SELECT doc_id, found, status FROM {complaint_groups}")
def context_plausibility(t: Tables):
    """Indication groups named by whole phrases, and whether the drug fits them."""
    groups = K.context_groups(t.complaints, "doc_id", "text", t.group_words.select("code", listed("word_list").alias("keywords")))
    j = t.complaints.join(groups, "doc_id")
    return j.select("doc_id", F.array_join("groups", ",").alias("found"), K.plausibility(listed("drug_groups"), F.col("groups")).alias("status"))


@query("""SELECT reading, concept, row_number() OVER (PARTITION BY reading ORDER BY CASE status WHEN 'fits' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, score DESC, concept) AS place FROM
 (SELECT p_brand AS reading, p_partkey AS concept, floor(p_retailprice) AS score, CASE p_size % 3 WHEN 0 THEN 'fits' WHEN 1 THEN 'unknown' ELSE 'mismatch' END AS status FROM part)""")
def plausible_first(t: Tables):
    """Candidates re-ranked by plausibility, then score; none is dropped."""
    status = F.when(F.col("p_size") % 3 == 0, "fits").when(F.col("p_size") % 3 == 1, "unknown").otherwise("mismatch")
    c = t.part.select(F.col("p_brand").alias("reading"), F.col("p_partkey").alias("concept"), F.floor("p_retailprice").alias("score"), status.alias("status"))
    return K.rerank(c, "reading", "status", "score", "concept").select("reading", "concept", "place")


@query("""SELECT a.c_name AS a, b.c_name AS b FROM customer a JOIN customer b ON a.c_name < b.c_name AND length(a.c_name) = length(b.c_name) AND levenshtein(a.c_name, b.c_name) <= 1""")
def blocked_fuzzy(t: Tables):
    """Names at most one edit apart, met where they are equal but for one place (all names are of one length, so the SQL may
    ask that); a pair of names gives a row for each pair of customers."""
    pairs = K.edit_pairs(t.customer, "c_name", same_length=True)
    return pairs.select("a", "b", "n_b", F.explode(F.expr("sequence(1L, n_a)"))).select("a", "b", F.explode(F.expr("sequence(1L, n_b)"))).select("a", "b")


@query("""SELECT w.word, coalesce(e.term, f.term) AS term, CASE WHEN e.term IS NOT NULL THEN 'exact' WHEN f.term IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS how FROM (VALUES ('signup'), ('signupp'), ('vieww'), ('erorr'), ('purchase'), ('zzz')) w(word)
 LEFT JOIN (SELECT DISTINCT event_type AS term FROM events) e ON e.term = w.word LEFT JOIN (VALUES ('signupp', 'signup'), ('vieww', 'view')) f(word, term) ON f.word = w.word""")
def dictionary_lookup(t: Tables):
    """Terms as written, else the most alike; `erorr` is under the cutoff."""
    words = t.sql("SELECT word FROM (VALUES ('signup'), ('signupp'), ('vieww'), ('erorr'), ('purchase'), ('zzz')) AS v(word)")
    return K.fuzzy_lookup(words, "word", t.events, "event_type").withColumnRenamed("w", "word")


@query("""SELECT event_id, coalesce(a.id, b.id) AS matched, CASE WHEN a.id IS NOT NULL THEN 'health_id' WHEN b.id IS NOT NULL THEN 'mrn' ELSE 'new' END AS how FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id * 7 END AS health, event_id % 40 AS mrn FROM events) e
 LEFT JOIN (SELECT c_custkey AS health, min(c_custkey) AS id FROM customer GROUP BY 1) a ON a.health = e.health LEFT JOIN (SELECT c_nationkey AS mrn, min(c_custkey) AS id FROM customer GROUP BY 1) b ON b.mrn = e.mrn""")
def cascading_match(t: Tables):
    """Identity by the first key that hits, else a new one."""
    e = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id") * 7).alias("health"), (F.col("event_id") % 40).cast("int").alias("mrn"))
    one, two = t.customer.select(F.col("c_custkey").alias("health"), "c_custkey"), t.customer.select(F.col("c_nationkey").alias("mrn"), "c_custkey")
    return K.cascade(e, [("health_id", one, "health", "c_custkey"), ("mrn", two, "mrn", "c_custkey")]).select("event_id", "matched", "how")


@query("""SELECT o_custkey, m.name, s.sex, round(least(0.99, 0.5 + 0.25 * (avg(CASE WHEN lower(left(o_orderpriority, 1)) = lower(left(m.name, 1)) THEN 1.0 ELSE 0 END) + avg(CASE WHEN o_orderstatus = s.sex THEN 1.0 ELSE 0 END))), 3) AS confidence FROM orders
 JOIN (SELECT o_custkey, arg_max(o_orderpriority, (n, length(o_orderpriority), o_orderpriority)) AS name FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1) m USING (o_custkey)
 JOIN (SELECT o_custkey, arg_max(o_orderstatus, (n, length(o_orderstatus), o_orderstatus)) AS sex FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1) s USING (o_custkey) GROUP BY ALL""")
def merged_identity(t: Tables):
    """The best supported name and sex, and how sure they are."""
    rows = t.orders.select("o_custkey", F.col("o_orderpriority").alias("name"), F.lower(F.substring("o_orderpriority", 1, 1)).alias("key"), F.col("o_orderstatus").alias("sex"))
    return K.merged_identity(rows, "o_custkey", "name", "key", "sex")


@query("SELECT doctor_id, lower(trim(original)) AS raw, min(corrected) AS concept FROM {corrections} GROUP BY 1, 2 HAVING count(DISTINCT corrected) = 1")
def single_concepts(t: Tables):
    """Readings of a doctor for which all corrections agree on one name."""
    return K.only_one(t.corrections.withColumn("raw", F.lower(F.trim("original"))), ["doctor_id", "raw"], "corrected").select("doctor_id", "raw", F.col("corrected").alias("concept"))


@query("SELECT doctor_id, raw, concept, n, n >= 3 AS promoted FROM (SELECT doctor_id, regexp_replace(lower(original), '[^0-9a-z]', '', 'g') AS raw, min(corrected) AS concept, count(*) AS n FROM {corrections} GROUP BY 1, 2 HAVING count(DISTINCT corrected) = 1)")
def lexicon_promotion(t: Tables):
    """Spellings count together; a doctor's own reading becomes an alias after three corrections to one concept."""
    c = t.corrections.withColumn("raw", X.key_alnum(F.col("original")))
    g = c.groupBy("doctor_id", "raw").agg(F.min("corrected").alias("concept"), F.count("*").alias("n"), F.count_distinct("corrected").alias("k")).where("k = 1")
    return g.select("doctor_id", "raw", "concept", "n", (F.col("n") >= 3).alias("promoted"))
