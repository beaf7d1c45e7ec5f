"""Binding, interpretation, evidence tiers, field checks, test clusters, decisions and results (C2-C4, C6, C8, C9, C12, C14, C15, G2, and the Z rows named below)."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import clinical as C
from quillmark.functions import linkage as L
from quillmark.functions import text as X
from quillmark.functions.similarity import ratio_udf
from quillmark.operators.linking import only_one
from quillmark.operators.rules import finding

DOMAINS = {"condition": "condition", "symptom": "symptom", "finding": "symptom", "procedure": "procedure", "lab_result": "lab", "investigation_order": "lab", "vital_sign": "vital", "medication": "drug", "allergy": "allergen"}


def bind(facts: DataFrame, terms: DataFrame, least: float = 0.86) -> DataFrame:
    """Facts (fact_id, fact_type, name, unit) with code, code_status, unit and confidence, by terms (domain, term, code, unit).

    A term as written (normalised) comes first, then the most alike one of the domain with the same first letter (ties: the
    greater); a drug's form words and numbers are left out.  Units become codes, and a missing one is the term's."""
    form = F.array_join(F.filter(F.split(X.lab_text(F.col("name")), " "), lambda w: ~w.isin(*X.FORM_WORDS) & ~w.rlike(r"^[0-9.]+(mg|mcg|g|ml)?$")), " ")
    f = facts.withColumn("domain", C.lookup(F.col("fact_type"), DOMAINS)).withColumn("key_", F.when(F.col("domain") == "drug", form).otherwise(X.lab_text(F.col("name"))))
    t = terms.select("domain", F.col("term").alias("term_"), F.struct("term", "code", F.col("unit").alias("term_unit")).alias("hit_"))
    exact = f.join(t.withColumnRenamed("term_", "key_"), ["domain", "key_"], "left")
    open_ = exact.where("hit_ is null and key_ <> ''").select("fact_id", "domain", "key_")
    j = open_.withColumn("f_", F.substring("key_", 1, 1)).join(t.withColumn("f_", F.substring("term_", 1, 1)), ["domain", "f_"])
    j = j.where((L.bounds(F.col("key_"), F.col("term_")) >= least) & (L.letter_bound(F.col("key_"), F.col("term_")) >= least)).withColumn("s_", ratio_udf("term_", "key_")).where(F.col("s_") >= least)
    near = j.groupBy("fact_id").agg(F.max_by("hit_", F.struct("s_", "term_")).alias("near_"))
    hit = F.coalesce("hit_", "near_")
    out = exact.join(near, "fact_id", "left").withColumn("h_", hit)
    own = F.nullif("unit", F.lit(""))
    return out.select(
        "fact_id", "fact_type", F.col("h_.code").alias("code"), F.when(F.col("h_").isNotNull(), "bound").otherwise("local_only").alias("code_status"),
        F.coalesce(C.unit_code(own), "h_.term_unit").alias("unit"), F.when(F.col("h_").isNotNull(), 0.9).otherwise(0.4).alias("confidence"),
    )


def reading_text(name: Column, strength: Column) -> Column:
    """The text that the alias cascade reads: a name without a digit gets its strength."""
    whole = F.when(strength == F.floor(strength), F.floor(strength).cast("string")).otherwise(strength.cast("string"))
    return F.when(strength.isNotNull() & ~name.rlike("[0-9]"), F.concat_ws(" ", name, whole)).otherwise(name)


def grounded_values(fact_type: Column, drug: Column, strength: Column, frequency: Column, value: Column) -> Column:
    """(label, value) of what the page must support: a drug's name, strength and a frequency with digits; a result's number."""
    plain = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    pair = lambda label, v, c: F.when(c, F.struct(F.lit(label).alias("label"), v.alias("value")))
    med, num = fact_type == "medication", fact_type.isin("lab_result", "vital_sign")
    return F.array_compact(F.array(
        pair("drug_text", drug, med & (F.length(drug) > 0)), pair("strength", plain(strength), med & strength.isNotNull()),
        pair("frequency", F.split(frequency, " ")[0], med & frequency.rlike("[0-9]")), pair("value", plain(value), num & value.isNotNull()),
    ))


def tier_findings(state: Column, fact_type: Column, values: Column, lines: Column, collision: Column, level: Column, unresolved: Column, plausible: Column, marketed: Column) -> Column:
    """C4: findings of the evidence tiers: readings, the page under each value, candidates, context, strength."""
    med = fact_type == "medication"
    ground = L.over(lambda vs, ls: [{"label": v["label"], **{k: x for k, x in L.ground(v["value"], ls).items() if k != "line"}, "number": any(c.isdigit() for c in v["value"]), "fine": any(L.numbers_supported(v["value"], x) for x in (ls if ls is not None else []) if x)} for v in (vs if vs is not None else [])], "array<struct<label:string,grounded:boolean,likeness:double,number:boolean,fine:boolean>>")
    read = F.when(state == "disagree", finding("blocker", "engine-disagreement")).when(state == "no_reading", finding("blocker", "no-reading")).when(state == "single_engine", finding("warn", "single-engine")).when(state == "page_level", finding("warn", "page-level-evidence"))
    weak = F.when(med, finding("warn", "med-grounding-weak")).otherwise(finding("warn", "grounding-weak"))
    on_page = F.transform(ground(values, lines), lambda g: F.when(g.number & ~g.fine, finding("blocker", "grounding-failed")).when(~g.grounded, weak))
    cand = F.when(collision, finding("blocker", "candidate-collision")).when(unresolved, finding("warn", "unresolved-reading")).when(level >= 3, F.when(med, finding("warn", "med-fuzzy-resolution")).otherwise(finding("warn", "fuzzy-resolution")))
    context = F.when(plausible == "mismatch", F.when(med, finding("blocker", "med-indication-mismatch")).otherwise(finding("warn", "indication-mismatch")))
    made = F.when(med & (marketed == F.lit(False)), finding("blocker", "med-strength-not-marketed"))
    return F.array_compact(F.concat(F.array(read), F.when(F.size(lines) > 0, on_page).otherwise(F.array()), F.array(cand, context, made)))


def checked(value: Column, fine: Column, reason: Column | str) -> Column:
    """struct(value, status, reason) of a field: absent, checked or needs_check."""
    v = F.nullif(F.trim(value), F.lit(""))
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(v.alias("value"), F.when(v.isNull(), "absent").when(F.coalesce(fine, F.lit(False)), "checked").otherwise("needs_check").alias("status"), F.when(v.isNotNull() & ~F.coalesce(fine, F.lit(False)), why).alias("reason"))


NOT_THERE = "not found on the page as written"


def field_checks(payload: DataFrame, page: str, today: Column) -> DataFrame:
    """Adds a check of each identity field (name, phone, sex, age_text, dob, abha, reg_no) against the page's text."""
    p = F.col(page)
    there = lambda c: L.over(L.on_page, "boolean")(c, page)
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    tight = X.compact(p)
    phone, abha = X.phone_digits(F.col("phone")), digits("abha")
    sex = F.lower(F.trim("sex"))
    word = F.when(sex.isin("m", "male"), "(m|male)").when(sex.isin("f", "female"), "(f|female)").when(sex.isin("o", "other"), "(o|other)")
    sex_there = F.when(word.isNotNull(), F.expr(f"{page} rlike concat('(?i)(?<![A-Za-z])', case when lower(trim(sex)) in ('m','male') then '(m|male)' when lower(trim(sex)) in ('f','female') then '(f|female)' else '(o|other)' end, '(?![A-Za-z])')"))
    dob, age = C.parse_date_text(F.col("dob")), C.age_of_text(F.col("age_text"))
    dob_fine = dob.isNotNull() & (dob <= today) & (F.year(today) - F.year(dob) <= 120) & F.forall(F.filter(F.regexp_extract_all("dob", F.lit(r"(\d+)"), F.lit(1)), lambda n: F.length(n) >= 2), lambda n: F.array_contains(F.regexp_extract_all(p, F.lit(r"(\d+)"), F.lit(1)), n))
    apart = F.coalesce(dob_fine & (F.abs(C.age_years(dob, today) - age) > 1), F.lit(False))
    return payload.withColumns({
        "name_check": checked(F.col("name"), there("name"), NOT_THERE), "phone_check": checked(F.col("phone"), phone.isNotNull() & F.contains(tight, phone), "not a mobile number on the page"),
        "sex_check": checked(F.col("sex"), sex_there, "sex is not written as such"), "abha_check": checked(F.col("abha"), (F.length(abha) == 14) & F.contains(tight, abha), "not 14 digits on the page"),
        "reg_check": checked(F.col("reg_no"), F.contains(tight, X.compact(F.col("reg_no"))), NOT_THERE), "dob_check": checked(F.col("dob"), dob_fine & ~apart, "not a plausible date on the page"),
        "age_check": checked(F.col("age_text"), age.isNotNull() & (age <= 120) & there("age_text") & ~apart, "not a plausible age on the page"),
    })


def review_items(checks: DataFrame, fields: list[str]) -> Column:
    """Names of the fields that a person must look at."""
    return F.array_compact(F.array(*[F.when(F.col(f"{f}_check.status") == "needs_check", F.lit(f)) for f in fields]))


def clustered(hits: DataFrame, group: str, kind: str = "kind") -> DataFrame:
    """Hits of tests in groups of near lines that stay, with why: strong and marker always, weak beside any other kind, near beside
    any other hit."""
    w = Window.partitionBy(group)
    n = lambda k: F.count_if(F.col(kind) == k).over(w)
    why = F.when(F.col(kind) == "strong", "exact").when(F.col(kind) == "marker", "marker").when((F.col(kind) == "weak") & (n("strong") + n("near") + n("marker") >= 1), "beside").when((F.col(kind) == "near") & (n("strong") + n("marker") + n("weak") + n("near") - 1 >= 1), "near")
    return hits.withColumn("why", why).where("why is not null")


def line_label(coverage: Column, confidence: Column, stroke: Column) -> Column:
    """Printed, handwritten, mixed or uncertain, by what the printed reader covers and how sure it is."""
    return (
        F.when((coverage >= 0.6) & (confidence >= 0.85), F.when(stroke >= 0.42, "mixed").otherwise("printed")).when((coverage < 0.3) & (confidence < 0.6), "handwritten")
        .when((coverage >= 0.3) & (coverage < 0.6), "mixed").otherwise("uncertain")
    )


def name_choice(first: str | None, reads: Sequence[str] | None) -> str | None:
    """The name to show: the readings' consensus if the first is missing or three agree on another; one read by most of the crops; the fuller of them."""
    org = re.compile(rf"\b(?:{X.ORGANISATIONS})\b", re.I)
    first = None if not first or first.casefold() in ("null", "none") or org.search(first) else first
    reads = [r for r in (reads if reads is not None else []) if r and not org.search(r)]
    if not reads:
        return first
    name = first
    won = L.consensus([first or "", *reads])
    if won["name"] and (first is None or (won["votes"] >= 3 and L.name_likeness(first, won["name"]) < 0.85)):
        name = won["name"]
    keys = [k for k in map(L.strict_key, reads) if k]
    top = max(dict.fromkeys(keys), key=keys.count, default=None)
    if top and keys.count(top) >= 2 and 2 * keys.count(top) > len(reads) and top != L.strict_key(name):
        name = next(r for r in reads if L.strict_key(r) == top)
    return L.fuller(name, [*([first] if first else []), *reads])


def lab_key(c: Column, leads: tuple[str, ...] = ("s ", "serum ", "blood ", "plasma ")) -> Column:
    """Forms under which a written test is looked up, in order: as it is, without a leading specimen, without spaces."""
    k = X.words_only(c)
    bare = F.regexp_replace(k, "^(?:" + "|".join(leads) + ")", "")
    flat = F.replace(k, F.lit(" "), F.lit(""))
    return F.array_distinct(F.array_compact(F.array(k, bare, F.when(F.length(flat) >= 6, flat))))


def lab_lookup(rows: DataFrame, key: str, name: str, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each name's standard test by the first table (alias, canonical) that has one of its forms: (key, canonical, how)."""
    forms = rows.select(key, F.posexplode(lab_key(F.col(name))).alias("form_no", "form"))
    hits = None
    for i, (how, t) in enumerate(tables):
        own = t.select(X.words_only(F.col("alias")).alias("form"), "canonical")
        own = own.unionByName(own.select(F.replace("form", F.lit(" "), F.lit("")).alias("form"), "canonical").where("length(form) >= 6")).groupBy("form").agg(F.min("canonical").alias("canonical"))
        one = forms.join(own, "form").select(key, F.struct(F.lit(i).alias("i"), "form_no", "canonical", F.lit(how).alias("how")).alias("h"))
        hits = one if hits is None else hits.unionByName(one)
    best = hits.groupBy(key).agg(F.min("h").alias("h"))
    return rows.select(key).join(best, key, "left").select(key, F.col("h.canonical").alias("canonical"), F.col("h.how").alias("how"))


def overlay(seed: DataFrame, own: DataFrame, key: str, enabled: str = "enabled") -> DataFrame:
    """A seed table under a site's own rows; a row that is switched off takes the seed's away too."""
    values = [c for c in seed.columns if c != key]
    j = seed.select(key, F.struct(*values).alias("s_")).join(own.select(key, F.struct(*values).alias("o_"), enabled), key, "full_outer")
    j = j.where(F.coalesce(enabled, F.lit(True)))
    return j.select(key, *[F.when(F.col("o_").isNotNull(), F.col(f"o_.{c}")).otherwise(F.col(f"s_.{c}")).alias(c) for c in values])


def wildcard_fit(rows: DataFrame, key: str, written: str, names: DataFrame) -> DataFrame:
    """Readings with ? for letters, and the one standard test (alias, canonical) that they fit: four known letters at least, two
    fifths of the characters unread at most; several different tests are none.  Both sides meet by length."""
    k = F.trim(F.regexp_replace(F.regexp_replace(X.fold(F.col(written)), "[^a-z0-9? ]", ""), r"\s+", " "))
    letters, unread = F.length(F.regexp_replace(k, "[^a-z]", "")), F.length(F.regexp_replace(k, r"[^?]", ""))
    r = rows.select(key, k.alias("k_")).where((unread > 0) & (letters >= 4) & (unread <= 0.4 * F.length(F.replace(k, F.lit(" "), F.lit(""))))).withColumn("n_", F.length("k_"))
    n = names.select(X.words_only(F.col("alias")).alias("a_"), "canonical").withColumn("n_", F.length("a_"))
    fits = F.forall(F.sequence(F.lit(1), F.col("n_")), lambda i: (F.substring(F.col("k_"), i, F.lit(1)) == "?") | (F.substring(F.col("k_"), i, F.lit(1)) == F.substring(F.col("a_"), i, F.lit(1))))
    return only_one(r.join(n, "n_").where("n_ > 0").where(fits), [key], "canonical")


def suggestions(readings: DataFrame, key: str, reading: str, names: DataFrame, name: str, k: int = 5, least: float = 0.5) -> DataFrame:
    """The k most alike names of each reading (ties: the greater name), among names with the same first letter; the limit is the feature."""
    r, n = readings.select(key, F.lower(reading).alias("r_")).withColumn("f_", F.substring("r_", 1, 1)), names.select(F.col(name).alias("n_")).distinct().withColumn("f_", F.lower(F.substring("n_", 1, 1)))
    j = r.join(n, "f_").where(L.bounds(F.col("r_"), F.col("n_")) >= least).withColumn("score", F.round(ratio_udf("r_", F.lower("n_")), 6)).where(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("n_")))
    return j.withColumn("place", place.cast("long")).where(F.col("place") <= k).select(key, "place", F.col("n_").alias("name"), "score")


def view_support(reads: DataFrame, key: str, view: str, name: str) -> DataFrame:
    """For each name read in a document the views with the same test: (key, name, support).  A document has few names."""
    own = reads.select(key, view, F.col(name).alias("b_")).distinct()
    names = reads.select(key, F.col(name).alias("a_")).distinct()
    j = names.join(own, key).where(L.over(L.same_test, "boolean")("a_", "b_"))
    return j.groupBy(key, F.col("a_").alias("name")).agg(F.count_distinct(view).alias("support"))


#: Families of software licences: banned ones win, then allowed, then those that need a decision.
BANNED, ALLOWED, REVIEW = r"\bagpl|affero|\bsspl|(?<!l)gpl|commons clause|non-?commercial", r"\bmit\b|\bbsd\b|apache|\bisc\b|python software|\bpsf\b|zlib|unlicense|public domain|0bsd", r"\blgpl|lesser general|\bmpl\b|mozilla|\bepl\b"


def licence_state(licence: Column) -> Column:
    """Banned, allowed, review or unknown: each part of `A and B` must be allowed, of `A or B` one is enough."""
    t = F.lower(F.trim(F.regexp_replace(licence, r"\s+", " ")))
    best = lambda part: F.when(part.rlike(ALLOWED), "allowed").when(part.rlike(REVIEW), "review").otherwise("unknown")
    parts = F.filter(F.transform(F.split(t, r"\band\b|;|,|/"), F.trim), lambda p: p != "")

    def state(p: Column) -> Column:
        branches = F.transform(F.split(p, r"\bor\b"), lambda b: best(F.trim(b)))
        return F.when(F.array_contains(branches, "allowed"), "allowed").when(F.array_contains(branches, "review"), "review").otherwise("unknown")

    states = F.transform(parts, state)
    return F.when(t.isNull() | t.isin("", "unknown"), "unknown").when(t.rlike(BANNED), "banned").when(F.forall(states, lambda s: s == "allowed"), "allowed").when(F.array_contains(states, "unknown"), "unknown").otherwise("review")


def licence_problem(state: Column, decision: Column, strict: bool = False) -> Column:
    """Why a component blocks a release; null if it doesn't."""
    return (
        F.when((state == "banned") & ~F.coalesce(decision == "approved", F.lit(False)), "banned").when(state.isin("review", "unknown") & (F.coalesce(decision, F.lit("none")) == "none"), "needs a decision")
        .when(state.isin("review", "unknown") & (decision == "rejected"), "rejected").when(F.lit(strict) & state.isin("review", "unknown") & (decision == "proposed"), "not yet approved")
    )


def upload_errors(files: Column, token: Column, phone: Column, name: Column, most_files: int = 10, most_bytes: int = 20_000_000) -> Column:
    """What is wrong with an upload: files (size, mime), token, phone, name."""
    phone_ok = F.regexp_replace(F.regexp_replace(F.trim(phone), r"[ \-().]", ""), r"^(?:\+91|91(?=\d{10}$)|0(?=\d{10}$))", "").rlike("^[6-9][0-9]{9}$")
    person = X.squeeze(name)
    name_ok = person.rlike(r"^\p{L}[\p{L}\p{M} .'-]{1,79}$") & (F.length(F.regexp_replace(person, r"[^\p{L}]", "")) >= 2)
    rules = [
        (F.size(files) < 1, "no file"), (F.size(files) > most_files, "too many files"), (F.exists(files, lambda f: f["size"] > most_bytes), "file too large"),
        (F.exists(files, lambda f: ~f.mime.isin("application/pdf", "image/png", "image/jpeg", "image/tiff")), "file type"), (~F.trim(token).rlike(r"^[A-Za-z0-9][A-Za-z0-9\-_/]{0,19}$"), "token"),
        (~phone_ok, "phone"), (~name_ok, "name"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(text)) for c, text in rules]))


def safe_file_name(c: Column, most: int = 120) -> Column:
    """a file name without its path, control and direction characters."""
    base = F.element_at(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    clean = F.regexp_replace(base, "[\\x00-\\x1f\\x7f\u200e\u200f\u202a-\u202e\u2066-\u2069]", "")
    return F.substring(F.when(base == "", "document").otherwise(clean), 1, most)


def classified(text: Column, signals: list[tuple[str, int, str]], least: int = 5, lead: int = 3) -> Column:
    """struct(kind, score, confidence) of a page by weighted wordings; null unless the text is long, legible and one kind leads."""
    low = F.lower(text)
    kinds = list(dict.fromkeys(k for k, _, _ in signals))
    score = {k: sum((F.when(low.rlike(rx), w).otherwise(0) for kind, w, rx in signals if kind == k), F.lit(0)) for k in kinds}
    ranked = F.array_sort(F.array(*[F.struct((-score[k]).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]))
    legible = F.length(F.regexp_replace(low, r"[^\p{L}\p{N}\s]", "")) / F.length(low)
    best, second = -ranked[0].s, -F.coalesce(F.get(ranked, F.lit(1)).s, F.lit(0))
    return F.when((F.length(low) >= 180) & (legible >= 0.75) & (best >= least) & (best - second >= lead), F.struct(ranked[0].k.alias("kind"), best.alias("score"), F.round(F.least(0.72 + 0.04 * best, F.lit(0.92)), 3).alias("confidence")))


def overridden_type(kind: Column, page: Column, signs: str, marks: str) -> Column:
    """An operative note without any word of one, but with a prescription's marks, is a prescription."""
    low = F.lower(page)
    return F.when((kind == "operative_note") & ~low.rlike(signs) & low.rlike(marks), "prescription").otherwise(kind)


def decided(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts after reviewers' decisions (fact_id, action, value): accept, reject, or correct to a value (none: the proposal stays)."""
    d = decisions.select("fact_id", "action", F.col("value").alias("new_"))
    state = F.when(F.col("action") == "accept", "clinician_confirmed").when(F.col("action") == "reject", "rejected").when(F.col("action") == "correct", "corrected").otherwise(F.col("review_state"))
    value = F.when(F.col("action") == "correct", F.coalesce("new_", "value_num")).otherwise(F.col("value_num"))
    return facts.join(d, "fact_id", "left").select(*[state.alias(c) if c == "review_state" else value.alias(c) if c == "value_num" else F.col(c) for c in facts.columns])


def ledger_rows(facts: DataFrame) -> DataFrame:
    """Rows for the ledger of verified facts: the governed value as JSON, nulls left out, fields in order."""
    body = F.to_json(F.struct(F.col("code").alias("code"), F.col("value_num").alias("value_num"), F.col("unit").alias("unit"), F.date_format("effective_on", "yyyy-MM-dd").alias("effective_on")))
    return facts.select("fact_id", "document_id", body.alias("governed_value"), F.when(F.col("review_state") == "auto_accepted", "auto_accepted").otherwise("reviewer").alias("method"))


TABLES = {"condition": "cn_condition", "lab_result": "cn_lab_result", "vital_sign": "cn_observation", "procedure": "cn_procedure", "allergy": "cn_allergy", "medication": "cn_medication", "investigation_order": "cn_order"}


def promoted(facts: DataFrame) -> DataFrame:
    """Governed facts as rows of the canonical tables, each with its provenance: (target, fact_id, patient_id, code, value_num, unit)."""
    return facts.select(C.lookup(F.col("fact_type"), TABLES).alias("target"), "fact_id", "patient_id", "document_id", "code", "value_num", "unit").where("target is not null")


def results(facts: DataFrame) -> DataFrame:
    """One result document per document: facts by kind with their status, in order, and the document's status."""
    status = F.when(F.col("review_state").isin("auto_accepted", "clinician_confirmed", "corrected"), "accepted").when(F.col("review_state") == "rejected", "rejected").otherwise("needs_check")
    item = F.struct("fact_id", F.col("code").alias("code"), F.col("value_num").alias("value"), F.col("unit").alias("unit"), status.alias("status"))
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("fact_type") == kind, item)))
    g = facts.groupBy("document_id").agg(*[pick(k).alias(n) for k, n in (("medication", "medications"), ("investigation_order", "lab_tests"), ("lab_result", "lab_results"), ("vital_sign", "vitals"), ("condition", "diagnoses"))], F.count_if(status == "needs_check").alias("open"))
    whole = F.when(F.col("open") > 0, "needs_review").otherwise("accepted")
    body = F.to_json(F.struct(F.lit("result.v1").alias("schema"), whole.alias("status"), "medications", "lab_tests", "lab_results", "vitals", "diagnoses"))
    return g.select("document_id", whole.alias("status"), body.alias("result"))


def synthetic(ids: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """C14: labelled cases from the hash of an id and a seed: the same on every run and engine: (key, name, drug, strength, shown, kind)."""
    digit = lambda k: F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key), F.lit(seed), F.lit(k))), 1, 6), 16, 10).cast("long")
    of = lambda k, *items: F.element_at(F.array(*[F.lit(x) for x in items]), (digit(k) % len(items) + 1).cast("int"))
    drug, strength = of(2, "Telma", "Pan", "Dolo"), of(3, "20", "40", "650")
    return ids.select(key, of(1, "Mita Bose", "Ketan Vyas", "Nilu Haldar", "Asha Sen").alias("name"), drug.alias("drug"), strength.alias("strength"), F.concat_ws(" ", drug, F.when(digit(4) % 5 == 0, F.translate(strength, "0", "O")).otherwise(strength)).alias("shown"), F.when(digit(4) % 5 == 0, "misread").otherwise("clean").alias("kind"))


def salvaged(text: str | None) -> str | None:
    """the first JSON object in a text, closed where it was cut off; null if there is none."""
    s = text or ""
    at = s.find("{")
    if at < 0:
        return None
    open_, quoted, escaped, cut = [], False, False, []
    for i, c in enumerate(s[at:], at):
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                return None
            if not open_:
                return _compact(s[at : i + 1])
        if c == "," and not quoted:
            cut.append((i, list(open_)))
    for end, closers in [(len(s), list(open_))] * (not quoted) + cut[::-1]:
        if done := _compact(s[at:end].rstrip(", \n\t:") + "".join(reversed(closers))):
            return done
    return None


def _compact(s: str) -> str | None:
    try:
        return json.dumps(json.loads(s), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None
