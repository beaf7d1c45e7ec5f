"""The rule engine: findings, evidence states, policy, gate and conflicts.

A finding is a struct (severity, code).  Rules are expressions over a fact's columns; tables of ranges, ceilings and
policies are fixed values, met by broadcast joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import clinical as C

#: Plausible ranges by fact type and code.
RANGES = [
    ("lab_result", "4548-4", 2.0, 20.0, "%"), ("lab_result", "1558-6", 20.0, 800.0, "mg/dL"), ("lab_result", "2345-7", 20.0, 1500.0, "mg/dL"), ("lab_result", "2160-0", 0.1, 25.0, "mg/dL"),
    ("lab_result", "3094-0", 2.0, 400.0, "mg/dL"), ("lab_result", "2093-3", 30.0, 600.0, "mg/dL"), ("lab_result", "2089-1", 10.0, 500.0, "mg/dL"), ("lab_result", "2085-9", 5.0, 200.0, "mg/dL"),
    ("lab_result", "2571-8", 10.0, 5000.0, "mg/dL"), ("lab_result", "1742-6", 1.0, 5000.0, "U/L"), ("lab_result", "1920-8", 1.0, 5000.0, "U/L"), ("lab_result", "3016-3", 0.001, 500.0, "m[IU]/L"),
    ("lab_result", "1975-2", 0.05, 60.0, "mg/dL"), ("lab_result", "718-7", 2.0, 25.0, "g/dL"), ("lab_result", "777-3", 2.0, 2000.0, "10*3/uL"), ("lab_result", "6690-2", 0.1, 200.0, "10*3/uL"),
    ("vital_sign", "8480-6", 50.0, 300.0, "mm[Hg]"), ("vital_sign", "8462-4", 20.0, 200.0, "mm[Hg]"), ("vital_sign", "8867-4", 20.0, 250.0, "/min"), ("vital_sign", "9279-1", 4.0, 80.0, "/min"),
    ("vital_sign", "8310-5", 30.0, 45.0, "Cel"), ("vital_sign", "59408-5", 40.0, 100.0, "%"), ("vital_sign", "29463-7", 0.5, 400.0, "kg"), ("vital_sign", "8302-2", 20.0, 260.0, "cm"),
    ("vital_sign", "39156-5", 5.0, 120.0, "kg/m2"), ("vital_sign", "72514-3", 0.0, 10.0, "{score}"),
]
#: Daily ceilings in mg by substance.
CEILINGS = [
    ("372567009", 3000.0), ("386864001", 20.0), ("373444002", 80.0), ("395892000", 80.0), ("373567002", 100.0), ("395807002", 8.0),
    ("387458008", 4000.0), ("387517004", 4000.0), ("395728002", 80.0), ("387137007", 80.0), ("710809001", 0.5),
]
#: Evidence states from worst to best.
STATES = ("no_reading", "disagree", "single_engine", "page_level", "agree", "printed", "legacy")
#: The default policy by fact type (null: all others) and evidence state: action and least confidence.
POLICY = [
    (None, "printed", "gate", None), (None, "legacy", "gate", None), (None, "agree", "gate", 0.90), (None, "page_level", "gate", 0.95), (None, "single_engine", "gate", 0.97), (None, "disagree", "review", None), (None, "no_reading", "review", None),
    ("medication", "agree", "gate", 0.92), ("medication", "page_level", "review", None), ("medication", "single_engine", "review", None), ("lab_result", "page_level", "review", None), ("lab_result", "single_engine", "review", None),
    ("vital_sign", "single_engine", "review", None), ("investigation_order", "single_engine", "review", None),
]
#: Fact types whose single reading always goes to a person.
SINGLE_REVIEW = ("medication", "lab_result", "vital_sign", "investigation_order", "allergy")
TERMINOLOGY_TYPES = ("condition", "medication", "allergy", "procedure")
#: Caps of confidence by evidence state.
STATE_CAPS = {"printed": 1.0, "agree": 0.98, "page_level": 0.55, "single_engine": 0.6, "disagree": 0.3, "no_reading": 0.0}
HANDWRITING = ("engine-disagreement", "no-reading", "single-engine", "grounding-failed", "page-level-evidence", "candidate-collision")


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table, small by its definition here."""
    return F.broadcast(spark.createDataFrame(rows, schema).coalesce(1))


def finding(severity: str, code: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))


def _some(*rules: tuple[Column, str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), finding(s, k)) for c, s, k in rules]))


def range_rule() -> Column:
    """P12, over value_num, unit, code, low, high, want_unit (the last three null without a range)."""
    unit, v = F.trim(F.coalesce("unit", F.lit(""))), F.col("value_num")
    hot = (F.col("code") == "8310-5") & ((v > 45) | unit.rlike(r"(?i)\bF\b|fahrenheit"))
    real = F.when(hot, C.celsius(v)).otherwise(v)
    known = v.isNotNull() & F.col("low").isNotNull()
    return _some(
        (known & hot, "info", "unit-normalized"), (known & ((real < F.col("low")) | (real > F.col("high"))), "blocker", "value-out-of-range"),
        (known & (unit != "") & (F.lower(unit) != F.lower("want_unit")), "warn", "unit-mismatch"),
    )


def unit_rule() -> Column:
    """P13."""
    return _some((F.col("fact_type").isin("lab_result", "vital_sign") & F.col("value_num").isNotNull() & (F.trim(F.coalesce("unit", F.lit(""))) == ""), "warn", "missing-unit"))


def medication_rule() -> Column:
    """P14, over dose_num, dose_unit, strength_num, strength_unit, frequency_per_day, frequency_code, ceiling."""
    med = F.col("fact_type") == "medication"
    fpd = F.col("frequency_per_day")
    dose = F.coalesce(F.nullif("dose_num", F.lit(0.0)), "strength_num")
    per_day = C.to_milligrams(dose * fpd, F.coalesce(F.nullif("dose_unit", F.lit("")), "strength_unit"))
    return _some(
        (med & F.col("dose_num").isNull() & F.col("strength_num").isNull(), "blocker", "med-no-dose"), (med & fpd.isNull() & (F.coalesce("frequency_code", F.lit("")) == ""), "blocker", "med-no-frequency"),
        (med & ((fpd <= 0) | (fpd > 6)), "blocker", "med-frequency-implausible"), (med & (fpd != 0) & (per_day > F.col("ceiling") * 1.5), "blocker", "med-dose-exceeds-ceiling"),
    )


def date_rule(as_of: Column) -> Column:
    """P15, over effective_on and period_start (days)."""
    t = F.col("effective_on")
    return _some(
        (t > F.date_add(as_of, 1), "blocker", "date-in-future"), (F.year(t) < 1900, "blocker", "date-implausible"),
        (F.abs(F.datediff(t, "period_start")) > 400, "warn", "date-far-from-encounter"),
    )


def evidence_rule() -> Column:
    """P16, over has_provenance and has_span (null without provenance)."""
    has = F.coalesce("has_provenance", F.lit(False))
    return _some((~has, "blocker", "no-provenance"), (has & ~F.coalesce("has_span", F.lit(False)), "warn", "weak-evidence"))


def terminology_rule() -> Column:
    """P16."""
    return _some((F.col("fact_type").isin(*TERMINOLOGY_TYPES) & F.coalesce("code_status", F.lit("unmapped")).isin("unmapped", "local_only"), "warn", "unmapped-concept"))


def fallback_rule() -> Column:
    """Z10, over fallback_model: whatever a fallback model read goes to a person."""
    return _some((F.col("fallback_model").isNotNull(), "blocker", "fallback-model"))


def with_tables(facts: DataFrame) -> DataFrame:
    """Adds low, high, want_unit and ceiling of the fixed tables."""
    spark = facts.sparkSession
    ranges = small(spark, RANGES, "fact_type string, code string, low double, high double, want_unit string")
    return facts.join(ranges, ["fact_type", "code"], "left").join(small(spark, CEILINGS, "code string, ceiling double"), "code", "left")


def findings(facts: DataFrame, as_of: Column) -> DataFrame:
    """Adds findings, an array of (severity, code) of all rules."""
    rules = (range_rule(), unit_rule(), fallback_rule(), date_rule(as_of), evidence_rule(), terminology_rule(), medication_rule())
    return with_tables(facts).withColumn("findings", F.concat(*rules)).drop("low", "high", "want_unit", "ceiling")


def worst_state(states: Column) -> Column:
    """The worst known state of an array; legacy if none is known."""
    order = F.transform(F.filter(states, lambda s: s.isin(*STATES)), lambda s: F.array_position(F.array(*[F.lit(x) for x in STATES]), s))
    return F.coalesce(F.element_at(F.array(*[F.lit(x) for x in STATES]), F.array_min(order).cast("int")), F.lit("legacy"))


def policy_table(spark: SparkSession, overrides: list[tuple] | None = None) -> list[tuple]:
    """The default policy under overrides of (fact_type or null, state, action, least confidence)."""
    merged = {(t, s): (a, m) for t, s, a, m in POLICY} | {(t, s): (a, m) for t, s, a, m in overrides or []}
    return [(*k, *v) for k, v in merged.items()]


def policy(facts: DataFrame, overrides: list[tuple] | None = None, state: str = "evidence_state") -> DataFrame:
    """P20: adds action, min_conf and scope: the fact type's own rule, else the default; some states always go to a person."""
    rows = policy_table(facts.sparkSession, overrides)
    own = small(facts.sparkSession, [r for r in rows if r[0]], f"fact_type string, {state} string, own_action string, own_conf double")
    default = small(facts.sparkSession, [r[1:] for r in rows if not r[0]], f"{state} string, any_action string, any_conf double")
    j = facts.join(own, ["fact_type", state], "left").join(default, state, "left")
    has = F.col("own_action").isNotNull()
    always = F.col(state).isin("no_reading", "disagree") | ((F.col(state) == "single_engine") & F.col("fact_type").isin(*SINGLE_REVIEW))
    return j.select(
        *facts.columns, F.when(always, "review").otherwise(F.coalesce("own_action", "any_action", F.lit("gate"))).alias("action"),
        F.when(has, F.col("own_conf")).otherwise(F.col("any_conf")).alias("min_conf"), F.when(has, F.col("fact_type")).otherwise("default").alias("scope"),
    )


def decide(facts: DataFrame) -> DataFrame:
    """Adds conf and state, from findings, partial, action, min_conf, confidence."""
    has = lambda s: F.exists("findings", lambda f: f.severity == s)
    out = facts.withColumn("conf", C.calibrate(F.col("confidence"), F.col("partial"), has("blocker"), has("warn")))
    review = (F.col("action") == "review") | F.coalesce(F.col("conf") < F.col("min_conf"), F.lit(False))
    med = (F.col("fact_type") == "medication") & F.exists("findings", lambda f: f.code.startswith("med-"))
    return out.withColumn("state", C.gate(F.col("conf"), has("blocker"), F.col("partial"), review, F.size("findings"), med))


def validate(facts: DataFrame, as_of: Column, overrides: list[tuple] | None = None) -> DataFrame:
    """C5 up to the gate: findings, policy, confidence and state of each fact."""
    return decide(policy(findings(facts, as_of), overrides))


def dominant_kind(codes: Column) -> Column:
    """The kind of a review task from the codes of all its findings."""
    any_of = lambda c: F.exists(codes, c)
    return (
        F.when(any_of(lambda c: c.isin(*HANDWRITING)), "handwriting").when(any_of(lambda c: c.startswith("med-")), "dose_check")
        .when(any_of(lambda c: c.isin("value-out-of-range", "date-in-future", "date-implausible")), "low_confidence").when(any_of(lambda c: c == "unmapped-concept"), "unmapped_terminology").otherwise("low_confidence")
    )


def review_tasks(decided: DataFrame) -> DataFrame:
    """C5's tasks: of each document with held facts, the kind and the facts in order."""
    held = decided.where("state = 'in_review'").groupBy("document_id").agg(F.array_sort(F.collect_list("fact_id")).alias("fact_ids"), F.flatten(F.collect_list(F.transform("findings", lambda f: f.code))).alias("codes"))
    return held.select("document_id", dominant_kind(F.col("codes")).alias("kind"), F.size("fact_ids").cast("long").alias("n_held"), "fact_ids")


def governed(state: Column, current: Column) -> Column:
    """The one definition of a governed fact; a null state is held."""
    return F.coalesce(current & state.isin("auto_accepted", "clinician_confirmed", "corrected"), F.lit(False))


def conflicts(facts: DataFrame, key: str = "fact_id") -> DataFrame:
    """Pairs of facts of one patient, type and code on one day: value_mismatch (blocker) if both values are known and
    differ, duplicate (info) if they are equal or both missing or zero.  Smaller key first; rows without a code or a day
    have no conflicts."""
    own = facts.where("code is not null and effective_on is not null").select(key, "patient_id", "fact_type", "code", "effective_on", "value_num")
    a, b = (own.withColumnsRenamed({key: f"{s}_id", "value_num": f"{s}_value"}) for s in ("left", "right"))
    j = a.join(b, ["patient_id", "fact_type", "code", "effective_on"]).where("left_id < right_id")
    x, y = F.col("left_value"), F.col("right_value")
    none = lambda v: v.isNull() | (v == 0)
    kind = F.when(x.isNotNull() & y.isNotNull() & (F.abs(x - y) > 1e-6), "value_mismatch").when((x == y) | (none(x) & none(y)), "duplicate")
    return j.select("patient_id", "left_id", "right_id", kind.alias("kind"), F.when(kind == "value_mismatch", "blocker").otherwise("info").alias("severity")).where("kind is not null")


def capped(state: Column, engine_confidences: Column) -> Column:
    """Confidence of a line: the least of its state's cap and its engines' (.5 if none is known)."""
    return F.least(F.coalesce(C.lookup(state, STATE_CAPS), F.lit(0.5)), F.coalesce(F.array_min(engine_confidences), F.lit(0.5)))


def task_priority(confidences: Column) -> Column:
    """Urgent if any confidence is under .6; null and 0 count as 1."""
    return F.when(F.exists(confidences, lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0)) < 0.6), "urgent").otherwise("routine")
