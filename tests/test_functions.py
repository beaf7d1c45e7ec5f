from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import clinical as C
from quillmark.functions import linkage as L
from quillmark.functions import orders as O
from quillmark.functions import similarity as S
from quillmark.functions import text as X

WORDS = st.text("abcd ", max_size=12)
ODD = ["Telma 4O", "l0 ml", "Dr. A. Sen-Roy", "½ tab 1/2", "5OO mg x 5OO", "", "  ", "Straße ß", "a|b 1|2", "Mr Mr X", "é É 12", "0,5 1.5.", "S5 5S", None]


@settings(max_examples=60, deadline=None)
@given(WORDS, WORDS)
def test_similarities(a, b):
    assert S.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    assert 0 <= S.jaro_winkler(a, b) <= 1 + 1e-9
    assert S.edit_distance(list(a), list(b)) == S.edit_distance(list(b), list(a))


def test_bounds_hold(spark):
    import random

    r = random.Random(4)
    rows = [("".join(r.choice("abcé 1") for _ in range(r.randint(0, 9))), "".join(r.choice("abcé 1") for _ in range(r.randint(0, 9)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", L.bounds(F.col("a"), F.col("b")).alias("x"), L.letter_bound(F.col("a"), F.col("b")).alias("y"))
    assert all(S.ratio(q.a, q.b) <= q.x + 1e-12 and S.ratio(q.a, q.b) <= q.y + 1e-12 for q in df.collect())


def test_plain_functions_equal_expressions(spark):
    df = spark.createDataFrame([(s,) for s in ODD], "s string")
    got = df.select("s", X.numeric_context(F.col("s")).alias("c"), X.person_key_strict(F.col("s")).alias("k"), X.reading_key(F.col("s")).alias("r"), X.numbers_repaired(F.col("s")).alias("n")).collect()
    for q in got:
        assert L.repaired(q.s) == q.c and (q.s is None or L.strict_key(q.s) == q.k) and L.canon(q.s) == q.r and L.numbers(q.s) == q.n


@pytest.mark.parametrize("s", ["/", "//", "-", ",", "((", "1)", "blood:", "and and", "S.", "v", "CBC" * 30, "x" * 3000, "✓", "F PP", "blood f pp"])
def test_odd_entries_are_split(s):
    out = O.Splitter().split(s)
    assert all(isinstance(x, str) and x for x in out)
    assert O.file_entries([s], [s], [s]).keys() == {"tests", "medicines", "advice"}


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "s string")
    s = F.col("s")
    row = df.select(C.per_day(s).alias("a"), C.parse_date(s).alias("b"), C.strength(s).alias("c"), C.follow_up(s).alias("d"), C.quantity(s).alias("e"), X.parse_name(s).alias("f"), X.injection_suspect(s).alias("g"), C.dose_slots(s).alias("h"), C.unit_code(s).alias("i")).first()
    assert row.a is None and row.b.day is None and row.c.value is None and row.d.kind is None and row.e.value is None and row.g is False and row.h is None and row.i is None
    assert L.ground(None, None)["grounded"] and L.consensus(None)["votes"] == 0 and L.compare_engines(None)["state"] == "no_reading"
    assert O.vital_values(None) == [] and O.page_support(None, None) is None


def test_rules_of_the_gate(spark):
    t, f = F.lit(True), F.lit(False)
    df = spark.createDataFrame([(0.95,), (0.99,), (None,)], "c double")
    got = [tuple(r) for r in df.select(C.calibrate(F.col("c"), t, f, f), C.calibrate(F.col("c"), f, t, f), C.calibrate(F.col("c"), f, f, t)).collect()]
    assert got == [(0.65, 0.5, 0.9), (0.69, 0.5, 0.9), (0.0, 0.0, 0.0)]
    low = df.select(C.wilson_lower(F.lit(0), F.lit(0)).alias("a"), C.wilson_lower(F.lit(100), F.lit(100)).alias("b")).first()
    assert low.a == 0 and abs(low.b - 0.963) < 0.002
