import pytest
from pyspark.sql import functions as F

from quillmark.operators import layout, linking, queues
from quillmark.operators import relational as R
from quillmark.operators import rules


def test_current(spark):
    df = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", None)], "id string, s array<string>")
    assert {r.id for r in R.current(df, "id", "s").collect()} == {"b", "c"}


def test_conflicts_need_both_values(spark):
    rows = [(1, "p", "t", "x", "2024-01-01", 5.0), (2, "p", "t", "x", "2024-01-01", None), (3, "p", "t", "x", "2024-01-01", 5.0), (4, "p", "t", "x", "2024-01-01", 6.0), (5, "p", "t", "x", "2024-01-01", 0.0), (6, "p", "t", None, "2024-01-01", 5.0), (7, "p", "t", "x", None, 5.0)]
    f = spark.createDataFrame(rows, "fact_id int, patient_id string, fact_type string, code string, d string, value_num double").withColumn("effective_on", F.to_date("d"))
    got = {(r.left_id, r.right_id, r.kind) for r in rules.conflicts(f).collect()}
    assert got == {(1, 3, "duplicate"), (1, 4, "value_mismatch"), (1, 5, "value_mismatch"), (2, 5, "duplicate"), (3, 4, "value_mismatch"), (3, 5, "value_mismatch"), (4, 5, "value_mismatch")}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string")
    new = spark.createDataFrame([(2, None, "e"), (3, "f", None)], "k int, x string, y string")
    assert sorted(map(tuple, R.upsert(old, new, ["k"]).collect())) == [(1, "a", "b"), (2, None, "e"), (3, "f", None)]
    assert sorted(map(tuple, R.upsert(old, new, ["k"], preserve=True).collect())) == [(1, "a", "b"), (2, "c", "e"), (3, "f", None)]
    assert R.insert_new(old, new, ["k"]).count() == 3


def test_components_of_any_length(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(909, 908), (None, 3)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(201), 908, 909, 1000]], "n long")
    got = {r.node: r.label for r in R.components(e, nodes).collect()}
    assert got == {i: 0 for i in range(201)} | {908: 908, 909: 908, 1000: 1000}
    assert R.components(e.limit(0)).count() == 0


def test_greedy(spark):
    n = spark.createDataFrame([("p", "Ketan Vyas", 4), ("p", "Ketan Vyass", 1), ("p", "Asha Rao", 1), ("p", None, 2)], "phone string, name string, n long")
    assert sorted((r.name, r.n) for r in linking.greedy_names(n, "phone", "name", "n").collect()) == [("", 2), ("Asha Rao", 1), ("Ketan Vyas", 5)]


def test_edit_pairs_equal_brute_force(spark):
    import random

    from quillmark.functions.similarity import edit_distance

    r = random.Random(3)
    words = {"".join(r.choice("ab1") for _ in range(r.randint(0, 5))) for _ in range(120)}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    want = {(a, b) for a in words for b in words if a < b and edit_distance(list(a), list(b)) <= 1}
    assert {(x.a, x.b) for x in linking.edit_pairs(df, "w").collect()} == want


def test_edit_pairs_come_once_and_are_not_broadcast(spark):
    words = ["", "a", "b", "ab", "ba", "bb", "b\u00e9", "\U0001f600b", "aab", "aaab", "aab"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    from quillmark.functions.similarity import edit_distance

    n = {w: words.count(w) for w in words}
    want = sorted((a, b, n[a], n[b]) for a in n for b in n if a < b and edit_distance(list(a), list(b)) <= 1)
    assert sorted(map(tuple, linking.edit_pairs(df, "w").collect())) == want
    assert sorted(map(tuple, linking.edit_pairs(df, "w", same_length=True).collect())) == [x for x in want if len(x[0]) == len(x[1])]


def test_names_of_several_customers_give_a_row_each(spark, tmp_path):
    import duckdb
    import oracle

    from quillmark.plans import linkage  # noqa: F401
    from quillmark.plans.registry import PLANS, SQL

    c = spark.createDataFrame([(i, n) for i, n in enumerate(["C1", "C1", "C2", "C3", "C3", "D3", None, ""])], "c_custkey long, c_name string")
    c.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    found = PLANS["blocked_fuzzy"](spark, str(tmp_path))
    ok, why = oracle.same(found, con, SQL["blocked_fuzzy"])
    assert ok and found.count() == 10, why
    assert found._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1  # the places of each length, no keys


def test_dispatch_plan_deals_no_pair(spark, tmp_path):
    import duckdb
    import oracle

    from quillmark.plans import extraction  # noqa: F401
    from quillmark.plans.registry import PLANS, SQL

    spark.createDataFrame([(k, 3 if k != 4 else 2) for k in (1, 2, 2, 4, 6)] + [(None, 3)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, "F"), (2, "O"), (3, None), (3, "F"), (None, "P")], "o_orderkey long, o_orderstatus string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("supplier", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = PLANS["dispatch_plan"](spark, str(tmp_path))
    ok, why = oracle.same(found, con, SQL["dispatch_plan"])
    assert ok, why
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_masters_are_bounded(spark, monkeypatch):
    m = spark.createDataFrame([(1, "r", "n", [], [])], "id long, reg string, name string, aliases array<string>, words array<string>")
    monkeypatch.setattr(linking, "MAX_MASTERS", 0)
    with pytest.raises(ValueError):
        linking.match_doctors(spark.createDataFrame([(1, "n", "", "")], "doc_id long, name string, reg string, header string"), m)


def test_boxes(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 0, 0, 100, 12), (1, 3, 500, 500, 510, 510), (2, 4, 0, 0, 10, 10)], "p int, k int, x0 int, y0 int, x1 int, y1 int")
    assert {tuple(r) for r in layout.inside(b, "p", "k", 0.5).collect()} == {(1, 2)}
    assert {tuple(r) for r in layout.near(b, "p", "k").collect()} == {(1, 2), (2, 1)}
    m = spark.createDataFrame([([1, 2, 3, 4], [2.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0])], "b array<int>, m array<double>")
    assert list(m.select(layout.mapped_box(F.col("b"), F.col("m")).alias("x")).first().x) == [3.0, 4.0, 7.0, 8.0]


def test_queue_steps(spark):
    q = spark.createDataFrame([(1, "pending", 2), (2, "pending", 0), (3, "done", 0)], "k long, state string, attempts long")
    done = spark.createDataFrame([(1, False), (2, True)], "k long, ok boolean")
    assert sorted(map(tuple, queues.settle(q, done, "k").collect())) == [(1, "dead", 3), (2, "done", 0), (3, "done", 0)]
    ready = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:30")], "file_no long, s string").withColumn("first_seen", F.to_timestamp("s"))
    at = lambda s: F.to_timestamp(F.lit(s))
    assert queues.next_batch(ready, 3, 60, at("2024-01-01 00:00:59")).count() == 0
    assert queues.next_batch(ready, 3, 60, at("2024-01-01 00:01:00")).count() == 2
    assert queues.next_batch(ready, 3, 60, at("2024-01-01 00:00:01"), flush=True).count() == 2
    assert queues.next_batch(ready, 1, 60, at("2024-01-01 00:00:01")).count() == 1
    numbers = queues.numbered(spark.range(1000).repartition(7).withColumnRenamed("id", "k"), "k").collect()
    assert sorted((r.k, r.number) for r in numbers) == [(i, i + 1) for i in range(1000)]
