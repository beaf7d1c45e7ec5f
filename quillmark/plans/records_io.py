"""Reads, writes and small projections that the other modules leave over, against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import linkage as L
from quillmark.operators import layout
from quillmark.operators import relational as R
from quillmark.plans import records  # noqa: F401
from quillmark.plans.registry import Tables, cases, query
from quillmark.sources.files import metrics_text


def listed(c: str):
    return F.filter(F.split(c, r"\|"), lambda x: x != "")


@query("SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|' || CAST(o_orderkey AS VARCHAR)) AS new_id FROM orders")
def inserted_ids(t: Tables):
    """Ids of inserted rows, from their content: the same on a second run."""
    return t.orders.select("o_orderkey", F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus", "o_orderkey"), 256).alias("new_id"))


@query("""SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, CASE WHEN n.k IS NOT NULL THEN n.w ELSE o.w END AS w FROM (SELECT o_orderkey AS k, o_orderstatus AS v, o_orderpriority AS w FROM orders WHERE o_orderkey % 3 <> 0) o
 FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS v, 'new' AS w FROM orders WHERE o_orderkey % 5 = 0) n ON n.k = o.k""")
def upsert_overwrite(t: Tables):
    """K2: new values over old ones, nulls too.  The two sides are the operator's two inputs."""
    old = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderpriority").alias("w"))
    new = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "X").alias("v"), F.lit("new").alias("w"))
    return R.upsert(old, new, ["k"])


@query("SELECT count(*) AS n, count(DISTINCT id) AS ids, sum(id)::BIGINT AS total FROM (SELECT event_id AS id FROM events UNION ALL SELECT event_id + 1000000 FROM events WHERE event_id % 2 = 0)")
def bulk_insert(t: Tables):
    """K6: many rows appended at once."""
    rows = t.events.select(F.col("event_id").alias("id")).unionByName(t.events.where("event_id % 2 = 0").select((F.col("event_id") + 1000000).alias("id")))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("id").alias("total"))


@query("SELECT fact_id, unit IS NOT DISTINCT FROM CASE WHEN fact_id % 2 = 0 THEN '%' END AS same_unit, code IS DISTINCT FROM '4548-4' AS other_code FROM {facts}")
def null_safe_compare(t: Tables):
    """Equality in which missing is equal to missing."""
    return t.facts.select("fact_id", F.col("unit").eqNullSafe(F.when(F.col("fact_id") % 2 == 0, "%")).alias("same_unit"), (~F.col("code").eqNullSafe("4548-4")).alias("other_code"))


cases("context_links", "J14: a test and a reason share a line, or only a page; the first shared line is the quote.", "test_lines STRING, reason_lines STRING", "relation STRING, quote STRING", [("b1|b3", "b3|b1", "same_line", "b1"), ("b1", "b2", "same_page", None), ("b1", "b9", None, None), ("", "b1", None, None), ("b9", "b9", "same_line", "b9")], lambda d: layout.context_link(d, listed("test_lines"), listed("reason_lines"), {"b1": 1, "b2": 1, "b3": 2, "b9": 3}).select("id", "relation", "quote"))

cases("header_names", "F16: doctor and clinic on the head of a page.", "lines STRING", "doctor STRING, clinic STRING", [
    ("Sunrise Polyclinic|Dr.Mita Bose MBBS MD|Name: K V|Adv CBC|x|y", "Dr. Mita Bose", "Sunrise Polyclinic"), ("a|b|c|Dr Late Here", None, None), ("Prof Dr Asha K. Sen|x|y", "Prof. Dr. Asha K. Sen", None), ("", None, None), ("Blue Clinic Mob.98111", None, "Blue Clinic"),
    ("KSHEALTHCARE|x", None, "KS HEALTHCARE"), ("LIFE CENTRE POLYCLINIC", None, "LIFE CENTRE POLYCLINIC"), ("Clinic", None, None), ("Dr Reg 123", None, None), ("Hospital A road and Clinic B far away", None, None),
], lambda d: d.select("id", L.over(layout.header, "doctor string, clinic string")(listed("lines")).alias("h")).select("id", "h.doctor", "h.clinic"))


@query("SELECT page_id, string_agg(CAST(block_id AS VARCHAR), ' ' ORDER BY x0, block_id) AS line, round(min(coalesce(ocr_conf, 0)), 6) AS conf FROM {blocks} GROUP BY 1")
def region_text(t: Tables):
    """A region's text from left to right, its confidence the least."""
    s = F.array_sort(F.collect_list(F.struct("x0", "block_id")))
    return t.blocks.groupBy("page_id").agg(F.array_join(F.transform(s, lambda x: x.block_id.cast("string")), " ").alias("line"), F.round(F.min(F.coalesce("ocr_conf", F.lit(0.0))), 6).alias("conf"))


@query("""SELECT f.fact_id, f.document_id, r.status, coalesce(l.n, 0) AS n_lines FROM {facts} f LEFT JOIN (SELECT document_id, arg_max(status, (started_at, run_id)) AS status FROM {runs} GROUP BY 1) r ON r.document_id = f.document_id LEFT JOIN (SELECT fact_id, count(*) AS n FROM {fact_lines} GROUP BY 1) l ON l.fact_id = f.fact_id WHERE f.is_current""")
def job_facts(t: Tables):
    """A job's facts with the last run of their document and their lines of evidence."""
    last = t.runs.groupBy("document_id").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status"))
    lines = t.fact_lines.groupBy("fact_id").agg(F.count("*").alias("n"))
    return t.facts.where("is_current").join(last, "document_id", "left").join(lines, "fact_id", "left").select("fact_id", "document_id", "status", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("SELECT k, arg_min(v, rank) AS v FROM (SELECT c_nationkey AS k, 'customer' AS v, 1 AS rank FROM customer UNION ALL SELECT s_nationkey, 'supplier', 2 FROM supplier UNION ALL SELECT n_nationkey, 'nation', 3 FROM nation) GROUP BY 1")
def ordered_union(t: Tables):
    """U4: a union in which the first source that has a key wins."""
    parts = [t.customer.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("v")), t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("v")), t.nation.select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("v"))]
    return R.first_wins(parts, "k")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'part', count(*) FROM part")
def table_counts(t: Tables):
    """Rows of several tables."""
    out = [t.__getattr__(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("orders", "events", "part")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT 'docs{stage="' || stage || '",status="' || status || '"} ' || count(*) AS line FROM {runs} GROUP BY stage, status""")
def metric_lines(t: Tables):
    """Counts as exposition lines."""
    return metrics_text(t.runs.groupBy("stage", "status").agg(F.count("*").alias("n")), "docs", ["stage", "status"], "n")


@query("SELECT block_id, CAST(2 * x0 + 5 AS DOUBLE) AS x0, CAST(2 * y0 - 1 AS DOUBLE) AS y0, CAST(2 * x1 + 5 AS DOUBLE) AS x1, CAST(2 * y1 - 1 AS DOUBLE) AS y1 FROM {blocks}")
def mapped_boxes(t: Tables):
    """boxes mapped back to the page by a homogeneous matrix."""
    m = F.array(*[F.lit(x) for x in (2.0, 0.0, 5.0, 0.0, 2.0, -1.0, 0.0, 0.0, 1.0)])
    b = layout.mapped_box(F.array("x0", "y0", "x1", "y1"), m)
    return t.blocks.select("block_id", b.alias("b")).select("block_id", *[F.col("b")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("SELECT document_id, string_agg(stage || ':' || status, ' ' ORDER BY started_at, run_id) AS history, count(*) AS n FROM {runs} GROUP BY 1")
def event_history(t: Tables):
    """ST11: a file's events in order, as they were appended."""
    s = F.array_sort(F.collect_list(F.struct("started_at", "run_id", "stage", "status")))
    return t.runs.groupBy("document_id").agg(F.array_join(F.transform(s, lambda x: F.concat(x.stage, F.lit(":"), x.status)), " ").alias("history"), F.count("*").alias("n"))


@query("SELECT event_id, user_id, first_value(event_id) OVER (PARTITION BY user_id, floor(epoch(ts) / 300) ORDER BY ts, event_id) AS loaded_by FROM events")
def cache_loads(t: Tables):
    """ST15: reads of a cache that lives 300 seconds: which read loaded what a read sees."""
    w = Window.partitionBy("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300)).orderBy("ts", "event_id")
    return t.events.select("event_id", "user_id", F.first("event_id").over(w).alias("loaded_by"))
