"""Read models and reports: views, joins, aggregates, rankings, sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators.relational import current, latest, upsert
from quillmark.plans.registry import Tables, query

GOV = "event_type IN ('view', 'purchase', 'signup')"


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, count(o_orderkey) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')) AS n_urgent,
 max(CAST(o_orderdate AS DATE)) AS last_day FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey, c_name""")
def encounter_timeline(t: Tables):
    """Left join with the predicate on the right side, conditional counts."""
    o = t.orders.where("o_orderstatus <> 'P'")
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_name").agg(
        F.count("o_orderkey").alias("n_orders"), F.count(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderkey"))).alias("n_urgent"), F.max(F.to_date("o_orderdate")).alias("last_day"))


@query(f"""SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, max(value) AS top, string_agg(DISTINCT k, ',' ORDER BY k) AS kinds
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events) WHERE {GOV} GROUP BY user_id, event_type""")
def problem_list(t: Tables):
    """Governed rows, min/max, distinct aggregate in a stable order."""
    e = t.events.where(GOV).withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"), F.max("value").alias("top"), F.array_join(F.array_sort(F.collect_set("k")), ",").alias("kinds"))


@query("""SELECT p_brand, p_type, p_size, l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS first_ship, max(l_quantity) AS top_qty
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def medication_list(t: Tables):
    """Inner join with many group keys."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type", "p_size", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"), F.max("l_quantity").alias("top_qty"))


@query("SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, value FROM events WHERE event_type <> 'error'")
def results_grid(t: Tables):
    """P11."""
    return t.events.where("event_type <> 'error'").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "value")


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def latest_per_key(t: Tables):
    """The newest order of each customer."""
    return latest(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("""SELECT e.event_id, e.user_id, e.event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_type = e.event_type
 AND (n.ts > e.ts OR (n.ts = e.ts AND n.event_id > e.event_id)))""")
def supersession_current(t: Tables):
    """Each row supersedes the one before it; rows that none supersedes are current."""
    before = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = t.events.withColumn("supersedes", F.array_compact(F.array(before)))
    return current(rows, "event_id", "supersedes").select("event_id", "user_id", "event_type")


@query("""SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers,
 (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = 'O') AS n_open FROM nation""")
def customer_360(t: Tables):
    """Children counted first, then left-joined."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers"))
    o = t.orders.where("o_orderstatus = 'O'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_open"))
    out = t.nation.select("n_nationkey", "n_name")
    for x in (c, s, o):
        out = out.join(x, "n_nationkey", "left")
    return out.fillna(0, ["n_customers", "n_suppliers", "n_open"])


@query("""SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY (o_orderpriority = '1-URGENT') DESC, (o_orderpriority = '2-HIGH') DESC, o_orderdate ASC NULLS LAST, o_orderkey LIMIT 200""")
def workbasket_order(t: Tables):
    """Boolean priorities, then first in first out; the limit is the feature."""
    p = F.col("o_orderpriority")
    return t.orders.where("o_orderstatus = 'O'").orderBy((p == "1-URGENT").desc(), (p == "2-HIGH").desc(), F.asc_nulls_last("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def state_counts(t: Tables):
    """A4."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, round(avg(epoch_us(nxt) - epoch_us(ts)) / 1e6, 3) AS mean_seconds FROM
 (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1""")
def stage_durations(t: Tables):
    """A5, P10: duration to the next event in the last day before the newest."""
    e = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("nxt", F.lead("us").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    end = t.events.agg(F.max("ts").alias("as_of"))
    e = e.where("nxt is not null").crossJoin(F.broadcast(end)).where("ts > as_of - INTERVAL 1 DAY")  # one row
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("nxt") - F.col("us")) / 1e6, 3).alias("mean_seconds"))


@query("SELECT coalesce(date_diff('day', min(o_orderdate), max(o_orderdate)), 0) AS oldest_days, count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def oldest_open(t: Tables):
    """A global aggregate gives a row even of nothing."""
    return t.orders.where("o_orderstatus = 'O'").agg(F.coalesce(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")), F.lit(0)).cast("long").alias("oldest_days"), F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1, 2 ORDER BY newest DESC, user_id, event_type LIMIT 10")
def top_groups(t: Tables):
    """A7, W6."""
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("newest")).orderBy(F.desc("newest"), "user_id", "event_type").limit(10)


@query("""SELECT o_custkey, o_orderpriority AS mode_value, c AS votes, round(least(0.99, 0.5 + 0.5 * c / total), 6) AS confidence FROM
 (SELECT *, sum(c) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, length(o_orderpriority) DESC, o_orderpriority) AS rn FROM
 (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2)) WHERE rn = 1""")
def mode_with_ties(t: Tables):
    """A10: most frequent value, then longest, with the share that agrees."""
    c = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("votes"))
    c = c.withColumn("total", F.sum("votes").over(Window.partitionBy("o_custkey")))
    best = latest(c, ["o_custkey"], F.desc("votes"), F.length("o_orderpriority").desc(), F.asc("o_orderpriority"))
    return best.select("o_custkey", F.col("o_orderpriority").alias("mode_value"), "votes", F.round(F.least(F.lit(0.99), 0.5 + 0.5 * F.col("votes") / F.col("total")), 6).alias("confidence"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, round(avg(value), 6) AS mean, max(value) AS top, median(value) AS med FROM events GROUP BY 1")
def latency_quantiles(t: Tables):
    """Exact quantiles."""
    return t.events.groupBy("event_type").agg(F.expr("percentile(value, 0.5)").alias("p50"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"), F.median("value").alias("med"))


@query("""SELECT day, rate, round(m, 6) AS mean_rate, n >= 7 AND abs(rate - m) > greatest(3 * s, 0.15) AS alarm FROM (SELECT day, rate, avg(rate) OVER w AS m, stddev_pop(rate) OVER w AS s, count(*) OVER w AS n FROM
 (SELECT CAST(ts AS DATE) AS day, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY 1) WINDOW w AS (ORDER BY day ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))""")
def drift_band(t: Tables):
    """A25, A26, ST13: a day's rate against the days before, population deviation.  One row a day, so one partition is enough."""
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("rate"))
    w = Window.orderBy("day").rowsBetween(-200, -1)
    d = d.select("day", "rate", F.avg("rate").over(w).alias("m"), F.stddev_pop("rate").over(w).alias("s"), F.count("*").over(w).alias("n"))
    return d.select("day", "rate", F.round("m", 6).alias("mean_rate"), ((F.col("n") >= 7) & (F.abs(F.col("rate") - F.col("m")) > F.greatest(3 * F.col("s"), F.lit(0.15)))).alias("alarm"))


@query("SELECT o_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE abs(date_diff('day', o_orderdate, l_shipdate)) <= 400")
def band_join(t: Tables):
    """Equi key and a band of days."""
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("days", F.datediff("l_shipdate", "o_orderdate").cast("long"))
    return j.where("abs(days) <= 400").select("o_orderkey", "l_linenumber", "l_partkey", "days")


@query("""SELECT a.l_orderkey, a.l_linenumber AS left_line, b.l_linenumber AS right_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
 AND CAST(a.l_shipdate AS DATE) <= CAST(b.l_shipdate AS DATE) + CAST(b.l_quantity AS INTEGER) AND CAST(b.l_shipdate AS DATE) <= CAST(a.l_shipdate AS DATE) + CAST(a.l_quantity AS INTEGER)""")
def interval_overlap(t: Tables):
    """Spans that overlap within one key."""
    s = t.lineitem.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("lo"), F.expr("date_add(to_date(l_shipdate), cast(l_quantity as int))").alias("hi"))
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.expr("a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.lo <= b.hi and b.lo <= a.hi")).select("a.l_orderkey", F.col("a.l_linenumber").alias("left_line"), F.col("b.l_linenumber").alias("right_line"))


@query("SELECT s_suppkey, count(DISTINCT l_orderkey) AS n_orders FROM (SELECT l_orderkey, list(DISTINCT l_suppkey) AS ids FROM lineitem GROUP BY 1) JOIN supplier ON list_contains(ids, s_suppkey) GROUP BY 1")
def array_membership(t: Tables):
    """Membership in an array as explode and an equi join."""
    arrays = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    return arrays.select("l_orderkey", F.explode("ids").alias("s_suppkey")).join(t.supplier.select("s_suppkey"), "s_suppkey").groupBy("s_suppkey").agg(F.count_distinct("l_orderkey").alias("n_orders"))


@query("SELECT n_nationkey, n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier) AS in_both, n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AS only_customers FROM nation")
def set_algebra(t: Tables):
    """Intersection and difference of key sets."""
    c, s = t.customer.select(F.col("c_nationkey").alias("n_nationkey")).distinct(), t.supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    both, only = c.intersect(s).withColumn("b", F.lit(True)), c.exceptAll(s).withColumn("o", F.lit(True))
    return t.nation.select("n_nationkey").join(both, "n_nationkey", "left").join(only, "n_nationkey", "left").select("n_nationkey", F.coalesce("b", F.lit(False)).alias("in_both"), F.coalesce("o", F.lit(False)).alias("only_customers"))


@query("SELECT r_name, n_name FROM region, nation WHERE NOT EXISTS (SELECT 1 FROM supplier JOIN nation x ON s_nationkey = x.n_nationkey WHERE x.n_nationkey = nation.n_nationkey AND x.n_regionkey = region.r_regionkey)")
def cross_minus_sent(t: Tables):
    """Targets times documents (two dimension tables of fixed size), less what was sent."""
    sent = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.col("n_regionkey").alias("r_regionkey")).distinct()
    return F.broadcast(t.region).crossJoin(t.nation.select("n_name")).join(sent, ["n_name", "r_regionkey"], "left_anti").select("r_name", "n_name")


@query("""SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM
 (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0) n ON o.o_orderkey = n.o_orderkey""")
def upsert_coalesce(t: Tables):
    """K3, K7: null in the new row keeps the old value.  The two sides are the operator's two inputs."""
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    old = t.orders.where("o_orderkey % 3 <> 0").select(cols)
    new = t.orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return upsert(old, new, ["o_orderkey"], preserve=True)


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_id, (ts, event_id)) AS last_example FROM events GROUP BY 1, 2")
def counter_upsert(t: Tables):
    """K4: counters over an append-only log."""
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_example"))


@query("""SELECT conv_id, arg_min(text, turn) FILTER (WHERE trim(text) <> '' AND role = 'user') AS first_user, arg_min(text, turn) FILTER (WHERE trim(text) <> '' AND role = 'assistant') AS first_assistant
 FROM (SELECT DISTINCT conv_id, turn, role, min(text) OVER (PARTITION BY conv_id, turn, role) AS text FROM conversations) GROUP BY conv_id""")
def first_nonempty_merge(t: Tables):
    """First non-empty value of each field in page order."""
    c = t.conversations.groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    pick = lambda r: F.min_by(F.when((F.trim("text") != "") & (F.col("role") == r), F.col("text")), F.when((F.trim("text") != "") & (F.col("role") == r), F.col("turn")))
    return c.groupBy("conv_id").agg(pick("user").alias("first_user"), pick("assistant").alias("first_assistant"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(length(text), (turn, role, length(text))) AS n_chars FROM conversations GROUP BY conv_id")
def latest_visit(t: Tables):
    """The last turn of each conversation."""
    rows = t.conversations.withColumn("n_chars", F.length("text").cast("long"))
    return latest(rows, ["conv_id"], F.desc_nulls_last("turn"), F.desc("role"), F.desc("n_chars")).select("conv_id", "turn", "n_chars")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract(props, '$.k') IS NOT NULL AS has_k FROM events")
def json_path(t: Tables):
    """A path of a JSON column."""
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"))


@query("""SELECT l_orderkey, l_linenumber, 'quantity' AS fact_type, l_quantity AS value_num FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem""")
def eav_fanout(t: Tables):
    """One row for each value: the unpivot that fan-outs are made of."""
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "fact_type", "value_num").withColumn("fact_type", F.substring("fact_type", 3, 20))


@query("""SELECT event_id, in_window, in_window > 3 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events)""")
def rate_limit(t: Tables):
    """ST9: strictly less than 60 seconds."""
    from quillmark.streaming.files import rate_limited

    return rate_limited(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", 3).select("event_id", "in_window", "limited")


@query("""SELECT user_id, session_no, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2""")
def session_components(t: Tables):
    """G1 in one dimension: gaps and islands."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("fresh", F.when(F.expr("ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hours"), 0).otherwise(1))
    e = e.withColumn("session_no", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 7")
def audit_sample(t: Tables):
    """A deterministic sample of keys; sampling is the feature."""
    return t.orders.where(F.pmod("o_orderkey", F.lit(10)) == 7).select("o_orderkey")


@query("SELECT coalesce(l_returnflag, 'ALL') AS slice, count(*) AS n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_f FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def overall_and_slices(t: Tables):
    """Overall and by slice."""
    return t.lineitem.rollup("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("n_f")).select(F.coalesce("l_returnflag", F.lit("ALL")).alias("slice"), "n", "n_f")


@query("""SELECT o_custkey, max(v) AS version, count(DISTINCT h) AS n_contents FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v, sha256(o_orderstatus || o_orderpriority) AS h FROM orders) GROUP BY 1""")
def versioned_contents(t: Tables):
    """Versions of a key, and its different contents."""
    v = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = t.orders.select("o_custkey", v.cast("long").alias("v"), F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("h"))
    return o.groupBy("o_custkey").agg(F.max("v").alias("version"), F.count_distinct("h").alias("n_contents"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def pending_gate(t: Tables):
    """Subjects without anything pending."""
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || ':' || l_returnflag, ';' ORDER BY l_linenumber, l_partkey, l_returnflag) AS lines FROM lineitem GROUP BY 1""")
def ordered_children(t: Tables):
    """Children gathered in order."""
    s = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(s, lambda x: F.concat(x.l_linenumber.cast("string"), F.lit(":"), x.l_returnflag)), ";").alias("lines"))
