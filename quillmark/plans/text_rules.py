"""Text, rules, linkage and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import clinical as C
from quillmark.functions import text as X
from quillmark.plans.registry import Tables, query


@query("""SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS n_numbers, coalesce(array_to_string(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), ','), '') AS numbers FROM documents""")
def numbers_extract(t: Tables):
    """F11."""
    n = X.numbers(F.col("text"))
    return t.documents.select("doc_id", F.size(n).cast("long").alias("n_numbers"), F.array_join(n, ",").alias("numbers"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 5 WHEN 3 THEN 'month' WHEN 4 THEN 'year' ELSE 'day' END AS precision,
 CASE o_orderkey % 5 WHEN 3 THEN date_trunc('month', o_orderdate)::DATE WHEN 4 THEN date_trunc('year', o_orderdate)::DATE ELSE o_orderdate::DATE END AS parsed FROM orders""")
def partial_dates(t: Tables):
    """dates written in five forms and parsed back."""
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    written = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d/M/yyyy")).when(k == 2, F.date_format(d, "dd-MMM-yyyy")).when(k == 3, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy"))
    o = t.orders.withColumn("p", C.parse_date(written))
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), "p.precision", F.col("p.day").alias("parsed"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(t: Tables):
    """The first document of each content."""
    return t.documents.where("text is not null").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT p_brand, rank_no, p_name, score, score >= max(score) OVER (PARTITION BY p_brand) - 0.03 AND count(*) FILTER (WHERE near) OVER (PARTITION BY p_brand) >= 2 AS collision FROM
 (SELECT *, score >= max(score) OVER (PARTITION BY p_brand) - 0.03 AS near FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_name) AS rank_no FROM
 (SELECT p_brand, p_name, max(p_retailprice / 2000) AS score FROM part GROUP BY 1, 2))) WHERE rank_no <= 5""")
def alias_candidates(t: Tables):
    """The best of each name, the first five, and those within .03 of the top."""
    b = t.part.groupBy("p_brand", "p_name").agg(F.max(F.col("p_retailprice") / 2000).alias("score"))
    b = b.withColumn("rank_no", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_name")).cast("long")).where("rank_no <= 5")
    w = Window.partitionBy("p_brand")
    b = b.withColumn("near", F.col("score") >= F.max("score").over(w) - 0.03)
    return b.select("p_brand", "rank_no", "p_name", "score", (F.col("near") & (F.count_if("near").over(w) >= 2)).alias("collision"))


@query("""SELECT doc_id, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind) AS rn, score - coalesce(lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, kind), 0) AS margin FROM
 (SELECT doc_id, kind, sum(weight)::BIGINT AS score FROM documents JOIN (VALUES ('license','legal',3),('terms','legal',2),('http','web',3),('@','web',2),('the ','prose',1),('und ','prose',1)) k(word, kind, weight) ON contains(lower(text), word) GROUP BY 1, 2)) WHERE rn = 1 AND margin >= 1""")
def keyword_classifier(t: Tables):
    """Weighted keywords (a fixed list), winner by margin."""
    words = [("license", "legal", 3), ("terms", "legal", 2), ("http", "web", 3), ("@", "web", 2), ("the ", "prose", 1), ("und ", "prose", 1)]
    low = F.lower("text")
    hits = F.filter(F.array(*[F.when(low.contains(w), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("weight"))) for w, k, n in words]), lambda x: x.isNotNull())
    s = t.documents.select("doc_id", F.explode(hits).alias("h")).groupBy("doc_id", "h.kind").agg(F.sum("h.weight").alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "kind")
    s = s.withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0))).withColumn("rn", F.row_number().over(w))
    return s.where("rn = 1 and margin >= 1").select("doc_id", "kind", "score")


@query("""SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good, round(CASE WHEN count(*) > 0 THEN greatest(0, (sum(quality)/count(*)::DOUBLE + 3.8416/(2*count(*)) - 1.96*sqrt(sum(quality)/count(*)::DOUBLE*(1-sum(quality)/count(*)::DOUBLE)/count(*) + 3.8416/(4.0*count(*)*count(*)))) / (1+3.8416/count(*))) ELSE 0 END, 6) AS lower_bound
 FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def wilson_by_slice(t: Tables):
    """F34, A15."""
    s = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    return s.withColumn("lower_bound", F.round(C.wilson_lower(F.col("good"), F.col("n")), 6))


@query("""SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, round(sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS false_reject FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def rejection_rates(t: Tables):
    """Rates overall and by language."""
    j = t.documents.join(t.labels, "doc_id")
    return j.rollup("lang").agg(F.count("*").alias("n"), F.round(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)) / F.count("*"), 6).alias("false_reject")).select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "n", "false_reject")


@query("""SELECT coalesce(a.p_name, b.p_name) AS p_name, CASE WHEN a.p_name IS NULL THEN 'added' WHEN b.p_name IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' ELSE 'same' END AS change FROM
 (SELECT p_name, max(p_size) AS s FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT p_name, max(p_size) AS s FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) b ON a.p_name = b.p_name""")
def inventory_diff(t: Tables):
    """Two inventories (the operator's two inputs) compared by a full outer join."""
    a = t.part.where("p_partkey % 2 = 0").groupBy("p_name").agg(F.max("p_size").alias("s"))
    b = t.part.where("p_partkey % 3 = 0").groupBy("p_name").agg(F.max("p_size").alias("z"))
    return a.join(b, "p_name", "full_outer").select("p_name", F.when(F.col("s").isNull(), "added").when(F.col("z").isNull(), "removed").when(F.col("s") != F.col("z"), "changed").otherwise("same").alias("change"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN value < 5 OR (event_id % 4) + 1 >= 3 THEN 'quarantine' ELSE 'error' END AS state, CAST(30 * pow(2, event_id % 4) AS BIGINT) AS wait_seconds FROM events""")
def stream_retries(t: Tables):
    """ST6, F33: state after a try, and the wait before the next."""
    from quillmark.streaming.files import retry_state

    a = F.col("event_id") % 4
    return t.events.select("event_id", retry_state(a, F.col("event_type") == "error", F.col("value") < 5).alias("state"), C.backoff(30, a).alias("wait_seconds"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (WHERE event_type = 'error') AS failures, date_diff('second', max(ts), (SELECT max(ts) FROM events)) > 86400 AS stalled FROM events GROUP BY 1""")
def listener_health(t: Tables):
    """ST10: last state, failures and stall against a given time."""
    end = t.events.agg(F.max("ts").alias("as_of"))
    g = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max("ts").alias("last"))
    secs = F.unix_seconds(F.col("as_of").cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    return g.crossJoin(F.broadcast(end)).select("user_id", "state", "failures", (secs > 86400).alias("stalled"))
