"""Queues, logs and listener streams against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import queues as Q
from quillmark.plans import records  # noqa: F401
from quillmark.plans.registry import Tables, fixture, query
from quillmark.streaming import files as W

AS_OF = "TIMESTAMP '2030-01-01 00:00:00'"
fixture("tasks", """SELECT event_id AS task_id, user_id AS document_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'pending' END AS state, event_id % 3 AS attempts, CASE WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 8 = 1 THEN DATE '2031-01-01' ELSE DATE '2029-01-01' END END AS lease_until, CAST(ts AS DATE) AS made_on FROM {events}""")


@query("SELECT task_id, state FROM {tasks} WHERE state = 'pending' OR (state = 'processing' AND lease_until < DATE '2030-01-01') ORDER BY made_on, task_id LIMIT 25")
def claim_next(t: Tables):
    """K13, ST5: the oldest waiting tasks, and those whose lease is over."""
    return Q.claim(t.tasks, 25, F.to_date(F.lit("2030-01-01")), ["made_on", "task_id"]).select("task_id", "state")


@query("SELECT state, lease_until, count(*) AS n FROM (SELECT CASE WHEN c.task_id IS NOT NULL THEN 'processing' ELSE state END AS state, CASE WHEN c.task_id IS NOT NULL THEN DATE '2030-02-01' ELSE lease_until END AS lease_until FROM {tasks} t LEFT JOIN (SELECT task_id FROM {tasks} WHERE state = 'pending' OR (state = 'processing' AND lease_until < DATE '2030-01-01') ORDER BY made_on, task_id LIMIT 25) c ON c.task_id = t.task_id) GROUP BY ALL")
def lease_states(t: Tables):
    """ST5: tasks after a claim."""
    claimed = Q.claim(t.tasks, 25, F.to_date(F.lit("2030-01-01")), ["made_on", "task_id"])
    return Q.leased(t.tasks, claimed, "task_id", F.to_date(F.lit("2030-02-01"))).groupBy("state", "lease_until").agg(F.count("*").alias("n"))


@query("SELECT document_id, count(*) AS n, count(*) FILTER (WHERE state = 'pending') AS waiting FROM (SELECT document_id, state FROM {tasks} UNION ALL SELECT DISTINCT user_id * 2, 'pending' FROM events WHERE user_id * 2 NOT IN (SELECT document_id FROM {tasks} WHERE state = 'pending')) GROUP BY 1")
def outbox_enqueue(t: Tables):
    """A pending entry for each document that has none."""
    own = t.tasks.select("document_id", "state")
    new = t.events.select((F.col("user_id") * 2).alias("document_id"), F.lit("pending").alias("state"))
    return Q.enqueue(own, new, "document_id").groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "pending").alias("waiting"))


@query("SELECT state, attempts, count(*) AS n FROM (SELECT CASE WHEN task_id % 5 = 0 THEN 'done' WHEN task_id % 5 < 3 AND attempts + 1 >= 3 THEN 'dead' WHEN task_id % 5 < 3 THEN 'pending' ELSE state END AS state, CASE WHEN task_id % 5 IN (1, 2) THEN attempts + 1 ELSE attempts END AS attempts FROM {tasks}) GROUP BY ALL")
def outbox_settle(t: Tables):
    """ST8, ST12: entries after a run: done, tried again, or dead after three failures."""
    done = t.tasks.where("task_id % 5 < 3").select("task_id", (F.col("task_id") % 5 == 0).alias("ok"))
    return Q.settle(t.tasks.select("task_id", "state", F.col("attempts").cast("long").alias("attempts")), done, "task_id").groupBy("state", "attempts").agg(F.count("*").alias("n"))


@query("SELECT user_id, min(event_id) AS first_id, count(*) AS n FROM events WHERE event_id % 2 = 0 OR user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def ledger_append(t: Tables):
    """New entries under keys that the ledger hasn't; the old ones stay as they are."""
    old = t.events.where("event_id % 2 = 0").select("event_id", "user_id")  # the ledger
    new = t.events.where("event_id % 2 = 1").join(old.select("user_id").distinct(), "user_id", "left_anti").select("event_id", "user_id")
    return Q.append_only(old, new, "event_id").groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT fact_id, CASE WHEN fact_id % 6 = 0 THEN 'mg/dL' ELSE unit END AS unit, CASE WHEN fact_id % 6 = 0 AND fact_id % 4 = 0 THEN 1.5 ELSE value_num END AS value_num, code FROM {facts}")
def allowed_corrections(t: Tables):
    """K8, K7: corrections of allowed columns; a code that isn't allowed stays."""
    c = t.facts.where("fact_id % 6 = 0").select("fact_id", F.lit("mg/dL").alias("unit"), F.when(F.col("fact_id") % 4 == 0, 1.5).alias("value_num"), F.lit("x").alias("code"))
    return Q.corrected(t.facts.select("fact_id", "unit", "value_num", "code"), c, "fact_id", ["unit", "value_num"])


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_suppkey % 7 = 0)")
def purge_sources(t: Tables):
    """K9: what is left when documents go: rows none of whose sources went."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("sources"))
    return Q.purged(rows, t.supplier.where("s_suppkey % 7 = 0").select("s_suppkey"), "l_orderkey", "sources").select("l_orderkey")


@query("SELECT o_custkey, count(*) + 1 AS version FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING arg_max(o_orderpriority, o_orderkey) <> '1-URGENT' UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')")
def next_versions(t: Tables):
    """A new version of what changed; what is as it was is skipped."""
    from pyspark.sql.window import Window

    o = t.orders.where("o_orderstatus <> 'P'")
    stored = o.select("o_custkey", F.sha2("o_orderpriority", 256).alias("digest"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("version"))
    built = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.sha2(F.lit("1-URGENT"), 256).alias("digest"))
    return Q.new_versions(stored, built, "o_custkey", "digest").select("o_custkey", "version")


@query("""SELECT doc_id AS arrival, CASE WHEN k.d IS NOT NULL THEN CASE WHEN k.d % 2 = 0 THEN 'reprocess' ELSE 'return_old' END WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'process' ELSE 'return_first' END AS action FROM documents d
 LEFT JOIN (SELECT sha256(text) AS h, min(doc_id) AS d FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL GROUP BY 1) k ON k.h = sha256(d.text) WHERE text IS NOT NULL""")
def late_arrivals(t: Tables):
    """ST7, ST3: the same content again returns the earlier result, unless that was held for quality."""
    d = t.documents.where("text is not null").select(F.col("doc_id").alias("arrival"), F.sha2("text", 256).alias("sha256"))
    known = d.where("arrival % 3 = 0").groupBy("sha256").agg(F.min("arrival").alias("document_id"))
    known = known.withColumn("status", F.when(F.col("document_id") % 2 == 0, "quality_hold").otherwise("done"))
    return Q.arrivals(d, known).select("arrival", "action")


@query("SELECT o_orderkey, 'P-2030-' || lpad(CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), 6, '0') AS number FROM orders WHERE o_orderstatus = 'O'")
def numbered_ids(t: Tables):
    """Numbers in the order of a key, the same on every run."""
    n = Q.numbered(t.orders.where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey")
    return n.select("o_orderkey", F.concat(F.lit("P-2030-"), F.lpad(F.col("number").cast("string"), 6, "0")).alias("number"))


@query("SELECT task_id FROM {tasks} WHERE state = 'pending' ORDER BY made_on, task_id LIMIT 3")
def listener_batch(t: Tables):
    """The oldest three ready files."""
    ready = t.tasks.where("state = 'pending'").select("task_id", F.col("task_id").alias("file_no"), F.col("made_on").alias("first_seen"))
    return Q.next_batch(ready, 3, 60, F.to_date(F.lit("2030-01-01"))).select("task_id")


@query("""WITH RECURSIVE rows AS (SELECT event_type AS lane, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
 walk AS (SELECT lane, event_id, rn, 0::BIGINT AS batch_no, 1 AS n, us AS first_us FROM rows WHERE rn = 1 UNION ALL SELECT r.lane, r.event_id, r.rn, CASE WHEN w.n >= 3 OR r.us - w.first_us >= 3600000000 THEN w.batch_no + 1 ELSE w.batch_no END,
 CASE WHEN w.n >= 3 OR r.us - w.first_us >= 3600000000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 3 OR r.us - w.first_us >= 3600000000 THEN r.us ELSE w.first_us END FROM walk w JOIN rows r ON r.lane = w.lane AND r.rn = w.rn + 1)
 SELECT lane, batch_no, count(*) AS n, min(event_id) AS first_id FROM walk GROUP BY 1, 2""")
def stream_batching(t: Tables):
    """ST4, batch twin: three files, or an hour since the first."""
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("lane"))
    return W.batches_of(e, 3, 3600).groupBy("lane", "batch_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT file_id, etag, poll FROM (SELECT *, row_number() OVER (PARTITION BY file_id, island ORDER BY poll) AS n FROM (SELECT *, sum(change) OVER (PARTITION BY file_id ORDER BY poll) AS island FROM
 (SELECT CAST(file_no AS VARCHAR) AS file_id, etag, poll, CASE WHEN etag = lag(etag) OVER (PARTITION BY file_no ORDER BY poll) THEN 0 ELSE 1 END AS change FROM {polled}))) WHERE n = 2""")
def stream_stability(t: Tables):
    """ST2, batch twin: a version seen twice in a row is ready."""
    return W.stable_files_batch(t.polled.select(F.col("file_no").cast("string").alias("file_id"), "etag", "poll"))


@query("SELECT reason, count(*) AS n, max(poll) AS last_poll FROM (SELECT poll, CASE name WHEN '.hidden' THEN 'temporary or hidden file' WHEN 'c.json' THEN 'note or data file, not a prescription' WHEN 'd.docx' THEN 'file type not allowed' END AS reason FROM {polled}) WHERE reason IS NOT NULL GROUP BY 1")
def ignored_files(t: Tables):
    """What polls skipped, why and how often."""
    from quillmark.functions.text import ignore_reason

    return t.polled.withColumn("reason", ignore_reason(F.col("name"))).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.max("poll").alias("last_poll"))


@query("SELECT document_id, stage, status, k AS n_runs FROM (SELECT *, row_number() OVER (PARTITION BY document_id, stage ORDER BY started_at DESC, run_id DESC) AS rn, count(*) OVER (PARTITION BY document_id, stage) AS k FROM {runs}) WHERE rn = 1")
def last_runs(t: Tables):
    """The last run of each stage of a document, of an append-only log."""
    g = t.runs.groupBy("document_id", "stage").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status"), F.count("*").alias("n_runs"))
    return g.select("document_id", "stage", "status", "n_runs")
