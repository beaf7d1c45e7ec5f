"""Work queues and logs as tables (K5, K6, K8, K9, K11-K14, S23, A9, ST5, ST7, ST8, ST12, W16, Z2, Z34, Z39): each step is a plan over the table
and the time is an argument; a single writer applies the result, so no row locks are needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def claim(tasks: DataFrame, n: int, as_of: Column, order: list[str], state: str = "state", lease: str = "lease_until") -> DataFrame:
    """K13, ST5: the next n tasks: those that wait and those whose lease is over, in order; the limit is the feature."""
    free = (F.col(state) == "pending") | ((F.col(state) == "processing") & (F.col(lease) < as_of))
    return tasks.where(free).orderBy(*order).limit(n)


def leased(tasks: DataFrame, claimed: DataFrame, key: str, until: Column, state: str = "state", lease: str = "lease_until") -> DataFrame:
    """ST5: tasks after a claim: those claimed are processing until the lease ends."""
    own = claimed.select(key, F.lit(True).alias("own_"))
    mine = F.col("own_").isNotNull()
    return tasks.join(own, key, "left").select(*[F.when(mine, "processing").otherwise(F.col(c)).alias(c) if c == state else F.when(mine, until).otherwise(F.col(c)).alias(c) if c == lease else F.col(c) for c in tasks.columns])


def enqueue(queue: DataFrame, new: DataFrame, key: str, state: str = "state") -> DataFrame:
    """The queue with one pending entry more for each new key that has none pending."""
    waiting = queue.where(F.col(state) == "pending").select(key)
    return queue.unionByName(new.dropDuplicates([key]).join(waiting, key, "left_anti").select(queue.columns))


def settle(queue: DataFrame, done: DataFrame, key: str, most: int = 3) -> DataFrame:
    """ST8, ST12: the queue after a run; done: (key, ok).  Success ends an entry; a failure counts, and the last one allowed makes it dead."""
    d = done.select(key, F.col("ok").alias("ok_"))
    tried = F.col("attempts") + F.when(F.col("ok_") == F.lit(False), 1).otherwise(0)
    state = F.when(F.col("ok_"), "done").when((F.col("ok_") == F.lit(False)) & (tried >= most), "dead").when(F.col("ok_") == F.lit(False), "pending").otherwise(F.col("state"))
    return queue.join(d, key, "left").select(*[state.alias(c) if c == "state" else tried.alias(c) if c == "attempts" else F.col(c) for c in queue.columns])


def append_only(ledger: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A ledger with new entries; one that is there already is never changed."""
    return ledger.unionByName(new.dropDuplicates([key]).join(ledger.select(key), key, "left_anti").select(ledger.columns))


def corrected(facts: DataFrame, corrections: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """K8: facts with corrected values in the allowed columns only; a null corrects nothing."""
    c = corrections.select(key, *[F.col(x).alias(f"{x}_new") for x in allowed])
    return facts.join(c, key, "left").select(*[F.coalesce(f"{x}_new", x).alias(x) if x in allowed else F.col(x) for x in facts.columns])


def purged(rows: DataFrame, gone: DataFrame, key: str, sources: str) -> DataFrame:
    """K9: rows of which no source (an array) is in gone (one column): exploded, so any number of documents may go."""
    hit = rows.select(key, F.explode(sources).alias("s_")).join(gone.select(F.col(gone.columns[0]).alias("s_")), "s_", "left_semi").select(key).distinct()
    return rows.join(hit, key, "left_anti")


def new_versions(stored: DataFrame, built: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, digest, version) of what was built anew: the next version, or nothing if the content is that of the last."""
    last = stored.groupBy(key).agg(F.max_by(digest, "version").alias("old_"), F.max("version").alias("v_"))
    j = built.select(key, digest).join(last, key, "left")
    return j.where(~F.col(digest).eqNullSafe(F.col("old_"))).select(key, digest, (F.coalesce("v_", F.lit(0)) + 1).cast("long").alias("version"))


def arrivals(new: DataFrame, known: DataFrame, digest: str = "sha256") -> DataFrame:
    """ST7: what to do with each new document: process it, return the earlier result, or process it again if that was held for quality.

    Of several new ones with one content the first (smallest arrival) is it."""
    first = F.row_number().over(Window.partitionBy(digest).orderBy("arrival"))
    j = new.withColumn("n_", first).join(known.select(digest, "document_id", "status"), digest, "left")
    action = F.when(F.col("document_id").isNull() & (F.col("n_") == 1), "process").when(F.col("document_id").isNull(), "return_first").when(F.col("status") == "quality_hold", "reprocess").otherwise("return_old")
    return j.select("arrival", digest, "document_id", action.alias("action"))


def numbered(rows: DataFrame, key: str, start: int = 1) -> DataFrame:
    """Adds number, from start, in the order of a key: the same again for the same rows.

    Keys are dealt by range and counted by range, so no task sorts all of them."""
    ranged = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("id_", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"part_": F.shiftright("id_", 33), "in_": F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("part_").agg(F.count("*").alias("k_")).withColumn("before_", F.coalesce(F.sum("k_").over(before), F.lit(0)))  # a row for each partition
    return ranged.join(F.broadcast(sizes), "part_").withColumn("number", F.col("before_") + F.col("in_") + start).drop("id_", "part_", "in_", "k_", "before_")


def next_batch(ready: DataFrame, size: int, wait_seconds: int, as_of: Column, flush: bool = False, since: str = "first_seen") -> DataFrame:
    """W16, ST4: the oldest `size` ready files; fewer only when the oldest has waited long enough, or on flush; the limit is the feature."""
    own = ready.orderBy(since, "file_no").limit(size)
    all_ = Window.partitionBy(F.lit(1))  # at most `size` rows
    n, waited = F.count("*").over(all_), F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.min(since).over(all_).cast("timestamp"))
    return own.withColumns({"n_": n, "waited_": waited}).where((F.col("n_") >= size) | F.lit(flush) | (F.col("waited_") >= wait_seconds)).drop("n_", "waited_")


def run_chain(spark: SparkSession, path: str, stages: list[tuple[str, Callable[[SparkSession, DataFrame | None], DataFrame]]]) -> DataFrame:
    """ST14: stages one after another, each written under path and read again by the next; one that was written to its end is
    not run again, so a chain that stopped goes on where it was."""
    jvm, rows = spark.sparkContext._jvm, None
    for name, stage in stages:
        own = f"{path.rstrip('/')}/{name}"
        done = jvm.org.apache.hadoop.fs.Path(f"{own}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            stage(spark, rows).write.mode("overwrite").parquet(own)
        rows = spark.read.parquet(own)
    return rows
