"""File-arrival streams (ST2-ST9): stability, batches, retries as stateful processors, with batch twins.

The pure functions step the state of one key; the streaming operators apply them with applyInPandasWithState.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from quillmark.functions.text import ignore_reason, mime_of

STABLE_POLLS = 2


def step_stability(state: tuple[str, int, bool] | None, etag: str, polls: int = STABLE_POLLS) -> tuple[tuple[str, int, bool], bool]:
    """ST2: the state (etag, polls seen, emitted) after another sight, and whether the file became ready now."""
    if state is None or state[0] != etag:
        state = (etag, 0, False)
    seen = state[1] + 1
    ready = seen >= polls and not state[2]
    return (etag, seen, state[2] or ready), ready


def stable_files(polled: DataFrame, polls: int = STABLE_POLLS) -> DataFrame:
    """Streaming ST2: polled (file_id string, etag string, poll long) -> a row when a version becomes ready."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("poll")
        out = []
        for r in rows.itertuples():
            own, ready = step_stability(own, r.etag, polls)
            if ready:
                out.append((key[0], r.etag, r.poll))
        state.update(own)
        yield pd.DataFrame(out, columns=["file_id", "etag", "poll"])

    return polled.groupBy("file_id").applyInPandasWithState(run, "file_id string, etag string, poll long", "etag string, seen long, emitted boolean", "append", GroupStateTimeout.NoTimeout)


def stable_files_batch(polled: DataFrame, polls: int = STABLE_POLLS) -> DataFrame:
    """The batch twin: sights of one version in a row are an island; its polls-th row makes it ready."""
    w = Window.partitionBy("file_id").orderBy("poll")
    change = F.when(F.lag("etag").over(w).eqNullSafe(F.col("etag")), 0).otherwise(1)
    island = polled.withColumn("c_", change).withColumn("island_", F.sum("c_").over(w))
    nth = F.row_number().over(Window.partitionBy("file_id", "island_").orderBy("poll"))
    return island.withColumn("n_", nth).where(F.col("n_") == polls).select("file_id", "etag", "poll")


def batches_of(events: DataFrame, size: int, wait_seconds: int, key: str = "lane", ts: str = "ts", ident: str = "event_id") -> DataFrame:
    """ST4 as a batch: files in order; a batch closes with `size` files or when the next comes `wait_seconds` after its first.

    Rows are dealt by lane and sorted; they are stepped through as a stream, with a state of three values."""
    schema = StructType([*events.schema.fields, StructField("batch_no", LongType())])
    at_lane, at_time = events.columns.index(key), events.columns.index(ts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, no, n, first = None, -1, 0, None
        for batch in batches:
            out = []
            for own, t in zip(batch.column(at_lane).to_pylist(), batch.column(at_time).to_pylist(), strict=True):
                if own != lane:
                    lane, no, n = own, -1, size
                if n >= size or (t - first).total_seconds() >= wait_seconds:
                    no, n, first = no + 1, 0, t
                n += 1
                out.append(no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "batch_no"])

    return events.repartition(key).sortWithinPartitions(key, ts, ident).mapInArrow(run, schema)


class Batcher(StatefulProcessor):
    """ST4 as a stream: ready files of a lane wait until there are `size`, or `wait_ms` are over since the first."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "file_no long, seen_ms long")

    def _send(self, key, rows, released) -> pd.DataFrame:
        return pd.DataFrame([(key[0], r[0], released) for r in rows], columns=["lane", "file_no", "released_ms"])

    def handleInputRows(self, key, rows, timerValues):
        have = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        now = timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            have += [(int(r.file_no), now) for r in frame.sort_values("file_no").itertuples()]
        while len(have) >= self.size:
            yield self._send(key, have[: self.size], now)
            have = have[self.size :]
        self.waiting.put(have)
        if have:
            self.handle.registerTimer(now + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        have = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        now = timerValues.getCurrentProcessingTimeInMs()
        if have and now - min(r[1] for r in have) >= self.wait_ms:
            yield self._send(key, have, now)
            self.waiting.put([])

    def close(self) -> None:
        pass


def batch_stream(ready: DataFrame, size: int = 3, wait_seconds: int = 60) -> DataFrame:
    """Streaming ST4 with processing-time timers: ready (lane string, file_no long) -> lane, file_no, released_ms."""
    return ready.groupBy("lane").transformWithStateInPandas(Batcher(size, wait_seconds * 1000), "lane string, file_no long, released_ms long", "append", "processingTime")


def watched(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """ST1, S6, S9: a stream of the files of a folder with name, size, media type and the reason to leave them alone."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), "length", "modificationTime", F.sha2("content", 256).alias("sha256"), mime_of(F.col("content")).alias("mime"), ignore_reason(name).alias("ignored"))


def outbox(stream: DataFrame, send: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "document_id"):
    """ST12, K19 without the network: each micro-batch is reduced to one entry a key (the newest), sent, and its results are appended.

    The folder of a batch is named by its number, so a batch that is run again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct("*"), "seq").alias("r")).select("r.*")
        send(newest).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(stream: DataFrame, key: str, ts: str, keep: str = "1 day") -> DataFrame:
    """ST3: first row of each content key within the time to live."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def retry_state(attempts: Column, failed: Column, data_error: Column, most: int = 3) -> Column:
    """ST6: state after a try: errors are tried again up to `most` times, data errors never."""
    return F.when(~failed, "done").when(data_error | (attempts + 1 >= most), "quarantine").otherwise("error")


def rate_limited(events: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """ST9: adds in_window (rows of the key in the last `seconds`, this one included) and limited.

    Time is cut into stretches of `seconds`; a row counts in its own and in the next, so a hot key is many small groups."""
    step = seconds * 1_000_000
    at = events.withColumn("us_", F.unix_micros(ts)).withColumn("part_", F.floor(F.col("us_") / step))
    both = at.withColumn("own_", F.lit(True)).unionByName(at.withColumns({"own_": F.lit(False), "part_": F.col("part_") + 1}))
    w = Window.partitionBy(key, "part_").orderBy("us_").rangeBetween(-(step - 1), 0)
    out = both.withColumn("in_window", F.count("*").over(w)).where("own_").drop("us_", "part_", "own_")
    return out.withColumn("limited", F.col("in_window") > limit)
