"""Vectorised text kernels shared by the training-data operators.

A batch of documents arrives from Arrow as one contiguous byte buffer with offsets, so words,
shingles and windows of many documents are hashed by a handful of numpy passes, never by a loop
over characters.  Memory is bounded by SLICE bytes of text (or by one document, if longer).
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 18
U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of the contracts: everything but ASCII white space, and letters, digits and non-ASCII bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_rng = np.random.Generator(np.random.PCG64(20_240_607))
TABLES = [_rng.integers(0, 2**64, 256, dtype=np.uint64) for _ in range(2)]
BASES = [0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1]
WORD_KEYS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply); x is not kept."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, 2 * SLICE)
        inverse = pow(BASES[which], -1, 2**64)
        made = []
        for b in (BASES[which], inverse):
            a = np.full(n, b, dtype=np.uint64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=np.uint64))
        _powers[which] = have = (made[0], made[1])
    return have


def prefix(data: np.ndarray, which: int, lower: bool) -> np.ndarray:
    """Prefix sums of the polynomial hash; span_hash() turns two of them into the hash of a span."""
    table = TABLES[which][LOWER] if lower else TABLES[which]
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    step = table[data]
    step *= powers(which, len(data) + 1)[0][: len(data)]
    np.cumsum(step, out=out[1:])
    return out


def span_hash(sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], equal for equal bytes wherever they stand."""
    h = sums[end] - sums[start]
    h *= powers(which, len(sums))[1][start]
    h += (end - start).astype(np.uint64) * U(0xA0761D6478BD642F)
    return mix(h)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary column without nulls."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def _trimmer():
    """Gives memory that is free back to the system; nothing where the C library can't."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


_trim = _trimmer()


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about SLICE bytes.

    After a batch its worker's free memory goes back, as workers live on and many share a machine."""
    data, offs = buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + SLICE, side="right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b
    _trim(0)


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = is_word[data]
    edge = np.empty(len(w) + 1, dtype=bool)
    edge[0], edge[-1] = w[0], w[-1]
    np.not_equal(w[1:], w[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    inner = np.unique(offs[(offs > 0) & (offs < len(w))])
    cut = inner[w[inner] & w[inner - 1]]
    starts, ends = at[0::2], at[1::2]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the words with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return span_hash(prefix(data, which, True), which, starts, ends)


def runs(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """At i the hash of the elements i+o of h, o in offsets; as long as such windows fit."""
    n = max(0, len(h) - offsets[-1])
    out = np.zeros(n, dtype=np.uint64)
    for o in offsets:
        out += h[o : o + n] * WORD_KEYS[o % 64]
    return mix(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its shingles; a shorter text is one shingle."""
    starts, ends, first = words(data, offs, NOT_SPACE)
    h = word_hashes(data, starts, ends)
    grams = runs(h, tuple(range(width)))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield mix((h[a:b] * WORD_KEYS[: b - a]).sum(keepdims=True) + U(b - a))
        else:
            yield h[:0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_bytes(text: str | Column) -> Column:
    """The text as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(m))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only a local master may go without the setting: its executors share the driver's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/{os.getpid()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Paths of the tables written so far, oldest first.
_written: list[str] = []
#: Set while a table is written: its shuffle files go, and Arrow batches of long texts are small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors.

    The shuffle files that led to it go as soon as it is written: nothing reads them again."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold 8 MB at most from now on, unless it says otherwise itself: texts may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, _WRITING[key])


def discard(*tables: DataFrame) -> None:
    """Removes tables of stored() that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t.stored_path)


def written() -> int:
    """How many tables have been written; for clear()."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Removes the tables written since then; to be called when the results that read them are written."""
    for path in _written[since:]:
        if path != keep:
            remove(spark, path)
    _written[since:] = [p for p in _written[since:] if p == keep]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """docs with row_key_, a key of each row in the order of the ids, and whether ids repeat.

    The key is the id if all are unique; else rows are sorted by id and text, so of repeated rows the one with the
    smaller text counts as earlier (equal ones in any order), and those without an id are left out."""
    known = docs.withColumn("row_key_", F.col(doc_id).cast("long"))
    if known.where("row_key_ is not null").groupBy("row_key_").count().where("count > 1").limit(1).count() == 0:
        return known, False
    ordered = known.where("row_key_ is not null").orderBy("row_key_", F.col(text).asc_nulls_first())
    return stored(ordered.withColumn("row_key_", F.monotonically_increasing_id()), "row-keys"), True
