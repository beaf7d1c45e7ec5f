"""Suffix-array de-duplication: repeated byte windows, found by a depth-limited radix sort of suffixes.

Only suffixes at *anchors* are ordered.  An anchor is the least 32-byte gram of some window of `window`
bytes (ties: leftmost), so two equal windows, wherever they stand, have an anchor at the same distance
from their start: ordering the anchors' suffixes misses no repeated window, with about 1/35 of the rows.

The sort is most significant digit first and never goes deeper than the threshold:
  digit 1  the 32-byte gram at the anchor; a gram that occurs once can't be in a repeated window
  digit 2  the whole stretch of text whose windows have this anchor; in an equal group all windows repeat
           the first member's, so the others are removed without a look at single windows
  digit 3  quarters of such stretches, only for the first members of different stretches with one gram: first
           the bytes common to all windows of the quarter, then the whole quarter
  digit 4  the windows themselves, only for the first members of different quarters with equal common bytes
Each pass is a shuffle by digit and a sort within partitions that streams over groups with a state of one
row, so a group of any size is never gathered.  A member that its own task already knows not to be the first of
its group is dealt out at random, not by its digit: of a hot group about one row a task meets in one place.
Digits are compared by hashes: 64 bits for each digit, and two independent 64-bit hashes for each decision to remove.

This is not the plain sort of every suffix, token by token: that would shuffle a row for each byte of text, over ten
times the input.  Anchors stand for the suffixes around them, and a digit is a stretch of bytes; what comes out is
the same, as equal groups at the last depth are exactly the repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.llm import kernels as K

WINDOW, GRAM = 100, 32
_POS = 22


class _Firsts:
    """Of the groups met lately in one task, the least member so far: tells rows that can't be first of their group.

    A table of fixed size; a group that another one took the place of is only sent again.  The least member of a group
    is never told to be later, whatever the order of rows."""

    def __init__(self, bits: int = 17):
        self.shift = K.U(64 - bits)
        self.key, self.doc, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.iinfo(np.int64).max), np.zeros(1 << bits, np.int64)

    def later(self, key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), bool)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if same.any():
            sub = order[np.append(same, False) | np.append(False, same)]
            sub = sub[np.lexsort((place[sub], doc[sub], key[sub]))]
            out[sub[1:][key[sub][1:] == key[sub][:-1]]] = True
        least = np.flatnonzero(~out)
        at = (key[least] >> self.shift).astype(np.int64)
        known = self.key[at] == key[least]
        after = known & ((self.doc[at] < doc[least]) | ((self.doc[at] == doc[least]) & (self.place[at] <= place[least])))
        out[least[after]] = True
        at, least = at[~after], least[~after]
        at, last = np.unique(at[::-1], return_index=True)
        least = least[::-1][last]
        self.key[at], self.doc[at], self.place[at] = key[least], doc[least], place[least]
        return out


def _routed(firsts: _Firsts, d1: np.ndarray, d2: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """digit1 and place as sent: of rows that aren't first, digit1 is random and place is ~place (negative)."""
    gone = firsts.later(K.mix(d1 + K.mix(d2)), doc, place)
    spread = K.mix(doc.astype(np.uint64) * K.WORD_KEYS[3] + place.astype(np.uint64) * K.WORD_KEYS[4])
    return np.where(gone, spread, d1), np.where(gone, ~place, place)


def _pieces(ids: np.ndarray, column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, place of the first byte in its text, bytes, offsets); long texts come in overlapping pieces."""
    for a, b, data, offs in K.slices(column):
        if len(data) <= 2 * K.SLICE:
            yield ids[a:b], np.zeros(b - a, np.int64), data, offs
        else:
            for at in range(0, len(data), K.SLICE):
                own = data[at : at + K.SLICE + window - 1]
                yield ids[a:b], np.array([at]), own, np.array([0, len(own)])


def _anchors(window: int, gram: int):
    width = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts()
        for batch in batches:
            for ids, base, data, offs in _pieces(batch.column(0).to_numpy(), batch.column(1), window):
                count = np.maximum(0, np.diff(offs) - window + 1)
                if not count.any():
                    continue
                row = np.repeat(np.arange(len(ids)), count)
                at = np.arange(len(row)) + np.repeat(offs[:-1] - (np.cumsum(count) - count), count)
                sums = K.prefix(data, 0, False)
                n = len(data) - gram + 1
                h = sums[gram:] - sums[:-gram]
                h *= K.powers(0, len(sums))[1][:n]
                h = K.mix(h)
                least = (h >> K.U(_POS) << K.U(_POS)) | np.arange(n, dtype=np.uint64)
                step = 1
                while 2 * step <= width:
                    least = np.minimum(least[:-step], least[step:])
                    step *= 2
                if rest := width - step:
                    least = np.minimum(least[:-rest], least[rest:])
                anchor = (least[at] & K.U((1 << _POS) - 1)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                last = np.append(first[1:], len(at)) - 1
                lo, hi, p, row = at[first], at[last], anchor[first], row[first]
                deep = K.span_hash(K.prefix(data, 1, False), 1, lo, hi + window)
                deep = K.mix(deep + (p - lo).astype(np.uint64) * K.WORD_KEYS[0] + (hi - lo).astype(np.uint64) * K.WORD_KEYS[1])
                place = (lo - offs[row] + base[row] << 16) | ((p - lo) << 8) | (hi - lo)
                digit1, place = _routed(firsts, h[p], deep, ids[row], place)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(digit1)), pa.array(K.signed(deep)), pa.array(ids[row]), pa.array(place)], ["digit1", "digit2", "doc_id", "place"])

    return run


def _classes(window: int):
    """Over rows sorted by digit1, digit2, doc_id, place: what to remove (kind 0), and first members of unequal stretches (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None  # the newest first member, (digit1, doc, place, whether others share its digit1 before it); the last row's digits
        for batch in batches:
            d1, d2, doc, place = (c.to_numpy() for c in batch.columns)
            if (told := place < 0).any():  # their task knew an earlier member
                yield _spans(doc[told], ~place[told], told.sum())
                d1, d2, doc, place = d1[~told], d2[~told], doc[~told], place[~told]
            if not len(d1):
                continue
            new1, new2 = np.empty(len(d1), bool), np.empty(len(d1), bool)
            new1[1:] = d1[1:] != d1[:-1]
            new2[1:] = new1[1:] | (d2[1:] != d2[:-1])
            new1[0] = last is None or last[0] != d1[0]
            new2[0] = new1[0] or last[1] != d2[0]
            last = d1[-1], d2[-1]
            again = ~new2
            reps = np.flatnonzero(new2)
            alone = new1[reps]
            r_doc, r_place = doc[reps], place[reps]
            if held is not None:
                alone, r_doc, r_place = np.append(held[2], alone), np.append(held[0], r_doc), np.append(held[1], r_place)
            if len(r_doc):
                many = ~alone[:-1] | ~alone[1:]
                held = r_doc[-1], r_place[-1], alone[-1]
                yield _spans(np.append(doc[again], r_doc[:-1][many]), np.append(place[again], r_place[:-1][many]), again.sum())
            else:
                yield _spans(doc[again], place[again], again.sum())
        if held is not None and not held[2]:
            yield _spans(np.array([held[0]]), np.array([held[1]]), 0)

    def _spans(doc: np.ndarray, place: np.ndarray, removed: int) -> pa.RecordBatch:
        lo, ahead, more = place >> 16, (place >> 8) & 255, place & 255
        kind = (np.arange(len(doc)) >= removed).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo.astype(np.int32)), pa.array((lo + more + np.where(kind == 0, window, 1)).astype(np.int32)), pa.array(kind), pa.array((lo + ahead).astype(np.int32))], ["doc_id", "lo", "hi", "kind", "anchor"])

    return run


def _stretches(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, place of the first byte, bytes; first window starts, ends of the window starts, anchors) of the pieces that hold given stretches."""
    lists = batch.column(2)
    for i, doc in enumerate(batch.column(0).to_pylist()):
        data, _ = K.buffers(batch.column(1).slice(i, 1))
        lo, hi, anchor = (f.to_numpy().astype(np.int64) for f in lists[i].values.flatten())
        for a in range(0, max(1, len(data)), K.SLICE):
            s, e = np.maximum(lo, a) - a, np.minimum(hi, a + K.SLICE) - a
            if (own := e > s).any():
                yield doc, a, data[a : a + K.SLICE + window - 1], s[own], e[own], anchor[own] - a


def _quarters(window: int, gram: int):
    """Stretches cut where the anchor's distance from the window's start is a multiple of a quarter of its range.

    digit1 is the hash of the bytes that all windows of such a quarter share, digit2 that of all its bytes here."""
    width = -(-(window - gram + 1) // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts()
        for batch in batches:
            for doc, a, data, s, e, p in _stretches(batch, window):
                low, high = (p - e + 1) // width, (p - s) // width
                n = high - low + 1
                q = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p = np.repeat(p, n)
                at, end = np.maximum(np.repeat(s, n), p - q * width - width + 1), np.minimum(np.repeat(e, n), p - q * width + 1)
                sums = [K.prefix(data, k, False) for k in (0, 1)]
                core = K.span_hash(sums[0], 0, p - q * width, p - q * width - width + 1 + window)
                core = K.mix(core + q.astype(np.uint64) * K.WORD_KEYS[2])
                whole = K.span_hash(sums[1], 1, at, end - 1 + window)
                whole = K.mix(whole + (p - at).astype(np.uint64) * K.WORD_KEYS[0] + (end - at).astype(np.uint64) * K.WORD_KEYS[1])
                digit1, place = _routed(firsts, core, whole, np.full(len(at), doc), ((at + a) << 16) | ((p - at) << 8) | (end - at - 1))
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(digit1)), pa.array(K.signed(whole)), pa.array(np.full(len(at), doc)), pa.array(place)], ["digit1", "digit2", "doc_id", "place"])

    return run


def _windows(window: int):
    """Hashes of the windows that start in the given stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts()
        for batch in batches:
            for doc, a, data, s, e, _ in _stretches(batch, window):
                n = e - s
                at = np.arange(n.sum()) + np.repeat(s - (np.cumsum(n) - n), n)
                w = [K.span_hash(K.prefix(data, k, False), k, at, at + window) for k in (0, 1)]
                w1, lo = _routed(firsts, w[0], w[1], np.full(len(at), doc), at + a)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(w1)), pa.array(K.signed(w[1])), pa.array(np.full(len(at), doc)), pa.array(lo.astype(np.int32))], ["w1", "w2", "doc_id", "lo"])

    return run


def _later(window: int):
    """Over rows sorted by w1, w2, doc_id, lo: all but the first of equal windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            w1, w2, doc, lo = (c.to_numpy() for c in batch.columns)
            same = lo < 0  # their task knew an earlier window
            lo = np.where(same, ~lo, lo)
            rest = np.flatnonzero(~same)
            if len(rest):
                own1, own2 = w1[rest], w2[rest]
                again = np.empty(len(rest), bool)
                again[1:] = (own1[1:] == own1[:-1]) & (own2[1:] == own2[:-1])
                again[0] = last == (own1[0], own2[0])
                last = own1[-1], own2[-1]
                same[rest] = again
            yield pa.RecordBatch.from_arrays([pa.array(doc[same]), pa.array(lo[same]), pa.array(lo[same] + np.int32(window))], ["doc_id", "lo", "hi"])

    return run


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal disjoint runs; runs that touch are one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def _whole(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the characters that they hold only in part."""
    out = []
    for lo, hi in runs:
        while lo < hi and lo and data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        if hi > lo:
            out.append((lo, hi))
    return out


def _cut(whole_chars: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                out = _cut_batch(part.select([0, 1, 3]), whole_chars)
                yield pa.RecordBatch.from_arrays([*out.columns, part.column(2)], [*_CUT_NAMES, "rest"])

    return run


def _cut_batch(batch: pa.RecordBatch, whole_chars: bool) -> pa.RecordBatch:
    out = []
    for doc, data, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        runs = []
        if spans.is_valid:
            lo, hi = merge_spans(spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy())
            runs = list(zip(lo.tolist(), hi.tolist(), strict=True))
            runs = _whole(data, runs) if whole_chars else runs
        kept, at = [], 0
        for lo, hi in runs:
            kept.append(data[at:lo])
            at = hi
        kept.append(data[at:])
        text = b"".join(kept)
        out.append((doc, len(data), len(data) - len(text), len(runs), K.sha(text), text, [{"lo": a, "hi": b} for a, b in runs]))
    columns = zip(*out, strict=True) if out else [[]] * len(_CUT_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CUT_TYPES, strict=True)], _CUT_NAMES)


_CUT_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
_CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]


def dedup_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, whole_chars: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Remove every byte covered by a `window`-byte string that also starts earlier.

    Earlier: in a document with a smaller id, or before in the same one.  One row for each row of docs:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (remaining bytes), spans, and with
    `keep` a struct `rest` of those columns of docs.
    whole_chars: keep the characters that a removed run cuts, so that what is kept is UTF-8.
    Null and empty texts have no bytes and nothing removed; texts shorter than the window stay whole; other
    columns are ignored; rows with a null id are left out.  Of rows with one id, that with the smaller text is earlier.
    """
    gram = min(GRAM, window)
    if not 8 <= window <= 255 + gram:
        raise ValueError("window must be from 8 to 287 bytes")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep or []], F.col(doc_id).cast("long").alias("own_id_")).alias("rest"))
    rows, _ = K.keyed(own, "doc_id", "text")
    n = K.parts(docs.sparkSession)
    base = rows.where("row_key_ is not null").select("row_key_", K.text_bytes("text").alias("data"), "rest")
    digits, spans = "digit1 long, digit2 long, doc_id long, place long", "doc_id long, lo int, hi int, kind int, anchor int"
    # In order, so that a task that runs again sends the same rows.
    span = F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")
    stretch = F.array_sort(F.collect_list(F.struct("lo", "hi", "anchor"))).alias("spans")

    def classes(rows: DataFrame, name: str) -> DataFrame:
        ordered = rows.repartition(n, "digit1").sortWithinPartitions("digit1", "digit2", "doc_id", "place")
        return K.stored(ordered.mapInArrow(_classes(window), spans), name)

    def unequal(found: DataFrame) -> DataFrame:
        texts = base.select(F.col("row_key_").alias("doc_id"), "data")
        return texts.join(found.where("kind = 1").groupBy("doc_id").agg(stretch), "doc_id")

    whole = classes(base.select("row_key_", "data").mapInArrow(_anchors(window, gram), digits), "suffix-stretches")
    quarter = classes(unequal(whole).mapInArrow(_quarters(window, gram), digits), "suffix-quarters")
    windows = unequal(quarter).mapInArrow(_windows(window), "w1 long, w2 long, doc_id long, lo int")
    later = windows.repartition(n, "w1").sortWithinPartitions("w1", "w2", "doc_id", "lo").mapInArrow(_later(window), "doc_id long, lo int, hi int")
    gone = whole.unionByName(quarter).where("kind = 0").drop("kind", "anchor").unionByName(later).groupBy(F.col("doc_id").alias("row_key_")).agg(span)
    gone = K.stored(gone, "suffix-spans")
    K.discard(whole, quarter)
    schema = StructType([*StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<lo:int,hi:int>>"), base.schema["rest"]])
    out = base.join(gone, "row_key_", "left").select("row_key_", "data", "rest", "spans").mapInArrow(_cut(whole_chars), schema)
    out = out.withColumn("doc_id", F.col("rest.own_id_"))
    return out.select(*_CUT_NAMES, F.col("rest").dropFields("own_id_").alias("rest")) if keep else out.select(_CUT_NAMES)
