"""Benchmark decontamination with spaced seeds.

A seed is two runs of three words at a fixed distance, so substituted words between them leave the hash as it is.
Hashes of all seeds of the benchmark are met with those of the training texts; the two texts are aligned at each hit
and compared word by word.  A document is contaminated by an item if some stretch of one alignment has MATCHES equal
words and a share of IDENTITY of its words are equal, substituted words at any places.

No such stretch is missed: it has at least 12 equal words in at most one run more than a third of their number, and
that leaves two runs of three words, or parts of one longer run, at most 13 places apart; DISTANCES has them all.

Of an item under 16 words, which can't hold 12 and lose a quarter, a share of IDENTITY of its words must be equal (9
of 12); its seeds are single runs of three words, for 8 words with one word left out too.  Items of under 8 words must
stand whole and unchanged.

The benchmark's seeds are broadcast only if the index they make, whose size is measured first, is under a bound; a
larger one is met by a join on the seed hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import kernels as K

#: Distances between the two runs of a seed.
RUN, DISTANCES = (0, 1, 2), range(1, 14)
#: Items of fewer words must be whole; of fewer than LONG words the matches wanted are a share of the item.
WHOLE, LONG = 8, 16
#: Seeds of items of exactly WHOLE words, besides RUN.
GAPPED = (0, 1, 3)
MATCHES, IDENTITY = 12, 0.75
#: Bytes of a word in the index: a hash, an item and a place for each seed that begins with it, and its own hash.
WORD_BYTES = 24 * len(DISTANCES) + 8
BROADCAST_BYTES = 96 << 20
BLOOM_BITS = 22
SALTS = 16


def _runs(h: np.ndarray) -> np.ndarray:
    return K.runs(h, RUN)


def _gapped(h: np.ndarray) -> np.ndarray:
    return K.mix(K.runs(h, GAPPED) + K.U(999))


def _whole(h: np.ndarray, n: int) -> np.ndarray:
    """Contiguous seeds of n words, n being the length of a short item."""
    return K.mix(K.runs(h, tuple(range(n))) + K.U(1000 + n))


def _pair(one: np.ndarray, two: np.ndarray, distance: int) -> np.ndarray:
    return K.mix(one + two * K.WORD_KEYS[10 + distance])


def _item_seeds(h: np.ndarray) -> list[np.ndarray]:
    """Seeds of an item, each array by place."""
    if len(h) < WHOLE:
        return [_whole(h, len(h))]
    t = _runs(h)
    if len(h) < LONG:
        return [t, _gapped(h)] if len(h) == WHOLE else [t]
    return [_pair(t[:-d], t[d:], d) for d in DISTANCES if len(t) > d]


def required(n: int, matches: int, identity: float) -> int:
    """Equal words asked of an item of n words."""
    if n < WHOLE:
        return n
    return min(matches, int(np.ceil(identity * n - 1e-9)))


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, identity: float) -> tuple[int, int, int]:
    """The stretch with the most equal words of those with the identity, where doc[i + shift] stands at item[i]: (matches, first and last place in doc, both included).

    It starts and ends with an equal word; of several, the first to end."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    total = np.concatenate([[0], np.cumsum(doc[lo + shift : hi + shift] == item[lo:hi])])
    # A stretch [i, j) has the identity if its balance does not fall; the earliest such i has the most equal words.
    balance = total - identity * np.arange(len(total))
    least = -np.minimum.accumulate(balance)
    start = np.searchsorted(least, -balance - 1e-9)
    gain = total - total[start]
    j = int(np.argmax(gain))
    equal = np.flatnonzero(np.diff(total[start[j] : j + 1]))
    first = int(start[j]) + lo + shift
    return (int(gain[j]), first + int(equal[0]), first + int(equal[-1])) if len(equal) else (0, first, first - 1)


class Index:
    """Seeds of a benchmark: sorted hashes with their item and place, and a bitmap that keeps most other windows out."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.words, hashes, item, place = [], [], [], [], []
        self.short: set[int] = set()
        self.middle: set[int] = set()
        runs: list[np.ndarray] = []
        for i, text in items:
            data = np.frombuffer(text, np.uint8)
            starts, ends, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
            h = K.word_hashes(data, starts, ends)
            if not len(h):
                continue
            found = _item_seeds(h)
            if len(h) < WHOLE:
                self.short.add(len(h))
            elif len(h) < LONG:
                self.middle.add(len(h))
            else:
                runs.append(_runs(h))
            for s in found:
                hashes.append(s)
                item.append(np.full(len(s), len(self.ids)))
                place.append(np.arange(len(s)))
            self.ids.append(i)
            self.words.append(h)
        cat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(cat, kind="stable")
        self.hash, self.item, self.place = cat[order], (np.concatenate(item) if item else cat.astype(int))[order], (np.concatenate(place) if place else cat.astype(int))[order]
        self.bloom, self.run_bloom = (_bitmap(x) for x in (self.hash, K.mix(np.concatenate(runs)) if runs else self.hash[:0]))

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in the text, items, places in the items) of equal seeds, short items' included."""
        t = _runs(h)
        everywhere = [_whole(h, n) for n in sorted(self.short) if len(h) >= n] + [t] * bool(self.middle) + [_gapped(h)] * (WHOLE in self.middle)
        found = [(np.arange(len(s)), s) for s in everywhere]
        if len(t):
            held = self.run_bloom[(K.mix(t) >> K.U(64 - BLOOM_BITS)).astype(np.int64)]
            for d in DISTANCES:
                at = np.flatnonzero(held[:-d] & held[d:])
                found.append((at, _pair(t[at], t[at + d], d)))
        for at, s in found:
            keep = self.bloom[(s >> K.U(64 - BLOOM_BITS)).astype(np.int64)]
            at, s = at[keep], s[keep]
            lo, hi = np.searchsorted(self.hash, s, "left"), np.searchsorted(self.hash, s, "right")
            n = hi - lo
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(at, n), self.item[k], self.place[k]

    def alignments(self, h: np.ndarray) -> np.ndarray:
        """Rows (place in the text, item, shift of the text against the item) of the hits."""
        found = list(self.hits(h))
        at, item, place = (np.concatenate([x[c] for x in found] + [np.zeros(0, np.int64)]).astype(np.int64) for c in range(3))
        return np.stack([at, item, at - place], axis=1)

    def matches(self, h: np.ndarray, matches: int, identity: float, found: np.ndarray | None = None) -> dict[int, tuple[int, int, int]]:
        """Best contaminating overlap of each item: item -> (matches, first, last word)."""
        best: dict[int, tuple[int, int, int]] = {}
        found = self.alignments(h)[:, 1:] if found is None else found
        for i, shift in np.unique(found, axis=0).tolist():
            n, first, last = overlap(h, self.words[i], shift, identity)
            if n >= required(len(self.words[i]), matches, identity) and (i not in best or (-n, first) < (-best[i][0], best[i][1])):
                best[i] = n, first, last
        return best


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BLOOM_BITS, bool)
    out[(hashes >> K.U(64 - BLOOM_BITS)).astype(np.int64)] = True
    return out


_OUT = "doc_id long, item_id long, n_match int, first_word int, last_word int"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, _TYPES, strict=True)], _NAMES)


def _match(index, matches: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, data, offs in K.slices(batch.column(1)):
                starts, ends, first = K.words(data, offs, K.ALNUM)
                h = K.word_hashes(data, starts, ends)
                found = own.alignments(h)
                doc = np.searchsorted(first, found[:, 0], "right") - 1
                order = np.argsort(doc, kind="stable")
                found, doc, out = found[order], doc[order], []
                for some in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []:
                    d = int(doc[some[0]])
                    shifts = found[some][:, 1:] - np.array([0, first[d]])
                    for i, (n, lo, hi) in own.matches(h[first[d] : first[d + 1]], matches, identity, shifts).items():
                        out.append((ids[a + d], own.ids[i], n, lo, hi))
                yield _rows(out)

    return run


def _emit(lengths: set[int] | None):
    """Seed hashes of texts, for the join: (id, seed).  lengths: those of the items under LONG words; None for the items' own seeds."""

    def seeds(h: np.ndarray) -> list[np.ndarray]:
        if lengths is None:
            return _item_seeds(h) if len(h) else []
        t = _runs(h)
        found = [_pair(t[:-d], t[d:], d) for d in DISTANCES if len(t) > d]
        found += [_whole(h, n) for n in sorted(lengths) if n < WHOLE and len(h) >= n]
        return found + [t] * any(n >= WHOLE for n in lengths) + [_gapped(h)] * (WHOLE in lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(data.as_py(), np.uint8)
                starts, ends, _ = K.words(raw, np.array([0, len(raw)]), K.ALNUM)
                for s in seeds(K.word_hashes(raw, starts, ends)):
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(s), pa.int64()), pa.array(K.signed(s))], ["id", "seed"])

    return run


def _pairs(matches: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, data, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(data, np.uint8)
                starts, ends, _ = K.words(raw, np.array([0, len(raw)]), K.ALNUM)
                for n, lo, hi in Index([(item, text)]).matches(K.word_hashes(raw, starts, ends), matches, identity).values():
                    out.append((doc, item, n, lo, hi))
            yield _rows(out)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", matches: int = MATCHES, identity: float = IDENTITY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Overlaps of documents with benchmark items: doc_id, item_id, n_match, first_word, last_word (the best of each pair).

    Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased; places count from 0.  The promise
    that no overlap is missed holds for matches of 12 and more and an identity of 0.75 and more.  Null and empty texts and items, and an empty
    benchmark, give no rows; repeated items give a row each; rows with a null id are left out; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), K.text_bytes(text).alias("data")).where("doc_id is not null")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), K.text_bytes(item_text).alias("item")).where("item_id is not null and length(item) > 0")
    words = F.size(F.filter(F.split(F.decode("item", "UTF-8"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    size = items.agg(F.coalesce(F.sum(words * WORD_BYTES + F.lit(64)), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        index = spark.sparkContext.broadcast(Index([(r.item_id, bytes(r.item)) for r in items.orderBy("item_id").collect()]))
        return base.mapInArrow(_match(index, matches, identity), _OUT)
    short = {r[0] for r in items.select(words.alias("n")).where(f"n between 1 and {LONG - 1}").distinct().collect()}
    one = base.mapInArrow(_emit(short), "id long, seed long").distinct().withColumnRenamed("id", "doc_id")
    two = items.mapInArrow(_emit(None), "id long, seed long").distinct().withColumnRenamed("id", "item_id")
    # A common seed may be in a third of the documents: the benchmark's side goes to each of SALTS parts of theirs.
    one = one.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    two = two.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    pairs = one.join(two, ["seed", "salt"]).select("doc_id", "item_id").distinct()
    return pairs.join(base, "doc_id").join(items, "item_id").select("doc_id", "item_id", "data", "item").mapInArrow(_pairs(matches, identity), _OUT)
