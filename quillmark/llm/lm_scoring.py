"""Language-model scores: the marginal likelihood of a text over all its subword segmentations.

The pieces are those of an existing vocabulary, which gives each a rank but no unigram probability (no unigram file is
at hand); Zipf's law on the ranks is the start, and ROUNDS of expectation and maximisation over all segmentations of all
training words, weighted by their counts, make the probabilities.  No piece crosses white space, so a text's probability
is the product of its words' and of one end; a word's is the sum over all segmentations, by the forward recursion in log
space.  Each distinct word is therefore scored once, not once per place.

Word counts are a table, never gathered on the driver.  The most frequent words (at most HEAD, of at most HEAD_BYTES each)
are broadcast; occurrences of all others meet the table in a join, so the words sent around are the rare ones only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import kernels as K

PIECES = "piece_bpe_32k.model"
HEAD, HEAD_BYTES = 150_000, 64
ROUNDS = 1
#: Words with a smaller probability are learned from in halves.
LEAST = 1e-280
GAP = "▁"


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _words(text: bytes) -> list[bytes]:
    """Runs of bytes outside ASCII white space, with A-Z lower-cased (both exactly as bytes do it)."""
    return text.lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])
        c.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            c.update(_words(text.as_py()))
            if len(c) > 300_000:
                yield flush()
    yield flush()


def _expect_pieces(path: str, counts):
    """How often each piece is expected over all segmentations of the words, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = _lattice(path, counts.value), [0.0] * len(counts.value)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lattice.expect(w.decode("utf-8", "replace"), c, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.array(total)[at])], ["piece", "c"])

    return run


class Lattice:
    """Marginal log10 probability of a word over all its segmentations into pieces."""

    def __init__(self, pieces: dict[str, float], by_byte: list[float], ids: dict[str, int] | None = None, byte_ids: list[int] | None = None):
        self.by_byte = by_byte
        #: Log probability of each piece; 0.0 for what only begins one.
        self.begun = {w[:k]: 0.0 for w in pieces for k in range(1, len(w))} | pieces
        self.ids, self.byte_ids = ids or {w: i for i, w in enumerate(pieces)}, byte_ids or list(range(len(pieces), len(pieces) + 256))
        self.linear = {w: (math.exp(p) if p else 0.0, self.ids.get(w, -1)) for w, p in self.begun.items()}

    def expect(self, word: str, c: float, total: list[float]) -> None:
        """Adds to total, for each piece, c times how often it is expected in a segmentation of the word."""
        s, get = GAP + word, self.linear.get
        n = len(s)
        alpha, arcs = [0.0] * (n + 1), []
        alpha[0] = 1.0
        for i in range(n):
            a = alpha[i]
            known = False
            for j in range(i + 1, n + 1):
                hit = get(s[i:j])
                if hit is None:
                    break
                p, piece = hit
                if p:
                    known |= j == i + 1
                    alpha[j] += a * p
                    arcs.append((i, j, p, piece))
            if not known:
                p = math.exp(sum(self.by_byte[x] for x in s[i].encode("utf-8", "replace")))
                alpha[i + 1] += a * p
                arcs.append((i, i + 1, p, -1))
        if alpha[n] < LEAST:
            # Too small for a number: the halves are learned from, so one place between pieces is given.
            if len(word) > 1:
                self.expect(word[: len(word) // 2], c, total)
                self.expect(word[len(word) // 2 :], c, total)
            return
        beta = [0.0] * n + [c / alpha[n]]
        for i, j, p, piece in reversed(arcs):
            b = p * beta[j]
            beta[i] += b
            b *= alpha[i]
            if piece >= 0:
                total[piece] += b
            else:
                for x in s[i].encode("utf-8", "replace"):
                    total[self.byte_ids[x]] += b

    def word(self, word: str) -> float:
        s, get, ln10 = GAP + word, self.begun.get, math.log(10)
        n = len(s)
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        log1p, exp = math.log1p, math.exp
        for i in range(n):
            a = alpha[i]
            known = False
            for j in range(i + 1, n + 1):
                p = get(s[i:j])
                if p is None:
                    break
                if p:
                    known |= j == i + 1
                    p += a
                    b = alpha[j]
                    alpha[j] = p if b == -math.inf else (p + log1p(exp(b - p)) if p > b else b + log1p(exp(p - b)))
            if not known:  # a character without a piece is spelled in bytes
                p = a + sum(self.by_byte[x] for x in s[i].encode("utf-8", "replace"))
                b = alpha[i + 1]
                alpha[i + 1] = p if b == -math.inf else max(p, b) + log1p(exp(-abs(p - b)))
        return alpha[n] / ln10


def _lattice(path: str, counts: np.ndarray) -> Lattice:
    model = _model(path)
    logs = np.log((counts + 1) / (counts.sum() + len(counts)))
    pieces, ids, by_byte, byte_ids = {}, {}, [float(logs[0])] * 256, [0] * 256
    for i in range(len(counts)):
        if model.is_byte(i):
            x = int(model.id_to_piece(i)[3:5], 16)
            by_byte[x], byte_ids[x] = float(logs[i]), i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)], ids[model.id_to_piece(i)] = float(logs[i]), i
    return Lattice(pieces, by_byte, ids, byte_ids)


def _by_rank(path: str) -> np.ndarray:
    """Counts by Zipf's law on the vocabulary's ranks; bytes come last."""
    model = _model(path)
    n = model.get_piece_size()
    rank = np.array([n if model.is_byte(i) else max(0.0, -model.get_score(i)) for i in range(n)])
    return 1e6 / (rank + 3.0)


def _score_words(path: str, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path, counts.value)
        for batch in batches:
            lp = [lattice.word(w.decode("utf-8", "replace")) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp, pa.float64())], [*batch.schema.names, "lp"])

    return run


_DOC = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, word binary, times int"


def _score_docs(head, unseen: float, end: tuple[int, float, float], known_end: int):
    names = [x.split()[0] for x in _DOC.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = head.value.get
        for batch in batches:
            rows, tail = [], []
            for doc, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = _words(text.as_py())
                base, model, seen = end[1], end[2], known_end
                for w, k in Counter(words).items():
                    if (own := get(w)) is None:
                        tail.append((doc, w, k))
                    else:
                        seen += k
                        base += k * own[0]
                        model += k * own[1]
                rows.append((doc, held, len(words) + 1, seen, base, model, None, None))
                if len(tail) > 50_000:
                    yield from send(rows, tail)
                    rows, tail = [], []
            yield from send(rows, tail)

    def send(rows, tail):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if tail:
            doc, word, times = zip(*tail, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, types[0]), *(pa.nulls(len(doc), t) for t in types[1:6]), pa.array(word, types[6]), pa.array(times, types[7])], names)

    return run


def _unseen(path: str, counts):
    """Scores for words that training has not: lp where the join found none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, cache = _lattice(path, counts.value), {}
        for batch in batches:
            lp = batch.column(4).to_pylist()
            for i, (w, p) in enumerate(zip(batch.column(1).to_pylist(), lp, strict=True)):
                if p is None:
                    if w not in cache:
                        if len(cache) > 50_000:
                            cache.clear()
                        cache[w] = lattice.word(w.decode("utf-8", "replace"))
                    lp[i] = cache[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(lp, pa.float64())], ["doc_id", "times", "c", "lp"])

    return run


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", pieces: str | None = None) -> DataFrame:
    """Score whole texts by a model of the rows where held_out is false.

    Returns a row per document: doc_id, held_out, n_tokens (words and one end), n_known (those seen in training),
    train_tokens, base_score (add-one unigram over words and the end, log10), score (log10 marginal probability over
    all segmentations, the end included; pieces of a very long word are learned from its halves).  Null texts count as empty: one end.  Without training rows every word is
    unseen and the vocabulary empty.  Rows with a null id are left out, those with one id are scored each; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows, repeated = K.keyed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out")), "doc_id", "text")
    if repeated:
        out = score(rows, F.col("held_out"), "row_key_", "text", pieces).withColumnRenamed("doc_id", "row_key_")
        return out.join(rows.select("row_key_", "doc_id"), "row_key_").select("doc_id", *[c for c in out.columns if c != "row_key_"])
    if pieces is None:
        import public_tokenizers

        pieces = public_tokenizers.path(PIECES)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), K.text_bytes(text).alias("data")).where("doc_id is not null")
    train = base.where("not held_out")
    words = K.stored(train.select("data").mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    n_docs = train.count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total.n + n_docs, total.v + (n_docs > 0)
    counts = _by_rank(pieces)
    for _ in range(ROUNDS):
        found = words.mapInArrow(_expect_pieces(pieces, spark.sparkContext.broadcast(counts)), "piece long, c double").groupBy("piece").agg(F.sum("c").alias("c")).collect()
        counts = np.zeros(len(counts))
        for r in found:
            counts[r.piece] = r.c
    counts[_model(pieces).eos_id()] = n_docs
    sent = spark.sparkContext.broadcast(counts)
    scored = K.stored(words.mapInArrow(_score_words(pieces, sent), "word binary, c long, lp double"), "lm-scored")

    def base_of(c: int) -> float:
        return math.log10((c + 1) / (n + v + 1))

    # At most HEAD words from a count on, found by a histogram of at most a thousand rows: no task sends its own best.
    level = F.floor(F.log2("c") * 16)
    short = scored.where(F.length("word") <= HEAD_BYTES)
    least, size = None, 0
    for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():
        size += r.k
        if size > HEAD:
            break
        least = r.level
    top = short.where(level >= least).collect() if least is not None else []
    head = spark.sparkContext.broadcast({bytes(r.word): (base_of(r.c), r.lp) for r in top})
    end = (n_docs, base_of(n_docs), math.log10((n_docs + 1) / (float(counts.sum()) + len(counts))))
    made = K.stored(base.mapInArrow(_score_docs(head, base_of(0), end, int(n_docs > 0)), _DOC), "lm-docs")
    tail = made.where("word is not null").select("word", "doc_id", "times").join(scored, "word", "left")
    tail = tail.select("doc_id", "word", "times", F.coalesce("c", F.lit(0)).alias("c"), "lp").mapInArrow(_unseen(pieces, sent), "doc_id long, times int, c long, lp double")
    tail = tail.select("doc_id", F.when(F.col("c") > 0, F.col("times")).otherwise(0).cast("long").alias("n_known"), (F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("base"), (F.col("times") * F.col("lp")).alias("model"))
    whole = made.where("word is null").select("doc_id", "held_out", "n_tokens", "n_known", "base", "model")
    both = whole.unionByName(tail, allowMissingColumns=True).groupBy("doc_id")
    out = both.agg(F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
