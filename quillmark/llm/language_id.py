"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1/-1 (seeded, never learned).  A trigram binds the vectors of its
letters, rotated by their place (elementwise product); a text bundles its trigrams (weighted sum); a language's
prototype bundles the normalised texts known to be in it.  A text gets the language of the nearest prototype by cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, SYMBOLS = 1024, 4096
#: At most about this many labelled texts, evenly by a hash of the id, are bundled into prototypes.
TRAIN_ROWS = 20_000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Symbol of each code point (0: no letter), and the letters' vectors rotated by 0, 1, 2."""
    symbol = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            symbol[c] = 1 + c % (SYMBOLS - 1)
    base = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (SYMBOLS, DIM), dtype=np.int8) * 2 - 1
    return symbol, [np.roll(base, k, axis=1) for k in (2, 1, 0)]


def encode(text: str | None) -> np.ndarray | None:
    """The bundled vector of a text, scaled to length 1; None without letters."""
    symbol, turned = _tables()
    if not text:
        return None
    s = symbol[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    if not s.any():
        return None
    s = np.concatenate([[0], s, [0]])
    s = s[np.append(True, (s[1:] > 0) | (s[:-1] > 0))]  # a run of other characters is one boundary
    grams, counts = np.unique(s[:-2] << 24 | s[1:-1] << 12 | s[2:], return_counts=True)
    out = np.zeros(DIM, np.float32)
    for k in range(0, len(grams), 1024):
        g, c = grams[k : k + 1024], counts[k : k + 1024]
        bound = turned[0][g >> 24] * turned[1][g >> 12 & 4095] * turned[2][g & 4095]
        out += c.astype(np.float32) @ bound.astype(np.float32)
    size = float(np.sqrt(out.astype(np.float64) @ out))
    return out / size if size else None


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (v := encode(text)) is not None:
                sums.setdefault(lang, np.zeros(DIM))
                sums[lang] += v
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(range(DIM), pa.int32()), pa.array(v)], ["lang", "dim", "value"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train: Column | None = None, max_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes of length 1, learned from rows with a language (and where train holds)."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if train is None else train))
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known
    rows = known.select(F.col(text), F.col(lang)).mapInArrow(_bundle, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r.lang for r in rows})
    out = np.zeros((len(langs), DIM))
    at = {x: i for i, x in enumerate(langs)}
    for r in rows:
        out[at[r.lang], r.dim] = r.value
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return langs, out / np.where(size > 0, size, 1)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, profiles = model.value
        for batch in batches:
            best, score = [], []
            for text in batch.column(0).to_pylist():
                v = encode(text) if langs else None
                if v is None:
                    best.append("und")
                    score.append(0.0)
                else:
                    cos = profiles @ v
                    k = int(np.argmax(cos))
                    best.append(langs[k])
                    score.append(float(min(1.0, max(0.0, cos[k]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(best, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) with lang_pred and score (cosine, 0 to 1) of each row's whole text.

    `und` with score 0 if the text is null, empty or has no letter, or nothing was learned.  Equal cosines: the first
    language in order.  Other columns pass through; those named lang_pred or score are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    own = docs.select(F.col(text).alias("text_"), *keep)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(_predict(sent), f"{shape + ', ' if shape else ''}lang_pred string, score double")
