"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone: those that come back as one token are proven
whole.  A text is normalised and cut into pre-tokens as the tokenizer does it; a whole pre-token counts one, and only
the rest are merged, each distinct one once per worker.  Texts outside the repertoire for which the cutting is equal (most
code points below U+0500 and general punctuation), not in NFC, or with special strings, go to the library as they are.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
CACHE = 400_000
#: Fixed: the tokenizer file's own split pattern; after normalisation the only white space is the space.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: What Python and the library class or lower-case differently, or might: separators, fractions, final sigma, the rest of Unicode.
OTHER = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\xb2\xb3\xb9\xbc-\xbe\u03a3]|[^\u0000-\u04ff\u2010-\u2027\u2030-\u205e\u20ac]")
END = "</w>"
_loaded: dict[str, tuple] = {}


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _loaded[path] = t, [a.content for a in t.get_added_tokens_decoder().values()], {}
    return _loaded[path]


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(0x100 + len(out) - len(plain))] = b
    return out


def whole_tokens(path: str) -> set[str]:
    """Pre-tokens that the tokenizer encodes alone as one token; proven one by one."""
    t, _, _ = _tokenizer(path)
    letters = _byte_letters()
    words = []
    for piece in t.get_vocab():
        if piece.endswith(END) and all(c in letters for c in piece[: -len(END)]):
            try:
                words.append(bytes(letters[c] for c in piece[: -len(END)]).decode())
            except UnicodeDecodeError:
                continue
    made = t.encode_batch(words, add_special_tokens=False)
    return {w for w, e in zip(words, made, strict=True) if len(e.ids) == 1 and PIECES.fullmatch(w) and t.normalizer.normalize_str(w) == w}


def _merged(pieces: set[str], path: str) -> dict[str, int]:
    """Tokens of each pre-token, merged by the tokenizer's own model."""
    t, _, _ = _tokenizer(path)
    tokenize, standing = t.model.tokenize, {b: c for c, b in _byte_letters().items()}
    return {p: len(tokenize(p if p.isascii() else "".join(standing[b] for b in p.encode()))) for p in pieces}


def count_texts(texts: list[str | None], path: str, whole: set[str]) -> list[int]:
    """Tokens of each text.  No pre-token crosses white space, so counts of the stretches between are kept and added."""
    t, special, cache = _tokenizer(path)
    cut: list[list[str] | None] = []
    for text in texts:
        if not text:
            cut.append([])
        elif OTHER.search(text) or any(s in text for s in special) or not unicodedata.is_normalized("NFC", text):
            cut.append(None)
        else:
            cut.append(text.lower().split())
    if len(cache) > CACHE:
        cache.clear()
    new = {w: PIECES.findall(w) for w in {w for own in cut if own for w in own if w not in cache}}
    rest = _merged({p for pieces in new.values() for p in pieces if p not in whole}, path)
    cache.update((w, sum(1 if p in whole else rest[p] for p in pieces)) for w, pieces in new.items())
    return [len(t.encode(text, add_special_tokens=False).ids) if own is None else sum(map(cache.__getitem__, own)) for text, own in zip(texts, cut, strict=True)]


def _count(path: str, whole):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[int] = []
            for k in range(0, batch.num_rows, 256):
                n += count_texts(batch.column(0).slice(k, 256).to_pylist(), path, whole.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], [*batch.schema.names[1:], "n_tokens"])

    return run


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) with n_tokens of each row's whole text, as the tokenizer's library counts them
    without begin, end or added special tokens.  tokenizer: path of a BPE .json file with `</w>` word ends and the
    pattern above.  Null and empty texts have 0 tokens.  A column named n_tokens is replaced; others pass through."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "n_tokens"]
    own = docs.select(F.col(text).alias("text_"), *keep)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))
    return own.mapInArrow(_count(tokenizer, whole), f"{shape + ', ' if shape else ''}n_tokens long")
