"""String similarities that Spark lacks, as Arrow-batched UDFs (M1-M4, M9, F35 on words)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp; not symmetric; null counts as empty; two empty texts are equal."""
    return SequenceMatcher(None, a or "", b or "").ratio()


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Jaro with a prefix bonus of .1 for up to 4 letters at any similarity."""
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == ch), None)
        if j is not None:
            used[j] = True
            left.append(ch)
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + same * 0.1 * (1 - jaro)


def edit_distance(a: list, b: list) -> int:
    """Levenshtein over any items."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(IntegerType())
def word_edits_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], dtype="int32")
