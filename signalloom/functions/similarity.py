"""Jaro-Winkler as one vectorised pandas UDF over candidate pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _jaro_winkler(a: str, b: str, floor_transpositions: bool) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach), i + reach + 1)
        while j >= 0 and used[j]:
            j = b.find(ch, j + 1, i + reach + 1)
        if j >= 0:
            used[j] = True
            left.append(ch)
    m = len(left)
    if m == 0:
        return 0.0
    right = [ch for ch, u in zip(b, used) if u]
    moved = sum(x != y for x, y in zip(left, right))
    t = moved // 2 if floor_transpositions else moved / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    shared = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        shared += 1
    return jaro + shared * 0.1 * (1 - jaro)


def jaro_winkler(a: Column, b: Column, floor_transpositions: bool = False) -> Column:
    """Similarity of two names in 0..1.

    Half transpositions count by default; ``floor_transpositions`` gives the
    variant most databases implement.
    """

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_jaro_winkler(p, q, floor_transpositions) for p, q in zip(x, y)], dtype="float64")

    return score(a, b)
