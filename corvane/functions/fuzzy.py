"""Fuzzy string similarity by longest common subsequences, in Arrow batches.

``ratio`` is 100 * 2 * LCS / (|a| + |b|). ``token_set_ratio`` compares the shared words
with either side's whole word set. ``weighted_ratio`` blends these with partial
matches where the lengths differ much.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 0.0
    some = set(a)
    starts = [i for i in range(1 - n, len(b)) if b[max(0, i)] in some]
    return max((ratio(a, b[max(0, i) : i + n]) for i in starts), default=0.0)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    with_left, with_right = (both + " " + left).strip(), (both + " " + right).strip()
    best = ratio(with_left, with_right)
    return max(best, ratio(both, with_left), ratio(both, with_right)) if both else best


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    base, longer = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    words = max(token_sort_ratio(a, b), token_set_ratio(a, b))
    if longer < 1.5:
        return max(base, words * 0.95)
    part = 0.9 if longer <= 8 else 0.6
    partial_words = max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 100.0 if set(a.split()) & set(b.split()) else 0.0)
    return max(base, partial_ratio(a, b) * part, partial_words * 0.95 * part)


@F.pandas_udf(DoubleType())
def token_set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def weighted_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x or "", y or "") for x, y in zip(a, b)])
