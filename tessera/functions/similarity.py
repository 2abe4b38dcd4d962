"""String similarities in [0, 1]: column functions over two text columns.

Levenshtein is a built-in.  The others are Arrow UDFs over plain functions of two strings; equal pairs of a batch are worked out
once.  Null counts as the empty string.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one bit of an integer per character of the longer text.

    What both start with is part of one, so only the rest is compared.
    """
    if len(a) < len(b):
        a, b = b, a
    same, beyond = 0, len(b) + 1
    while beyond - same > 1:
        mid = (same + beyond) // 2
        same, beyond = (mid, beyond) if a.startswith(b[same:mid], same) else (same, mid)
    if same:
        return same + lcs_length(a[same:], b[same:])
    if not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & where.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def indel(a: str, b: str) -> float:
    """1 - (insertions + deletions) / (length of both); two empty strings are equal."""
    n = len(a) + len(b)
    return 1.0 if a == b else 2 * lcs_length(a, b) / n if n else 1.0


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best of three comparisons of the shared words and each side's words; 1 if one side has no word of its own, 0 if one is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (only_x and only_y):
        return 1.0
    common, dx, dy = " ".join(both), " ".join(only_x), " ".join(only_y)
    best = indel(" ".join(filter(None, (common, dx))), " ".join(filter(None, (common, dy))))
    if both:  # the shared part against itself with either rest: only the rest and its space differ
        for d in (dx, dy):
            best = max(best, 2 * len(common) / (2 * len(common) + 1 + len(d)))
    return best


def partial(a: str, b: str) -> float:
    """The best ``indel`` of the shorter string with a window of the longer one of its length, or shorter at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    n, best, chars = len(a), 0.0, set(a)
    for i in range(1 - n, len(b)):
        lo, hi = max(i, 0), min(i + n, len(b))
        # a window that ends on a foreign character does no worse further left; one cut off at the end, no worse without its first
        if b[hi - 1 if hi - lo == n or lo == 0 else lo] not in chars:
            continue
        if 2 * (hi - lo) / (n + hi - lo) > best:
            best = max(best, indel(a, b[lo:hi]))
    if len(a) == len(b):
        m = len(b)
        for i in range(1 - m, m):  # either may be the one that is cut
            lo, hi = max(i, 0), min(i + m, m)
            if 2 * (hi - lo) / (m + hi - lo) > best:
                best = max(best, indel(a[lo:hi], b))
    return best


@lru_cache(maxsize=1 << 16)
def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    m = len(hits)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (b[j] for j in range(len(b)) if used[j]))) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity; above 0.7 a common prefix of up to four characters closes part of what is missing."""
    s = jaro(a, b)
    if s > 0.7:
        n = 0
        while n < min(4, len(a), len(b)) and a[n] == b[n]:
            n += 1
        s += n * weight * (1 - s)
    return s


def levenshtein_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def _paired(f: Callable[[str, str], float]):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b):
            key = (x or "", y or "")
            if key not in known:
                known[key] = f(*key)
            out.append(known[key])
        return pd.Series(out, dtype="float64")

    return run


def _column(f: Callable[[str, str], float]) -> Callable[[str | Column, str | Column], Column]:
    def column(a: str | Column, b: str | Column) -> Column:
        return F.pandas_udf(_paired(f), "double")(a, b)

    column.__doc__ = f.__doc__
    return column


ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler_sim = map(_column, (indel, token_sort, token_set, partial, jaro_winkler))


def levenshtein_sim(a: str | Column, b: str | Column) -> Column:
    """1 - distance / longer length; two empty strings are equal."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (a, b))
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def weighted_jaccard(a: Column, b: Column, idf: Column, default: float = 0.0) -> Column:
    """Shared weight over all weight of two arrays of tokens; ``idf`` is a map; null if a side is empty.  Built-ins only."""
    weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, t: s + F.coalesce(F.element_at(idf, t), F.lit(default)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), weight(F.array_intersect(a, b)) / F.greatest(weight(F.array_union(a, b)), F.lit(1e-6)))
