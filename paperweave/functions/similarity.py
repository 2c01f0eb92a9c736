"""String similarity on a 0-100 scale.

``ratio`` is 200 * LCS / (len a + len b), rounded. The scorers are the only Python code in the matching
operators; a bound on the edit distance sorts out nearly all other pairs inside the JVM first.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType


LONG_TEXT = 500


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word-parallel row per character."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for ch in a:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def score(a: str, b: str) -> int:
    if a == b:
        return 100
    return int(round(200.0 * _common(a, b) / (len(a) + len(b))))


def words_of(s: str) -> str:
    return re.sub(r"[^\w]|_", " ", s).lower().strip()


def _window_score(a: str, b: str) -> int:
    """Best ratio of the shorter string against equally long pieces of the longer one.

    From one piece to the next the common subsequence grows by at most one character, so pieces that cannot
    pass the best one are stepped over; the places of the shorter string's characters are found once.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    if a in b:
        return 100
    n = len(a)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << n) - 1
    best, start = 0, 0
    while start <= len(b) - n:
        row = full
        for ch in b[start : start + n]:
            hit = row & where.get(ch, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
        common = n - row.bit_count()
        best = max(best, common)
        start += best - common + 1
    return int(round(200.0 * best / (n + n)))


def weighted_score(left: str, right: str) -> int:
    """Weighted best of whole, partial, sorted-word and shared-word comparison."""
    a, b = words_of(left), words_of(right)
    if not a or not b:
        return 0
    long, short = max(len(a), len(b)), min(len(a), len(b))
    partial = long >= 1.5 * short
    compare = _window_score if partial else score
    shrink = 1.0
    if partial:
        shrink = 0.6 if long > 8 * short else 0.9
    wa, wb = set(a.split()), set(b.split())
    both = " ".join(sorted(wa & wb))
    only_a = (both + " " + " ".join(sorted(wa - wb))).strip()
    only_b = (both + " " + " ".join(sorted(wb - wa))).strip()
    by_order = compare(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    by_set = max(compare(both, only_a), compare(both, only_b), compare(only_a, only_b)) if both else compare(only_a, only_b)
    found = [float(score(a, b)), 0.95 * shrink * by_order, 0.95 * shrink * by_set]
    if partial:
        found.append(shrink * compare(a, b))
    return int(round(max(found)))


@pandas_udf(IntegerType())
def _score_udf(pair: pd.DataFrame) -> pd.Series:
    """Scores of (a, b) structs; a null struct stays null, so settled pairs cost nothing here."""
    return pd.Series(
        [None if x is None or y is None else score(x, y) for x, y in zip(pair["a"], pair["b"])], dtype="Int32"
    )


@pandas_udf(IntegerType())
def _weighted_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else weighted_score(x, y) for x, y in zip(a, b)], dtype="Int32"
    )


def _scored(condition: Column, a: Column, b: Column) -> Column:
    # one struct argument: the condition, which may be costly, is evaluated once per pair
    return _score_udf(F.when(condition, F.struct(a.alias("a"), b.alias("b"))))


def ratio(a: Column, b: Column) -> Column:
    """0-100 similarity; equal strings never leave the JVM."""
    return F.when(a == b, F.lit(100)).otherwise(_scored(a != b, a, b))


def weighted_ratio(a: Column, b: Column) -> Column:
    return _weighted_udf(a, b)


def at_least(a: Column, b: Column, least: int) -> Column:
    """``ratio(a, b) >= least``, false if a side is null.

    A pair that reaches ``least`` needs at most ``(100.5 - least) / 100`` of its characters as insertions and
    deletions (the half point is the rounding), and there are at least as many of these as the edit distance
    counts. Pairs that differ more, in length or in distance, are settled in the JVM; the distance only fills
    a band of that width and gives -1 beyond it.
    """
    budget = F.lit((100 - least + 0.5) / 100.0) * (F.length(a) + F.length(b)) + F.lit(1e-9)
    room = F.floor(budget).cast("int")
    near = (a != b) & (F.abs(F.length(a) - F.length(b)) <= room)
    # the band grows with the length, the score does 64 places at a time: long texts go straight to it
    short = F.length(a) <= LONG_TEXT
    close = near & F.when(short, F.call_function("levenshtein", a, b, room) >= 0).otherwise(F.lit(True))
    return F.coalesce((a == b) | (_scored(close, a, b) >= least), F.lit(False))
