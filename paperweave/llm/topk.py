"""Exact top-k by integer inner product with a uniform threshold in three phases.

A score is the sum of the partial scores of m slices of the components. Phase one: every block of rows gathers,
per query and slice, its list of the best partial scores, and the whole scores of the listed rows give each query
a safe cutoff t, its k-th best so far. Phase two sends the cutoffs back: a row that reaches t has a partial score
of t/m or more in some slice, so a block collects just those entries. Phase three resolves their scores exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweave.session import landed

SLICES = 2
#: Rows of a block of candidates and of queries: what a task holds of each.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 8192
#: Queries that are multiplied at a time.
AT_A_TIME = 256
SCALE = 1024
_LONG = 2**63 - 1


def whole_numbers(rows: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of vectors as a matrix, shorter ones filled with zeros.

    Float64 while every number is below 2**53 and so exact, else Python integers.
    """
    width = max((len(r) for r in rows), default=0)
    matrix = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        matrix[k, : len(row)] = row
    if not matrix.size or np.abs(matrix).max() < 2.0**53 / scale:
        return np.floor(matrix * scale)
    exact = np.zeros(matrix.shape, dtype=object)
    for k, row in enumerate(matrix.tolist()):
        # from 2**53 on a double is a whole number
        exact[k] = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) if abs(x) < 2.0**43 else int(x * scale) for x in row]
    return exact


def _integers(matrix: np.ndarray) -> np.ndarray:
    out = np.zeros(matrix.shape, dtype=object)
    for k, row in enumerate(matrix):
        out[k] = [int(x) for x in row]
    return out


def partial_scores(queries: np.ndarray, rows: np.ndarray, slices: int) -> np.ndarray:
    """Scores per slice, query and row, exact: a slice takes every ``slices``-th component."""
    width = min(queries.shape[1], rows.shape[1])  # beyond it one side is zero
    queries, rows = queries[:, :width], rows[:, :width]
    small = queries.dtype != object and rows.dtype != object
    if small and queries.size and rows.size:
        small = float(np.abs(queries).max()) * float(np.abs(rows).max()) * max(width, 1) < 2.0**53
    if not small:
        queries, rows = _integers(queries), _integers(rows)
    return np.stack([queries[:, s::slices] @ rows[:, s::slices].T if width > s else np.zeros((len(queries), len(rows))) for s in range(slices)])


def _best(scores: np.ndarray, allowed: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best allowed scores, ties by ``order``."""
    places = np.flatnonzero(allowed)
    if len(places) > k and scores.dtype != object:
        own = scores[places]
        places = places[own >= np.partition(own, len(own) - k)[len(own) - k]]
    ranked = sorted(places.tolist(), key=lambda p: (-scores[p], order[p]))
    return np.array(ranked[:k], dtype=np.int64)


class Block:
    """A block of candidates against a block of queries."""

    def __init__(self, rows: pd.DataFrame, queries: pd.DataFrame):
        self.rows, self.queries = rows.sort_values("_order", kind="stable"), queries.sort_values("_query")
        self.order = self.rows["_order"].to_numpy(np.int64)
        self.uids = self.rows["_uid"].to_numpy(np.int64)
        self.matrix = whole_numbers(list(self.rows["_v"]))

    def parts(self, slices: int):
        """Query rows with their partial scores, some at a time."""
        for at in range(0, len(self.queries), AT_A_TIME):
            own = self.queries.iloc[at : at + AT_A_TIME]
            scores = partial_scores(whole_numbers(list(own["_asked"])), self.matrix, slices)
            for n, (uid, cutoff) in enumerate(zip(own["_query"].tolist(), own["_cutoff"].tolist())):
                yield uid, cutoff, scores[:, n], self.uids != uid

    def listed(self, slices: int, k: int) -> pd.DataFrame:
        """Phase one: the k best whole scores among the rows that lead in some slice."""
        out = []
        for uid, _, scores, allowed in self.parts(slices):
            leading = np.unique(np.concatenate([_best(s, allowed, self.order, k) for s in scores]))
            total = scores[:, leading].sum(axis=0)
            out += [(uid, _clipped(x)) for x in sorted(total.tolist(), reverse=True)[:k]]
        return pd.DataFrame(out, columns=["_query", "_score"])

    def resolved(self, slices: int, k: int) -> pd.DataFrame:
        """Phases two and three: rows that reach t/m in some slice, resolved, those from t on, at most k of them."""
        out = []
        for uid, cutoff, scores, allowed in self.parts(slices):
            # as text: beside nulls pandas would round a whole number
            if isinstance(cutoff, str) and abs(int(cutoff)) < _LONG:
                # whole numbers throughout: m times a partial score against t
                enough = allowed & (scores * slices >= int(cutoff)).any(axis=0)
            else:
                cutoff, enough = None, allowed
            entries = np.flatnonzero(enough)
            total = scores[:, entries].sum(axis=0)
            keep = np.ones(len(entries), dtype=bool) if cutoff is None else (total >= int(cutoff)).astype(bool)
            for p in _best(total, keep, self.order[entries], k):
                out.append((uid, int(self.uids[entries[p]]), _clipped(total[p])))
        return pd.DataFrame(out, columns=["_query", "_uid", "_score"])


def _clipped(x) -> int:
    return max(-_LONG, min(_LONG, int(x)))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", slices: int = SLICES,
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, <key>, score``: for each query row its k best other rows, ties to the smaller key.

    Null vectors and vectors with a null or non-finite component take no part; a shorter vector counts as filled
    with zeros. Repeated rows are rows of their own, told apart by their place in the written table; a null key is
    no query and, as a candidate, comes last among equals. Scores beyond 64 bits stop at the largest number.
    Every block of candidates meets every block of queries, one pair of blocks a task.
    """
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(False)))
    numbered = landed(
        usable.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_asks"))
        .withColumn("_uid", F.monotonically_increasing_id()),
        "vectors",
    )
    held = numbered.agg(F.count(F.lit(1)).alias("n"), F.count_if("_asks").alias("q")).first()
    n_rows, n_queries = max(1, -(-held["n"] // block_rows)), max(1, -(-held["q"] // block_queries))

    def dealt(parts: int) -> Column:
        return F.pmod(F.xxhash64("_uid"), F.lit(parts)).cast("int")

    # candidates in the order of their keys: null last
    order = F.coalesce(F.col("_id"), F.lit(_LONG)).alias("_order")
    rows = numbered.select("_uid", "_v", order, dealt(n_rows).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("_b"))
    asked = numbered.filter("_asks").select("_uid", "_v", dealt(n_queries).alias("_b"))

    def against(queries: DataFrame, work, schema: str) -> DataFrame:
        spread = queries.select(
            F.col("_uid").alias("_query"), F.col("_v").alias("_asked"), "_cutoff", "_b",
            F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("_a"),
        )
        return rows.groupBy("_a", "_b").cogroup(spread.groupBy("_a", "_b")).applyInPandas(work, schema)

    def first_phase(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return Block(own, queries).listed(slices, k)

    def other_phases(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return Block(own, queries).resolved(slices, k)

    lists = against(asked.withColumn("_cutoff", F.lit(None).cast("string")), first_phase, "_query long, _score long")
    place = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("_score")))
    cutoffs = lists.withColumn("_place", place).filter(F.col("_place") <= k).filter(F.col("_place") == k)
    cutoffs = landed(cutoffs.select(F.col("_query").alias("_uid"), F.col("_score").cast("string").alias("_cutoff")), "cutoffs")
    found = against(asked.join(cutoffs, "_uid", "left"), other_phases, "_query long, _uid long, _score long")
    named = found.join(numbered.select("_uid", F.col("_id").alias(key)), "_uid")
    best = Window.partitionBy("_query").orderBy(F.desc("_score"), F.asc_nulls_last(key), "_uid")
    ranked = named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    ids = numbered.filter("_asks").select(F.col("_uid").alias("_query"), F.col("_id").alias("query_id"))
    return ranked.join(ids, "_query").select("query_id", "rank", key, F.col("_score").alias("score"))
