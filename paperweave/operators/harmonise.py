"""Mapping foreign subject names onto a taxonomy."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.constants import PLACEHOLDER_LABEL
from paperweave.functions.similarity import ratio, score, weighted_ratio, weighted_score, words_of
from paperweave.functions.text import clean_subjects

SURE_SCORE = 95
ACCEPT_LEAST = 90
# Labels and names that meet in one task, and buckets that characters are counted in.
LABELS_AT_ONCE, NAMES_AT_ONCE, BUCKETS = 2_000, 5_000, 48


def open_subjects(papers: DataFrame, subjects: str, taxonomy: DataFrame, key: str = "paper_id") -> DataFrame:
    """``label``: distinct subjects of placeholder papers that stand before the first exact taxonomy name
    in their row and have more than three letters."""
    names = taxonomy.select(F.col("name").alias("label")).distinct().withColumn("_exact", F.lit(True))
    rows = papers.filter(F.col("label") == PLACEHOLDER_LABEL)
    each = rows.select(key, F.posexplode(clean_subjects(F.col(subjects))).alias("pos", "label"))
    marked = each.join(names, "label", "left")
    # two numbers and the label travel; the window is over the subjects of one paper
    first = F.min(F.when(F.col("_exact"), F.col("pos"))).over(Window.partitionBy(key))
    before = marked.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col("pos") < F.col("_first")))
    return before.filter(F.length("label") > 3).select("label").distinct()


class _Names:
    """Names of a block with what bounds their scores: lengths, words, and characters counted in buckets.

    Two characters in one bucket can only raise a bound, so the buckets need not be exact.
    """

    def __init__(self, names: list[str], weighted: bool):
        plain = [words_of(n) for n in names] if weighted else names
        parts = [p.split() for p in plain]
        self.length = np.array([len(p) for p in plain])
        self.in_order = np.array([len(" ".join(w)) for w in parts])
        self.unique = np.array([len(" ".join(set(w))) for w in parts])
        self.counts = np.zeros((len(names), BUCKETS), dtype=np.int32)
        self.with_word: dict[str, list[int]] = {}
        for n, p in enumerate(plain):
            np.add.at(self.counts[n], [ord(c) % BUCKETS for c in p], 1)
            if weighted:
                for word in set(parts[n]):
                    self.with_word.setdefault(word, []).append(n)

    def bounds(self, label: str, weighted: bool) -> np.ndarray:
        """The most that each name can score with a label: no common subsequence is longer than the shared characters."""
        own = _Names([label], weighted)
        shared = np.minimum(self.counts, own.counts[0]).sum(axis=1)
        if not weighted:
            return np.floor(200.0 * shared / np.maximum(1, self.length + own.length[0]) + 0.5)
        long, short = np.maximum(self.length, own.length[0]), np.minimum(self.length, own.length[0])
        partial = long >= 1.5 * short
        shrink = np.where(partial, np.where(long > 8 * short, 0.6, 0.9), 1.0)

        def compared(a: np.ndarray, b: int) -> np.ndarray:
            less = np.maximum(1, np.minimum(a, b))
            return np.where(partial, 100.0 * np.minimum(shared, less) / less, 200.0 * np.minimum(shared, less) / np.maximum(1, a + b))

        of_words = compared(self.unique, own.unique[0])
        for word in own.with_word:
            of_words[self.with_word.get(word, [])] = 100.0  # a shared word may be all of one side
        most = np.maximum(200.0 * shared / np.maximum(1, long + short), 0.95 * shrink * np.maximum(compared(self.in_order, own.in_order[0]), of_words))
        most = np.maximum(most, np.where(partial, shrink * compared(self.length, own.length[0]), 0.0))
        return np.where(short > 0, np.floor(most + 0.5 + 1e-9), 0.0)


def top_of_block(labels: list[str], names: list[str], order: list, top: int, weighted: bool) -> tuple[list[tuple], int]:
    """``label, name, ord, score`` of the best names of a block for each label, ties to the smaller ord; pairs scored.

    Names are scored from the highest bound down, until the bound is below the last score that is in.
    """
    held, scorer = _Names(names, weighted), weighted_score if weighted else score
    out, tried = [], 0
    for label in labels:
        bounds = held.bounds(label, weighted)
        best: list[tuple] = []
        for n in np.argsort(-bounds, kind="stable").tolist():
            if len(best) == top and bounds[n] < -best[-1][0]:
                break
            insort(best, (-scorer(label, names[n]), order[n], names[n]))
            tried += 1
            del best[top:]
        out += [(label, name, place, -negative) for negative, place, name in best]
    return out, tried


def score_labels(labels: DataFrame, taxonomy: DataFrame, scorer=weighted_ratio, top: int = 5, least: int = ACCEPT_LEAST) -> DataFrame:
    """``label, name, ord, score`` of the ``top`` best names per label, by score, then ``ord``; those below ``least`` go.

    ``taxonomy`` has ``name`` and ``ord``; ``scorer`` is ``weighted_ratio`` or ``ratio``. With ``least=0`` every label has
    its best names, however low they score. Labels meet the names in blocks of both, each block gives its own best, and
    only pairs whose bound reaches a label's cutoff are scored.
    """
    if scorer not in (weighted_ratio, ratio):
        raise ValueError("only the two scorers here have a bound")
    weighted = scorer is weighted_ratio
    n_names, n_labels = taxonomy.count(), labels.count()
    blocks, chunks = n_names // NAMES_AT_ONCE + 1, n_labels // LABELS_AT_ONCE + 1
    chunk = F.pmod(F.xxhash64("label"), F.lit(chunks)).cast("int").alias("chunk")
    left = labels.select("label", chunk, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    block = F.pmod(F.xxhash64("name", "ord"), F.lit(blocks)).cast("int").alias("block")
    right = taxonomy.select("name", "ord", block, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    kind = dict(taxonomy.dtypes)["ord"]

    def meet(own: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        rows, _ = top_of_block(own["label"].tolist(), names["name"].tolist(), names["ord"].tolist(), top, weighted)
        return pd.DataFrame(rows, columns=["label", "name", "ord", "score"])

    met = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block"))
    scored = met.applyInPandas(meet, f"label string, name string, ord {kind}, score int")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.col("score").desc(), "ord", "name"))
    kept = scored.filter(F.col("score") >= least).withColumn("_rank", rank).filter(F.col("_rank") <= top)
    return kept.select("label", "name", "ord", "score")


def best_match(scored: DataFrame) -> DataFrame:
    """``src, dst``: the best name if it scores 95 or more, else the longest among those with 90 or more."""
    good = scored.filter(F.col("score") >= ACCEPT_LEAST)
    best = F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.col("ord")))
    longest = F.min_by("name", F.struct(-F.length("name"), -F.col("score"), F.col("ord")))
    picked = good.groupBy("label").agg(best.alias("best"), longest.alias("longest"))
    dst = F.when(F.col("best.score") >= SURE_SCORE, F.col("best.name")).otherwise(F.col("longest"))
    return picked.select(F.col("label").alias("src"), dst.alias("dst"))


def fuzzy_map_labels(
    papers: DataFrame,
    subjects: str,
    taxonomy: DataFrame,
    scorer=weighted_ratio,
    include_exact: bool = False,
    key: str = "paper_id",
) -> DataFrame:
    """Mapping table ``src, dst`` for review. Exact names do not enter it unless ``include_exact``."""
    found = best_match(score_labels(open_subjects(papers, subjects, taxonomy, key), taxonomy, scorer))
    if not include_exact:
        return found
    same = taxonomy.select(F.col("name").alias("src"), F.col("name").alias("dst")).distinct()
    return found.join(same.select("src"), "src", "left_anti").unionByName(same)
