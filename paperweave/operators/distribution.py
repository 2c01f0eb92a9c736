"""Label counts and what is derived from them. All results are label-sized, not paper-sized."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweave.constants import NO_LABEL, PLACEHOLDER_LABEL


def label_distribution_multi(df: DataFrame, known: DataFrame | None = None, labels: str = "categories") -> DataFrame:
    """Papers per label; a paper with three labels counts in three. Only ``known`` (``label``) ones, if given."""
    each = df.select(F.explode(F.array_distinct(F.col(labels))).alias("label"))
    counts = each.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    # counting first keeps the join with the known labels label-sized
    return counts if known is None else counts.join(known.select("label").distinct(), "label", "left_semi")


def label_distribution_single(df: DataFrame, label: str = "categories", skip: str | None = PLACEHOLDER_LABEL) -> DataFrame:
    """Rows per whole label value, the placeholder left out."""
    kept = df if skip is None else df.filter(F.col(label) != skip)
    return kept.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("cnt"))


def value_counts(df: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.col("cnt").asc() if ascending else F.col("cnt").desc(), column)


def label_index(labels: DataFrame, label: str = "label") -> DataFrame:
    """``label -> idx`` in alphabetical order, from 0."""
    distinct = labels.select(F.col(label).alias("label")).distinct()
    # an ungrouped window, but over distinct labels only
    return distinct.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint").alias("idx"))


def completeness_stats(df: DataFrame, stage: str) -> DataFrame:
    """One row: papers, papers without doi / publisher / url, papers with the placeholder label."""
    def empty(c: str) -> Column:
        return F.count_if(F.coalesce(F.col(c), F.lit("")) == "")

    return df.agg(
        F.count(F.lit(1)).alias("num_papers"),
        empty("doi").alias("num_dois"),
        empty("publisher").alias("num_publisher"),
        empty("url").alias("num_urls"),
        F.count_if(F.col("label") == PLACEHOLDER_LABEL).alias("num_science_labels"),
    ).withColumn("stage", F.lit(stage))


def top_labels(dist: DataFrame, k: int, tie: str = "label") -> DataFrame:
    """Adds ``rank`` (most frequent first) and ``relevant`` (within the first k)."""
    order = Window.orderBy(F.col("cnt").desc(), F.col(tie))
    return dist.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn(
        "relevant", F.col("rank") <= k
    )


def quota(dist: DataFrame, total: int) -> DataFrame:
    """Share of ``total`` in proportion to the count, rounded down, over the labels of ``dist``."""
    whole = F.sum("cnt").over(Window.partitionBy())
    share = F.col("cnt").cast("double") / whole.cast("double") * F.lit(float(total))
    return dist.withColumn("quota", F.floor(share).cast("bigint"))


def labels_by_threshold(dist: DataFrame, threshold: int, most: int) -> DataFrame:
    """Labels above the threshold, rarest first, until more than ``most`` are kept (so ``most + 1``)."""
    above = dist.filter(F.col("cnt") > threshold)
    rank = F.row_number().over(Window.orderBy("cnt", "label")).cast("bigint")
    return above.withColumn("rank", rank).filter(F.col("rank") <= most + 1)


def moved_counts(df: DataFrame, listed: Sequence[str], labels: str = "categories") -> DataFrame:
    """``label, moved_cnt``: papers whose labels are all listed, at their last label in the listing.

    Labels are taken away one after the other, and a paper moves to the no-label class with the last one.
    """
    names = F.array(*[F.lit(x) for x in listed])
    held = F.filter(names, lambda x: F.array_contains(F.col(labels), x))
    gone = df.filter((F.size(labels) > 0) & (F.size(F.array_except(F.col(labels), names)) == 0))
    return gone.groupBy(F.element_at(held, -1).alias("label")).agg(F.count(F.lit(1)).alias("moved_cnt"))


def move_to_nolabel(dist: DataFrame, moved: DataFrame, listed: Sequence[str]) -> DataFrame:
    """``label, cnt`` without the listed labels, what they moved added to ``nolabel``."""
    extra = moved.select(F.lit(NO_LABEL).alias("label"), F.col("moved_cnt").alias("cnt"))
    kept = dist.filter(~F.col("label").isin(list(listed))).select("label", "cnt")
    return kept.unionByName(extra).groupBy("label").agg(F.sum("cnt").alias("cnt"))
