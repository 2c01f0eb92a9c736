"""Exact "first n of each group by hash" without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.functions.hashing import hash_int
from paperweave.session import landed

# Three hexadecimal digits: the groups are cut at one of 4096 places.
_DIGITS = 3


def first_by_hash(
    df: DataFrame, groups: Sequence[str], limits: DataFrame, digest: str, flag: str = "picked"
) -> DataFrame:
    """Mark in each group the ``limit`` rows with the smallest digest; all other rows get false.

    ``limits`` has the group columns and ``limit``; groups it does not name get none. Digests must differ
    within a group. Counting the leading digits tells, per group, the slot in which the limit falls; only
    the rows of that slot, about one in 4096, are ranked to find the last digest that is in. So a group that
    holds a third of the table is no heavier than the others, and the rows themselves are not moved. The
    last digests, one row per group, are written first: their size is then known when they are joined.
    """
    groups = list(groups)
    slot = hash_int(F.col(digest), _DIGITS).cast("int")
    narrow = df.select(*groups, F.col(digest).alias("_digest"), slot.alias("_slot"))
    per_slot = narrow.groupBy(*groups, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_slot"))
    upto = per_slot.withColumn("_upto", running).join(limits, groups)
    cut = upto.groupBy(*groups).agg(
        # the first slot in which the running count passes the limit, if any
        F.min(F.when(F.col("_upto") > F.col("limit"), F.col("_slot"))).alias("_slot"),
        (F.first("limit") - F.coalesce(F.max(F.when(F.col("_upto") <= F.col("limit"), F.col("_upto"))), F.lit(0))).alias("_room"),
    )
    cut = landed(cut, "cuts")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy("_digest"))
    inside = narrow.join(cut.filter("_room > 0"), [*groups, "_slot"]).withColumn("_rank", rank)
    last = inside.filter(F.col("_rank") == F.col("_room")).select(*groups, F.col("_digest").alias("_last"))
    # without a last digest in the slot, everything before the slot is in; without a slot, the whole group
    bound = F.coalesce("_last", F.lpad(F.lower(F.hex("_slot")), _DIGITS, "0"), F.lit("g"))
    bounds = landed(cut.join(last, groups, "left").select(*groups, bound.alias("_bound")), "bounds")
    marked = df.join(bounds, groups, "left")
    return marked.withColumn(flag, F.coalesce(F.col(digest) <= F.col("_bound"), F.lit(False))).drop("_bound")
