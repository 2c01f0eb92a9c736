"""Row filters and column rules of the paper table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.constants import PLACEHOLDER_LABEL


def select_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the columns and the rows in which none of them is null or empty."""
    kinds = dict(df.dtypes)
    kept = [F.nullif(F.col(c), F.lit("")).alias(c) if kinds[c] == "string" else F.col(c) for c in columns]
    return df.select(*kept).na.drop("any")


def drop_missing(df: DataFrame, columns: Sequence[str] = ("title", "abstract")) -> DataFrame:
    return df.na.drop(subset=list(columns))


def with_placeholder(df: DataFrame, label: str = PLACEHOLDER_LABEL) -> DataFrame:
    return df.filter(F.col("label") == label)


def without_placeholder(df: DataFrame, label: str = PLACEHOLDER_LABEL) -> DataFrame:
    return df.filter(F.col("label") != label)


def with_known_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose label is in the one-column table ``labels``."""
    return df.join(labels.select("label").distinct(), "label", "left_semi")


def rename_and_fix(
    df: DataFrame,
    old: str = "label",
    new: str = "categories",
    wrong: str = "Information science",
    right: str = "Information Science",
) -> DataFrame:
    """Rename the label column and correct a spelling inside its values."""
    renamed = df.withColumnRenamed(old, new) if old in df.columns else df
    return renamed.withColumn(new, F.replace(F.col(new), F.lit(wrong), F.lit(right)))


def needs_enrichment(df: DataFrame, unmatched: DataFrame | None = None, key: str = "paper_id") -> DataFrame:
    """Papers without a doi or with a short abstract, among those a previous run did not cover.

    With ``unmatched`` given and empty nothing is left to do.
    """
    todo = df if unmatched is None else df.join(unmatched.select(key), key, "left_semi")
    has_doi = F.coalesce(F.col("doi"), F.lit("")) != ""
    long_enough = F.length(F.coalesce(F.col("abstract"), F.lit(""))) > 50
    return todo.filter(~(long_enough & has_doi))


def drop_unlabelled(df: DataFrame, column: str = "categories") -> DataFrame:
    return df.filter(F.size(column) > 0)


def overwrite(own: Column, found: Column, matched: Column) -> Column:
    """The found value whenever there is a valid record, even an empty one."""
    return F.when(matched, found).otherwise(own)


def fill_empty(own: Column, found: Column) -> Column:
    """The found value only where the own one is missing."""
    return F.coalesce(F.nullif(own, F.lit("")), found, F.lit(""))


def relabel(df: DataFrame, old: str, new: str, column: str = "label") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def long_subjects(subjects: Column, least: int = 4) -> Column:
    """Foreign labels too short to be compared are left out."""
    return F.filter(subjects, lambda x: F.length(x) >= least)
