"""Keyed joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.constants import PLACEHOLDER_LABEL
from paperweave.session import landed

# A key with more rows than this is spread over several tasks.
HOT_ROWS = 500_000
# Rows without a key are dealt over so many parts.
NULL_PARTS = 1 << 20


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    keys_of: DataFrame | None = None,
    salt: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` with ``right``, which has each key once, on the column ``key``.

    The right side is an aggregate, where the adaptive skew join does not apply. A count of the left keys
    finds the hot ones: there are at most rows / hot_rows of them, so this table may be broadcast. Only
    their right rows are repeated, one copy per part of the left key. ``keys_of`` may name a cheaper table
    whose ``key`` column holds at least the same keys, so that counting does not repeat earlier joins.

    Rows with a null key match nothing and are dealt over all tasks, as most lookups make null keys on purpose.

    The part of a row follows from its column ``salt`` (all columns, if none is named), so a task that is run
    again sends it to the same place.
    """
    hot = (
        (left if keys_of is None else keys_of)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > hot_rows) & F.col(key).isNotNull())
        .select(key, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_parts"))
    )
    spread = left.join(F.broadcast(hot), key, "left")
    place = F.xxhash64(*([salt] if salt else left.columns))
    # a null key matches nothing, so its rows may go anywhere
    part = (
        F.when(F.col(key).isNull(), F.pmod(place, F.lit(NULL_PARTS)))
        .when(F.col("_parts").isNull(), F.lit(0))
        .otherwise(F.pmod(place, F.col("_parts").cast("bigint")))
        .cast("int")
    )
    spread = spread.withColumn("_part", part).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    repeated = right.join(F.broadcast(hot), key, "left").withColumn("_part", copies).drop("_parts")
    return spread.join(repeated, [key, "_part"], how).drop("_part")


def first_by_key(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """``_key, _row``: per non-empty key the row with the smallest ``order``, a number that no two rows share.

    Only keys and numbers are aggregated, which partial aggregation shrinks for hot keys; the rows that win are
    fetched by their number.
    """
    usable = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    first = usable.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    rows = usable.select(F.col(order).alias("_first"), F.struct(*[F.col(c) for c in columns]).alias("_row"))
    return first.join(rows, "_first").select("_key", "_row")


def update_from(
    papers: DataFrame, prior: DataFrame, columns: Sequence[str], order: str = "ord", key: str = "paper_id"
) -> tuple[DataFrame, DataFrame]:
    """Replace a paper by its row from a previous run: by doi, else by title, the first one counts.

    Returns the updated papers and the ids that found no row; both come from one table, which is written once.
    """
    columns = list(columns)
    by_doi = first_by_key(prior, "doi", order, columns).select("_key", F.col("_row").alias("_by_doi"))
    by_title = first_by_key(prior, "title", order, columns).select("_key", F.col("_row").alias("_by_title"))
    doi = F.nullif(F.col("doi"), F.lit(""))
    found = lookup_join(papers.withColumn("_key", doi), by_doi, "_key", salt=key).drop("_key")
    # the title is asked only where the doi found nothing
    title = F.nullif(F.col("title"), F.lit(""))
    found = lookup_join(
        found.withColumn("_key", F.when(F.col("_by_doi").isNull(), title)),
        by_title,
        "_key",
        keys_of=papers.select(title.alias("_key")),
        salt=key,
    ).drop("_key")
    chosen = F.coalesce(F.col("_by_doi"), F.col("_by_title"))
    updated = found.withColumn("_hit", chosen).select(
        key,
        *[F.when(F.col("_hit").isNotNull(), F.col("_hit")[c]).otherwise(F.col(c)).alias(c) for c in columns],
        F.col("_hit").isNotNull().alias("_matched"),
    )
    updated = landed(updated, "updated")
    return updated.drop("_matched"), updated.filter(~F.col("_matched")).select(key)


def drop_known_doi(new: DataFrame, corpus: DataFrame, key: str | None = None) -> DataFrame:
    """New rows whose doi the corpus does not hold; a null doi is never known. ``key`` names their id, if any."""
    known = corpus.filter(F.col("doi").isNotNull()).select(F.col("doi").alias("_key")).distinct()
    known = known.withColumn("_known", F.lit(True))
    # a left join, not an anti join, so that the balanced lookup serves a hot doi as well
    joined = lookup_join(new.withColumn("_key", F.col("doi")), known, "_key", salt=key)
    return joined.filter(F.col("_known").isNull()).drop("_key", "_known")


def first_mapped(df: DataFrame, subjects: str, mapping: DataFrame, key: str = "paper_id") -> DataFrame:
    """``key, mapped``: target of the first subject, in list order, that the ``(src, dst)`` table knows.

    The table has each ``src`` once. A subject that very many rows name is spread over several tasks.
    """
    each = df.select(key, F.posexplode(F.col(subjects)).alias("pos", "src"))
    hits = lookup_join(each, mapping.select("src", "dst"), "src", how="inner", salt=key)
    return hits.groupBy(key).agg(F.min(F.struct("pos", "dst")).alias("first")).select(key, F.col("first")["dst"].alias("mapped"))


def apply_mapping(
    df: DataFrame, subjects: Column, mapping: DataFrame, placeholder: str = PLACEHOLDER_LABEL, key: str = "paper_id"
) -> DataFrame:
    """Give placeholder papers the target of their first known subject in the ``(src, dst)`` table.

    ``key`` names a paper. Only placeholder papers take part in the join, and the subjects travel without the rest.
    """
    asked = df.filter(F.col("label") == placeholder).select(key, subjects.alias("_subjects"))
    found = first_mapped(asked, "_subjects", mapping, key).select(F.col(key).alias("_key"), "mapped")
    joined = df.join(found, df[key] == F.col("_key"), "left")
    replace = F.when(F.col("label") == placeholder, F.col("mapped"))
    return joined.withColumn("label", F.coalesce(replace, F.col("label"))).drop("_key", "mapped")


def uncovered_labels(test: DataFrame, train: DataFrame) -> DataFrame:
    """Labels that occur in the test rows and in no training row (both with a ``labels`` array)."""
    seen = train.select(F.explode("labels").alias("label")).distinct()
    return test.select(F.explode("labels").alias("label")).distinct().join(seen, "label", "left_anti")


def labels_absent(new: DataFrame, reduced: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels of ``new`` that are no mapped name of the reduced corpus' codes."""
    names = reduced.join(mapping, reduced["label"] == mapping["src"]).select(F.col("dst").alias("label"))
    return new.join(names.distinct(), "label", "left_anti")
