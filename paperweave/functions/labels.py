"""Label arrays and lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_array(c: Column, separator: str = " ") -> Column:
    return F.split(c, "[" + separator + "]")


def label_string(c: Column, separator: str = " ") -> Column:
    return F.array_join(c, separator)


def lookup(mapping: Mapping[str, str]) -> Column:
    """A map column from a dictionary."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def with_lookup(df: DataFrame, mapping: Mapping[str, str] | DataFrame, name: str = "_map") -> DataFrame:
    """Adds a map column from a dictionary or from a ``(src, dst)`` table of the size of a vocabulary.

    The table becomes one value, computed once, so the rows are mapped in place, without a join. For a table
    of unknown size use :func:`paperweave.operators.joins.first_mapped`, which joins.
    """
    if not isinstance(mapping, DataFrame):
        return df.withColumn(name, lookup(mapping))
    pairs = F.array_sort(F.collect_set(F.struct("src", "dst")))
    return df.withColumn(name, mapping.agg(F.map_from_entries(pairs)).scalar())


def map_lenient(labels: Column, m: Column) -> Column:
    """Replace every known label, keep the others."""
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(m, x), x))


def map_strict(labels: Column, m: Column) -> Column:
    """Replace every label, trimmed; an unknown label is an error."""
    return F.transform(
        labels,
        lambda x: F.coalesce(
            F.trim(F.try_element_at(m, x)),
            F.raise_error(F.concat(F.lit("label without a mapping: "), x)).cast("string"),
        ),
    )


def has_label(labels: Column, label: str) -> Column:
    return F.array_contains(labels, label)


def drop_label(labels: Column, label: str) -> Column:
    return F.array_remove(labels, label)


def compact(c: Column) -> Column:
    """Label without spaces, so that it survives a space-separated list."""
    return F.replace(c, F.lit(" "), F.lit(""))


def first_label(labels: Column) -> Column:
    return F.get(labels, F.lit(0))


def rest_labels(labels: Column) -> Column:
    return F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
