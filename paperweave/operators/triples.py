"""Paper properties from (subject, predicate, object, object_is_literal) rows."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.constants import PAPER_PREDICATES
from paperweave.functions.text import local_name
from paperweave.operators.joins import lookup_join
from paperweave.session import work_path

# A source of statements: any function that gives the four-column table, whatever it reads.
StatementSource = Callable[[SparkSession], DataFrame]


@dataclass
class StatementStore:
    """Statements after one pass over their source, split by what they are needed for.

    ``asked`` holds the statements of the predicates named, ``literals`` a ``subject, object`` row per literal
    statement. Both are narrow and written, so no question goes back to the source.
    """

    asked: DataFrame
    literals: DataFrame
    predicates: frozenset[str]
    has_labels: bool

    def _resolved(self, statements: DataFrame) -> DataFrame:
        return resolve_objects(statements, self.literals)

    def by_predicate(self, predicate: str) -> DataFrame:
        """``paper, label`` of all statements with the predicate, given by its local name."""
        self._check([predicate])
        wanted = self.asked.filter(F.col("predicate") == predicate)
        return self._resolved(wanted).select(F.col("subject").alias("paper"), F.col("value").alias("label"))

    def by_subject(self, papers: DataFrame, predicates: Mapping[str, str] = PAPER_PREDICATES) -> DataFrame:
        """One row per paper and one sorted array column per predicate; a value stated twice counts twice.

        If the statements carry a ``subject_label``, it stands in for a missing title.
        """
        self._check(predicates)
        known = F.create_map(*[F.lit(x) for pair in predicates.items() for x in pair])
        asked = papers.select(F.col("paper").alias("subject")).distinct()
        keyed = self.asked.withColumn("_column", F.try_element_at(known, F.col("predicate")))
        wanted = keyed.filter(F.col("_column").isNotNull()).join(asked, "subject", "left_semi")
        values = self._resolved(wanted).filter(F.col("value").isNotNull())
        pivoted = values.groupBy("subject").pivot("_column", list(predicates.values())).agg(F.collect_list("value"))
        columns = [
            F.coalesce(F.sort_array(F.col(c)), F.expr("cast(array() as array<string>)")).alias(c)
            for c in predicates.values()
        ]
        full = asked.join(pivoted, "subject", "left").select(F.col("subject").alias("paper"), *columns)
        if not self.has_labels or "title" not in predicates.values():
            return full
        names = wanted.groupBy(F.col("subject").alias("paper")).agg(F.min("subject_label").alias("_name"))
        title = F.when(F.size("title") > 0, F.col("title")).otherwise(F.array_compact(F.array("_name")))
        return full.join(names, "paper", "left").withColumn("title", title).drop("_name")

    def _check(self, predicates: Collection[str]) -> None:
        missing = sorted(set(predicates) - self.predicates)
        if missing:
            raise ValueError(f"the store was landed without {missing}")


def land_statements(triples: DataFrame, predicates: Collection[str]) -> StatementStore:
    """Read the source once and keep what questions about ``predicates`` (local names) can need.

    A literal statement of a predicate asked for has both uses and is written for each. Other statements whose
    object is no literal are not kept. A statement without predicate is never asked for; one without the mark of a
    literal is none, and its object is not looked up either.
    """
    spark = triples.sparkSession
    name = local_name(F.col("predicate"))
    has_labels = "subject_label" in triples.columns
    use = F.array_compact(
        F.array(F.when(name.isin(list(predicates)), F.lit("asked")), F.when(F.col("object_is_literal"), F.lit("literal")))
    )
    label = F.col("subject_label") if has_labels else F.lit(None).cast("string")
    rows = triples.select("subject", name.alias("predicate"), "object", "object_is_literal", label.alias("subject_label"), F.explode(use).alias("use"))
    path = work_path(spark, "statements")
    rows.write.partitionBy("use").parquet(path)
    kept = spark.read.schema(rows.schema).parquet(path)
    return StatementStore(
        kept.filter(F.col("use") == "asked").drop("use"),
        kept.filter(F.col("use") == "literal").select("subject", "object"),
        frozenset(predicates),
        has_labels,
    )


def resolve_objects(statements: DataFrame, literals: DataFrame) -> DataFrame:
    """Adds ``value``: the object if literal, else the object's own first literal, else null.

    ``literals`` are ``subject, object`` rows. Only those of objects that the statements name are aggregated: a semi
    join drops the rest first, and Spark splits it where one subject has very many literals.
    """
    objects = statements.filter(~F.col("object_is_literal")).select(F.col("object").alias("subject")).distinct()
    first = (
        literals.join(objects, "subject", "left_semi")
        .groupBy(F.col("subject").alias("_key"))
        .agg(F.min("object").alias("_literal"))
    )
    reference = statements.withColumn("_key", F.when(~F.col("object_is_literal"), F.col("object")))
    resolved = lookup_join(reference, first, "_key", salt="subject")
    value = F.when(F.col("object_is_literal"), F.col("object")).otherwise(F.col("_literal"))
    return resolved.withColumn("value", value).drop("_key", "_literal")


def statements_by_predicate(triples: DataFrame, predicate: str) -> DataFrame:
    """:meth:`StatementStore.by_predicate` of statements that are asked one question."""
    return land_statements(triples, [predicate]).by_predicate(predicate)


def statements_by_subject(
    triples: DataFrame, papers: DataFrame, predicates: Mapping[str, str] = PAPER_PREDICATES
) -> DataFrame:
    """:meth:`StatementStore.by_subject` of statements that are asked one question."""
    return land_statements(triples, list(predicates)).by_subject(papers, predicates)


def scalar_view(values: Column) -> Column:
    """No value -> empty, one -> itself, more -> the list as JSON text."""
    return (
        F.when(F.size(values) == 0, F.lit(""))
        .when(F.size(values) == 1, F.get(values, F.lit(0)))
        .otherwise(F.to_json(values))
    )


def papers_from(
    spark: SparkSession,
    source: StatementSource,
    field_predicate: str,
    predicates: Mapping[str, str] = PAPER_PREDICATES,
) -> DataFrame:
    """The paper table of any statement source, read once: labels by predicate, properties by subject."""
    store = land_statements(source(spark), [field_predicate, *predicates])
    labels = store.by_predicate(field_predicate)
    properties = store.by_subject(labels, predicates)
    flat = properties.select("paper", *[scalar_view(F.col(c)).alias(c) for c in predicates.values()])
    return labels.join(flat, "paper")
