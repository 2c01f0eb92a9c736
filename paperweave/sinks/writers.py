"""Writers. Paper-sized tables are written by all tasks; only label-sized ones become a single file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.functions.labels import label_string
from paperweave.operators.filters import drop_missing
from paperweave.operators.instances import instance_lines
from paperweave.operators.sampling import shuffle


def write_csv(df: DataFrame, path: str) -> None:
    """With a header and no row number; array columns as comma-separated text."""
    flat = [
        F.array_join(F.col(n), ",").alias(n) if t.startswith("array<") else F.col(n) for n, t in df.dtypes
    ]
    df.select(*flat).write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_json_indexed(df: DataFrame, key: str, path: str) -> None:
    """One line per row: ``{"index": key, "row": {...}}``."""
    rest = F.struct(*[F.col(c) for c in df.columns if c != key])
    df.select(F.to_json(F.struct(F.col(key).alias("index"), rest.alias("row"))).alias("value")).write.mode("overwrite").text(path)


def write_corpus(df: DataFrame, key: str, path: str, seed: int = 100) -> None:
    """Complete rows in random order as JSON lines, labels space-separated."""
    rows = shuffle(drop_missing(df), key, seed)
    rows.withColumn("categories", label_string(F.col("categories"))).write.mode("overwrite").json(path)


def write_instances(instances: DataFrame, path: str) -> None:
    """Instance lines; replaces what is there."""
    instance_lines(instances).write.mode("overwrite").text(path)


def write_dict(table: DataFrame, key: str, value: str, path: str) -> None:
    """A label-sized two-column table as one JSON object."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    table.agg(F.to_json(F.map_from_entries(pairs)).alias("value")).write.mode("overwrite").text(path)


def write_distribution(everything: DataFrame, reduced: DataFrame, path: str) -> None:
    """Both distributions (``label, cnt``) in one JSON object with the members ``all`` and ``reduced``."""
    parts = everything.select(F.lit("all").alias("part"), "label", "cnt").unionByName(
        reduced.select(F.lit("reduced").alias("part"), "label", "cnt")
    )
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "cnt"))))
    objects = parts.groupBy("part").agg(pairs.alias("counts"))
    both = objects.agg(
        F.struct(
            F.max_by("counts", F.col("part") == "all").alias("all"),
            F.max_by("counts", F.col("part") == "reduced").alias("reduced"),
        ).alias("d")
    )
    both.select(F.to_json("d").alias("value")).write.mode("overwrite").text(path)


def write_settings(spark: SparkSession, results: Mapping, settings: Mapping, path: str) -> None:
    """Scores and settings of a run as one JSON object."""
    import json

    text = json.dumps({"result": dict(results), "setting": dict(settings)})
    spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_field_table(table: DataFrame, path: str) -> None:
    table.select("label", "codes", "cnt", "precision_title", "precision_title_abstract").write.mode("overwrite").csv(
        path, header=True, escape='"'
    )
