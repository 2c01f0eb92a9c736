"""Text instances for a classifier: true ones, sampled and complete false ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.text import description
from paperweave.operators.filters import with_known_label
from paperweave.operators.sampling import sample_false


def descriptions(experiments: Sequence[str]) -> Column:
    """One struct ``(experiment, description)`` per experiment; its columns are the parts of its name."""
    return F.array(
        *[F.struct(F.lit(e).alias("experiment"), description(e.split("_")).alias("description")) for e in experiments]
    )


def _instances(df: DataFrame, is_true: bool, label: str, file: str, experiments: Sequence[str]) -> DataFrame:
    """All experiments in one pass over the rows."""
    each = df.withColumn("_d", F.explode(descriptions(experiments)))
    fixed = [F.lit(is_true).alias("is_true"), F.lit(file).alias("file"), F.col(label).alias("label")]
    return each.select("_d.experiment", *fixed, "_d.description")


def true_instances(df: DataFrame, labels: DataFrame, experiments: Sequence[str], file: str = "test") -> DataFrame:
    """``experiment, is_true, file, label, description`` of the rows with an available label."""
    return _instances(with_known_label(df, labels), True, "label", file, experiments)


def false_instances_sampled(
    df: DataFrame, experiments: Sequence[str], percentage: float, key: str, seed: int = 100, file: str = "test"
) -> DataFrame:
    """A share of the rows with a wrong label each; every experiment gets the same draws."""
    drawn = sample_false(df, percentage, key, seed=seed).filter(F.col("false_label").isNotNull())
    return _instances(drawn, False, "false_label", file, experiments)


def false_instances_full(df: DataFrame, labels: DataFrame, experiments: Sequence[str], file: str = "test") -> DataFrame:
    """Every row with every label but its own. The labels travel as one array, so no join is needed."""
    names = labels.agg(F.sort_array(F.collect_set("label"))).scalar()
    described = _instances(df, False, "label", file, experiments)
    # the text is made before the rows are multiplied
    return described.withColumn("label", F.explode(F.array_remove(names, F.col("label"))))


def instance_lines(instances: DataFrame) -> DataFrame:
    """One tab-separated line per instance, in the column ``value``."""
    line = F.concat_ws(
        "\t",
        F.when(F.col("is_true"), "true").otherwise("false"),
        F.concat(F.lit("["), "file", F.lit("].txt")),
        F.concat(F.lit("["), "label", F.lit("]")),
        "description",
    )
    return instances.select(line.alias("value"))
