"""Training and test instance files from the paper table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.operators.distribution import labels_by_threshold
from paperweave.operators.filters import select_complete, with_known_label, without_placeholder
from paperweave.operators.instances import false_instances_full, false_instances_sampled, true_instances
from paperweave.operators.sampling import stratified_split
from paperweave.session import landed

DESCRIPTION_COLUMNS = ["abstract", "author", "title", "publisher"]


def select_training_rows(papers: DataFrame, threshold: int, most: int, key: str = "paper_id") -> DataFrame:
    """Complete rows whose label is frequent enough."""
    rows = select_complete(without_placeholder(papers), [key, *DESCRIPTION_COLUMNS, "label"])
    dist = rows.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    return with_known_label(rows, labels_by_threshold(dist, threshold, most))


def build_instances(
    papers: DataFrame,
    experiments: Sequence[str] = ("title", "title_publisher", "title_abstract"),
    threshold: int = 20,
    most: int = 1000,
    ratio: float = 0.7,
    percentage: float = 0.4,
    with_false: bool = False,
    key: str = "paper_id",
    seed: int = 100,
) -> DataFrame:
    """``experiment, split`` and the instance columns, for each set of description columns."""
    # the chosen rows and their split are read by every branch below
    rows = landed(select_training_rows(papers, threshold, most, key), "training-rows")
    labels = landed(rows.select("label").distinct(), "labels")
    parted = landed(stratified_split(rows, ratio, key, seed=seed), "split")
    test = F.col("split") == "test"
    true = [
        true_instances(parted.filter(rule), labels, experiments).withColumn("split", F.lit(name))
        for name, rule in (("train", ~test), ("test", test))
    ]
    if not with_false:
        return true[0].unionByName(true[1])
    sampled = false_instances_sampled(parted.filter(~test), experiments, percentage, key, seed)
    full = false_instances_full(parted.filter(test), labels, experiments)
    false = [sampled.withColumn("split", F.lit("train")), full.withColumn("split", F.lit("test"))]
    return true[0].unionByName(true[1]).unionByName(false[0]).unionByName(false[1])
