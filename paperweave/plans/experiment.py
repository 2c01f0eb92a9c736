"""Build the corpus, then train, evaluate and report for each text form."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.constants import TRAIN_SHARE, UNLABELLED_CODES
from paperweave.functions.labels import map_strict, with_lookup
from paperweave.functions.text import paper_text
from paperweave.operators.corpus import add_new_data, reduce_by_distribution, to_nolabel
from paperweave.operators.distribution import label_distribution_multi, move_to_nolabel, moved_counts
from paperweave.operators.features import embedding
from paperweave.operators.learning import label_numbers, predict, train_classifier
from paperweave.operators.linear import LinearModel, predict_text, save_linear, train_text
from paperweave.operators.metrics import confusion, field_table, label_precision, macro_scores, mean_over_batches, test_labels
from paperweave.operators.nested import explode_labels
from paperweave.operators.sampling import random_split
from paperweave.session import landed
from paperweave.sinks.writers import save_model, write_dict, write_distribution, write_field_table, write_settings

#: Embeddings whose terms and weights stay in tables, and whether they have bigrams.
TABLE_FORMS = {"tfidf": False, "tfidf bigram": True}

@dataclass
class Result:
    model: PipelineModel | LinearModel
    predictions: DataFrame
    scores: DataFrame
    precisions: DataFrame
    labels: DataFrame


def build_corpus(
    corpus: DataFrame,
    new: DataFrame,
    mapping: DataFrame,
    total: int,
    k: int,
    new_k: int,
    new_limit: int,
    key: str,
    listed: Sequence[str] = UNLABELLED_CODES,
    seed: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """The balanced corpus and its distribution: reduce, add new labels, fold unwanted ones."""
    known = mapping.select(F.col("src").alias("label"))
    reduced, dist = reduce_by_distribution(corpus, known, total, k, key, seed)
    # the sample is far smaller than the corpus and is read several times from here on
    reduced = landed(reduced.drop("drawn_for"), "reduced")
    quotas = dist.filter("relevant").select("label", "quota")
    # known dois are those of the reduced corpus, as it is the table that gets extended
    merged, merged_dist = add_new_data(reduced, quotas, new, mapping, new_k, new_limit, key, seed)
    moved = moved_counts(merged, listed)
    return to_nolabel(merged, listed), move_to_nolabel(merged_dist, moved, listed)


def prepare(corpus: DataFrame, mapping: DataFrame, experiment: str, key: str, share: float = TRAIN_SHARE) -> DataFrame:
    """``id, text, labels, split`` with mapped label names."""
    rows = with_lookup(corpus, mapping).select(
        F.col(key).alias("id"),
        paper_text(F.col("title"), F.col("abstract"), experiment).alias("text"),
        F.array_distinct(map_strict(F.col("categories"), F.col("_map"))).alias("labels"),
    )
    return random_split(rows, share, "id")


def run_experiment(
    corpus: DataFrame,
    mapping: DataFrame,
    experiment: str,
    key: str,
    embedder: str = "tfidf bigram",
    model: OneVsRest | None = None,
    batch: str | None = None,
    path: str | None = None,
    seed: int = 100,
) -> Result:
    """Split, features, training, prediction and scores of one text form; saved below ``path`` if given.

    The TF-IDF forms train and score with terms and weights in tables. A ``model``, or another form, goes through the
    feature stages and their vectors.
    """
    rows = landed(prepare(corpus, mapping, experiment, key), "split")
    train = explode_labels(rows.filter("split = 'train'"))
    test = rows.filter("split = 'test'")
    keep = ["id", "labels"]
    if embedder in TABLE_FORMS and model is None:
        fitted = train_text(train, "id", "text", "label", TABLE_FORMS[embedder])
        found = predict_text(fitted, test, "text", keep)
    else:
        fitted = train_classifier(train, embedding(embedder, "text", experiment), "label", model)
        found = predict(fitted, test, keep)
    if batch:
        found = found.join(corpus.select(F.col(key).alias("id"), batch), "id")
    predictions = landed(found, "predicted")
    scores = mean_over_batches(predictions, batch, seed) if batch else macro_scores(predictions, seed)
    precisions = label_precision(confusion(predictions, seed), test_labels(predictions))
    labels = label_numbers(rows)
    if path:
        target = os.path.join(path, f"model_{experiment}")
        save_linear(fitted, target) if isinstance(fitted, LinearModel) else save_model(fitted, target)
        numbered = labels.withColumn("idx", F.col("idx").cast("string"))
        write_dict(numbered, "idx", "label", os.path.join(path, f"label-map_{experiment}"))
        write_dict(numbered.join(precisions, "label"), "idx", "precision", os.path.join(path, f"result_precision_{experiment}"))
    return Result(fitted, predictions, scores, precisions, labels)


def run_experiments(
    corpus: DataFrame,
    mapping: DataFrame,
    key: str,
    experiments: Sequence[str] = ("title", "title_abstract"),
    path: str | None = None,
    settings: dict | None = None,
    **options,
) -> dict[str, Result]:
    """Both text forms; with ``path`` the run ends with its report, see :func:`publish_run`."""
    results = {name: run_experiment(corpus, mapping, name, key, path=path, **options) for name in experiments}
    if path:
        publish_run(corpus, mapping, results, path, {"experiments": list(experiments), **options, **(settings or {})})
    return results


def publish_run(corpus: DataFrame, mapping: DataFrame, results: dict[str, Result], path: str, settings: dict) -> None:
    """Distribution, scores with settings, and the field table of a run; the marker ``published`` comes last.

    Each artefact replaces what an earlier attempt left, so a run that broke off is simply repeated; :func:`read_run`
    takes no run without its marker.
    """
    spark = corpus.sparkSession
    names = mapping.select("src", F.trim("dst").alias("dst"))
    dist = landed(label_distribution_multi(corpus, names.select(F.col("src").alias("label"))), "distribution")
    write_distribution(dist, dist.filter("cnt > 0"), os.path.join(path, "distribution"))
    scores = {name: result.scores.first().asDict() for name, result in results.items()}
    plain = {k: v if isinstance(v, (str, int, float, bool, list, type(None))) else str(v) for k, v in settings.items()}
    write_settings(spark, scores, plain, os.path.join(path, "meta-info"))
    if {"title", "title_abstract"} <= set(results):
        # a label that no test row has in one of the forms still has its line, with precision 0
        labels = results["title"].labels
        indexed = {n: labels.join(results[n].precisions, "label", "left").na.fill(0.0, ["precision"]) for n in ("title", "title_abstract")}
        write_field_table(field_table(dist, names, labels, indexed["title"], indexed["title_abstract"]), os.path.join(path, "field-table"))
    write_dict(spark.createDataFrame([("experiments", ",".join(results))], "k string, v string"), "k", "v", os.path.join(path, "published"))


def read_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Texts of the artefacts of a published run by name, and its field table; a run without a marker is an error."""
    try:
        names = json.loads(spark.read.text(os.path.join(path, "published")).first()["value"])["experiments"].split(",")
    except AnalysisException as error:
        raise ValueError(f"no published run below {path}") from error
    texts = ["distribution", "meta-info", *[f"{kind}_{n}" for kind in ("label-map", "result_precision") for n in names]]
    out = {name: spark.read.text(os.path.join(path, name)) for name in texts}
    if {"title", "title_abstract"} <= set(names):
        schema = "label string, codes string, cnt long, precision_title double, precision_title_abstract double"
        out["field-table"] = spark.read.schema(schema).csv(os.path.join(path, "field-table"), header=True, escape='"')
    return out
