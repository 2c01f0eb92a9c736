"""Building the labelled corpus: reduce, add new labels, fold rare ones into one class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.constants import NO_LABEL, PLACEHOLDER_LABEL, UNLABELLED_CODES
from paperweave.functions.labels import compact
from paperweave.operators.distribution import (
    label_distribution_multi,
    label_distribution_single,
    quota,
    top_labels,
)
from paperweave.operators.joins import drop_known_doi, labels_absent
from paperweave.operators.sampling import drop_rare, sample_capped, sample_proportional
from paperweave.session import landed


def concat_corpora(*parts: DataFrame) -> DataFrame:
    whole, *rest = parts
    for part in rest:
        whole = whole.unionByName(part)
    return whole


def to_nolabel(df: DataFrame, listed: Sequence[str] = UNLABELLED_CODES, labels: str = "categories") -> DataFrame:
    """Remove the listed labels; a paper that had no other becomes ``nolabel``."""
    kept = F.array_except(F.col(labels), F.array(*[F.lit(x) for x in listed]))
    return df.withColumn(labels, F.when(F.size(kept) == 0, F.array(F.lit(NO_LABEL))).otherwise(kept))


def add_nolabel(new: DataFrame, irrelevant: DataFrame, label: str = "categories") -> DataFrame:
    """New rows of the irrelevant labels, all as ``nolabel``."""
    names = irrelevant.filter(F.col("label") != PLACEHOLDER_LABEL).select(F.col("label").alias(label)).distinct()
    return new.join(names, label, "left_semi").withColumn(label, F.lit(NO_LABEL))


def reduce_by_distribution(
    df: DataFrame, known: DataFrame | None, total: int, k: int, key: str, seed: int = 100, labels: str = "categories"
) -> tuple[DataFrame, DataFrame]:
    """A sample with the label shares of the whole corpus, over its ``k`` most frequent labels.

    Returns the sample and the distribution (``label, cnt, relevant, quota``). Shares are counted before
    papers with a rare label are left out.
    """
    # label-sized and read by every step below
    ranked = landed(top_labels(label_distribution_multi(df, known, labels), k), "label-counts")
    shares = quota(ranked.filter("relevant"), total).select("label", "quota")
    dist = ranked.join(shares, "label", "left").select("label", "cnt", "relevant", "quota")
    kept = drop_rare(df, ranked.filter(~F.col("relevant")).select("label"), key, labels)
    return sample_proportional(kept, shares, key, seed, labels), dist


def add_new_data(
    corpus: DataFrame,
    reduced: DataFrame,
    new: DataFrame,
    mapping: DataFrame,
    k: int,
    limit: int,
    key: str,
    seed: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Add rows of labels the corpus does not have; the rarer ones as ``nolabel``.

    ``corpus`` has a ``categories`` array, ``new`` one label string in ``categories``; ``reduced`` is the
    corpus' ``label, quota`` table. Returns the corpus and the ``label, cnt`` distribution, in which new
    labels keep their spaces while rows hold them without.
    """
    # the new rows are matched with the corpus once; the label table is small
    fresh = landed(drop_known_doi(new, corpus, key), "new-rows")
    ranked = top_labels(label_distribution_single(fresh), k)
    absent = landed(labels_absent(ranked, reduced, mapping), "new-labels")
    wanted = absent.filter("relevant").select("label", "cnt")
    unwanted = absent.filter(~F.col("relevant")).select("label", "cnt")

    capped = sample_capped(fresh, wanted, limit, key, seed)
    capped = capped.withColumn("categories", compact(F.col("categories")))
    rest = add_nolabel(fresh, unwanted)
    columns = corpus.columns
    parts = [p.withColumn("categories", F.array("categories")).select(*columns) for p in (capped, rest)]
    dist = concat_corpora(
        reduced.select("label", F.col("quota").alias("cnt")),
        wanted.select("label", F.least(F.col("cnt"), F.lit(limit).cast("bigint")).alias("cnt")),
        unwanted.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("cnt")).select(F.lit(NO_LABEL).alias("label"), "cnt"),
    )
    return concat_corpora(corpus, *parts), dist
