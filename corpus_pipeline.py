"""Documents through five stages: quality rules, toxicity, near copies, secrets, packing.

Each stage takes what the one before it kept, written as Parquet and read again. All but the last return the
columns of documents; the last returns a row per piece with its place in a packed sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm import toxicity
from paperweave.llm.common import fresh, read
from paperweave.llm.dedup import drop_near_duplicates
from paperweave.llm.quality import clean_documents
from paperweave.llm.queries import packed
from paperweave.llm.secrets import redact_documents
from paperweave.session import landed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, then documents that lost too much; ``text`` and ``n_chars`` are those of the rest."""
    return clean_documents(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of one half and more go; the model is learned from all labels of the documents at hand."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), toxicity.train_characters(docs))
    mark = fresh(docs.columns, "__toxicity")
    return toxicity.with_toxicity(docs, model, into=mark).filter(F.col(mark) < 0.5).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents with a similarity of 0.8 over five-word shingles, one stays."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark; no document goes."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of at most 4096 ids."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near copies", near_copies),
    ("secrets", secret_scan),
    ("packing", packing),
]

#: The toxicity model and the search for a packing cannot be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
