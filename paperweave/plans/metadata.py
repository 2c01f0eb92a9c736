"""Complete the paper table: statements, previous run, services, subject mapping."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.constants import FIELD_PREDICATE
from paperweave.functions.text import clean_abstract, clean_subjects
from paperweave.operators.distribution import completeness_stats
from paperweave.operators.filters import needs_enrichment
from paperweave.operators.harmonise import fuzzy_map_labels
from paperweave.operators.joins import apply_mapping, update_from
from paperweave.operators.matching import enrich
from paperweave.operators.triples import StatementSource, papers_from
from paperweave.session import landed
from paperweave.sources.readers import extract_page_metadata, page_records

# What a service's record may change in a paper.
COMPLETED = ["abstract", "crossref_field", "semantic_field", "publisher", "doi", "url"]
RECORD = "title string, authors array<string>, doi string, field array<string>, publisher string, url string, abstract string, rank long"
ASKED = "paper_id string, question string, service string, found boolean"


@dataclass
class Completed:
    papers: DataFrame
    stats: DataFrame
    mappings: dict[str, DataFrame]


def load_papers(spark: SparkSession, source: StatementSource) -> DataFrame:
    """Paper table from statements, one row per paper and label."""
    raw = papers_from(spark, source, FIELD_PREDICATE)
    empty = F.array().cast("array<string>")

    def number(c: str):
        return F.coalesce(F.expr(f"try_cast({c} AS int)"), F.lit(0))

    return raw.select(
        F.col("paper").alias("paper_id"),
        F.lit("").alias("abstract"),
        "author",
        "doi",
        "url",
        number("publication_month").alias("publication_month"),
        number("publication_year").alias("publication_year"),
        clean_abstract(F.col("title")).alias("title"),
        "publisher",
        empty.alias("crossref_field"),
        empty.alias("semantic_field"),
        "label",
    )


def harmonise(papers: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    return apply_mapping(papers, clean_subjects(F.col(column)), mapping)


def complete_metadata(
    papers: DataFrame,
    prior: DataFrame | None,
    first: DataFrame,
    second: DataFrame,
    pages: DataFrame | None,
    taxonomy: DataFrame,
    mappings: dict[str, DataFrame] | None = None,
) -> Completed:
    """Run all stages; each is written once, so a later stage never repeats an earlier one.

    ``mappings`` gives reviewed ``(src, dst)`` tables per subject column; without them the proposed ones
    are applied as they are.
    """
    # the papers are asked for their keys, their rows and their numbers; prior rows meet them once
    papers = landed(papers, "loaded")
    stats = [completeness_stats(papers, "loaded")]
    todo = None
    columns = [c for c in papers.columns if c != "paper_id"]
    if prior is not None:
        papers, todo = update_from(papers, prior, columns)
    asked = needs_enrichment(papers, todo).select("paper_id")
    work = papers.join(asked, "paper_id", "left_semi")
    rest = papers.join(asked, "paper_id", "left_anti")
    done = enrich(landed(work, "asked"), first, second, pages).drop("enriched_from")
    papers = landed(done.unionByName(rest), "enriched")
    stats.append(completeness_stats(papers, "enriched"))
    return _mapped(papers, stats, taxonomy, mappings)


def _mapped(papers: DataFrame, stats: list[DataFrame], taxonomy: DataFrame, mappings: dict[str, DataFrame] | None) -> Completed:
    used = {}
    for column in ("crossref_field", "semantic_field"):
        mapping = (mappings or {}).get(column)
        used[column] = mapping if mapping is not None else landed(fuzzy_map_labels(papers, column, taxonomy), "mapping")
        papers = harmonise(papers, column, used[column])
        stats.append(completeness_stats(papers, column))
    return Completed(papers, reduce(DataFrame.unionByName, stats), used)


def _question() -> Column:
    """Digest of what a service is asked by; unlike the doi in the table it does not change when a record fills it."""
    return F.md5(F.to_json(F.struct("title", "author", "doi")))


def last_run(spark: SparkSession, path: str) -> int:
    """Number of the last published run below ``path``, 0 if there is none."""
    try:
        return spark.read.schema("run int").parquet(os.path.join(path, "published")).agg(F.max("run")).first()[0] or 0
    except AnalysisException:
        return 0


def run_metadata(
    spark: SparkSession,
    source: StatementSource,
    first: DataFrame | None,
    second: DataFrame | None,
    pages: DataFrame | None,
    taxonomy: DataFrame,
    path: str,
    mappings: dict[str, DataFrame] | None = None,
    **page_options,
) -> Completed:
    """From statements to completed papers, in runs that go on from each other.

    ``first`` and ``second`` are record tables, ``pages`` stored pages (``page_id, html``), read with ``page_options``.
    What is None is not asked in this run and stays open; pages need the second service, which is asked for the doi
    they give. Every run keeps its papers below ``path`` and a row per paper and service asked. A later run takes
    over what is complete and asks a service only for papers that no valid record has settled and for which it has
    not been asked. A paper whose title, author or doi differ in the statements counts as new.

    A run counts once its number stands in ``published``, which is written last; one that broke off is repeated and
    replaces its files. Subjects are mapped in every run, so a reviewed mapping takes effect without asking again.
    """
    before = last_run(spark, path)
    papers = load_papers(spark, source).withColumn("_question", _question())
    asked = spark.createDataFrame([], ASKED)
    if before:
        kept = spark.read.parquet(os.path.join(path, f"run={before}", "papers"))
        kept = kept.groupBy("paper_id", "_question").agg(F.min(F.struct(*COMPLETED)).alias("_kept"))
        own = papers.columns
        joined = papers.join(kept, ["paper_id", "_question"], "left")
        done = F.col("_kept").isNotNull()
        papers = joined.select(*[F.when(done, F.col("_kept")[c]).otherwise(F.col(c)).alias(c) if c in COMPLETED else c for c in own])
        asked = spark.read.schema(ASKED).parquet(os.path.join(path, f"run={before}", "asked"))
    papers = landed(papers, "loaded")
    stats = [completeness_stats(papers, "loaded")]

    seen = asked.groupBy("paper_id", F.col("question").alias("_question")).agg(
        F.bool_or("found").alias("_settled"), F.collect_set("service").alias("_services")
    )
    todo = needs_enrichment(papers).join(seen, ["paper_id", "_question"], "left").filter(~F.coalesce("_settled", F.lit(False)))

    def is_open(service: str, given: DataFrame | None) -> Column:
        return F.lit(given is not None) & ~F.coalesce(F.array_contains("_services", service), F.lit(False))

    # without a doi the second service can only be asked for the one that a page gives
    has_doi = F.coalesce(F.col("doi"), F.lit("")) != ""
    rest = F.when(has_doi & is_open("second", second), "second").when(
        ~has_doi & is_open("pages", pages) & F.lit(second is not None), "pages"
    )
    todo = todo.select(*papers.columns, is_open("first", first).alias("_first"), F.coalesce(rest, F.lit("")).alias("_rest"))
    todo = landed(todo.filter(F.col("_first") | (F.col("_rest") != "")), "open")

    nothing = spark.createDataFrame([], RECORD)
    found_pages = None if pages is None else landed(page_records(extract_page_metadata(pages, **page_options)), "pages")
    parts, answers = [], [asked]
    # a handful of kinds: which services a paper is still to be asked of
    for kind in todo.select("_first", "_rest").distinct().collect():
        ask_first, ask_rest = kind["_first"], kind["_rest"]
        part = todo.filter((F.col("_first") == ask_first) & (F.col("_rest") == ask_rest)).drop("_first", "_rest")
        done = enrich(part, first if ask_first else nothing, second if ask_rest else nothing, found_pages if ask_rest == "pages" else None)
        done = landed(done, "enriched")
        parts.append(done.drop("enriched_from"))
        services = [*(["first"] if ask_first else []), *([ask_rest] if ask_rest else [])]
        answers.append(
            done.select(
                "paper_id", F.col("_question").alias("question"),
                F.explode(F.array(*[F.lit(x) for x in services])).alias("service"), (F.col("enriched_from") > 0).alias("found"),
            ).distinct()
        )
    untouched = papers.join(todo.select("paper_id"), "paper_id", "left_anti")
    run = os.path.join(path, f"run={before + 1}")
    reduce(DataFrame.unionByName, [untouched, *parts]).write.mode("overwrite").parquet(os.path.join(run, "papers"))
    reduce(DataFrame.unionByName, answers).write.mode("overwrite").parquet(os.path.join(run, "asked"))
    spark.createDataFrame([(before + 1,)], "run int").write.mode("append").parquet(os.path.join(path, "published"))

    papers = spark.read.schema(papers.schema).parquet(os.path.join(run, "papers")).drop("_question")
    stats.append(completeness_stats(papers, "enriched"))
    return _mapped(papers, stats, taxonomy, mappings)
