"""Readers. Every schema is explicit; nothing is inferred and nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.constants import LEGACY_CODES, PAGE_FIELDS, PLACEHOLDER_LABEL
from paperweave.functions.labels import label_array, lookup, map_lenient
from paperweave.functions.text import clean_abstract, full_names, page_field, page_fields
from paperweave.operators.filters import drop_missing, rename_and_fix
from paperweave.operators.nested import flatten_nested

# Texts that a table file uses for "no value".
NULL_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

CORPUS_SCHEMA = "title string, abstract string, categories string, doi string"
PAPER_COLUMNS = ["abstract", "author", "doi", "url", "publication_month", "publication_year", "title",
                 "publisher", "crossref_field", "semantic_field", "label"]
FIRST_RECORD_SCHEMA = (
    "title array<string>, author array<struct<given:string,family:string>>, DOI string, subject array<string>, "
    "`container-title` string, URL string, abstract string, rank bigint"
)
SECOND_RECORD_SCHEMA = (
    "title string, authors array<struct<name:string>>, doi string, fieldsOfStudy array<string>, venue string, "
    "url string, abstract string, rank bigint"
)
PAGE_SCHEMA = (
    "content array<struct<subject:struct<id:string,label:string>,predicate:struct<id:string>,"
    "object:struct<id:string,label:string>>>"
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; the four corpus columns, ``categories`` as an array with retired codes replaced."""
    raw = spark.read.schema(CORPUS_SCHEMA).json(path)
    codes = map_lenient(label_array(F.col("categories")), lookup(LEGACY_CODES))
    return raw.withColumn("categories", codes)


def read_labelled_text(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """The lazy form for training: text of the experiment and label array, other columns not read."""
    columns = "title string, categories string" if experiment == "title" else "title string, abstract string, categories string"
    raw = spark.read.schema(columns).json(path)
    text = F.col("title") if experiment == "title" else F.concat("title", "abstract")
    return raw.select(text.alias("text"), label_array(F.col("categories")).alias("labels"))


def _table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, all text, "no value" texts as null.

    Abstracts hold line breaks, so a file is one task: write the table as many files of moderate size.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)
    return raw.select(*[F.when(~F.col(c).isin(NULL_TEXTS), F.col(c)).alias(c) for c in columns])


def _whole_number(c: str) -> Column:
    return F.coalesce(F.expr(f"try_cast(try_cast({c} AS double) AS int)"), F.lit(0))


def read_papers(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The paper table: month and year as numbers (0 if missing), other gaps empty, abstract cleaned."""
    columns = columns or PAPER_COLUMNS
    raw = _table(spark, path, columns)
    rules = {
        "publication_month": _whole_number("publication_month"),
        "publication_year": _whole_number("publication_year"),
        "abstract": clean_abstract(F.col("abstract")),
    }
    return raw.select(*[rules.get(c, F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])


def read_new_labelled(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Newly labelled papers: complete title and abstract, ``categories`` renamed from ``label`` and corrected."""
    named = rename_and_fix(_table(spark, path, columns))
    return drop_missing(named).select("title", "abstract", "categories", "doi")


def read_training_papers(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Gaps empty, placeholder labels left out."""
    return _table(spark, path, columns).na.fill("").filter(F.col("label") != PLACEHOLDER_LABEL)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``name`` of all leaves of a nested JSON document, ``ord`` by their path."""
    documents = spark.read.text(path, wholetext=True).select(F.lit(0).alias("doc_id"), F.col("value").alias("doc"))
    leaves = flatten_nested(documents, "doc_id", "doc")
    return leaves.groupBy(F.col("value").alias("name")).agg(F.min("path").alias("ord"))


# Subject, predicate, then an identifier, a blank node or a literal with its escapes. Nothing in it is tried twice
# or matched by recursion, so the length of a literal does not matter.
_TRIPLE = r'^(?:<([^>]*+)>|(_:\S++))\s++<([^>]*+)>\s++(?:<([^>]*+)>|(_:\S++)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"[^\s"]*+)\s*+\.\s*+(?:#.*)?$'


def _statement_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def _unescaped(literal: Column) -> Column:
    """The text of a literal: JSON knows all its escapes but the one with eight digits."""
    # a doubled backslash first, so that what follows it is no escape
    plain = F.regexp_replace(literal, r"\\\\", r"\\u005C")
    code = r"\\U([0-9A-Fa-f]{8})"

    def char(digits: Column) -> Column:
        # up to four digits JSON has an escape, above them the character itself stands in the text
        return F.when(digits.startswith("0000"), F.concat(F.lit("\\u"), F.substring(digits, 5, 4))).otherwise(
            F.decode(F.unhex(digits), "UTF-32")
        )

    codes = F.regexp_extract_all(plain, F.lit(code), F.lit(1))
    parts = F.transform(F.split(plain, code), lambda part, n: F.concat(part, F.coalesce(char(F.get(codes, n)), F.lit(""))))
    text = F.when(F.contains(plain, F.lit("\\U")), F.array_join(parts, "")).otherwise(plain)
    options = {"allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}
    return F.from_json(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "v string", options)["v"]


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples, one statement per line -> subject, predicate, object, object_is_literal.

    Lines that are no statement are left out; :func:`unparsed_triples` has them.
    """

    def part(i: int) -> Column:
        return F.regexp_extract("line", _TRIPLE, i)

    stated = _statement_lines(spark, path).filter(F.col("line").rlike(_TRIPLE))
    groups = stated.select(*[part(i).alias(f"g{i}") for i in range(1, 7)])
    is_literal = (F.col("g4") == "") & (F.col("g5") == "")
    return groups.select(
        F.concat("g1", "g2").alias("subject"),
        F.col("g3").alias("predicate"),
        F.when(is_literal, _unescaped(F.col("g6"))).otherwise(F.concat("g4", "g5")).alias("object"),
        is_literal.alias("object_is_literal"),
    )


def unparsed_triples(spark: SparkSession, path: str) -> DataFrame:
    """``line``: what :func:`read_triples` leaves out, but for blank lines and comments."""
    return _statement_lines(spark, path).filter(~F.col("line").rlike(_TRIPLE))


def read_statement_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed service pages -> statements; the service gives objects by name, so all are literals."""
    pages = spark.read.schema(PAGE_SCHEMA).json(path)
    s = F.col("s")
    return pages.select(F.explode("content").alias("s")).select(
        s["subject"]["id"].alias("subject"),
        s["predicate"]["id"].alias("predicate"),
        s["object"]["label"].alias("object"),
        F.lit(True).alias("object_is_literal"),
        s["subject"]["label"].alias("subject_label"),
    )


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A flat JSON object, one per file -> ``src, dst``."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "map<string,string>")).alias("src", "dst")
    return text.select(entries)


def read_distribution(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """The ``all`` or ``reduced`` part of a distribution file -> ``label, cnt``."""
    text = spark.read.text(path, wholetext=True)
    parts = F.from_json("value", "map<string,map<string,bigint>>")
    return text.select(F.explode(F.try_element_at(parts, F.lit(variant))).alias("label", "cnt"))


def reload_reduced(spark: SparkSession, corpus: str, distribution: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A written corpus with its two distributions."""
    rows = spark.read.schema(CORPUS_SCHEMA).json(corpus).withColumn("categories", label_array(F.col("categories")))
    return rows, read_distribution(spark, distribution, "all"), read_distribution(spark, distribution, "reduced")


def read_result_json(spark: SparkSession, precisions: str, label_map: str) -> DataFrame:
    """``idx, label, precision`` from a list of precisions and the number -> label object beside it."""
    listed = spark.read.text(precisions, wholetext=True).select(
        F.posexplode(F.from_json("value", "array<double>")).alias("idx", "precision")
    )
    names = read_mapping(spark, label_map).select(F.col("src").cast("int").alias("idx"), F.col("dst").alias("label"))
    return listed.join(names, "idx").select("idx", "label", "precision")


def first_records(raw: DataFrame) -> DataFrame:
    """Records of the first service in the common form of :mod:`paperweave.operators.matching`."""
    return raw.select(
        F.get("title", F.lit(0)).alias("title"),
        full_names(F.coalesce("author", F.array().cast("array<struct<given:string,family:string>>"))).alias("authors"),
        F.coalesce("DOI", F.lit("")).alias("doi"),
        F.coalesce("subject", F.array().cast("array<string>")).alias("field"),
        F.coalesce("container-title", F.lit("")).alias("publisher"),
        F.coalesce("URL", F.lit("")).alias("url"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        "rank",
    )


def second_records(raw: DataFrame) -> DataFrame:
    names = F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: F.coalesce(a["name"], F.lit("")))
    return raw.select(
        F.coalesce("title", F.lit("")).alias("title"),
        names.alias("authors"),
        F.coalesce("doi", F.lit("")).alias("doi"),
        F.coalesce("fieldsOfStudy", F.array().cast("array<string>")).alias("field"),
        F.coalesce("venue", F.lit("")).alias("publisher"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        "rank",
    )


def read_crossref_records(spark: SparkSession, path: str) -> DataFrame:
    return first_records(spark.read.schema(FIRST_RECORD_SCHEMA).json(path))


def read_scholar_records(spark: SparkSession, path: str) -> DataFrame:
    return second_records(spark.read.schema(SECOND_RECORD_SCHEMA).json(path))


# Where a stored paper page holds what; each pattern has one group.
PAGE_PATTERNS = {
    "title": r"(?s)<h1[^>]*>(.*?)</h1>",
    "doi": r'(?s)class="[^"]*doi__link[^"]*"[^>]*>(.*?)</a>',
    "abstract": r'(?s)class="[^"]*abstract__text[^"]*"[^>]*>(.*?)</',
    "publisher": r'(?s)data-heap-id="paper-meta-journal"[^>]*>(.*?)</span>',
    "field": r'(?s)class="[^"]*paper-meta-item[^"]*"[^>]*>(.*?)</',
    "year": r'(?s)data-selenium-selector="paper-year"[^>]*>(.*?)</span>',
    "author": r'(?s)data-selenium-selector="author-list"[^>]*>(.*?)</span>',
}
MOST_AUTHORS = 4


def extract_page_metadata(
    pages: DataFrame,
    patterns: dict[str, str] | None = None,
    fields: list[str] = PAGE_FIELDS,
    html: str = "html",
    keep: tuple[str, ...] = ("page_id",),
    most_authors: int | None = MOST_AUTHORS,
) -> DataFrame:
    """Title, doi, abstract, publisher, year, the last known field and the authors of each page.

    As published only the first ``most_authors`` authors count; ``None`` keeps all of them.
    """
    patterns = {**PAGE_PATTERNS, **(patterns or {})}
    h = F.col(html)
    known = F.filter(page_fields(h, patterns["field"]), lambda x: x.isin(list(fields)))
    authors = page_fields(h, patterns["author"])
    if most_authors is not None:
        authors = F.slice(authors, 1, most_authors)
    single = [page_field(h, patterns[c]).alias(c) for c in ("title", "doi", "abstract", "publisher", "year")]
    return pages.select(
        *keep,
        *single,
        F.try_element_at(known, F.lit(-1)).alias("research_field"),
        F.transform(authors, lambda a: F.trim(F.replace(a, F.lit(","), F.lit("")))).alias("author"),
    )


def page_records(pages: DataFrame, rank: str = "page_id") -> DataFrame:
    """Extracted pages in the common record form."""
    return pages.select(
        "title",
        F.col("author").alias("authors"),
        F.coalesce("doi", F.lit("")).alias("doi"),
        F.array_compact(F.array("research_field")).alias("field"),
        F.coalesce("publisher", F.lit("")).alias("publisher"),
        F.lit("").alias("url"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.col(rank).alias("rank"),
    )
