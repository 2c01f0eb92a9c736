"""Queries that write a derived table to the shared folder and read it back with the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.catalog import sqltext as q
from paperweave.catalog.registry import query
from paperweave.functions.labels import label_string
from paperweave.operators import distribution as D
from paperweave.operators import instances as I
from paperweave.operators import metrics as M
from paperweave.operators import nested
from paperweave.session import work_path
from paperweave.sinks import writers as W
from paperweave.sources import readers as R

_CORPUS_SQL = "SELECT title, abstract, array_to_string(categories, ' ') AS categories, doi FROM corpus"


def _landed_corpus(t) -> str:
    path = work_path(t.spark, "corpus")
    # more columns than the corpus has, so that the reader has something to leave out
    t.corpus.withColumn("categories", label_string(F.col("categories"))).write.json(path)
    return path


@query("read_corpus", _CORPUS_SQL, "corpus")
def read_corpus(t) -> DataFrame:
    rows = R.read_corpus(t.spark, _landed_corpus(t))
    return rows.withColumn("categories", label_string(F.col("categories")))


@query("read_labelled_text", "SELECT title || abstract AS text, array_to_string(categories, ' ') AS labels FROM corpus", "corpus")
def read_labelled_text(t) -> DataFrame:
    rows = R.read_labelled_text(t.spark, _landed_corpus(t), "title_abstract")
    return rows.withColumn("labels", label_string(F.col("labels")))


_PAPER_COLUMNS = ["paper_id", "abstract", "author", "doi", "publication_month", "publication_year", "title", "label"]


@query(
    "read_papers",
    f"""
    SELECT cast(paper_id AS VARCHAR) AS paper_id, {q.clean('abstract')} AS abstract, author, doi,
           CASE WHEN publication_month = 3 THEN 0 ELSE publication_month END AS publication_month, publication_year, title, label
    FROM papers
    """,
    "papers",
)
def read_papers(t) -> DataFrame:
    path = work_path(t.spark, "papers")
    # a month that is missing, and years as they come from a table with gaps
    month = F.when(F.col("publication_month") != 3, F.col("publication_month"))
    year = F.col("publication_year").cast("double")
    W.write_csv(t.papers.withColumn("publication_month", month).withColumn("publication_year", year).select(*_PAPER_COLUMNS), path)
    return R.read_papers(t.spark, path, _PAPER_COLUMNS)


@query(
    "read_new_labelled",
    "SELECT title, abstract, replace(categories, 'Information science', 'Information Science') AS categories, doi FROM new_papers WHERE title <> '' AND abstract <> ''",
    "new_papers",
)
def read_new_labelled(t) -> DataFrame:
    path = work_path(t.spark, "new")
    rows = t.new_papers.select("title", "abstract", F.col("categories").alias("label"), "doi")
    W.write_csv(rows, path)
    return R.read_new_labelled(t.spark, path, rows.columns)


@query("read_training_papers", "SELECT abstract, author, title, publisher, label FROM papers WHERE label <> 'Science'", "papers")
def read_training_papers(t) -> DataFrame:
    path = work_path(t.spark, "training")
    rows = t.papers.select("abstract", "author", "title", "publisher", "label")
    W.write_csv(rows, path)
    return R.read_training_papers(t.spark, path, rows.columns)


@query("read_taxonomy", "SELECT DISTINCT p_name AS name FROM part")
def read_taxonomy(t) -> DataFrame:
    path = work_path(t.spark, "taxonomy")
    names = t.part.select("p_type", "p_name").distinct()
    branches = names.groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_name", "p_name"))).alias("leaves"))
    tree = branches.agg(F.map_from_entries(F.collect_list(F.struct("p_type", "leaves"))).alias("t"))
    tree.select(F.to_json("t").alias("value")).write.text(path)
    return R.read_taxonomy(t.spark, path).select("name")


@query("read_triples", "SELECT * FROM triples", "triples")
def read_triples(t) -> DataFrame:
    path = work_path(t.spark, "triples")
    rows = t.triples
    escaped = F.regexp_replace(F.col("object"), r'(["\\])', r"\\$1")
    value = F.when(F.col("object_is_literal"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("<"), "object", F.lit(">")))
    line = F.concat(F.lit("<"), "subject", F.lit("> <"), "predicate", F.lit("> "), value, F.lit(" ."))
    rows.select(line.alias("value")).write.text(path)
    return R.read_triples(t.spark, path)


@query(
    "read_statement_pages",
    "SELECT 'C' || o_custkey AS subject, 'P27' AS predicate, o_orderpriority AS object, c_name AS subject_label FROM orders JOIN customer ON c_custkey = o_custkey",
)
def read_statement_pages(t) -> DataFrame:
    path = work_path(t.spark, "statements")
    named = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    subject = F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"))
    statement = F.struct(subject.alias("subject"), F.struct(F.lit("P27").alias("id")).alias("predicate"), F.struct(F.col("o_orderpriority").alias("label")).alias("object"))
    # a page holds up to a thousand statements
    pages = named.groupBy(F.floor(F.col("o_orderkey") / 1000)).agg(F.collect_list(statement).alias("content"))
    pages.select("content").write.json(path)
    return R.read_statement_pages(t.spark, path).drop("object_is_literal")


@query("read_mapping", "SELECT src, dst FROM mapping", "mapping")
def read_mapping(t) -> DataFrame:
    path = work_path(t.spark, "mapping")
    W.write_dict(t.mapping, "src", "dst", path)
    return R.read_mapping(t.spark, path)


_RECORD_SQL = "SELECT rank, title, array_to_string(authors, '|') AS authors, doi, array_to_string(field, '|') AS field, publisher, url, abstract FROM {}"


def _flat(records: DataFrame) -> DataFrame:
    return records.withColumn("authors", F.array_join("authors", "|")).withColumn("field", F.array_join("field", "|"))


@query("read_first_records", _RECORD_SQL.format("first_records"), "first_records")
def read_first_records(t) -> DataFrame:
    path = work_path(t.spark, "first")
    t.first_raw.withColumnRenamed("container", "container-title").write.json(path)
    return _flat(R.read_crossref_records(t.spark, path))


@query("read_second_records", _RECORD_SQL.format("second_records"), "second_records")
def read_second_records(t) -> DataFrame:
    path = work_path(t.spark, "second")
    raw = t.second_records.select(
        "title",
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"),
        "doi",
        F.col("field").alias("fieldsOfStudy"),
        F.col("publisher").alias("venue"),
        "url",
        "abstract",
        "rank",
    )
    raw.write.json(path)
    return _flat(R.read_scholar_records(t.spark, path))


def _plain(x: str) -> str:
    return q.strip(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


_WORDS = ["the", "and", "die", "und", "les", "de", "la", "que", "of"]


@query(
    "extract_page_metadata",
    f"""
    SELECT page_id, nullif({_plain("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")}, '') AS title,
           nullif({_plain("regexp_extract(html, '(?s)<p>(.*?)</p>', 1)")}, '') AS abstract,
           list_filter(list_transform(regexp_extract_all(html, '<li><a href=[^>]*>(.*?)</a>', 1), lambda x: {_plain('x')}),
                       lambda x: x IN ({', '.join(f"'{w}'" for w in _WORDS)}))[-1] AS research_field,
           array_to_string(list_transform(regexp_extract_all(html, '<li><a href=[^>]*>(.*?)</a>', 1)[1:4],
                                          lambda x: trim(replace({_plain('x')}, ',', ''))), '|') AS author
    FROM pages
    """,
)
def extract_page_metadata(t) -> DataFrame:
    link = r"<li><a href=[^>]*>(.*?)</a>"
    found = R.extract_page_metadata(t.pages, {"abstract": r"(?s)<p>(.*?)</p>", "field": link, "author": link}, _WORDS)
    return found.select("page_id", "title", "abstract", "research_field", F.array_join("author", "|").alias("author"))


_REDUCED_SQL = """
    WITH dist AS (SELECT label, count(*) AS cnt FROM (SELECT DISTINCT doc_id, unnest(categories) AS label FROM corpus) t GROUP BY label),
    reduced AS (SELECT label, floor(cnt::DOUBLE / (sum(cnt) OVER ())::DOUBLE * 500.0)::BIGINT AS cnt FROM dist)
"""


@query("reload_reduced", _REDUCED_SQL + "SELECT 'all' AS part, label, cnt FROM dist UNION ALL SELECT 'reduced', label, cnt FROM reduced UNION ALL SELECT 'rows', lang, count(*) FROM documents GROUP BY lang", "corpus")
def reload_reduced(t) -> DataFrame:
    dist = D.label_distribution_multi(t.corpus)
    path = work_path(t.spark, "distribution")
    W.write_distribution(dist, D.quota(dist, 500).select("label", F.col("quota").alias("cnt")), path)
    rows, everything, reduced = R.reload_reduced(t.spark, _landed_corpus(t), path)
    languages = rows.groupBy(F.get("categories", F.lit(0)).alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    named = [("all", everything), ("reduced", reduced), ("rows", languages)]
    parts = [df.select(F.lit(part).alias("part"), "label", "cnt") for part, df in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "read_result_json",
    """
    WITH scores AS (SELECT source AS label, row_number() OVER (ORDER BY source) - 1 AS idx, round(avg(quality), 6) AS precision
                    FROM labels JOIN documents USING (doc_id) GROUP BY source)
    SELECT idx, label, precision FROM scores
    """,
)
def read_result_json(t) -> DataFrame:
    scores = t.labels.join(t.documents, "doc_id").groupBy(F.col("source").alias("label")).agg(F.round(F.avg("quality"), 6).alias("precision"))
    numbered = scores.join(D.label_index(scores), "label")
    lists, names = work_path(t.spark, "precisions"), work_path(t.spark, "label-map")
    pairs = F.array_sort(F.collect_list(F.struct("idx", "precision")))
    numbered.agg(F.to_json(F.transform(pairs, lambda p: p["precision"])).alias("value")).write.text(lists)
    W.write_dict(numbered.withColumn("idx", F.col("idx").cast("string")), "idx", "label", names)
    return R.read_result_json(t.spark, lists, names)


# Sinks -----------------------------------------------------------------------------------------------


@query("write_csv", "SELECT cast(paper_id AS VARCHAR) AS paper_id, title, abstract, author, label FROM papers", "papers")
def write_csv(t) -> DataFrame:
    path = work_path(t.spark, "csv")
    W.write_csv(t.papers.select("paper_id", "title", "abstract", "author", "label"), path)
    schema = "paper_id string, title string, abstract string, author string, label string"
    return t.spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"').na.fill("")


@query("write_json_indexed", "SELECT paper_id, title, label, publication_year FROM papers", "papers")
def write_json_indexed(t) -> DataFrame:
    path = work_path(t.spark, "indexed")
    W.write_json_indexed(t.papers.select("paper_id", "title", "label", "publication_year"), "paper_id", path)
    schema = "index bigint, row struct<title: string, label: string, publication_year: int>"
    back = t.spark.read.schema(schema).json(path)
    return back.select(F.col("index").alias("paper_id"), "row.title", "row.label", "row.publication_year")


@query("write_corpus", "SELECT doc_id, title, abstract, array_to_string(categories, ' ') AS categories FROM corpus WHERE abstract <> '' AND title <> ''", "corpus")
def write_corpus(t) -> DataFrame:
    path = work_path(t.spark, "written")
    gaps = [F.nullif(c, F.lit("")).alias(c) for c in ("title", "abstract")]
    W.write_corpus(t.corpus.select("doc_id", *gaps, "categories"), "doc_id", path)
    return t.spark.read.schema("doc_id bigint, title string, abstract string, categories string").json(path)


@query("write_instances", f"SELECT 'true' || chr(9) || '[test].txt' || chr(9) || '[' || label || ']' || chr(9) || {q.describe(['title', 'publisher'])} AS value FROM papers", "papers")
def write_instances(t) -> DataFrame:
    path = work_path(t.spark, "instances")
    W.write_instances(I.true_instances(t.papers, t.papers.select("label"), ["title_publisher"]), path)
    return t.spark.read.text(path)


@query("write_dict", "SELECT label, count(*)::VARCHAR AS cnt FROM papers GROUP BY label", "papers")
def write_dict(t) -> DataFrame:
    path = work_path(t.spark, "dict")
    W.write_dict(D.value_counts(t.papers, "label"), "label", "cnt", path)
    return R.read_mapping(t.spark, path).select(F.col("src").alias("label"), F.col("dst").alias("cnt"))


@query(
    "write_field_table",
    """
    WITH dist AS (SELECT unnest(categories) AS label, count(*) AS cnt FROM corpus GROUP BY 1),
    grouped AS (SELECT dst AS label, sum(cnt)::BIGINT AS cnt, array_to_string(list_sort(list(dist.label)), ' ') AS codes FROM dist JOIN mapping ON src = dist.label GROUP BY dst)
    SELECT label, codes, cnt, round(cnt / 1000.0, 6) AS precision_title, round(cnt / 3000.0, 6) AS precision_title_abstract FROM grouped
    """,
    "corpus mapping",
)
def write_field_table(t) -> DataFrame:
    path = work_path(t.spark, "fields")
    dist = D.label_distribution_multi(t.corpus, t.mapping.select(F.col("src").alias("label")))
    grouped = dist.join(t.mapping, F.col("label") == F.col("src")).groupBy(F.col("dst").alias("label")).agg(F.sum("cnt").alias("cnt"))
    numbers = D.label_index(grouped)
    both = numbers.join(grouped, "label")
    one = both.select("idx", F.round(F.col("cnt") / 1000.0, 6).alias("precision"))
    two = both.select("idx", F.round(F.col("cnt") / 3000.0, 6).alias("precision"))
    W.write_field_table(M.field_table(dist, t.mapping, numbers, one, two), path)
    schema = "label string, codes string, cnt bigint, precision_title double, precision_title_abstract double"
    return t.spark.read.schema(schema).csv(path, header=True, escape='"')


@query("flatten_events", "SELECT event_id, (props::JSON ->> '$.k') AS value FROM events")
def flatten_events(t) -> DataFrame:
    return nested.flatten_nested(t.events, "event_id", "props").select("event_id", "value")
