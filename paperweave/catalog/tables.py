"""Bibliographic tables derived from the given ones, by SQL that both engines can run.

Every derived table keeps all rows and whole texts: a title is the first sentence of a document, its
abstract is the rest. Service records are the documents with changes chosen by hash, so that close, far
and missing matches all occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperweave.session import spread

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


# Tables with long texts, by key.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


class SparkDialect:
    def h(self, key: str, salt: str, mod: int) -> str:
        return f"cast(conv(substr(md5(concat(cast({key} as string), ':{salt}')), 1, 8), 16, 10) as bigint) % {mod}"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def word(self, text: str, i: int) -> str:
        return f"regexp_replace(coalesce(get(split({text}, ' ', 6), {i - 1}), ''), '[^A-Za-z]', '')"

    def table(self, name: str) -> str:
        return "{" + name + "}"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    empty_array = "cast(array() as array<string>)"
    # braces name the tables in the text, so literal ones are doubled
    open, close = "{{", "}}"


class DuckDialect:
    def h(self, key: str, salt: str, mod: int) -> str:
        return f"('0x' || substr(md5(concat(cast({key} as varchar), ':{salt}')), 1, 8))::BIGINT % {mod}"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def word(self, text: str, i: int) -> str:
        return f"regexp_replace(split_part({text}, ' ', {i}), '[^A-Za-z]', '', 'g')"

    def table(self, name: str) -> str:
        return name

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    empty_array = "[]::VARCHAR[]"
    open, close = "{", "}"


def corpus(d) -> str:
    return f"""
    SELECT doc_id, title, substr(text, length(title) + 1) AS abstract, lang, source,
           CASE WHEN {d.h('doc_id', 'doi', 7)} = 0 THEN '' ELSE '10.1/' || doc_id END AS doi,
           CASE WHEN n_chars > 2000 THEN {d.array('lang', 'source', "'long'")}
                ELSE {d.array('lang', 'source')} END AS categories
    FROM (SELECT *, regexp_extract(text, '^[^.\\n]*', 0) AS title FROM {d.table('documents')}) t
    """


def papers(d) -> str:
    w = [d.word("text", i) for i in range(1, 5)]
    q = "chr(39)"
    names = f"'[' || {q} || {w[0]} || ' ' || {w[1]} || {q} || ', ' || {q} || {w[2]} || ' ' || {w[3]} || {q} || ']'"
    return f"""
    SELECT doc_id AS paper_id, title, substr(text, length(title) + 1) AS abstract,
           {names} AS author,
           CASE WHEN {d.h('doc_id', 'doi', 7)} = 0 THEN '' ELSE '10.1/' || doc_id END AS doi,
           CASE WHEN {d.h('doc_id', 'url', 5)} = 0 THEN '' ELSE 'http://papers.test/' || doc_id END AS url,
           cast({d.h('doc_id', 'month', 13)} AS int) AS publication_month,
           cast(1990 + {d.h('doc_id', 'year', 30)} AS int) AS publication_year,
           CASE WHEN {d.h('doc_id', 'pub', 6)} = 0 THEN '' ELSE lang || ' press' END AS publisher,
           {d.empty_array} AS crossref_field, {d.empty_array} AS semantic_field,
           CASE WHEN {d.h('doc_id', 'label', 3)} = 0 THEN 'Science' ELSE source END AS label
    FROM (SELECT *, regexp_extract(text, '^[^.\\n]*', 0) AS title FROM {d.table('documents')}) t
    """


def _perturbed_title(d, salt: str) -> str:
    middle = "cast(floor(length(title) / 2) as int)"
    return f"""CASE {d.h('doc_id', salt, 4)}
             WHEN 0 THEN lower(title)
             WHEN 1 THEN substr(title, 1, {middle}) || substr(title, {middle} + 2)
             WHEN 2 THEN reverse(title)
             ELSE title END"""


def _records(d, salt: str) -> str:
    return f"""
    SELECT doc_id AS rank, {_perturbed_title(d, 'title' + salt)} AS title,
           {d.h('doc_id', 'author' + salt, 3)} AS how, {', '.join(f'{d.word("text", i)} AS w{i}' for i in range(1, 5))},
           CASE {d.h('doc_id', 'doi' + salt, 4)} WHEN 0 THEN '' WHEN 1 THEN '10.9/' || (doc_id + 1)
                ELSE '10.1/' || doc_id END AS doi,
           CASE WHEN {d.h('doc_id', 'abs' + salt, 3)} = 0 THEN ''
                ELSE '<jats:p>Abstract ' || substr(text, length(title) + 1) || '</jats:p>' END AS abstract,
           lang, source
    FROM (SELECT *, regexp_extract(text, '^[^.\\n]*', 0) AS title FROM {d.table('documents')}) t
    """


def _two(d, a: str, b: str, c: str, e: str) -> str:
    one = d.struct(given=a, family=b)
    two = d.struct(given=c, family=e)
    return d.array(one, two)


def first_raw(d) -> str:
    """Records of the first service as they are delivered."""
    return f"""
    SELECT {d.array('title')} AS title,
           CASE how WHEN 0 THEN {_two(d, 'w1', 'w2', 'w3', 'w4')}
                    WHEN 1 THEN {_two(d, "substr(w1, 1, 1) || '.'", 'w2', 'w3', 'w4')}
                    ELSE {_two(d, 'reverse(w1)', 'reverse(w2)', "'x'", 'reverse(w3)')} END AS author,
           doi AS DOI, {d.array('source', 'lang')} AS subject, 'Journal of ' || source AS container,
           'http://first.test/' || rank AS URL, abstract, rank
    FROM ({_records(d, '1')}) r
    """


def first_records(d) -> str:
    if isinstance(d, SparkDialect):
        names = "transform(author, a -> concat(a.given, ' ', a.family))"
    else:
        names = "list_transform(author, lambda a: a.given || ' ' || a.family)"
    return f"""
    SELECT {'title[0]' if isinstance(d, SparkDialect) else 'title[1]'} AS title, {names} AS authors, DOI AS doi,
           subject AS field, container AS publisher, URL AS url, abstract, rank
    FROM {d.table('first_raw')}
    """


def second_records(d) -> str:
    """Records of the second service in the common form."""
    return f"""
    SELECT title,
           CASE how WHEN 0 THEN {d.array("w1 || ' ' || w2", "w3 || ' ' || w4")}
                    WHEN 1 THEN {d.array("w1", "w4")}
                    ELSE {d.array("reverse(w1) || 'q'")} END AS authors,
           doi, {d.array('lang')} AS field, 'Venue ' || lang AS publisher, 'http://second.test/' || rank AS url,
           abstract, rank
    FROM ({_records(d, '2')}) r
    """


def page_rows(d) -> str:
    """Page records in the common form, most without a doi."""
    return f"""
    SELECT title,
           CASE how WHEN 0 THEN {d.array("w1 || ' ' || w2")} WHEN 1 THEN {d.empty_array}
                    ELSE {d.array("w3 || ' ' || w4")} END AS authors,
           CASE WHEN {d.h('rank', 'pagedoi', 3)} = 0 THEN '10.1/' || rank ELSE '' END AS doi,
           {d.array('source')} AS field, 'Page ' || source AS publisher, '' AS url, abstract, rank
    FROM ({_records(d, '3')}) r
    """


def prior(d) -> str:
    """An earlier run: some rows found by doi, some by title only, some not at all."""
    return f"""
    SELECT paper_id AS ord,
           CASE WHEN {d.h('paper_id', 'ptitle', 3)} = 0 THEN title || ' (draft)' ELSE title END AS title,
           'earlier ' || abstract AS abstract, author,
           CASE {d.h('paper_id', 'pdoi', 3)} WHEN 0 THEN '' WHEN 1 THEN '10.7/' || paper_id
                ELSE '10.1/' || paper_id END AS doi,
           'http://prior.test/' || paper_id AS url, publication_month, publication_year,
           'prior press' AS publisher, crossref_field, semantic_field, label
    FROM {d.table('papers')}
    """


def mapping(d) -> str:
    """Codes to names, many to one."""
    return f"""
    SELECT 'src' || n_nationkey AS src, r_name AS dst
    FROM {d.table('nation')} JOIN {d.table('region')} ON n_regionkey = r_regionkey
    """


def full_mapping(d) -> str:
    """The same for every code of the corpus."""
    return f"""
    SELECT src, dst FROM {d.table('mapping')}
    UNION ALL SELECT DISTINCT lang, ' ' || upper(lang) || ' ' FROM {d.table('documents')}
    UNION ALL SELECT 'long', 'LONG TEXT'
    """


def subjects(d) -> str:
    """Papers with foreign subjects: parts give the names, some of them misspelt or turned round."""
    first, second = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
    bent = f"""CASE {d.h('p_partkey', 'bend', 4)} WHEN 0 THEN p_name || 's' WHEN 1 THEN {second} || ' ' || {first}
               WHEN 2 THEN '(' || p_name || ')' ELSE p_type END"""
    return f"""
    SELECT paper_id, label, {d.array('p_brand', bent, 'p_type')} AS crossref_field,
           {d.array(bent, "'AI, ' || p_type")} AS semantic_field
    FROM {d.table('papers')} JOIN {d.table('part')} ON p_partkey = paper_id
    """


def taxonomy(d) -> str:
    return f"SELECT DISTINCT p_name AS name, p_name AS ord FROM {d.table('part')}"


def part_documents(d) -> str:
    """A nested document per part; the type stands both directly in a list and in an object in it."""
    o, c = d.open, d.close
    return f"""
    SELECT p_partkey, '{o}"name":"' || p_name || '","in":{o}"brand":"' || p_brand || '","kinds":["' || p_type ||
           '",{o}"type":"' || p_type || '","size":' || p_size || '{c}]{c}{c}' AS doc
    FROM {d.table('part')}
    """


def triples(d) -> str:
    """Statements about customers as papers, nations as fields and orders as repeated values."""
    base, word = "'http://data.test/resource/", "'http://data.test/predicate/"

    def rows(subject: str, predicate: str, obj: str, literal: str, table: str) -> str:
        return f"SELECT {subject} AS subject, {predicate}' AS predicate, {obj} AS object, {literal} AS object_is_literal FROM {d.table(table)}"

    c, n, r = f"{base}C' || c_custkey", f"{base}N' || n_nationkey", f"{base}R' || r_regionkey"
    name = "'http://www.w3.org/2000/01/rdf-schema#label"
    return "\nUNION ALL ".join(
        [
            rows(c, word + "P30", f"{base}N' || c_nationkey", "true", "customer").replace("true AS", "false AS"),
            rows(c, name, "c_name", "true", "customer"),
            rows(c, word + "HAS_VENUE", "c_mktsegment", "true", "customer"),
            rows(c, word + "P26", "'10.1/' || c_custkey", "true", "customer"),
            rows(f"{base}C' || o_custkey", word + "P27", "o_orderpriority", "true", "orders"),
            rows(f"{base}C' || o_custkey", word + "P29", f"{base}Y' || year(o_orderdate)", "false", "orders"),
            rows(n, name, "n_name", "true", "nation"),
            rows(n, word + "part_of", f"{base}R' || n_regionkey", "false", "nation"),
            rows(r, name, "r_name", "true", "region"),
        ]
    )


def paper_triples(d) -> str:
    """The papers as statements; their labels are nodes with names of their own."""
    node, base = "'http://data.test/resource/", "'http://data.test/predicate/"
    name = "'http://www.w3.org/2000/01/rdf-schema#label'"
    subject = f"{node}P' || paper_id"

    def literal(predicate: str, obj: str, where: str = "") -> str:
        return f"SELECT {subject} AS subject, {predicate} AS predicate, {obj} AS object, true AS object_is_literal FROM {d.table('papers')} {where}"

    values = {"P26": "doi", "P27": "author", "HAS_VENUE": "publisher", "url": "url"}
    return "\nUNION ALL ".join(
        [
            f"SELECT {subject} AS subject, {base}P30' AS predicate, {node}F-' || label AS object, false AS object_is_literal FROM {d.table('papers')}",
            f"SELECT DISTINCT {node}F-' || label AS subject, {name} AS predicate, label AS object, true AS object_is_literal FROM {d.table('papers')}",
            literal(name, "title"),
            literal(base + "P29'", "cast(publication_year AS varchar(9))"),
            *[literal(f"{base}{p}'", c, f"WHERE {c} <> ''") for p, c in values.items()],
        ]
    )


def stored_pages(d) -> str:
    """Web pages that hold the page records, with marks around their parts."""
    spark = isinstance(d, SparkDialect)
    mark = '<span data-selenium-selector="author-list">'
    listed = f"CASE WHEN {'size' if spark else 'len'}(authors) > 0 THEN '{mark}' || {'array_join' if spark else 'array_to_string'}(authors, ',</span>{mark}') || ',</span>' ELSE '' END"
    return f"""
    SELECT rank AS page_id, '<html><h1 data-x="1">' || replace(title, '<', '') || '</h1><a class="doi__link" href="#">' || doi ||
           '</a><span class="abstract__text">' || replace(abstract, '<', '') || '</span><span data-heap-id="paper-meta-journal">' || publisher ||
           '</span><li class="paper-meta-item">' || field_name || '</li>' || {listed} || '</html>' AS html
    FROM (SELECT *, {'field[0]' if spark else 'field[1]'} AS field_name FROM {d.table('page_rows')}) r
    """


def lemmas(d) -> str:
    """A dictionary: every twentieth word of the documents has a lemma of its own, some of them two."""
    each = "explode(split(lower(text), ' '))" if isinstance(d, SparkDialect) else "unnest(string_split(lower(text), ' '))"
    return f"""
    SELECT word, substr(word, 1, 3) || 'um' AS lemma FROM (SELECT DISTINCT {each} AS word FROM {d.table('documents')}) w
    WHERE word <> '' AND {d.h('word', 'lemma', 20)} = 0
    UNION ALL SELECT word, 'zz' FROM (SELECT DISTINCT {each} AS word FROM {d.table('documents')}) w WHERE {d.h('word', 'lemma', 40)} = 0
    """


def predictions(d) -> str:
    """Papers with their labels and one guessed label."""
    return f"""
    SELECT doc_id AS id, categories AS labels, doc_id % 3 AS batch,
           CASE {d.h('doc_id', 'guess', 4)} WHEN 0 THEN lang WHEN 1 THEN source
                WHEN 2 THEN 'src' || ({d.h('doc_id', 'wrong', 23)}) ELSE 'en' END AS pred
    FROM {d.table('corpus')}
    """


def new_papers(d) -> str:
    """Newly labelled papers: half share a doi with the corpus, some have none."""
    return f"""
    SELECT doc_id + 1000000 AS doc_id, title, abstract,
           CASE {d.h('doc_id', 'newlabel', 6)} WHEN 0 THEN 'Science' WHEN 1 THEN source
                ELSE 'Topic ' || lang || ' ' || ({d.h('doc_id', 'topic', 5)}) END AS categories,
           CASE {d.h('doc_id', 'newdoi', 4)} WHEN 0 THEN NULL WHEN 1 THEN '10.1/' || doc_id
                ELSE '10.3/' || doc_id END AS doi
    FROM {d.table('corpus')}
    """


DERIVED = {
    "corpus": (corpus, ["documents"]),
    "papers": (papers, ["documents"]),
    "first_raw": (first_raw, ["documents"]),
    "first_records": (first_records, ["first_raw"]),
    "second_records": (second_records, ["documents"]),
    "page_rows": (page_rows, ["documents"]),
    "prior": (prior, ["papers"]),
    "mapping": (mapping, ["nation", "region"]),
    "full_mapping": (full_mapping, ["mapping", "documents"]),
    "subjects": (subjects, ["papers", "part"]),
    "taxonomy": (taxonomy, ["part"]),
    "part_documents": (part_documents, ["part"]),
    "paper_triples": (paper_triples, ["papers"]),
    "stored_pages": (stored_pages, ["page_rows"]),
    "triples": (triples, ["customer", "orders", "nation", "region"]),
    "lemmas": (lemmas, ["documents"]),
    "predictions": (predictions, ["corpus"]),
    "new_papers": (new_papers, ["corpus"]),
}


class Tables:
    """The given and the derived tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return spread(table, TEXT_TABLES[name]) if name in TEXT_TABLES else table
        if name in DERIVED:
            build, needs = DERIVED[name]
            return self.spark.sql(build(SparkDialect()), **{n: getattr(self, n) for n in needs})
        raise AttributeError(name)


def with_tables(sql: str, uses: list[str]) -> str:
    """``sql`` with the derived tables it reads in front, as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in GIVEN or name in order:
            return
        for need in DERIVED[name][1]:
            visit(need)
        order.append(name)

    for name in uses:
        visit(name)
    # common tables of the query itself follow the derived ones
    parts = [f"{n} AS ({DERIVED[n][0](DuckDialect())})" for n in order]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*parts, body[5:]]) if parts else body
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
