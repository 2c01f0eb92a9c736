"""Queries over text, label and column functions, filters and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.catalog import sqltext as q
from paperweave.catalog.registry import query
from paperweave.functions import labels as L
from paperweave.functions import similarity, text
from paperweave.functions.hashing import hash_fraction, hash_order
from paperweave.operators import filters, nested
from paperweave.operators.lemmas import lemma_tokens


@query("clean_abstract", f"SELECT doc_id, {q.clean('t')} AS abstract FROM (SELECT doc_id, '<jats:p>Abstract ' || text || '</jats:p>' || chr(10) AS t FROM documents) d")
def clean_abstract(t) -> DataFrame:
    wrapped = F.concat(F.lit("<jats:p>Abstract "), "text", F.lit("</jats:p>\n"))
    return t.documents.select("doc_id", text.clean_abstract(wrapped).alias("abstract"))


@query("tokenize_clean", f"SELECT doc_id, array_to_string({q.tokens('text')}, ' ') AS tokens FROM documents")
def tokenize_clean(t) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(text.tokens("text"), " ").alias("tokens"))


@query(
    "tokenize_lemmas",
    f"""
    WITH dictionary AS (SELECT lower(word) AS word, min(lemma) AS lemma FROM lemmas WHERE word <> '' AND lemma <> '' GROUP BY 1),
    raw AS (SELECT doc_id, list_transform({q.words('text')}, lambda w: lower(w)) AS ws FROM documents),
    each AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM raw),
    found AS (SELECT doc_id, string_agg(coalesce(lemma, {q.singular('w')}), ' ' ORDER BY pos) AS tokens FROM each LEFT JOIN dictionary ON word = w GROUP BY doc_id)
    SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN found USING (doc_id)
    """,
    "lemmas",
)
def tokenize_lemmas(t) -> DataFrame:
    return lemma_tokens(t.documents, "text", t.lemmas, ["doc_id"]).select("doc_id", F.array_join("_words", " ").alias("tokens"))


@query(
    "ngram_terms",
    f"""
    WITH u AS (SELECT doc_id, {q.unigrams(q.tokens('text'))} AS u FROM documents)
    SELECT doc_id, len({q.with_bigrams('u')}) AS n_terms, md5(array_to_string({q.with_bigrams('u')}, '|')) AS digest FROM u
    """,
)
def ngram_terms(t) -> DataFrame:
    tokens = t.documents.select("doc_id", text.tokens("text").alias("tokens"))
    terms = tokens.select("doc_id", text.terms("tokens").alias("terms"))
    return terms.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("digest"))


@query(
    "map_legacy",
    """
    SELECT doc_id, array_to_string(list_transform(categories, lambda x: coalesce(list_extract(map_extract(m, x), 1), x)), ' ') AS categories
    FROM corpus, (SELECT map(list(src), list(dst)) AS m FROM mapping) mm
    """,
    "corpus mapping",
)
def map_legacy(t) -> DataFrame:
    mapped = L.map_lenient(F.col("categories"), F.col("_map"))
    return L.with_lookup(t.corpus, t.mapping).select("doc_id", L.label_string(mapped).alias("categories"))


@query("has_label", "SELECT doc_id, list_contains(categories, 'en') AS is_en, list_contains(categories, 'lon') AS is_lon FROM corpus", "corpus")
def has_label(t) -> DataFrame:
    c = F.col("categories")
    return t.corpus.select("doc_id", L.has_label(c, "en").alias("is_en"), L.has_label(c, "lon").alias("is_lon"))


@query("drop_label", "SELECT doc_id, array_to_string(list_filter(categories, lambda x: x <> 'long'), ' ') AS rest FROM corpus", "corpus")
def drop_label(t) -> DataFrame:
    return t.corpus.select("doc_id", L.label_string(L.drop_label(F.col("categories"), "long")).alias("rest"))


@query(
    "normalise_subjects",
    "SELECT doc_id, array_to_string(list_transform(string_split(text, ','), lambda x: trim(regexp_replace(x, '[^a-zA-Z ]+', '', 'g'))), '|') AS subjects FROM documents",
)
def normalise_subjects(t) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(text.normalise_subjects(F.col("text")), "|").alias("subjects"))


@query("build_description", f"SELECT paper_id, {q.describe(['title', 'abstract', 'publisher'])} AS description FROM papers", "papers")
def build_description(t) -> DataFrame:
    return t.papers.select("paper_id", text.description(["title", "abstract", "publisher"]).alias("description"))


@query("ascii_fold", f"SELECT doc_id, {q.ascii_only('text')} AS folded FROM documents")
def ascii_fold(t) -> DataFrame:
    return t.documents.select("doc_id", text.ascii_only(F.col("text")).alias("folded"))


@query(
    "similarity_ratio",
    f"""
    WITH p AS (SELECT p_partkey, p_name AS a, lower(p_type) || ' ' || split_part(p_name, ' ', 1) AS b FROM part)
    SELECT p_partkey, {q.ratio('a', 'b')} AS score, {q.at_least('a', 'b', 60)} AS at_least_60 FROM p
    """,
)
def similarity_ratio(t) -> DataFrame:
    b = F.concat(F.lower("p_type"), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)))
    pairs = t.part.select("p_partkey", F.col("p_name").alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return pairs.select("p_partkey", similarity.ratio(a, b).alias("score"), similarity.at_least(a, b, 60).alias("at_least_60"))


@query("weighted_ratio")
def weighted_ratio(t) -> DataFrame:
    b = F.concat("p_type", F.lit(" ("), "p_name", F.lit(")"))
    return t.part.select("p_partkey", similarity.weighted_ratio(F.col("p_name"), b).alias("score"))


@query("normalise_authors", f"SELECT paper_id, array_to_string({q.own_authors('author')}, '|') AS authors FROM papers", "papers")
def normalise_authors(t) -> DataFrame:
    return t.papers.select("paper_id", F.array_join(text.normalise_authors(F.col("author")), "|").alias("authors"))


@query("compact_label", "SELECT doc_id, replace(lang || ' ' || source, ' ', '') AS label FROM documents")
def compact_label(t) -> DataFrame:
    return t.documents.select("doc_id", L.compact(F.concat("lang", F.lit(" "), "source")).alias("label"))


@query("local_name", "SELECT page_id, list_last(string_split(url, '/')) AS name FROM pages")
def local_name(t) -> DataFrame:
    return t.pages.select("page_id", text.local_name(F.col("url")).alias("name"))


@query(
    "author_names",
    "SELECT rank, array_to_string(list_transform(author, lambda a: coalesce(a.given, '') || ' ' || coalesce(a.family, '')), '|') AS names FROM first_raw",
    "first_raw",
)
def author_names(t) -> DataFrame:
    return t.first_raw.select("rank", F.array_join(text.full_names(F.col("author")), "|").alias("names"))


@query(
    "first_and_rest_labels",
    "SELECT doc_id, categories[1] AS first, array_to_string(categories[2:], ' ') AS rest FROM corpus",
    "corpus",
)
def first_and_rest_labels(t) -> DataFrame:
    c = F.col("categories")
    return t.corpus.select("doc_id", L.first_label(c).alias("first"), L.label_string(L.rest_labels(c)).alias("rest"))


_MAPPED = "list_transform(categories, lambda x: {}) AS names FROM corpus, (SELECT map(list(src), list(dst)) AS m FROM {}) mm"


@query(
    "map_strict",
    "SELECT doc_id, array_to_string(names, ';') AS names FROM (SELECT doc_id, " + _MAPPED.format("trim(map_extract(m, x)[1])", "full_mapping") + ") t",
    "corpus full_mapping",
)
def map_strict(t) -> DataFrame:
    names = L.map_strict(F.col("categories"), F.col("_map"))
    return L.with_lookup(t.corpus, t.full_mapping).select("doc_id", L.label_string(names, ";").alias("names"))


@query(
    "map_lenient",
    "SELECT doc_id, array_to_string(names, ';') AS names FROM (SELECT doc_id, " + _MAPPED.format("coalesce(map_extract(m, x)[1], x)", "mapping") + ") t",
    "corpus mapping",
)
def map_lenient(t) -> DataFrame:
    names = L.map_lenient(F.col("categories"), F.col("_map"))
    return L.with_lookup(t.corpus, t.mapping).select("doc_id", L.label_string(names, ";").alias("names"))


@query(
    "split_sentences",
    "SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(string_split(text, '.'), lambda s: length(s) > 5) AS s FROM documents) t",
)
def split_sentences(t) -> DataFrame:
    s = t.documents.select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(
    "select_complete",
    "SELECT paper_id, publisher, url, label FROM papers WHERE publisher <> '' AND url <> '' AND label <> ''",
    "papers",
)
def select_complete(t) -> DataFrame:
    return filters.select_complete(t.papers, ["paper_id", "publisher", "url", "label"])


@query("drop_missing", "SELECT doc_id, title FROM corpus WHERE title <> '' AND abstract <> ''", "corpus")
def drop_missing(t) -> DataFrame:
    gaps = t.corpus.select("doc_id", F.nullif("title", F.lit("")).alias("title"), F.nullif("abstract", F.lit("")).alias("abstract"))
    return filters.drop_missing(gaps).select("doc_id", "title")


@query("keep_placeholder", "SELECT paper_id, label FROM papers WHERE label = 'Science'", "papers")
def keep_placeholder(t) -> DataFrame:
    return filters.with_placeholder(t.papers).select("paper_id", "label")


@query("drop_placeholder", "SELECT paper_id, label FROM papers WHERE label <> 'Science'", "papers")
def drop_placeholder(t) -> DataFrame:
    return filters.without_placeholder(t.papers).select("paper_id", "label")


@query("with_known_label", "SELECT paper_id, label FROM papers WHERE label IN (SELECT src FROM mapping WHERE dst = 'ASIA')", "papers mapping")
def with_known_label(t) -> DataFrame:
    known = t.mapping.filter("dst = 'ASIA'").select(F.col("src").alias("label"))
    return filters.with_known_label(t.papers, known).select("paper_id", "label")


@query("rename_and_fix", "SELECT paper_id, replace(label, 'src1', 'Source 1') AS categories FROM papers", "papers")
def rename_and_fix(t) -> DataFrame:
    return filters.rename_and_fix(t.papers.select("paper_id", "label"), wrong="src1", right="Source 1")


@query(
    "needs_enrichment",
    "SELECT paper_id FROM papers WHERE publisher = '' AND NOT (length(abstract) > 50 AND doi <> '')",
    "papers",
)
def needs_enrichment(t) -> DataFrame:
    unmatched = t.papers.filter("publisher = ''").select("paper_id")
    return filters.needs_enrichment(t.papers, unmatched).select("paper_id")


@query(
    "drop_unlabelled",
    "SELECT * FROM (SELECT doc_id, array_to_string(list_filter(categories, lambda x: NOT contains('src1 src2 en long', x)), ' ') AS rest FROM corpus) t WHERE rest <> ''",
    "corpus",
)
def drop_unlabelled(t) -> DataFrame:
    rest = F.filter("categories", lambda x: ~F.contains(F.lit("src1 src2 en long"), x))
    kept = filters.drop_unlabelled(t.corpus.select("doc_id", rest.alias("categories")))
    return kept.select("doc_id", L.label_string(F.col("categories")).alias("rest"))


@query(
    "fill_or_overwrite",
    f"""
    SELECT p.paper_id,
           CASE WHEN r.rank IS NOT NULL THEN {q.clean('r.abstract')} ELSE p.abstract END AS abstract,
           CASE WHEN p.publisher <> '' THEN p.publisher ELSE coalesce(r.publisher, '') END AS publisher,
           CASE WHEN p.doi <> '' THEN p.doi ELSE coalesce(r.doi, '') END AS doi
    FROM papers p LEFT JOIN (SELECT * FROM first_records WHERE doi <> '') r ON p.paper_id = r.rank
    """,
    "papers first_records",
)
def fill_or_overwrite(t) -> DataFrame:
    found = t.first_records.filter("doi <> ''").select("rank", F.struct("*").alias("r"))
    joined = t.papers.join(found, F.col("paper_id") == F.col("rank"), "left")
    return joined.select(
        "paper_id",
        filters.overwrite(F.col("abstract"), text.clean_abstract(F.col("r.abstract")), F.col("r").isNotNull()).alias("abstract"),
        filters.fill_empty(F.col("publisher"), F.col("r.publisher")).alias("publisher"),
        filters.fill_empty(F.col("doi"), F.col("r.doi")).alias("doi"),
    )


@query("relabel", "SELECT paper_id, CASE WHEN label = 'src3' THEN 'nolabel' ELSE label END AS label FROM papers", "papers")
def relabel(t) -> DataFrame:
    return filters.relabel(t.papers.select("paper_id", "label"), "src3", "nolabel")


@query("paper_text", "SELECT doc_id, title AS short, title || abstract AS long FROM corpus", "corpus")
def paper_text(t) -> DataFrame:
    title, abstract = F.col("title"), F.col("abstract")
    return t.corpus.select(
        "doc_id",
        text.paper_text(title, abstract, "title").alias("short"),
        text.paper_text(title, abstract, "title_abstract").alias("long"),
    )


_CLEANED = "list_transform(string_split(array_to_string({}, ','), ','), lambda x: trim(regexp_replace(x, '[^a-zA-Z ]+', '', 'g')))"


@query(
    "long_subjects",
    f"SELECT paper_id, array_to_string(list_filter({_CLEANED.format('semantic_field')}, lambda x: length(x) > 3), '|') AS subjects FROM subjects",
    "subjects",
)
def long_subjects(t) -> DataFrame:
    kept = filters.long_subjects(text.clean_subjects(F.col("semantic_field")))
    return t.subjects.select("paper_id", F.array_join(kept, "|").alias("subjects"))


@query(
    "explode_labels",
    f"""
    WITH s AS (SELECT doc_id, categories, CASE WHEN {q.fraction(q.digest(100, 'doc_id'))} < 0.7 THEN 'train' ELSE 'test' END AS split FROM corpus)
    SELECT doc_id, split, unnest(CASE WHEN split = 'train' THEN categories ELSE [NULL] END) AS label FROM s
    """,
    "corpus",
)
def explode_labels(t) -> DataFrame:
    drawn = F.when(hash_fraction(hash_order(100, F.col("doc_id"))) < 0.7, "train").otherwise("test")
    return nested.explode_labels(t.corpus.withColumn("split", drawn), "categories").select("doc_id", "split", "label")


@query(
    "flatten_nested",
    """
    SELECT p_partkey, e.atom::JSON ->> '$' AS value
    FROM part_documents, json_tree(doc) e
    WHERE e.type NOT IN ('OBJECT', 'ARRAY') AND NOT regexp_matches(e.fullkey, '\\]$')
    """,
    "part_documents",
)
def flatten_nested(t) -> DataFrame:
    return nested.flatten_nested(t.part_documents, "p_partkey", "doc").select("p_partkey", "value")


@query(
    "pad_or_clip",
    """
    WITH v AS (
        SELECT vec_id, list_concat(embedding[1:16 * least(label % 5, 3)], list_transform(range(48 - 16 * least(label % 5, 3)), lambda z: 0.0::FLOAT)) AS v
        FROM embeddings
    )
    SELECT vec_id, len(v) AS n, round(list_sum(list_transform(v, lambda x, i: x::DOUBLE * i)), 5) AS checksum FROM v
    """,
)
def pad_or_clip(t) -> DataFrame:
    count = F.col("label") % 5
    cut = F.expr("transform(sequence(0, 3), i -> slice(embedding, i * 16 + 1, 16))")
    vectors = nested.pad_or_clip(F.slice(cut, F.lit(1), count), 3, 16)
    padded = t.embeddings.select("vec_id", vectors.alias("v"))
    weighted = F.transform("v", lambda x, i: x.cast("double") * (i + 1))
    checksum = F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 5)
    return padded.select("vec_id", F.size("v").cast("bigint").alias("n"), checksum.alias("checksum"))
