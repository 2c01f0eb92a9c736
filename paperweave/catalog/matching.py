"""Queries over previous runs, service records, stored pages and foreign subjects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.catalog import sqltext as q
from paperweave.catalog.registry import query
from paperweave.functions import similarity
from paperweave.functions.text import clean_subjects
from paperweave.operators import harmonise as H
from paperweave.operators import joins as J
from paperweave.operators import matching as M
from paperweave.plans import metadata
from paperweave.session import work_path
from paperweave.streaming.rate import rate_window

_PRIOR = """
    by_doi AS (SELECT doi AS key, arg_min(r, ord) AS r FROM (SELECT doi, ord, prior AS r FROM prior WHERE doi <> '') t GROUP BY doi),
    by_title AS (SELECT title AS key, arg_min(r, ord) AS r FROM (SELECT title, ord, prior AS r FROM prior WHERE title <> '') t GROUP BY title),
    hit AS (
        SELECT p.paper_id, p AS own, coalesce(d.r, CASE WHEN p.title <> '' THEN t.r END) AS r
        FROM papers p LEFT JOIN by_doi d ON p.doi = d.key AND p.doi <> '' LEFT JOIN by_title t ON p.title = t.key
    )
"""


@query(
    "update_from",
    f"""
    WITH {_PRIOR} SELECT paper_id, CASE WHEN r IS NULL THEN own.title ELSE r.title END AS title,
        CASE WHEN r IS NULL THEN own.abstract ELSE r.abstract END AS abstract, CASE WHEN r IS NULL THEN own.doi ELSE r.doi END AS doi,
        CASE WHEN r IS NULL THEN own.url ELSE r.url END AS url, CASE WHEN r IS NULL THEN own.publisher ELSE r.publisher END AS publisher
    FROM hit
    """,
    "papers prior",
)
def update_from(t) -> DataFrame:
    return J.update_from(t.papers, t.prior, ["title", "abstract", "doi", "url", "publisher"])[0]


@query("unmatched_papers", f"WITH {_PRIOR} SELECT paper_id FROM hit WHERE r IS NULL", "papers prior")
def unmatched_papers(t) -> DataFrame:
    return J.update_from(t.papers, t.prior, ["title", "abstract", "doi", "url", "publisher"])[1]


@query(
    "first_mapped",
    """
    SELECT paper_id, arg_min(dst, pos) AS mapped FROM (
        SELECT paper_id, generate_subscripts(field, 1) AS pos, unnest(field) AS src FROM (SELECT rank AS paper_id, list_reverse(field) || ['src1', 'src2'] AS field FROM first_records) r
    ) t JOIN mapping USING (src) GROUP BY paper_id
    """,
    "first_records mapping",
)
def first_mapped(t) -> DataFrame:
    field = F.concat(F.reverse("field"), F.array(F.lit("src1"), F.lit("src2")))
    return J.first_mapped(t.first_records.select(F.col("rank").alias("paper_id"), field.alias("field")), "field", t.mapping)


def _titles(records: str) -> str:
    """Common tables up to ``matched``: rank of the first record with an equal or nearly equal title."""
    return f"""
    asked AS (SELECT DISTINCT lower(title) AS a FROM papers),
    offered AS (SELECT lower(title) AS b, min(rank) AS rank FROM {records} GROUP BY 1),
    near AS (SELECT a, rank, b FROM asked JOIN offered ON abs(length(a) - length(b)) <= 0.045 * (length(a) + length(b)) + 1e-9),
    agreed AS (SELECT a, min(rank) AS rank FROM near WHERE {q.at_least('a', 'b', 96)} GROUP BY a),
    matched AS (SELECT p.paper_id, g.rank FROM papers p LEFT JOIN agreed g ON lower(p.title) = g.a)
    """


@query("match_by_title", f"WITH {_titles('first_records')} SELECT paper_id, rank FROM matched", "papers first_records")
def match_by_title(t) -> DataFrame:
    found = M.match_by_title(t.papers.select("paper_id", "title"), t.first_records.select("title", "rank"))
    return found.select("paper_id", F.col("match.rank").alias("rank"))


@query(
    "author_score",
    f"""
    WITH author_input AS (SELECT paper_id, r.authors AS found, p.author AS own FROM papers p JOIN second_records r ON rank = paper_id),
    {q.AUTHOR_POINTS} SELECT paper_id, point FROM author_points
    """,
    "papers second_records",
)
def author_score(t) -> DataFrame:
    joined = t.papers.join(t.second_records.select("rank", "authors"), F.col("rank") == F.col("paper_id"))
    return joined.select("paper_id", M.author_score(F.col("authors"), F.col("author")).alias("point"))


def _scores(pairs: str) -> str:
    """Common tables up to ``scored`` from ``pairs``: paper_id, own (struct), r (struct, may be null)."""
    return f"""
    author_input AS (SELECT paper_id, r.authors AS found, own.author AS own FROM {pairs} WHERE r IS NOT NULL),
    {q.AUTHOR_POINTS},
    dois AS (SELECT paper_id, own.doi AS a, r.doi AS b, lower(own.title) AS ta, lower(r.title) AS tb FROM {pairs} WHERE r IS NOT NULL),
    scored AS (
        SELECT paper_id, ({q.at_least('ta', 'tb', 96)})::INT + point + CASE WHEN a <> '' AND b <> '' THEN ({q.at_least('a', 'b', 96)})::INT ELSE 0 END AS score
        FROM dois JOIN author_points USING (paper_id)
    )
    """


@query(
    "validate_match",
    f"""
    WITH pairs AS (SELECT paper_id, p AS own, r AS r FROM papers p JOIN first_records r ON rank = paper_id),
    {_scores('pairs')} SELECT paper_id, score, score >= 2 AS valid FROM scored
    """,
    "papers first_records",
)
def validate_match(t) -> DataFrame:
    records = t.first_records.select(F.col("rank").alias("paper_id"), F.struct("*").alias("match"))
    return M.validate_match(t.papers.join(records, "paper_id")).select("paper_id", "score", "valid")


def _records(name: str, table: str) -> str:
    return f"{name} AS (SELECT doi, arg_min(r, rank) AS r FROM (SELECT doi, rank, {table} AS r FROM {table} WHERE doi <> '') t GROUP BY doi)"


_STEPS = ["author_input", "author_rows", "author_own", "author_pairs", "author_scored", "author_parts", "author_whole",
          "author_points", "dois", "scored", "asked", "offered", "near", "agreed", "matched"]


def _rename(sql: str, prefix: str) -> str:
    """The same common tables under other names, so that a query can use them twice."""
    return re.sub(rf"\b({'|'.join(_STEPS)})\b", rf"{prefix}\1", sql)


_ENRICH = f"""
    WITH {_titles('first_records')}, {_records('first_doi', 'first_records')}, {_records('second_doi', 'second_records')},
    first_pairs AS (
        SELECT p.paper_id, p AS own, CASE WHEN p.doi <> '' THEN d.r ELSE f END AS r
        FROM papers p LEFT JOIN first_doi d ON p.doi = d.doi LEFT JOIN matched m ON m.paper_id = p.paper_id
        LEFT JOIN first_records f ON f.rank = m.rank
    ),
    {_scores('first_pairs')},
    first_valid AS (SELECT paper_id, own, r FROM first_pairs JOIN scored USING (paper_id) WHERE score >= 2),
    open AS (SELECT p.paper_id, p AS own FROM papers p WHERE paper_id NOT IN (SELECT paper_id FROM first_valid)),
    {_rename(_titles('page_rows'), 'page_')},
    page_of AS (SELECT m.paper_id, g AS page FROM page_matched m JOIN page_rows g ON g.rank = m.rank JOIN papers p ON p.paper_id = m.paper_id WHERE p.doi = ''),
    ask AS (
        SELECT paper_id, own, CASE WHEN own.doi <> '' THEN own.doi ELSE coalesce(page.doi, '') END AS ask_doi,
               CASE WHEN own.doi = '' AND page.doi = '' AND len(page.authors) > 0 AND own.author <> '' THEN page END AS page
        FROM open LEFT JOIN page_of USING (paper_id)
    ),
    second_pairs AS (
        SELECT paper_id, own, coalesce(s.r.title, page.title) AS title,
               CASE WHEN s.r IS NOT NULL THEN s.r ELSE page END AS r, s.r IS NULL AND page IS NOT NULL AS is_page
        FROM ask LEFT JOIN second_doi s ON ask_doi = s.doi AND ask_doi <> ''
    ),
    {_rename(_scores('second_pairs'), 'second_')},
    second_valid AS (SELECT paper_id, own, r, is_page FROM second_pairs JOIN second_scored USING (paper_id) WHERE score >= 2),
    done AS (
        SELECT paper_id, own, r, 1 AS enriched_from FROM first_valid
        UNION ALL SELECT paper_id, own, r, CASE WHEN is_page THEN 3 ELSE 2 END FROM second_valid
        UNION ALL SELECT paper_id, own, NULL, 0 FROM open WHERE paper_id NOT IN (SELECT paper_id FROM second_valid)
    )
"""


@query(
    "enrich",
    _ENRICH
    + f"""
    SELECT paper_id, enriched_from,
           CASE WHEN enriched_from > 0 THEN {q.clean('r.abstract')} ELSE own.abstract END AS abstract,
           CASE WHEN enriched_from = 1 THEN array_to_string(r.field, ',') ELSE '' END AS crossref_field,
           CASE WHEN enriched_from >= 2 THEN array_to_string(r.field, ',') ELSE '' END AS semantic_field,
           CASE WHEN enriched_from > 0 AND own.publisher = '' THEN r.publisher ELSE own.publisher END AS publisher,
           CASE WHEN enriched_from IN (1, 2) AND own.doi = '' THEN r.doi ELSE own.doi END AS doi,
           CASE WHEN enriched_from IN (1, 2) AND own.url = '' THEN r.url ELSE own.url END AS url
    FROM done
    """,
    "papers first_records second_records page_rows",
)
def enrich(t) -> DataFrame:
    done = M.enrich(t.papers, t.first_records, t.second_records, t.page_rows)
    lists = [F.array_join(c, ",").alias(c) for c in ("crossref_field", "semantic_field")]
    return done.select("paper_id", "enriched_from", "abstract", *lists, "publisher", "doi", "url")


@query(
    "enrich_from_pages",
    f"""
    WITH {_titles('page_rows')},
    pairs AS (
        SELECT p.paper_id, p AS own, CASE WHEN p.doi = '' AND g.doi = '' AND len(g.authors) > 0 AND p.author <> '' THEN g END AS r
        FROM papers p LEFT JOIN matched m ON m.paper_id = p.paper_id LEFT JOIN page_rows g ON g.rank = m.rank
    ),
    {_scores('pairs')}
    SELECT paper_id, coalesce(score >= 2, false) AS page_used,
           CASE WHEN score >= 2 THEN {q.clean('r.abstract')} ELSE own.abstract END AS abstract,
           CASE WHEN score >= 2 AND own.publisher = '' THEN r.publisher ELSE own.publisher END AS publisher,
           CASE WHEN score >= 2 THEN array_to_string(r.field, ',') ELSE '' END AS semantic_field
    FROM pairs LEFT JOIN scored USING (paper_id)
    """,
    "papers page_rows",
)
def enrich_from_pages(t) -> DataFrame:
    done = M.enrich_from_pages(t.papers, t.page_rows)
    return done.select("paper_id", "page_used", "abstract", "publisher", F.array_join("semantic_field", ",").alias("semantic_field"))


# From statements -------------------------------------------------------------------------------------

_SUBJECTS = "list_transform(string_split(array_to_string({}, ','), ','), lambda x: trim(regexp_replace(x, '[^a-zA-Z ]+', '', 'g')))"
_LISTED = [f"src{n}" for n in range(0, 20, 2)]
_FROM_STATEMENTS = f"""
    WITH loaded AS (SELECT paper_id, {q.clean('title')} AS title, '' AS abstract, author, doi, url, publisher, label FROM papers),
    read_pages AS (
        SELECT nullif({q.strip("replace(title, '<', '')")}, '') AS title, list_transform(authors, lambda a: trim(a)) AS authors, doi,
               CASE WHEN field[1] IN ({', '.join(f"'{x}'" for x in _LISTED)}) THEN field ELSE [] END AS field,
               publisher, '' AS url, {q.strip("replace(abstract, '<', '')")} AS abstract, rank
        FROM page_rows
    ),
    {re.sub(r'page_rows', 'read_pages', re.sub(r'papers', 'loaded', _ENRICH.strip()[5:]))},
    subject_rows AS (SELECT paper_id, generate_subscripts(s, 1) AS pos, unnest(s) AS src FROM (SELECT paper_id, {_SUBJECTS.format('r.field')} AS s FROM done WHERE own.label = 'Science' AND enriched_from > 0) t),
    mapped AS (SELECT paper_id, arg_min(dst, pos) AS dst FROM subject_rows JOIN full_mapping USING (src) GROUP BY paper_id)
    SELECT 'http://data.test/resource/P' || paper_id AS paper_id, own.title AS title,
           CASE WHEN enriched_from > 0 THEN {q.clean('r.abstract')} ELSE own.abstract END AS abstract,
           CASE WHEN enriched_from = 1 THEN array_to_string(r.field, ',') ELSE '' END AS crossref_field,
           CASE WHEN enriched_from >= 2 THEN array_to_string(r.field, ',') ELSE '' END AS semantic_field,
           CASE WHEN enriched_from > 0 AND own.publisher = '' THEN r.publisher ELSE own.publisher END AS publisher,
           CASE WHEN enriched_from IN (1, 2) AND own.doi = '' THEN r.doi ELSE own.doi END AS doi,
           CASE WHEN enriched_from IN (1, 2) AND own.url = '' THEN r.url ELSE own.url END AS url,
           CASE WHEN own.label = 'Science' AND dst IS NOT NULL THEN dst ELSE own.label END AS label
    FROM done LEFT JOIN mapped USING (paper_id)
"""


@query("metadata_from_statements", _FROM_STATEMENTS, "papers first_records second_records page_rows full_mapping")
def metadata_from_statements(t) -> DataFrame:
    """Two runs over statements, services and stored pages: the pages come with the second run."""
    path = work_path(t.spark, "metadata")
    reviewed = {c: t.full_mapping for c in ("crossref_field", "semantic_field")}
    done = None
    for pages in (None, t.stored_pages):
        done = metadata.run_metadata(
            t.spark, lambda spark: t.paper_triples, t.first_records, t.second_records, pages, t.taxonomy, path, reviewed, fields=_LISTED
        )
    lists = [F.array_join(c, ",").alias(c) for c in ("crossref_field", "semantic_field")]
    return done.papers.select("paper_id", "title", "abstract", *lists, "publisher", "doi", "url", "label")


# Subjects --------------------------------------------------------------------------------------------

_OPEN = f"""
    subject_rows AS (SELECT paper_id, generate_subscripts(s, 1) AS pos, unnest(s) AS label FROM (SELECT paper_id, {_SUBJECTS.format('crossref_field')} AS s FROM subjects WHERE label = 'Science') t),
    exact AS (SELECT paper_id, min(pos) AS first FROM subject_rows WHERE label IN (SELECT name FROM taxonomy) GROUP BY paper_id),
    open_labels AS (SELECT DISTINCT label FROM subject_rows LEFT JOIN exact USING (paper_id) WHERE (first IS NULL OR pos < first) AND length(label) > 3),
    scored AS (SELECT label, name, ord, {q.ratio('label', 'name')} AS score FROM open_labels, taxonomy),
    top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) AS rk FROM scored) t WHERE rk <= 5),
    best AS (
        SELECT label AS src, CASE WHEN max(score) >= 95 THEN arg_min(name, (-score, ord)) ELSE arg_min(name, (-length(name), -score, ord)) END AS dst
        FROM top5 WHERE score >= 90 GROUP BY label
    )
"""


@query("open_subjects", f"WITH {_OPEN} SELECT label FROM open_labels", "subjects taxonomy")
def open_subjects(t) -> DataFrame:
    return H.open_subjects(t.subjects, "crossref_field", t.taxonomy)


@query("top_scores", f"WITH {_OPEN} SELECT label, name, score FROM top5 WHERE score >= 90", "subjects taxonomy")
def top_scores(t) -> DataFrame:
    scored = H.score_labels(H.open_subjects(t.subjects, "crossref_field", t.taxonomy), t.taxonomy, similarity.ratio)
    return scored.select("label", "name", "score")


@query("top_five", f"WITH {_OPEN} SELECT label, name, score FROM top5", "subjects taxonomy")
def top_five(t) -> DataFrame:
    """Five names for every label, also where none is near."""
    scored = H.score_labels(H.open_subjects(t.subjects, "crossref_field", t.taxonomy), t.taxonomy, similarity.ratio, least=0)
    return scored.select("label", "name", "score")


@query("best_match", f"WITH {_OPEN} SELECT src, dst FROM best", "subjects taxonomy")
def best_match(t) -> DataFrame:
    scored = H.score_labels(H.open_subjects(t.subjects, "crossref_field", t.taxonomy), t.taxonomy, similarity.ratio)
    return H.best_match(scored)


@query("fuzzy_map_labels")
def fuzzy_map_labels(t) -> DataFrame:
    return H.fuzzy_map_labels(t.subjects, "crossref_field", t.taxonomy)


@query("fuzzy_map_labels_by_ratio", f"WITH {_OPEN} SELECT src, dst FROM best WHERE src NOT IN (SELECT name FROM taxonomy) UNION ALL SELECT name, name FROM taxonomy", "subjects taxonomy")
def fuzzy_map_labels_by_ratio(t) -> DataFrame:
    return H.fuzzy_map_labels(t.subjects, "crossref_field", t.taxonomy, similarity.ratio, include_exact=True)


@query(
    "apply_mapping",
    f"""
    WITH {_OPEN},
    hits AS (SELECT paper_id, arg_min(dst, pos) AS dst FROM subject_rows JOIN best ON src = label GROUP BY paper_id)
    SELECT paper_id, CASE WHEN s.label = 'Science' AND h.dst IS NOT NULL THEN h.dst ELSE s.label END AS label
    FROM subjects s LEFT JOIN hits h USING (paper_id)
    """,
    "subjects taxonomy",
)
def apply_mapping(t) -> DataFrame:
    mapping = H.fuzzy_map_labels(t.subjects, "crossref_field", t.taxonomy, similarity.ratio)
    return J.apply_mapping(t.subjects, clean_subjects(F.col("crossref_field")), mapping).select("paper_id", "label")


@query("complete_metadata")
def complete_metadata(t) -> DataFrame:
    found = t.subjects.select("paper_id", F.col("crossref_field").alias("_c"), F.col("semantic_field").alias("_s"))
    papers = t.papers.join(found, "paper_id").withColumn("crossref_field", F.col("_c")).withColumn("semantic_field", F.col("_s")).drop("_c", "_s")
    done = metadata.complete_metadata(papers, t.prior, t.first_records, t.second_records, t.page_rows, t.taxonomy)
    return done.stats


@query(
    "rate_window",
    """
    SELECT event_id, count(*) OVER w AS in_span, count(*) OVER w >= 3 AS over_limit FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW)
    """,
)
def rate_window_query(t) -> DataFrame:
    return rate_window(t.events, "event_type", limit=3).select("event_id", "in_span", "over_limit")
