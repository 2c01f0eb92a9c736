"""Queries over statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.catalog.registry import query
from paperweave.constants import FIELD_PREDICATE, PAPER_PREDICATES
from paperweave.operators import triples as T

_LITERALS = "literals AS (SELECT subject, min(object) AS literal FROM triples WHERE object_is_literal GROUP BY subject)"
_VALUES = f"""
    {_LITERALS},
    labels AS (
        SELECT t.subject AS paper, CASE WHEN object_is_literal THEN object ELSE literal END AS label
        FROM triples t LEFT JOIN literals l ON l.subject = t.object WHERE predicate LIKE '%/P30'
    ),
    vals AS (
        SELECT t.subject AS paper, list_last(string_split(predicate, '/')) AS predicate, CASE WHEN object_is_literal THEN object ELSE literal END AS value
        FROM triples t LEFT JOIN literals l ON l.subject = t.object WHERE t.subject IN (SELECT paper FROM labels)
    )
"""


def _list(predicate: str) -> str:
    return f"list_sort(coalesce(list(value) FILTER (predicate = '{predicate}' AND value IS NOT NULL), []))"


_ROWS = ", ".join(f"{_list(p)} AS {c}" for p, c in PAPER_PREDICATES.items())
_JOINED = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in PAPER_PREDICATES.values())


@query("statements_by_predicate", f"WITH {_VALUES} SELECT paper, label FROM labels", "triples")
def statements_by_predicate(t) -> DataFrame:
    return T.statements_by_predicate(t.triples, FIELD_PREDICATE)


@query("statements_by_subject", f"WITH {_VALUES}, wide AS (SELECT paper, {_ROWS} FROM vals GROUP BY paper) SELECT paper, {_JOINED} FROM wide", "triples")
def statements_by_subject(t) -> DataFrame:
    store = T.land_statements(t.triples, [FIELD_PREDICATE, *PAPER_PREDICATES])
    wide = store.by_subject(store.by_predicate(FIELD_PREDICATE))
    return wide.select("paper", *[F.array_join(c, "|").alias(c) for c in PAPER_PREDICATES.values()])


@query(
    "collapse_values",
    f"""
    WITH {_VALUES}, wide AS (SELECT paper, {_ROWS} FROM vals GROUP BY paper)
    SELECT paper, CASE len(author) WHEN 0 THEN '' WHEN 1 THEN author[1] ELSE '["' || array_to_string(author, '","') || '"]' END AS author,
           CASE len(url) WHEN 0 THEN '' ELSE url[1] END AS url
    FROM wide
    """,
    "triples",
)
def collapse_values(t) -> DataFrame:
    store = T.land_statements(t.triples, [FIELD_PREDICATE, *PAPER_PREDICATES])
    wide = store.by_subject(store.by_predicate(FIELD_PREDICATE))
    return wide.select("paper", *[T.scalar_view(F.col(c)).alias(c) for c in ("author", "url")])


@query("papers_from_source", f"WITH {_VALUES}, wide AS (SELECT paper, {_ROWS} FROM vals GROUP BY paper) SELECT paper, label, title[1] AS title, doi[1] AS doi, publisher[1] AS publisher FROM labels JOIN wide USING (paper)", "triples")
def papers_from_source(t) -> DataFrame:
    papers = T.papers_from(t.spark, lambda spark: t.triples, FIELD_PREDICATE)
    return papers.select("paper", "label", "title", "doi", "publisher")
