"""Matching papers with service records and stored pages, and completing them."""

from __future__ import annotations

import math
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from paperweave.functions.similarity import at_least, score
from paperweave.functions.text import clean_abstract, normalise_authors
from paperweave.operators.filters import fill_empty, overwrite
from paperweave.operators.joins import first_by_key, lookup_join
from paperweave.session import landed

TITLE_LEAST = 96  # "above 95" on whole numbers
AUTHOR_LEAST = 85
ACCEPT_SCORE = 2
HOT_GRAM = 20_000
LONGEST_PIECE = 8


def _gram_length(length: Column, share: float) -> Column:
    """Longest piece, up to a bound, such that cutting a text of this length gives more pieces than edits."""
    return F.least(F.lit(LONGEST_PIECE), F.floor(length / (_edits(length, share) + 1))).cast("int")


def _edits(length: Column, share: float) -> Column:
    """Most insertions and deletions between a text of this length and any partner it may match."""
    return F.floor(length * F.lit(share * (1 + (1 + share) / (1 - share))) + F.lit(1e-9))


def _settled_length(share: float) -> int:
    """From this length on every text is cut into pieces of the longest size."""
    left_over = 1 - LONGEST_PIECE * share * (1 + (1 + share) / (1 - share))
    return math.ceil(LONGEST_PIECE / left_over) + 1 if left_over > 0.05 else 2**31 - 1


def _pieces(text: Column, size: Column, overlapping: bool) -> Column:
    """Substrings of ``size`` (1 to 8) characters, at every place or one after the other.

    One regex pass per text: cutting substrings by position would walk the text anew for each of them.
    """
    cut = F.array().cast("array<string>")
    for n in range(1, LONGEST_PIECE + 1):
        pattern = f"(?s)(?=(.{{{n}}}))" if overlapping else f"(?s)(.{{{n}}})"
        cut = F.when(size == n, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(cut)
    return cut


def similar_texts(left: DataFrame, right: DataFrame, least: int = TITLE_LEAST) -> DataFrame:
    """``left_id, right_id`` of texts (``id, text``, each text once) with ``ratio >= least``, equal ones left out.

    Exact, without comparing all pairs. With ``s`` = (100.5 - least) / 100 a pair may differ by at most
    ``s * (l1 + l2)`` insertions and deletions, so of the pieces of the left text at least one more than
    that bound stands unchanged in the right one. Any bound + 1 pieces will do: the ones rarest among the
    right texts are looked up, and only texts that share one of them and are close in length are compared.
    The rows are linear in the length of the texts; a piece that is frequent all the same is spread over
    several tasks.
    """
    share = (100 - least + 0.5) / 100
    size = F.length("text")
    probe = left.withColumn("n", size).withColumn("need", _edits(F.col("n"), share) + 1)
    # a text so short that no edit is allowed can only be equal
    probe = probe.filter(F.col("need") > 1).withColumn("q", _gram_length(F.col("n"), share))
    pieces = probe.select("id", "n", "need", "q", F.explode(_pieces(F.col("text"), F.col("q"), False)).alias("gram"))

    index = right.withColumn("n", size)
    low = F.ceil(F.col("n") * F.lit((1 - share) / (1 + share)) - F.lit(1e-9)).cast("int")
    high = F.floor(F.col("n") * F.lit((1 + share) / (1 - share)) + F.lit(1e-9)).cast("int")
    # beyond this length the piece length no longer changes
    settled = F.lit(_settled_length(share))
    lengths = F.sequence(F.greatest(low, F.lit(1)), F.greatest(low, F.lit(1), F.least(high, settled)))
    sizes = F.array_distinct(F.transform(lengths, lambda x: _gram_length(x, share)))
    sized = index.select("id", "n", "text", F.explode(F.filter(sizes, lambda x: x > 0)).alias("q"))
    grams = F.array_distinct(_pieces(F.col("text"), F.col("q"), True))
    # the planner cannot see how many rows the substrings make, so the joins with them must not be broadcasts
    index = sized.select("id", "n", "q", F.explode(grams).alias("gram"))

    frequency = index.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("df"))
    counted = pieces.join(frequency.hint("merge"), ["q", "gram"], "left")
    chosen = counted.groupBy("id", "n", "need", "q").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("all")
    )
    # repeated pieces count as often as they stand in the text, but are looked up once
    chosen = chosen.select("id", "n", "q", F.explode(F.array_distinct(F.slice("all", 1, F.col("need").cast("int")))).alias("c"))
    chosen = chosen.select("id", "n", "q", "c.gram", "c.df").filter(F.col("df") > 0)

    hot = frequency.filter(F.col("df") > HOT_GRAM).select(
        "q", "gram", F.ceil(F.col("df") / F.lit(HOT_GRAM)).cast("int").alias("parts")
    )
    parts = F.ceil(F.col("df") / F.lit(HOT_GRAM)).cast("int")
    chosen = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    # few pieces are hot, but their number grows with the texts: the size met at run time decides on the join
    spread = index.join(hot, ["q", "gram"], "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts").cast("bigint")).cast("int"), F.lit(0))
    )
    a, b = chosen.alias("a"), spread.alias("b")
    close = F.abs(F.col("a.n") - F.col("b.n")) <= F.lit(share) * (F.col("a.n") + F.col("b.n")) + F.lit(1e-9)
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("q", "gram", "part")]
    pairs = a.join(b.hint("merge"), [*same, close]).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()
    texts = pairs.join(left.select(F.col("id").alias("left_id"), F.col("text").alias("left_text")), "left_id").join(
        right.select(F.col("id").alias("right_id"), F.col("text").alias("right_text")), "right_id"
    )
    differ = texts.filter(F.col("left_text") != F.col("right_text"))
    return differ.filter(at_least(F.col("left_text"), F.col("right_text"), least)).select("left_id", "right_id")


def match_by_title(papers: DataFrame, candidates: DataFrame, rank: str = "rank") -> DataFrame:
    """Adds ``match``: the first candidate, by its unique rank, with an equal or nearly equal title; else null.

    The comparison runs on distinct lower-cased titles, so a title shared by many papers or candidates is
    compared once. These narrow tables are written first, since the comparison reads them several times.
    ``papers`` needs ``paper_id`` and ``title``.
    """
    text = F.lower("title").alias("text")
    titles = candidates.filter(F.col("title").isNotNull()).groupBy(text).agg(F.min(rank).alias("id"))
    best = landed(titles, "candidate-titles")
    titles = papers.filter(F.col("title").isNotNull()).groupBy(text).agg(F.min("paper_id").alias("id"))
    asked = landed(titles, "paper-titles")

    near = similar_texts(asked, best)
    equal = asked.join(best.select("text", F.col("id").alias("right_id")), "text").select(
        F.col("id").alias("left_id"), "right_id"
    )
    first = near.unionByName(equal).groupBy("left_id").agg(F.min("right_id").alias("right_id"))
    by_title = landed(
        asked.join(first, F.col("id") == F.col("left_id")).select("text", F.col("right_id").alias("_rank")), "title-matches"
    )
    records = candidates.select(F.col(rank).alias("_rank"), F.struct(*candidates.columns).alias("match"))
    found = by_title.join(records, "_rank").drop("_rank")
    keyed = papers.withColumn("text", F.lower("title"))
    return lookup_join(keyed, found, "text", keys_of=papers.select(text), salt="paper_id").drop("text")


def _author_point(found: list[str], own: list[str]) -> int:
    names = [n.replace(".", "").replace("'", "").lower() for n in found if not n.isdigit()]
    parts = {p for n in names for p in n.split(" ") if len(p) > 4}
    whole = [max((score(n, o.lower()) for n in names), default=0) for o in own]
    if max(whole, default=0) >= AUTHOR_LEAST:
        return 1
    reached = zip(own, accumulate(whole, max))
    return int(any(best > 60 and any(score(p, o.lower()) >= AUTHOR_LEAST for p in parts) for o, best in reached))


@pandas_udf(IntegerType())
def _author_udf(found: pd.Series, own: pd.Series) -> pd.Series:
    return pd.Series(
        [_author_point(f if f is not None else [], o if o is not None else []) for f, o in zip(found, own)],
        dtype="int32",
    )


def author_score(found: Column, own: Column) -> Column:
    """1 if an author agrees: a name at 85 or more, or, once names agree above 60, a long part of one.

    ``found`` is an array of names, ``own`` the paper's author string.
    """
    return _author_udf(found, normalise_authors(own))


def match_score(
    title: Column, found_title: Column, author: Column, found_authors: Column, doi: Column, found_doi: Column, short_of: int | None = None
) -> Column:
    """0-3: one point each for title, author and (if both are known) doi.

    With ``short_of`` the authors are compared only where the other points are one short of that number, so the score
    tells whether it is reached and no more.
    """
    empty = F.lit("")
    title_point = at_least(
        F.lower(F.coalesce(found_title, empty)), F.lower(F.coalesce(title, empty)), TITLE_LEAST
    ).cast("int")
    both = (F.coalesce(doi, empty) != "") & (F.coalesce(found_doi, empty) != "")
    doi_point = F.when(both, at_least(found_doi, doi, TITLE_LEAST).cast("int")).otherwise(F.lit(0))
    others = title_point + doi_point
    if short_of is None:
        return others + author_score(found_authors, F.coalesce(author, empty))
    # no names on either side give no point, so a row that is settled costs the comparison nothing
    asked = others == short_of - 1
    return others + author_score(F.when(asked, found_authors), F.when(asked, F.coalesce(author, empty)))


def validate_match(df: DataFrame, record: str = "match", level: int = ACCEPT_SCORE, whole: bool = True) -> DataFrame:
    """Adds ``score`` and ``valid`` for the paper's own columns against the struct column ``record``.

    Without ``whole`` the author's point is looked at only where it decides on ``valid``.
    """
    r = F.col(record)
    points = match_score(F.col("title"), r["title"], F.col("author"), r["authors"], F.col("doi"), r["doi"], None if whole else level)
    scored = df.withColumn("score", F.when(r.isNotNull(), points))
    return scored.withColumn("valid", F.coalesce(F.col("score") >= level, F.lit(False)))


RECORD_FIELDS = ["title", "authors", "doi", "field", "publisher", "url", "abstract"]


def attach_records(papers: DataFrame, records: DataFrame, by_title: bool = True) -> DataFrame:
    """Adds ``match``: the record with the paper's doi or, for a paper without one, the best by title."""
    columns = [*RECORD_FIELDS, "rank"]
    records = records.select(*columns)
    with_doi = records.filter(F.coalesce(F.col("doi"), F.lit("")) != "")
    # the ranks that win are found first, so no abstract is sorted or sent for a record that does not
    per_doi = first_by_key(with_doi, "doi", "rank", columns).select(F.col("_key").alias("_doi"), F.col("_row").alias("match"))
    known = F.coalesce(F.col("doi"), F.lit("")) != ""
    keyed = papers.filter(known).withColumn("_doi", F.col("doi"))
    by_doi = lookup_join(keyed, per_doi, "_doi", salt="paper_id").drop("_doi")
    rest = papers.filter(~known)
    if not by_title:
        return by_doi.unionByName(rest, allowMissingColumns=True)
    return by_doi.unionByName(match_by_title(rest, records))


def enrich(papers: DataFrame, first: DataFrame, second: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Complete papers from two record tables and, for papers without a doi, from stored pages.

    A record must pass :func:`validate_match`. The second source is asked only if the first gave no valid
    record. Abstract and subjects of a valid record replace the paper's own, even if empty; publisher, doi
    and url only fill gaps. The first source sets ``crossref_field``, the other ones ``semantic_field``.
    """
    own = papers.columns
    # both branches below go on from here, so the first source is matched once and written
    found = validate_match(attach_records(papers, first), whole=False).withColumn("_rec", F.when(F.col("valid"), F.col("match")))
    found = landed(found.select(*own, "_rec", "valid"), "first-source")
    settled = found.filter("valid").withColumn("_from", F.lit(1))
    open_papers = found.filter(~F.col("valid")).select(*own)

    # without pages a paper that has no doi cannot be looked up in the second source
    if pages is not None:
        open_papers = doi_from_pages(open_papers, pages)
        asked = open_papers.withColumn("_own_doi", F.col("doi")).withColumn("doi", F.col("_ask"))
    else:
        asked = open_papers.withColumn("_own_doi", F.col("doi")).withColumn("_page", F.lit(None).cast(_record_type(second)))
    attached = attach_records(asked.drop("_ask"), second, by_title=False)
    attached = attached.withColumn("doi", F.col("_own_doi")).drop("_own_doi")
    # a page stands in for a record only if neither side has a doi
    record = F.coalesce(F.col("match"), F.col("_page"))
    is_page = F.col("match").isNull() & F.col("_page").isNotNull()
    checked = validate_match(attached.withColumn("_is_page", is_page).withColumn("match", record), whole=False)
    rest = checked.withColumn("_rec", F.when(F.col("valid"), F.col("match"))).withColumn(
        "_from", F.when(~F.col("valid"), F.lit(0)).when(F.col("_is_page"), F.lit(3)).otherwise(F.lit(2))
    )
    both = settled.select(*own, "_rec", "_from").unionByName(rest.select(*own, "_rec", "_from"))
    r, source = F.col("_rec"), F.col("_from")
    empty_list = F.array().cast("array<string>")
    page = source == 3
    new = {
        "abstract": overwrite(F.col("abstract"), clean_abstract(r["abstract"]), source > 0),
        "crossref_field": overwrite(F.col("crossref_field"), F.coalesce(r["field"], empty_list), source == 1),
        "semantic_field": overwrite(F.col("semantic_field"), F.coalesce(r["field"], empty_list), source >= 2),
        "publisher": F.when(source > 0, fill_empty(F.col("publisher"), r["publisher"])).otherwise(F.col("publisher")),
        "doi": F.when((source > 0) & ~page, fill_empty(F.col("doi"), r["doi"])).otherwise(F.col("doi")),
        "url": F.when((source > 0) & ~page, fill_empty(F.col("url"), r["url"])).otherwise(F.col("url")),
    }
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in own], source.alias("enriched_from"))


def _record_type(records: DataFrame):
    return records.select(F.struct(*RECORD_FIELDS, "rank").alias("r")).schema["r"].dataType


def doi_from_pages(papers: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``_ask``, the paper's doi or that of a page with its title, and ``_page``, the page record to
    fall back on: only without any doi and with authors on both sides."""
    known = F.coalesce(F.col("doi"), F.lit("")) != ""
    matched = match_by_title(papers.filter(~known), pages.select(*RECORD_FIELDS, "rank"))
    page_doi = F.coalesce(F.col("match.doi"), F.lit(""))
    usable = (page_doi == "") & (F.size("match.authors") > 0) & (F.coalesce(F.col("author"), F.lit("")) != "")
    matched = matched.withColumn("_ask", page_doi).withColumn("_page", F.when(usable, F.col("match"))).drop("match")
    rest = papers.filter(known).withColumn("_ask", F.col("doi"))
    rest = rest.withColumn("_page", F.lit(None).cast(_record_type(pages)))
    return matched.unionByName(rest)


def enrich_from_pages(papers: DataFrame, pages: DataFrame) -> DataFrame:
    """Publisher, subject and abstract of a page with the paper's title, for papers without a doi.

    Neither side has a doi, so title and author must both agree. Adds ``page_used``.
    """
    own = papers.columns
    found = doi_from_pages(papers, pages)
    checked = validate_match(found.withColumn("match", F.col("_page")), whole=False)
    r, ok = F.col("match"), F.col("valid")
    new = {
        "abstract": overwrite(F.col("abstract"), clean_abstract(r["abstract"]), ok),
        "semantic_field": overwrite(
            F.col("semantic_field"), F.coalesce(r["field"], F.array().cast("array<string>")), ok
        ),
        "publisher": F.when(ok, fill_empty(F.col("publisher"), r["publisher"])).otherwise(F.col("publisher")),
    }
    return checked.select(*[new[c].alias(c) if c in new else F.col(c) for c in own], ok.alias("page_used"))
