"""Cleaning and tokenising of titles and abstracts.

Everything is a Spark SQL expression. The token functions are kept as SQL text because the same text also
feeds ``SQLTransformer`` stages, so that training and scoring cannot drift apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperweave.constants import STOP_WORDS

# Whitespace as Unicode text processing sees it: the regex class knows only the ASCII part.
SPACE_CLASS = r"\t-\r\x1C- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _other_digit_class() -> str:
    """Digits outside the decimal category (superscripts, circled digits), as regex ranges."""
    points = [p for p in range(0x10000) if chr(p).isdigit() and unicodedata.category(chr(p)) != "Nd"]
    ranges: list[list[int]] = []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


DIGIT_CLASS = r"\p{Nd}" + _other_digit_class()
ASCII_MARKS = r"!-/:-@\[-`{-~"
WORD_CLASS = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    """Strip Unicode whitespace from both ends (``trim`` strips spaces only)."""
    return F.regexp_replace(c, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def clean_abstract(c: Column) -> Column:
    """Delete line breaks, tabs, the word "abstract" and journal markup, in this order; null becomes empty."""
    c = F.translate(F.coalesce(c, F.lit("")), "\n\t\r", "")
    c = F.regexp_replace(c, "(?iu)abstract", "")
    c = F.regexp_replace(c, "</?jats:[a-zA-Z0-9_]*>", "")
    return strip(c)


def ascii_only(c: Column) -> Column:
    """Drop, not transliterate, everything outside ASCII."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def description(columns: Sequence[str]) -> Column:
    """One line of text from the named columns, for an instance file."""
    joined = F.translate(ascii_only(F.concat_ws(".", *[F.col(c) for c in columns])), "\n\t\r[]", "")
    return clean_abstract(joined) if "abstract" in columns else joined


def paper_text(title: Column, abstract: Column, experiment: str) -> Column:
    """``title``, or title and abstract run together without a separator."""
    return title if experiment == "title" else F.concat(title, abstract)


def normalise_subjects(c: Column) -> Column:
    """Comma-separated foreign subjects -> array of ASCII letters and spaces only."""
    return F.transform(F.split(c, ","), lambda x: F.trim(F.regexp_replace(x, "[^a-zA-Z ]+", "")))


def clean_subjects(c: Column) -> Column:
    """The same cleaning for subjects that are already an array; an element may hold several subjects."""
    return normalise_subjects(F.array_join(c, ","))


def normalise_authors(c: Column) -> Column:
    """Author string (possibly a printed list) -> array of names without dots, quotes and brackets."""
    plain = F.replace(F.translate(c, "'.[]", ""), F.lit("et al"), F.lit(""))
    named = F.filter(F.split(plain, ","), lambda x: ~x.rlike(f"^[{DIGIT_CLASS}]+$"))
    return F.transform(named, strip)


def full_names(authors: Column) -> Column:
    """Structs with ``given`` and ``family`` -> "given family", missing parts empty."""
    return F.transform(
        authors,
        lambda a: F.concat(
            F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit(""))
        ),
    )


def local_name(c: Column) -> Column:
    """Text after the last slash of an identifier."""
    return F.substring_index(c, "/", -1)


def sentences(c: Column) -> Column:
    """Split at full stops, keep what is longer than five characters."""
    return F.filter(F.split(c, "[.]"), lambda s: F.length(s) > 5)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words_sql(text: str, stop_words: Sequence[str] = STOP_WORDS) -> str:
    """SQL text: words of ``text`` without marks, digits and stop words, lower-cased.

    Stop words are compared before lower-casing, so a capitalised one stays.
    """
    bare = f"regexp_replace({text}, r'[{ASCII_MARKS}{DIGIT_CLASS}]', '')"
    words = f"split({bare}, r'[{SPACE_CLASS}]+')"
    stops = ", ".join(_quoted(w) for w in stop_words)
    keep = f"w <> '' AND w NOT IN ({stops})" if stop_words else "w <> ''"
    return f"transform(filter({words}, w -> {keep}), w -> lower(w))"


def singular_sql(word: str) -> str:
    """SQL text: the singular of a noun by its ending; the three endings stand in for a noun dictionary."""
    # only a word that ends in s can have one of the endings
    singular = word
    for pattern, replacement in (
        (r"^(.{2,})ies$", "$1y"),
        (r"(ch|sh|ss|x|z)es$", "$1"),
        (r"(..[^suis])s$", "$1"),
    ):
        singular = f"regexp_replace({singular}, r'{pattern}', '{replacement}')"
    return f"CASE WHEN endswith({word}, 's') THEN {singular} ELSE {word} END"


def tokens_sql(text: str, stop_words: Sequence[str] = STOP_WORDS) -> str:
    """SQL text: :func:`words_sql`, nouns in the singular. ``operators.lemmas`` also knows a dictionary."""
    return f"transform({words_sql(text, stop_words)}, w -> {singular_sql('w')})"


def tokens(c: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Column form of :func:`tokens_sql`; takes a column name or expression text."""
    if isinstance(c, Column):
        raise TypeError("pass a column name or SQL text")
    return F.expr(tokens_sql(c, stop_words))


def terms_sql(token_array: str, bigrams: bool = True) -> str:
    """SQL text: runs of two or more word characters, followed by their bigrams."""
    runs = f"regexp_extract_all(array_join({token_array}, ' '), r'[{WORD_CLASS}]{{2,}}', 0)"
    if not bigrams:
        return runs
    pairs = (
        "zip_with(slice(u, 1, greatest(size(u) - 1, 0)), slice(u, 2, greatest(size(u) - 1, 0)), "
        "(a, b) -> concat(a, ' ', b))"
    )
    # transform over a one-element array names the unigrams once instead of computing them three times
    return f"transform(array({runs}), u -> concat(u, {pairs}))[0]"


def terms(token_array: str, bigrams: bool = True) -> Column:
    return F.expr(terms_sql(token_array, bigrams))


def page_field(html: Column, pattern: str) -> Column:
    """First capture of a pattern in a page, markup removed, null if there is none."""
    found = F.regexp_extract(html, pattern, 1)
    return F.nullif(strip(F.regexp_replace(found, "<[^>]*>", "")), F.lit(""))


def page_fields(html: Column, pattern: str) -> Column:
    """All captures of a pattern, markup removed."""
    return F.transform(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)),
        lambda x: strip(F.regexp_replace(x, "<[^>]*>", "")),
    )


def counted(words: Column) -> Column:
    """``array<struct<term, tf>>``: each distinct word of an array with its number, within the row.

    The array is sorted once and cut where the word changes; no shuffle is needed to count a row's own words.
    """

    def once(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def of_sorted(s: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def runs(starts: Column) -> Column:
            length = lambda p, k: (F.coalesce(F.get(starts, k + 1), F.size(s)) - p).cast("bigint")
            return F.transform(starts, lambda p, k: F.struct(F.get(s, p).alias("term"), length(p, k).alias("tf")))

        return once(places, runs)

    return F.when(F.size(words) > 0, once(F.sort_array(words), of_sorted))
