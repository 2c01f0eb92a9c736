"""Line-first cleaning: rules per line remove lines, and a document that loses too much text is rejected.

All of it is column expressions over one row: no shuffle, no Python, no state between documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.common import SPACE, fresh, let, total, words

WINDOW = 5
#: A document needs this many words.
LEAST_WORDS = 10
#: Percent of the words that may stand in repeated windows.
MOST_REPEATED = 20
#: Percent of the characters in words that may be lost with the removed lines.
MOST_LOST = 30
#: Percent of the words of a line that may be matched by one of the marks below.
MOST_MARKS = 30

SYMBOLS = r"[#*$%&|<>]"
# punctuation: runs of symbols or of exclamation and question marks; navigation: the bars between entries
MARKS = r"[#*$%&<>~^=]+|[!?]{2,}|[|»›→]"
NAVIGATION = (
    r"^[\x20\x09-\x0D]*(home|menu|main menu|next|next page|previous|previous page|back to top|skip to content|log ?in|sign ?in|sign ?up|"
    r"read more|share this|search|sitemap|contact us|about us)[\x20\x09-\x0D.:!]*$"
)
BOILERPLATE = [
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies",
    "accept cookies", "subscribe to our", "sign up for our", "click here", "enable javascript", "lorem ipsum",
    "copyright (c)", "share on facebook", "share on twitter",
]


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of ``window`` words that occur twice or more in the list.

    Windows are compared by a 64-bit hash. They are sorted with their places only where one of them repeats.
    """

    def covered(starts: Column) -> Column:
        reach = F.transform(
            starts, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1), p + window) - p).cast("bigint")
        )
        return total(reach)

    def starts_of(marked: Column) -> Column:
        def place(row: Column, k: Column) -> Column:
            before, after = F.get(marked, k - 1)["h"], F.get(marked, k + 1)["h"]
            same = F.coalesce(before == row["h"], F.lit(False)) | F.coalesce(after == row["h"], F.lit(False))
            return F.when(same, row["i"])

        return F.sort_array(F.filter(F.transform(marked, place), lambda x: x.isNotNull()))

    def of_hashes(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        several = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(several, let(marked, lambda m: let(starts_of(m), covered))).otherwise(F.lit(0).cast("bigint"))

    each = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - window),
        lambda i: F.xxhash64(F.slice(tokens, i + 1, F.lit(window))),
    )
    return F.when(F.size(tokens) > window, let(each, of_hashes)).otherwise(F.lit(0).cast("bigint"))


def line_passes(line: Column, most_marks: int = MOST_MARKS) -> Column:
    """Whether a line is prose: few marks and bars for its words, no navigation, no boilerplate."""

    def plain(low: Column) -> Column:
        bad = low.rlike(NAVIGATION)
        for phrase in BOILERPLATE:
            bad = bad | F.contains(low, F.lit(phrase))
        return ~bad

    def few(marks: Column) -> Column:
        return (marks == 0) | (F.lit(100) * marks <= F.lit(most_marks) * F.size(words(line)))

    return let(F.regexp_count(line, F.lit(MARKS)), few) & let(F.lower(line), plain)


def quality(
    text: Column,
    least_words: int = LEAST_WORDS,
    most_repeated: int = MOST_REPEATED,
    most_lost: int = MOST_LOST,
    most_marks: int = MOST_MARKS,
) -> Column:
    """A struct per text: counts, the text without the lines that failed, and the verdict.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` describe the whole text; ``n_lines`` and
    ``n_removed`` count the lines that hold a word and those that failed; ``lost_chars`` are the characters in
    words of the latter; ``clean`` is the rest, blank lines included; ``base_failed`` and ``kept`` the verdict.
    A null or empty text has no words and is rejected; its clean text is empty.
    """
    whole = F.coalesce(text, F.lit(""))
    has_word = f"[^{SPACE[1:-1]}]"

    def chars(lines: Column) -> Column:
        return F.char_length(F.regexp_replace(F.array_join(lines, ""), f"{SPACE}+", "")).cast("bigint")

    def verdict(own: Column, tokens: Column, lines: Column, passed: Column) -> Column:
        filled = F.filter(lines, lambda x: x.rlike(has_word))
        word_chars = F.char_length(F.array_join(tokens, "")).cast("bigint")
        n_words = F.size(tokens).cast("bigint")

        def settled(repeated: Column, all_chars: Column, lost: Column, with_word: Column) -> Column:
            base_failed = (n_words < least_words) | (100 * repeated > most_repeated * n_words)
            return F.struct(
                n_words.alias("n_words"),
                all_chars.alias("word_chars"),
                F.char_length(F.regexp_replace(own, f"[^{SYMBOLS[1:-1]}]+", "")).cast("bigint").alias("n_symbols"),
                (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("bigint").alias("n_dup_lines"),
                repeated.alias("n_repeat_words"),
                F.size(with_word).cast("bigint").alias("n_lines"),
                (F.size(lines) - F.size(passed)).cast("bigint").alias("n_removed"),
                lost.alias("lost_chars"),
                F.array_join(passed, "\n").alias("clean"),
                base_failed.alias("base_failed"),
                (~base_failed & (100 * lost <= most_lost * all_chars)).alias("kept"),
            )

        def lost(all_chars: Column) -> Column:
            return F.when(F.size(lines) > F.size(passed), all_chars - chars(passed)).otherwise(F.lit(0).cast("bigint"))

        return let(
            repeated_words(tokens),
            lambda r: let(word_chars, lambda c: let(lost(c), lambda s: let(filled, lambda f: settled(r, c, s, f)))),
        )

    def passes(line: Column) -> Column:
        return ~line.rlike(has_word) | line_passes(line, most_marks)

    return let(
        whole,
        lambda own: let(
            words(own),
            lambda tokens: let(
                F.split(own, "\n"),
                lambda lines: let(F.filter(lines, passes), lambda passed: verdict(own, tokens, lines, passed)),
            ),
        ),
    )


def with_quality(docs: DataFrame, text: str = "text", into: str = "quality", **rules: int) -> DataFrame:
    """The table with one more column, the struct of :func:`quality`; every row and every other column stays.

    A column of the name ``into`` is replaced; the fields cannot clash with other columns.
    """
    return docs.withColumn(into, quality(F.col(text), **rules))


def clean_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **rules: int) -> DataFrame:
    """The documents that pass, with their clean text, and the columns they came with.

    Repeated rows are judged alike and all stay; ``n_chars``, where the table has it, follows the text.
    """
    mark = fresh(docs.columns, "__quality")
    judged = with_quality(docs, text, mark, **rules).filter(F.col(mark)["kept"])
    changed = {text: F.col(mark)["clean"]}
    if n_chars in docs.columns:
        changed[n_chars] = F.char_length(F.col(mark)["clean"]).cast(docs.schema[n_chars].dataType)
    return judged.withColumns(changed).select(*docs.columns)
