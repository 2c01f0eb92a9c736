"""Pieces of the checking SQL that several queries share."""

from __future__ import annotations

from paperweave.constants import STOP_WORDS
from paperweave.functions.text import ASCII_MARKS, DIGIT_CLASS, SPACE_CLASS, WORD_CLASS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def clean(x: str) -> str:
    x = f"translate(coalesce({x}, ''), chr(10) || chr(9) || chr(13), '')"
    x = f"regexp_replace({x}, 'abstract', '', 'gi')"
    return strip(f"regexp_replace({x}, '</?jats:[a-zA-Z0-9_]*>', '', 'g')")


def ascii_only(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')"


def describe(columns: list[str]) -> str:
    x = f"translate({ascii_only(f'concat_ws({chr(39)}.{chr(39)}, ' + ', '.join(columns) + ')')}, chr(10) || chr(9) || chr(13) || '[]', '')"
    return clean(x) if "abstract" in columns else x


def words(x: str) -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    words = f"string_split_regex(regexp_replace({x}, '[{ASCII_MARKS}{DIGIT_CLASS}]', '', 'g'), '[{SPACE_CLASS}]+')"
    return f"list_filter({words}, lambda w: w <> '' AND w NOT IN ({stops}))"


def singular(word: str) -> str:
    one = word
    for pattern, replacement in (
        ("^(.{2,})ies$", "\\1y"),
        ("^(.*)(ch|sh|ss|x|z)es$", "\\1\\2"),
        ("^(.{2,}[^suis])s$", "\\1"),
    ):
        one = f"regexp_replace({one}, '{pattern}', '{replacement}')"
    return one


def tokens(x: str) -> str:
    return f"list_filter(list_transform({words(x)}, lambda w: {singular('lower(w)')}), lambda w: w <> '')"


def unigrams(token_list: str) -> str:
    return f"regexp_extract_all(array_to_string({token_list}, ' '), '[{WORD_CLASS}]{{2,}}')"


def with_bigrams(u: str) -> str:
    return f"list_concat({u}, list_transform(range(1, len({u})), lambda i: {u}[i] || ' ' || {u}[i + 1]))"


def digest(seed: int | str, *keys: str) -> str:
    return "md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(f"cast({k} AS VARCHAR)" for k in keys) + "))"


def hash_int(d: str) -> str:
    return f"(('0x' || substr({d}, 1, 8))::BIGINT)"


def fraction(d: str) -> str:
    return f"({hash_int(d)} / 4294967296.0)"


def ratio(a: str, b: str) -> str:
    """Rounded 200 * LCS / lengths; the longest common subsequence by rows of its table."""
    row = (
        f"list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: [j::INT])), lambda nr, jj: "
        f"list_append(nr, CASE WHEN unicode(substr({b}, jj[1], 1)) = ch[1] THEN old[jj[1]] + 1 "
        "ELSE greatest(nr[len(nr)], old[jj[1] + 1]) END))"
    )
    table = (
        f"list_reduce(list_prepend(list_transform(range(length({b}) + 1), lambda z: 0), "
        f"list_transform(string_split({a}, ''), lambda c: [unicode(c)])), lambda old, ch: {row})"
    )
    return (
        f"(CASE WHEN {a} = {b} THEN 100 WHEN {a} = '' OR {b} = '' THEN 0 "
        f"ELSE round_even(200.0 * list_last({table}) / (length({a}) + length({b})), 0)::INT END)"
    )


# The checking engine counts edits in bytes, so each letter outside ASCII becomes a control character first.
_LETTERS = "éèñßêçíóöüä"
_CODES = " || ".join(f"chr({i})" for i in range(14, 14 + len(_LETTERS)))


def at_least(a: str, b: str, least: int) -> str:
    """``ratio >= least``, the exact score only where the edit distance leaves it open."""
    budget = f"({(100 - least + 0.5) / 100} * (length({a}) + length({b})) + 1e-9)"
    near = f"abs(length({a}) - length({b})) <= {budget}"
    distance = f"levenshtein(translate({a}, '{_LETTERS}', {_CODES}), translate({b}, '{_LETTERS}', {_CODES}))"
    return (
        f"(CASE WHEN {a} = {b} THEN true WHEN NOT ({near}) THEN false "
        f"WHEN {distance} > {budget} THEN false "
        f"WHEN 2 * {distance} < {budget} - 1e-6 THEN true "
        f"ELSE {ratio(a, b)} >= {least} END)"
    )


def own_authors(x: str) -> str:
    plain = f"replace(translate({x}, '''.[]', ''), 'et al', '')"
    named = f"list_filter(string_split({plain}, ','), lambda x: NOT regexp_matches(x, '^[{DIGIT_CLASS}]+$'))"
    return f"list_transform({named}, lambda x: {strip('x')})"


# paper_id, found (names), own (author text) -> paper_id, point
AUTHOR_POINTS = f"""
    author_rows AS (
        SELECT paper_id, found, {own_authors('own')} AS own FROM author_input
    ),
    author_own AS (
        SELECT paper_id, found, generate_subscripts(own, 1) AS k, unnest(own) AS o FROM author_rows
    ),
    author_pairs AS (
        SELECT paper_id, k, lower(o) AS o, lower(translate(f, '.''', '')) AS f
        FROM (SELECT paper_id, k, o, unnest(found) AS f FROM author_own) t
        WHERE NOT regexp_matches(f, '^[0-9]+$')
    ),
    author_scored AS (SELECT *, {ratio('f', 'o')} AS s FROM author_pairs),
    author_parts AS (
        SELECT paper_id, k, max({ratio('p', 'o')}) AS s
        FROM (SELECT DISTINCT paper_id, k, o, unnest(string_split(f, ' ')) AS p FROM author_pairs) t
        WHERE length(p) > 4 GROUP BY ALL
    ),
    author_whole AS (
        SELECT paper_id, k, max(max(s)) OVER (PARTITION BY paper_id ORDER BY k) AS reached
        FROM author_scored GROUP BY paper_id, k
    ),
    author_points AS (
        SELECT r.paper_id, coalesce(max(CASE WHEN w.reached >= 85 THEN 1 WHEN w.reached > 60 AND p.s >= 85 THEN 1 ELSE 0 END), 0)::INT AS point
        FROM author_rows r LEFT JOIN author_whole w USING (paper_id) LEFT JOIN author_parts p USING (paper_id, k)
        GROUP BY r.paper_id
    )
"""
