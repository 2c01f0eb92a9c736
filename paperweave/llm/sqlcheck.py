"""DuckDB SQL for the rows of the queries."""

from paperweave.llm import licenses as li
from paperweave.llm import quality as q
from paperweave.llm import urlfilter as uf


def _text(pattern: str) -> str:
    return pattern.replace("'", "''")


def _any(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{_text(p)}')" for p in phrases) + ")"


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), starts AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n
  FROM (SELECT r, i, array_to_string(w[i:i + {q.WINDOW - 1}], ' ') AS win
        FROM (SELECT r, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM d))
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {q.WINDOW})) AS p FROM starts WHERE n > 1) GROUP BY r
), lines AS (
  SELECT r, line, len({_WORDS.format("line")}) AS n_words FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
), judged AS (
  SELECT r, line, n_words, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    n_words = 0 OR (
      100 * len(regexp_extract_all(line, '{_text(q.MARKS)}')) <= {q.MOST_MARKS} * n_words
      AND NOT regexp_matches(lower(line), '{_text(q.NAVIGATION)}') AND NOT {_any("lower(line)", q.BOILERPLATE)}
    ) AS ok
  FROM lines
), per AS (
  SELECT r, count(*) FILTER (n_words > 0) AS n_lines, count(DISTINCT line) FILTER (n_words > 0) AS n_distinct,
    count(*) FILTER (NOT ok) AS n_removed, coalesce(sum(chars) FILTER (NOT ok), 0) AS lost_chars FROM judged GROUP BY r
), all_counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{q.SYMBOLS}'))::BIGINT AS n_symbols, (n_lines - n_distinct)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, lost_chars::BIGINT AS lost_chars
  FROM d JOIN per USING (r) LEFT JOIN rep USING (r)
)
SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words) AND 100 * lost_chars <= {q.MOST_LOST} * word_chars AS kept
FROM all_counts
"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{_text(x)}'" for x in row) + ")" for row in rows)


LICENSES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), phrases(phrase, label) AS (VALUES {_values(li.PHRASES)}),
templates(t, label, words) AS (
  SELECT t, label, string_split(txt, ' ') FROM (VALUES {_values([(n, a, b) for n, (a, b) in enumerate(li.TEMPLATES)])}) AS x(t, label, txt)
), base AS (
  SELECT r, i - 1 AS i, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), phrases
  WHERE array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase
), per_base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM base GROUP BY r
), grams AS (
  SELECT r, i - 1 AS i, array_to_string(w[i:i + {li.GRAM - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {li.GRAM - 2})) AS i FROM d)
), places AS (
  SELECT t, label, len(words) AS n, j - 1 AS j, array_to_string(words[j:j + {li.GRAM - 1}], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(words) - {li.GRAM - 2})) AS j FROM templates)
), hits AS (SELECT r, t, label, n, i, j, i - j AS diag FROM grams JOIN places USING (g)),
diags AS (SELECT DISTINCT r, t, label, n, diag FROM hits),
chains AS (
  SELECT r, t, d.label, d.n, d.diag, list([h.j] ORDER BY h.i, h.j DESC) AS js
  FROM diags d JOIN hits h USING (r, t) WHERE h.diag BETWEEN d.diag AND d.diag + {li.DRIFT} GROUP BY ALL
), cover AS (
  SELECT r, t, label, list_max(list_reduce([list_transform(range(n), lambda p: 0)] || js, lambda best, h: list_transform(range(n), lambda p: CASE
    WHEN p = h[1] THEN greatest(best[p + 1], {li.GRAM}, coalesce(list_max(list_transform(range(p), lambda o: CASE WHEN best[o + 1] > 0 THEN best[o + 1] + least({li.GRAM}, p - o) END)), 0))
    ELSE best[p + 1] END))) / n AS covered
  FROM chains
), per AS (
  SELECT r, max(covered) AS score, coalesce(list(DISTINCT label) FILTER (covered >= {li.LEAST_COVERED}), []) AS ls FROM cover GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(per.ls, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN per_base b USING (r) LEFT JOIN per USING (r)
"""


URLS = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p
), rules(own, prefix, verdict) AS (VALUES {_values(uf.RULES)}),
best AS (
  SELECT r, arg_max(own || prefix, length(own) + length(prefix)) AS rule, arg_max(verdict, length(own) + length(prefix)) AS verdict
  FROM u JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, prefix) GROUP BY r
), known AS (
  SELECT host, bool_or(list_has_any(string_split(replace(host, '-', '.'), '.'), [{", ".join(f"'{w}'" for w in uf.LISTED_WORDS)}])) AS listed FROM u GROUP BY host
)
SELECT page_id, u.host AS host, path, rule, coalesce(best.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM u JOIN known USING (host) LEFT JOIN best USING (r)
"""


TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r AS q, q.vec_id AS query_id, v.vec_id, v.r,
    list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
  FROM v AS q JOIN v ON q.r <> v.r WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS rank FROM scored) WHERE rank <= 10
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b)] || [0 FOR _ IN range(8)], lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    codes = f"[ascii(ch)::BIGINT FOR ch IN string_split({text}, '')]"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: {bits}))"


def _value(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_value, ["doc_id", "source", "lang", "n_chars", text])) + ")"


_UP = "SELECT tree, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY tree, lvl, idx // 16, n"

MERKLE = rf"""
WITH RECURSIVE lowered AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), d AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf("low")} ELSE {_leaf("text")} END AS changed
  FROM lowered
), placed AS (
  SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n FROM d
), low_nodes(tree, lvl, idx, n, h) AS (
  SELECT tree, 0, idx, n, leaf FROM placed UNION ALL {_UP.format("low_nodes")}
), subroots AS (
  SELECT tree, lvl, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low_nodes WHERE n = 1
), top_nodes(tree, lvl, idx, n, h) AS (
  SELECT 'top', 0, place, n, h FROM subroots UNION ALL {_UP.format("top_nodes")}
), runs AS (
  SELECT tree, lvl, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM (SELECT * FROM low_nodes UNION ALL SELECT * FROM top_nodes) WHERE n > 1 GROUP BY ALL
), fold(own, pos, tree, lvl, idx, h, proof) AS (
  SELECT tree, idx, tree, 0, idx, changed, '' FROM placed
  UNION ALL
  SELECT f.own, f.pos, coalesce(s.next_tree, f.tree), CASE WHEN s.next_tree IS NULL THEN f.lvl + 1 ELSE 0 END,
    CASE WHEN s.next_tree IS NULL THEN f.idx // 16 ELSE s.place END,
    CASE WHEN s.next_tree IS NULL THEN sha256(array_to_string(runs.hs[:f.idx % 16], '') || f.h || array_to_string(runs.hs[f.idx % 16 + 2:], '')) ELSE f.h END,
    CASE WHEN s.next_tree IS NULL THEN f.proof || array_to_string(runs.hs[:f.idx % 16], '') || array_to_string(runs.hs[f.idx % 16 + 2:], '') ELSE f.proof END
  FROM fold f LEFT JOIN runs ON runs.tree = f.tree AND runs.lvl = f.lvl AND runs.run = f.idx // 16
    LEFT JOIN (SELECT tree, lvl, 'top' AS next_tree, place FROM subroots) s ON s.tree = f.tree AND s.lvl = f.lvl
  WHERE runs.run IS NOT NULL OR s.next_tree IS NOT NULL
), ended AS (
  SELECT f.own AS tree, f.pos AS idx, f.h, f.proof FROM fold f JOIN top_nodes t ON t.tree = f.tree AND t.lvl = f.lvl AND t.n = 1
)
SELECT doc_id, leaf, subroots.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, ended.h AS folded_root, ended.h = t.h AS verified
FROM placed JOIN subroots USING (tree) JOIN ended USING (tree, idx) JOIN top_nodes t ON t.n = 1
"""

TRIE = rf"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), drawn AS (
  SELECT *, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM own
), whole AS (
  SELECT o.conv_id AS c, coalesce(b.turns[1:o.h], []) || coalesce(o.turns[o.h + 1:], []) AS turns
  FROM drawn o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), members AS (
  SELECT c, d, turns[1:d] AS prefix, turns[1:d - 1] AS above, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)
), nodes AS (
  SELECT d, prefix, any_value(CASE WHEN d > 0 THEN above END) AS above, min(c) AS c, count(*) AS n,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends
  FROM members GROUP BY d, prefix
), kids AS (
  SELECT above AS prefix, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), own_values AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN nodes.d > 0 THEN (nodes.n - 1) * length(nodes.prefix[nodes.d].text) ELSE 0 END AS saved
  FROM nodes LEFT JOIN kids ON kids.prefix = nodes.prefix AND kids.d = nodes.d
), sums AS (
  SELECT k AS d, prefix[1:k] AS prefix, sum((n_children = 0)::BIGINT) AS leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM own_values) GROUP BY ALL
)
SELECT v.c::BIGINT AS conv_id, v.d::BIGINT AS depth, p.c::BIGINT AS parent_conv_id, v.n::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM own_values v JOIN sums s ON s.d = v.d AND s.prefix = v.prefix LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.prefix = v.above
"""
