"""URL rules and an exact key list held in a cascade of Bloom filters.

Level 1 holds the listed keys. Keys of the corpus that pass it without being listed are held by level 2, listed
keys that pass level 2 by level 3, and so on until no key is left to correct. Every key of the corpus is then
answered exactly, from bit arrays of a known size, with no join against the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import lower_ascii
from paperweave.session import landed

#: Bits per key: the first level keeps false positives rare, the others only have to halve what is left.
FIRST_BITS, LATER_BITS = 12, 6
FIRST_HASHES, LATER_HASHES = 8, 4
#: Most bytes of one broadcast cascade. A larger list is dealt into several cascades, one pass over the table each.
MOST_BYTES = 64 << 20

# (host, path, verdict); the host of a rule fits itself and its subdomains, the path is a prefix
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Words that list a host, as a whole part between dots or hyphens.
LISTED_WORDS = ["adult", "ads", "bets", "casino", "pills", "spam"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty for null and for text without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.char_length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null: longest host, then longest path."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


@dataclass
class Level:
    bits: np.ndarray
    hashes: int

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each key, given by two 64-bit hashes, is in the filter."""
        size, second = np.uint64(len(self.bits) * 64), second | np.uint64(1)
        found = np.ones(len(first), dtype=bool)
        for k in range(self.hashes):
            place = (first + np.uint64(k) * second) % size
            found &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Exact for every key of the corpus: the level at which a key stops passing tells the side it is on.

        ``hashes`` holds two arrays per level.
        """
        answer = np.zeros(len(hashes[0]), dtype=bool)
        open_ = np.ones(len(hashes[0]), dtype=bool)
        for depth, level in enumerate(self.levels):
            passes = level.holds(hashes[2 * depth], hashes[2 * depth + 1])
            answer[open_ & ~passes] = depth % 2 == 1
            open_ &= passes
        answer[open_] = len(self.levels) % 2 == 1
        return answer


def _unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _hashes(key: Column, depth: int) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(2 * depth)), F.xxhash64(key, F.lit(2 * depth + 1))


def _filter_of(keys: DataFrame, depth: int, n: int) -> Level:
    """Bits of the keys, set by Spark: one row per 64-bit word, or-ed over all keys."""
    per_key, hashes = (FIRST_BITS, FIRST_HASHES) if depth == 0 else (LATER_BITS, LATER_HASHES)
    size = max(1, -(-per_key * n // 64))
    words = np.zeros(size, dtype=np.uint64)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, second = _unsigned(batch["a"]), _unsigned(batch["b"]) | np.uint64(1)
            place = np.concatenate([(first + np.uint64(k) * second) % np.uint64(size * 64) for k in range(hashes)])
            bit = np.left_shift(np.uint64(1), place & np.uint64(63)).view(np.int64)
            yield pd.DataFrame({"word": (place >> np.uint64(6)).astype(np.int64), "bit": bit})

    a, b = _hashes(F.col("key"), depth)
    table = keys.select(a.alias("a"), b.alias("b")).mapInPandas(places, "word long, bit long")
    found = table.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return Level(words, hashes)


def _passing(keys: DataFrame, level: Level, depth: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def holds(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(shared.value.holds(_unsigned(a), _unsigned(b)))

    return keys.filter(holds(*_hashes(F.col("key"), depth)))


def build_cascades(universe: DataFrame, key: str, listed: str, most_bytes: int = MOST_BYTES) -> list[Cascade]:
    """Cascades for the distinct non-null keys of a corpus, of which the rows with ``listed`` are on the list.

    A key counts as listed if any of its rows says so. Several cascades, each below ``most_bytes``, share the
    keys by hash. Keys on each side shrink with every level; a level is written to the shared folder so that
    the next one does not repeat it.
    """
    keys = universe.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.coalesce(F.col(listed), F.lit(False))).alias("listed"))
    keys = landed(keys, "url-keys")
    n_listed = keys.filter("listed").count()
    parts = max(1, -(-2 * FIRST_BITS * n_listed // (8 * most_bytes)))
    cascades = []
    for part in range(parts):
        own = keys.filter(part_of(F.col("key"), parts) == part)
        inside, outside, levels = own.filter("listed").select("key"), own.filter("NOT listed").select("key"), []
        while n := inside.count():
            level = _filter_of(inside, len(levels), n)
            levels.append(level)
            inside, outside = landed(_passing(outside, level, len(levels) - 1), "url-level"), inside
        cascades.append(Cascade(levels))
    return cascades


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))


def with_listed(table: DataFrame, key: Column, cascades: list[Cascade], into: str = "listed") -> DataFrame:
    """One more column: whether the key is listed; false for null. Keys outside the corpus may be answered wrongly.

    One cascade is broadcast at a time, each at most the size it was built for; its rows are those of its part.
    """
    out = None
    for part, cascade in enumerate(cascades):
        shared = table.sparkSession.sparkContext.broadcast(cascade)
        depth = max(1, len(cascade.levels))

        @F.pandas_udf("boolean")
        def judge(*columns: pd.Series) -> pd.Series:
            return pd.Series(shared.value.listed([_unsigned(c) for c in columns]))

        hashes = [h for d in range(depth) for h in _hashes(key, d)]
        own = table if len(cascades) == 1 else table.filter(F.coalesce(part_of(key, len(cascades)), F.lit(0)) == part)
        own = own.withColumn(into, F.when(key.isNotNull(), judge(*hashes)).otherwise(False))
        out = own if out is None else out.unionByName(own)
    return out


def has_listed_word(host: Column, words: list[str] = LISTED_WORDS) -> Column:
    return F.arrays_overlap(F.split(host, r"[.-]"), F.array(*[F.lit(w) for w in words]))


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: list[tuple[str, str, str]] = RULES,
    listed: Column | None = None,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """The table with ``host, path, rule, verdict, listed`` in a struct column ``url_filter``.

    ``listed`` says of a column ``host`` whether it is on the list (default: it holds a listed word). The verdict
    is that of the rule, else block for a listed host, else allow. Null and odd urls have an empty host, which
    is a key like any other. Repeated rows are judged alike; other columns stay, one of that name is replaced.
    """
    mark = "url_filter"
    host, path = url_parts(F.col(url))
    hosts = pages.select(host.alias("host"))
    universe = hosts.withColumn("listed", has_listed_word(F.col("host")) if listed is None else listed)
    cascades = build_cascades(universe, "host", "listed", most_bytes)
    placed = pages.withColumn(mark, F.struct(host.alias("host"), path.alias("path"), matched_rule(host, path, rules).alias("match")))
    inside = "__listed"
    judged = with_listed(placed, F.col(mark)["host"], cascades, inside)
    verdict = F.coalesce(F.col(mark)["match"]["verdict"], F.when(F.col(inside), "block").otherwise("allow"))
    final = F.struct(
        F.col(mark)["host"].alias("host"), F.col(mark)["path"].alias("path"), F.col(mark)["match"]["rule"].alias("rule"),
        verdict.alias("verdict"), F.col(inside).alias("listed"),
    )
    return judged.withColumn(mark, final).drop(inside)
