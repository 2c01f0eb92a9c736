"""Near copies by bottom-k sketches from one hash function, with links confirmed on full shingle sets.

Texts with equal shingle sets form a class, and only classes are compared. A class keeps the k smallest hashes of
its shingles. Inverted lists of the kept values, each class standing in the lists of its rarest ones only, bring
classes together; the member of a list with the fewest values of its own leads it. First every member is compared
with its leader: the smallest hashes of the union estimate the similarity, full sets decide. Members that belong to
their leader's component by then need no further comparison among each other; what is left over is compared with
its group in blocks. Only links leave a comparison, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.llm.common import fresh
from paperweave.session import landed

#: Words of a shingle and the similarity, in percent, from which documents are linked.
SHINGLE, PERCENT = 5, 80
#: Hashes that a class keeps.
KEPT = 64
#: Deviations by which an estimate may fall below the similarity: a link is missed once in some 10**9.
DEVIATIONS = 6.0
#: Members of a block, and rows that one task compares on average.
BLOCK, TASK_ROWS = 256, 512
#: Distinct words whose hashes a task keeps; beyond it the store starts anew.
KEPT_WORDS = 200_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_30, _27, _31 = np.uint64(30), np.uint64(27), np.uint64(31)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


@lru_cache(maxsize=1)
def _word_hashes() -> WordHashes:
    return WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _30)) * _B
    x = (x ^ (x >> _27)) * _C
    return x ^ (x >> _31)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    Words are runs without ASCII white space, A-Z in lower case; fewer than ``size`` words are one shingle; no
    words, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    known = _word_hashes()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = _mixed(out * _A + hashes[k : k + count])
    return np.unique(out.view(np.int64))


def least_shared(percent: int, kept: int = KEPT) -> int:
    """Values that the smallest ``kept`` hashes of a linked pair's union share at least, but for a rare accident."""
    share = percent / 100
    return max(1, math.floor(kept * share - DEVIATIONS * math.sqrt(kept * share * (1 - share))))


def may_link(a: np.ndarray, b: np.ndarray, percent: int, kept: int = KEPT) -> bool:
    """Whether the estimate from the smallest hashes of both sets leaves a link possible."""
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    if max(len(a), len(b)) <= kept:
        return True
    union = np.union1d(a[:kept], b[:kept])[:kept]
    shared = np.intersect1d(a[:kept], b[:kept], assume_unique=True)
    return int(np.count_nonzero(shared <= union[-1])) >= min(least_shared(percent, kept), len(union))


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _sketched(docs: DataFrame, key: str, text: str, shingle: int, kept: int) -> DataFrame:
    """Per row: a place, the key, digests of key and text, size and digest of the shingle set, its smallest hashes."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(x, shingle) for x in batch["_text"]]
            out = batch.drop(columns=["_text"])
            out["_n"] = np.array([len(s) for s in sets], dtype=np.int64)
            out["_set"] = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            out["_kept"] = [s[:kept] for s in sets]
            yield out

    narrow = docs.select(F.col(key).alias("_key"), *_text_id(key, text), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType(
        [f for f in narrow.schema if f.name != "_text"]
        + [T.StructField("_n", T.LongType()), T.StructField("_set", T.BinaryType()), T.StructField("_kept", T.ArrayType(T.LongType()))]
    )
    return narrow.mapInPandas(sketch, schema).withColumn("_uid", F.monotonically_increasing_id())


def _text_id(key: str, text: str) -> list[Column]:
    """What names a text of a row in any later reading: rows that agree in it have equal key and text."""
    return [F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_md5"), F.xxhash64(F.col(key)).alias("_keyhash")]


def _rarest(classes: DataFrame, percent: int, kept: int) -> DataFrame:
    """``v, c, n, own``: the lists a class stands in, those of its rarest values, and how many values are its own.

    Two sets that are linked share so many kept values that the rarest of one, in number one more than it may
    miss, hold one of them. A value of a single class makes no list, it only fills a place.
    """
    postings = classes.select("c", F.explode("kept").alias("v"))
    shared = landed(postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-values")
    met = postings.join(shared, "v").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("met"))
    size, share = F.size("kept"), percent / 100
    need = F.ceil(F.lit(percent) * size / 100)
    # a full set that may be linked with a larger one is held to the estimate as that one is
    need = F.when(size >= share * kept, F.least(need, F.lit(least_shared(percent, kept)))).otherwise(need).cast("int")
    own = size - F.size("met")
    places = size - need + 1 - own
    rare = met.join(classes.select("c", "n", "kept"), "c").withColumn("own", own).filter(places > 0)
    return rare.select("c", "n", "own", F.explode(F.slice("met", F.lit(1), places)).alias("m")).select(F.col("m")["v"].alias("v"), "c", "n", "own")


def _tasks(*parts: str, rows: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(max(1, -(-rows // TASK_ROWS)))).cast("int").alias("task")


def _array(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.int64)


def _star_links(members: DataFrame, sets: DataFrame, percent: int, kept: int, rows: int) -> DataFrame:
    """Links ``a, b`` between leaders ``p`` and their members ``c``; a large group is dealt to several tasks."""
    blocks = members.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = landed(blocks, "group-blocks")
    dealt = members.join(blocks, "p").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    left = dealt.join(sets, "c").select("p", "c", "hashes", _tasks("p", "block", rows=rows))
    spread = blocks.select("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    lead = spread.join(sets.withColumnRenamed("c", "p"), "p")
    right = lead.select(F.col("p").alias("leader"), F.col("hashes").alias("own"), _tasks("p", "block", rows=rows)).withColumnRenamed("task", "at")

    def compare(own: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        known = {p: _array(h) for p, h in zip(leaders["leader"], leaders["own"])}
        out = []
        for p, c, packed in zip(own["p"], own["c"], own["hashes"]):
            a, b = known[p], _array(packed)
            if may_link(a, b, percent, kept) and linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent):
                out.append((p, c))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return left.groupBy("task").cogroup(right.groupBy("at")).applyInPandas(compare, "a long, b long")


def _joined(c: np.ndarray, label: np.ndarray, sets: list[np.ndarray], others: pd.DataFrame, leader: int, percent: int) -> list[tuple[int, int]]:
    """Links that join components, between leftover members and the members of a block of their group."""
    other_c, other_label = others["c"].to_numpy(np.int64), others["label"].to_numpy(np.int64)
    other_sets = [_array(h) for h in others["hashes"]]
    sizes = np.array([len(s) for s in other_sets])
    owner = np.repeat(np.arange(len(other_sets)), sizes)
    values = np.concatenate(other_sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    # members that are left over as well meet twice: the smaller one asks
    twice = others["left"].to_numpy(bool)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for own_c, own_label, own in zip(c.tolist(), label.tolist(), sets):
        fits = (percent * np.maximum(sizes, len(own)) <= 100 * np.minimum(sizes, len(own))) & (other_label != own_label)
        fits &= ~(twice & (other_c <= own_c)) & (other_c != leader)
        if not fits.any():
            continue
        first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        runs = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        shared = np.bincount(owner[at], minlength=len(sizes))
        for k in np.flatnonzero(fits & (100 * shared >= percent * (sizes + len(own) - shared))):
            x, y = root(own_label), root(int(other_label[k]))
            if x != y:
                parent[x] = y
                out.append((own_c, int(other_c[k])))
    return out


def _rest_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within a group: what is not with its leader against all of the group, in blocks."""
    with_leader = members.select("p", "c").unionByName(members.select("p", F.col("p").alias("c")).distinct())
    named = with_leader.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    of_leader = labels.select(F.col("c").alias("p"), F.col("label").alias("_lead"))
    named = named.join(of_leader, "p", "left").withColumn("left", F.col("label") != F.coalesce("_lead", "p"))
    named = landed(named.select("p", "c", "label", "left"), "group-members")
    blocks = named.groupBy("p").agg(
        F.count_if("left").alias("n_left"), F.count(F.lit(1)).alias("n_all"),
        F.ceil(F.count_if("left") / (BLOCK // 2)).cast("int").alias("nu"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("na"),
    )
    # a single leftover has met its leader, so a group needs one more member
    blocks = landed(blocks.filter("nu > 0"), "rest-blocks")
    # each leftover meets every block of its group, each member every block of leftovers: so many rows are compared
    rows = blocks.agg(F.coalesce(F.sum(F.col("n_left") * F.col("na") + F.col("n_all") * F.col("nu")), F.lit(0)).alias("n")).first()["n"]
    open_ = named.join(blocks, "p")
    asking = open_.filter("left").withColumn("u", F.pmod(F.xxhash64("c"), F.col("nu")).cast("int"))
    asking = asking.select("*", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("a"))
    asked = open_.withColumn("a", F.pmod(F.xxhash64("c", F.lit(1)), F.col("na")).cast("int"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("u"))
    left = asking.join(sets, "c").select("p", "u", "a", "c", "label", "hashes", _tasks("p", "u", "a", rows=rows))
    right = asked.join(sets, "c").select(
        F.col("p").alias("p2"), F.col("u").alias("u2"), F.col("a").alias("a2"), F.col("c").alias("c2"), F.col("label").alias("label2"),
        F.col("left").alias("left2"), F.col("hashes").alias("hashes2"), _tasks("p", "u", "a", rows=rows).alias("at"),
    )

    def compare(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        others = others.rename(columns={n + "2": n for n in ("p", "u", "a", "c", "label", "left", "hashes")})
        known = dict(list(others.groupby(["p", "u", "a"])))
        out = []
        for place, block in own.groupby(["p", "u", "a"]):
            sets_ = [_array(h) for h in block["hashes"]]
            out += _joined(block["c"].to_numpy(np.int64), block["label"].to_numpy(np.int64), sets_, known[place], place[0], percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return left.groupBy("task").cogroup(right.groupBy("at")).applyInPandas(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``c, label``: the smallest node that each node of the links ``a, b`` reaches.

    Every round a node takes the smallest label among its neighbours and then its label's label, so the way to go
    halves or better; each round is written, so that a lost executor costs one round at most.
    """
    both = links.select(F.col("a").alias("c"), F.col("b").alias("d")).unionByName(links.select(F.col("b").alias("c"), F.col("a").alias("d")))
    edges = landed(both.distinct(), "edges")
    labels = landed(edges.groupBy("c").agg(F.min("d").alias("near")).select("c", F.least("c", "near").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("c").alias("d"), "label"), "d").groupBy("c").agg(F.min("label").alias("near"))
        better = labels.join(near, "c").select("c", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("c").alias("label"), F.col("label").alias("next"))
        moved = better.join(jump, "label").select("c", "old", F.least("label", "next").alias("label"))
        moved = landed(moved, "labels")
        changed = moved.filter("label <> old").limit(1).count()
        labels = moved.select("c", "label")
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, kept: int = KEPT
) -> DataFrame:
    """One row per document: ``<key>, n_shingles, component, kept``, and ``_md5, _keyhash, _first``.

    ``component`` is the smallest key reachable over links, ``kept`` whether it is the document's own. A text
    without words is linked with nothing. Repeated rows belong together and share their verdict; ``_first`` is true
    for one row of every component, which ``_md5`` and ``_keyhash`` find again. A null key comes after all others:
    a component of such rows only has a null name and keeps its first row. Other columns are not read. Equal
    sets are one class, whatever their number; no list, group or component is collected anywhere.
    """
    rows = landed(_sketched(docs, key, text, shingle, kept), "sketches")
    best = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_uid").alias("uid"), F.col("_md5").alias("md5"), F.col("_keyhash").alias("keyhash")))
    classes = rows.filter(F.col("_set").isNotNull()).groupBy("_set").agg(best.alias("best"), F.first("_n").alias("n"), F.first("_kept").alias("kept"))
    classes = landed(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    lists = landed(_rarest(classes, percent, kept), "lists")
    leaders = landed(lists.groupBy("v").agg(F.min(F.struct("own", "c")).alias("lead")).select("v", F.col("lead")["c"].alias("p")), "leaders")
    members = landed(lists.join(leaders, "v").filter(F.col("c") != F.col("p")).select("p", "c").distinct(), "members")
    n_members = members.count()
    involved = members.select("c").union(members.select("p")).distinct()
    named = classes.join(involved, "c").select("c", F.col("best")["md5"].alias("_md5"), F.col("best")["keyhash"].alias("_keyhash"))
    sets = landed(_full_sets(docs, named, key, text, shingle), "sets")
    star = landed(_star_links(members, sets, percent, kept, n_members), "links")
    rest = landed(_rest_links(members, components(star), sets, percent), "links")
    labels = components(star.unionByName(rest))
    grouped = classes.select("_set", "best", "c").join(labels, "c")
    first = grouped.groupBy("label").agg(F.min("best").alias("whole"))
    resolved = landed(grouped.join(first, "label").select("_set", "whole"), "components")
    own = classes.select("_set", "best").join(resolved, "_set", "left").select("_set", F.coalesce("whole", "best").alias("whole"))
    out = rows.drop("_kept").join(landed(own, "components"), "_set", "left")
    alone = F.col("whole").isNull()
    is_first = alone | (F.col("_uid") == F.col("whole")["uid"])
    component = F.when(alone, F.col("_key")).otherwise(F.col("whole")["key"])
    return out.select(
        F.col("_key").alias(key), F.col("_n").alias("n_shingles"), component.alias("component"),
        F.when(F.col("_key").isNull(), is_first).otherwise(F.col("_key") == component).alias("kept"),
        "_md5", "_keyhash", is_first.alias("_first"),
    )


def _full_sets(docs: DataFrame, named: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``c, hashes``: the full set of the text that stands for a class, for classes that stand in a group."""

    def hash_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"c": batch["c"], "hashes": [shingle_hashes(x, shingle).tobytes() for x in batch["_text"]]})

    texts = docs.select(*_text_id(key, text), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    found = texts.join(named, ["_md5", "_keyhash"]).dropDuplicates(["_md5", "_keyhash"])
    return found.select("c", "_text").mapInPandas(hash_all, "c long, hashes binary")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The documents without near copies: one row of every component, with all columns; texts without words stay."""
    verdict = near_duplicates(docs, key, text, **options)
    firsts = verdict.filter("_first").select("_md5", "_keyhash").distinct()
    md5, keyhash = fresh(docs.columns, "__md5"), fresh(docs.columns, "__keyhash")
    named = docs.withColumns(dict(zip((md5, keyhash), _text_id(key, text))))
    kept = named.join(firsts.select(F.col("_md5").alias(md5), F.col("_keyhash").alias(keyhash)), [md5, keyhash], "left_semi")
    # a row that is there several times, word for word, stays once
    return kept.dropDuplicates([md5, keyhash]).select(*docs.columns)
