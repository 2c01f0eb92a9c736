"""Prefix trie over conversations: ternary search trees per range of sorted turn sequences, merged at the borders.

A turn is coded by 20 bytes: the first 16 of the SHA-256 digest of role and text, and the number of its code points.
Conversations, as strings of such codes, are dealt into ranges of their order. Each range numbers its own codes,
builds a ternary search tree by inserting medians first, and adds up members, leaves and savings from the bottom.
Only prefixes of a range's first and last sequence can lie in other ranges too; those few nodes are merged by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.session import landed

#: Bytes of a turn's code: digest and length.
DIGEST, CODE = 16, 20
#: Turns of a range, on average; what one task holds at a time.
RANGE_TURNS = 1 << 18
#: Bytes of a list of ids that one row holds.
LIST_BYTES = 1 << 16

_NODES = """depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,
  ends_sha256 string, key binary, parent_key binary, chars long, jumps array<binary>, ids binary, first_id long"""
_COLUMNS = [c.split()[0] for c in _NODES.replace("\n", " ").split(",")]


def turn_code(role: Column, text: Column) -> Column:
    """Hexadecimal code of a turn; a null role or text is empty. Equal codes mean equal turns but for a clash of 128 bits."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.concat(F.upper(F.substring(digest, 1, 2 * DIGEST)), F.lpad(F.hex(F.char_length(text).cast("bigint")), 8, "0"))


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, codes`` of ``conv_id, turn, role, text``: hexadecimal codes in the order of turns, null first.

    Equal turn numbers go by their codes. Rows without a conv_id belong to no conversation and are left out.
    """
    coded = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", turn_code(F.col("role"), F.col("text")).alias("code"))
    listed = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code"))).alias("turns"))
    return listed.select("conv_id", F.col("turns")["code"].alias("codes"))


def path(codes: Column) -> Column:
    """The codes of a conversation end to end, as bytes: their order is the order of sequences."""
    return F.unhex(F.array_join(codes, ""))


class Ternary:
    """A ternary search tree over sequences of small numbers, in flat lists; nodes are numbered as they are made."""

    def __init__(self):
        self.value, self.low, self.same, self.high = [], [], [], []
        self.root = -1

    def insert(self, sequence: list[int]) -> list[int]:
        """Tree nodes of the prefixes of a sequence, shortest first."""
        value, low, same, high = self.value, self.low, self.same, self.high
        nodes, links, slot = [], None, 0
        at = self.root
        for x in sequence:
            while at >= 0 and value[at] != x:
                links, slot = (low, at) if x < value[at] else (high, at)
                at = links[slot]
            if at < 0:
                at = len(value)
                value.append(x)
                low.append(-1)
                same.append(-1)
                high.append(-1)
                if links is None:
                    self.root = at
                else:
                    links[slot] = at
            nodes.append(at)
            links, slot = same, at
            at = same[at]
        return nodes


def _medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves, and so on."""
    todo = [(0, n)]
    for a, b in todo:
        if a < b:
            mid = (a + b) // 2
            yield mid
            todo += [(a, mid), (mid + 1, b)]


def _keys(sequence: bytes) -> list[bytes]:
    """Keys of all prefixes of a coded sequence, the empty one first."""
    running = hashlib.blake2b(digest_size=DIGEST)
    keys = [running.digest()]
    for k in range(0, len(sequence), CODE):
        running.update(sequence[k : k + CODE])
        keys.append(running.digest())
    return keys


def _lists(ids: list[int]) -> Iterator[tuple[int, bytes]]:
    """Ascending ids as comma-joined texts of bounded size, each with its first id."""
    step = LIST_BYTES // 20
    for k in range(0, len(ids), step):
        yield ids[k], ",".join(map(str, ids[k : k + step])).encode()


def range_nodes(paths: list[bytes], ids: list[int]) -> list[tuple]:
    """Rows of ``_NODES`` for one range: sequences in their order, ids ascending among equal sequences.

    Nodes on the path of the first or last sequence carry a key and count only what lies off these two paths; lists
    of ids that end there are rows of their own. All others are final, but for a parent with a key.
    """
    distinct, members = [], []
    for path, conv_id in zip(paths, ids):
        if not distinct or distinct[-1] != path:
            distinct.append(path)
            members.append([])
        members[-1].append(conv_id)
    raw = np.frombuffer(b"".join(distinct), dtype=f"S{CODE}") if any(distinct) else np.zeros(0, dtype=f"S{CODE}")
    # numpy drops zero bytes at the end of such strings alike in all of them, so equality is kept
    codes, numbers = np.unique(raw, return_inverse=True)
    chars = [int.from_bytes(c.ljust(CODE, b"\0")[DIGEST:], "big") for c in codes.tolist()]
    ends = np.cumsum([len(p) // CODE for p in distinct]).tolist()
    numbers = numbers.tolist()
    tree = Ternary()
    nodes: list[list[int]] = [[]] * len(distinct)
    for k in _medians(len(distinct)):
        nodes[k] = tree.insert(numbers[ends[k - 1] if k else 0 : ends[k]])
    size = len(tree.value) + 1  # the root of the trie has the last place
    root = size - 1
    parent, depth, least, count, leaves, saved, children = [[0] * size for _ in range(7)]
    least = [None] * size
    border: dict[int, tuple[bytes, bytes | None, list[bytes]]] = {}
    for k in {0, len(distinct) - 1}:
        keys = _keys(distinct[k])
        for d, at in enumerate([root, *nodes[k]]):
            jumps = [keys[d - (1 << j)] for j in range(d.bit_length()) if d >= 1 << j]
            border[at] = (keys[d], keys[d - 1] if d else None, jumps)
    ending: dict[int, list[int]] = {}
    order = [root]
    for own, listed in zip(nodes, members):
        at, low, n = root, min(listed), len(listed)
        least[root] = low if least[root] is None else min(least[root], low)
        count[root] += n
        for d, node in enumerate(own, 1):
            if least[node] is None:
                order.append(node)
                parent[node], depth[node], least[node] = at, d, low
                children[at] += node not in border
            elif low < least[node]:
                least[node] = low
            count[node] += n
            at = node
        ending[at] = listed
    out = []
    for at in reversed(order):  # a node stands after its parent
        fixed = at in border
        if not fixed:
            leaves[at] += children[at] == 0
            saved[at] += (count[at] - 1) * chars[tree.value[at]]
        if at != root and not fixed:
            leaves[parent[at]] += leaves[at]
            saved[parent[at]] += saved[at]
        listed = ending.get(at, [])
        up = border.get(parent[at]) if at != root else None
        if fixed:
            key, parent_key, jumps = border[at]
            length = 0 if at == root else chars[tree.value[at]]
            out.append((depth[at], least[at], None, count[at], children[at], leaves[at], saved[at], None, key, parent_key, length, jumps, None, None))
            for first, joined in _lists(listed):
                out.append((None,) * 8 + (key, None, None, None, joined, first))
        else:
            own = hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()
            above = None if up else least[parent[at]]
            out.append((depth[at], least[at], above, count[at], children[at], leaves[at], saved[at], own, None, up and up[0]) + (None,) * 4)
    return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, ids = [], []
    for batch in batches:
        paths += batch.column(0).to_pylist()
        ids += batch.column(1).to_pylist()
    if not paths:
        return
    rows = range_nodes(paths, ids)
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.int64()]
    for k in range(0, len(rows), 20_000):
        columns = zip(*rows[k : k + 20_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=_COLUMNS)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest per key of lists that come sorted by key and first id; only one hash is held at a time."""

    def row(key: bytes, running) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])

    last, running = None, None
    for batch in batches:
        for key, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key == last:
                running.update(b"," + joined)
                continue
            if last is not None:
                yield row(last, running)
            last, running = key, hashlib.sha256(joined)
    if last is not None:
        yield row(last, running)


def _merged(border: DataFrame, rounds: int) -> DataFrame:
    """Nodes with a key, one row each, complete but for the list of ends.

    What lies below along border nodes is added up by jumps of 1, 2, 4 ... nodes, so a path of d nodes takes log d rounds.
    """
    one = border.groupBy("key").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.first("parent_key").alias("parent_key"), F.first("chars").alias("chars"), F.first("jumps").alias("jumps"),
    )
    one = landed(one, "trie-border")
    under = one.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    counted = one.join(under, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = counted.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"))
    own = own.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars"))
    sums = own.select("key", "jumps", "n_leaves", "saved_tokens")
    for k in range(rounds):
        to = F.filter(F.array(F.col("key"), F.get("jumps", F.lit(k))), lambda x: x.isNotNull())
        sent = sums.select(F.explode(to).alias("to"), "key", "jumps", "n_leaves", "saved_tokens")
        jumps = F.max(F.when(F.col("to") == F.col("key"), F.col("jumps"))).alias("jumps")
        sums = sent.groupBy(F.col("to").alias("key")).agg(jumps, F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return own.drop("n_leaves", "saved_tokens", "jumps", "more").join(sums.drop("jumps"), "key")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``conv_id long, path binary`` (see :func:`path`), one row per distinct prefix.

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` of the members that end there. Conversations without turns are
    members of the root; without any conversation there is no node. conv_id must be unique and not null. A
    conversation is held whole by one task, and a range of some ``RANGE_TURNS`` turns; equal conversations and those
    with a common start are spread over as many ranges as they fill.
    """
    spark = conversations.sparkSession
    narrow = landed(conversations.select("path", F.col("conv_id").cast("bigint").alias("conv_id")), "trie-paths")
    turns = narrow.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // CODE // RANGE_TURNS + 1)
    ranged = narrow.repartitionByRange(tasks, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = landed(ranged.mapInArrow(_build, _NODES), "trie-nodes")
    border = nodes.filter("key IS NOT NULL AND depth IS NOT NULL")
    deepest = border.agg(F.max("depth")).first()[0] or 0
    merged = landed(_merged(border, int(deepest).bit_length()), "trie-merged")
    lists = nodes.filter("ids IS NOT NULL").select("key", "ids", "first_id").repartition("key").sortWithinPartitions("key", "first_id")
    ends = lists.select("key", "ids").mapInArrow(_end_digests, "key binary, ends_sha256 string")
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    joined = merged.join(ends, "key", "left").join(above, "parent_key", "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
    others = nodes.filter("key IS NULL")
    inner = others.filter("parent_key IS NULL").select(*joined.columns)
    # few keys have very many children, so a child goes by its own id, too: every parent is copied to all salts
    salts = 32
    copies = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    outer = others.filter("parent_key IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int"))
    outer = outer.join(copies, ["parent_key", "salt"]).withColumn("parent_conv_id", F.col("above")).select(*joined.columns)
    return joined.unionByName(inner).unionByName(outer)


def rebuilt(turns: DataFrame, every: int = 100, spread: int = 6) -> DataFrame:
    """``conv_id, path``: the first h turns of conversation c - c % every, then c's own after its first h.

    h is the unsigned crc32 of the decimal conv_id modulo ``spread``; at most ``every`` conversations share a start.
    """
    own = landed(sequences(turns), "trie-sequences")
    base = F.col("conv_id") - F.col("conv_id") % every
    starts = own.filter(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.slice("codes", 1, max(1, spread - 1)).alias("start"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int")
    joined = own.withColumn("base", base).withColumn("h", h).join(starts, "base", "left")
    head = F.slice(F.coalesce("start", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    tail = F.slice("codes", F.col("h") + 1, F.greatest(F.size("codes") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", path(F.concat(head, tail)).alias("path"))
