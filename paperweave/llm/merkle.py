"""Merkle manifest of a table: a tree per group, a tree over the groups' roots, proofs and their check.

Every level is a table of nodes (tree, idx). Each node is sent to its siblings' computed indices (XOR for pairs,
slot offsets for wider runs) and an equijoin with the nodes there gives every node its siblings; the node at slot
zero of a run then emits the parent. Paths come back down the levels by a join with the parent's path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.ordinals import numbered
from paperweave.session import landed

FANOUT = 16
NODE = ["tree", "idx", "n", "digest"]
#: Bytes of a digest.
WIDTH = 32


def digest(text: Column) -> Column:
    """SHA-256 of a text or bytes, as bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: of every value its number of UTF-8 bytes, a colon and the value; ``-`` for null."""
    values = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes with ``siblings``: the digests of the others of their run, in order, end to end."""
    slot = F.col("idx") % fanout
    if fanout == 2:
        target = F.array(F.col("idx").bitwiseXOR(F.lit(1)))
    else:
        first = F.col("idx") - slot
        target = F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda shift: first + (slot + shift) % fanout)
    sent = nodes.select("tree", F.explode(F.filter(target, lambda t: t < F.col("n"))).alias("idx"), slot.alias("slot"), F.col("digest").alias("sibling"))
    met = nodes.join(sent, ["tree", "idx"], "left")
    kept = [F.first(c).alias(c) for c in nodes.columns if c not in ("tree", "idx")]
    near = F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "sibling"))))
    gathered = met.groupBy("tree", "idx").agg(*kept, near.alias("near"))
    joined = F.aggregate("near", F.lit(b""), lambda done, x: F.concat(done, x["sibling"]))
    return gathered.withColumn("siblings", joined).drop("near")


@dataclass
class Trees:
    """Levels of a forest: per level the nodes with siblings, and the roots that stand at that level."""

    levels: list[DataFrame]
    roots: list[DataFrame]
    fanout: int

    def all_roots(self) -> DataFrame:
        """``tree, digest`` of every tree's root."""
        every = [r.select("tree", "digest") for r in self.roots]
        out = every[0]
        for r in every[1:]:
            out = out.unionByName(r)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """Leaves with ``path``: per level up to the root ``struct<slot, siblings>``, then what ``above`` has for the tree.

        ``above``: ``tree, path`` and more columns, which go along.
        """
        more = [c for c in above.columns if c not in ("tree", "path")]
        upper: DataFrame | None = None
        for k in reversed(range(len(self.roots))):
            own = self.roots[k].join(above, "tree")
            if k < len(self.levels):
                nodes = self.levels[k].withColumn("up", F.floor(F.col("idx") / self.fanout))
                step = F.struct((F.col("idx") % self.fanout).cast("int").alias("slot"), "siblings")
                parents = upper.select("tree", F.col("idx").alias("up"), F.col("path").alias("rest"), *more)
                below = nodes.join(parents, ["tree", "up"]).withColumn("path", F.concat(F.array(step), "rest"))
                own = below.select(*own.columns).unionByName(own)
            upper = own
        return upper


def grow(leaves: DataFrame, fanout: int = FANOUT) -> Trees:
    """Trees over leaves ``tree, idx, n, digest`` and columns that stay with them; a tree of one leaf is that leaf.

    While a tree has several nodes, every ``fanout`` consecutive ones become the digest of their hexadecimal digests,
    the last run having fewer, even one. One table is written per level, each a ``fanout``-th of the one below.
    """
    top = leaves.agg(F.max("n")).first()[0] or 0
    levels, roots, nodes = [], [], leaves
    while True:
        roots.append(nodes.filter("n = 1"))
        if top <= 1:
            return Trees(levels, roots, fanout)
        level = landed(_with_siblings(nodes.filter("n > 1"), fanout), f"merkle-{len(levels)}")
        levels.append(level)
        made = digest(as_hex(F.concat("digest", "siblings")))
        nodes = level.filter(F.col("idx") % fanout == 0).select(
            "tree", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), made.alias("digest")
        )
        top = -(-top // fanout)


@dataclass
class Manifest:
    """``proofs``: the given columns, ``leaf``, ``subroot`` (bytes) and ``path``; ``root``: hexadecimal, null for no rows."""

    proofs: DataFrame
    root: str | None


def manifest(rows: DataFrame, group: Column, order: list[str], leaf_digest: Column, carry: list[str], fanout: int = FANOUT) -> Manifest:
    """Manifest of a table: per group a tree of its leaves by ``order`` (null first), over their roots one by group.

    A null group is a group and comes first; groups go by their UTF-8 bytes. Rows equal in ``order`` go by their
    digests, so repeated rows give the same manifest in any order. Only digests and the columns of ``order`` and
    ``carry`` travel: texts are read once, for their digests. A table without rows has no root and no proofs.
    Proofs hold the columns of ``carry``, whatever they are called, before ``leaf``, ``subroot`` and ``path``.
    """
    names = {"tree": F.coalesce(F.concat(F.lit("="), group), F.lit("")), "digest": leaf_digest}
    places = {c: f"row_{n}" for n, c in enumerate(dict.fromkeys([*order, *carry]))}
    kept = [F.col(c).alias(n) for c, n in places.items()]
    own = [places[c] for c in order]
    narrow = landed(rows.select(*[c.alias(n) for n, c in names.items()], *kept), "merkle-leaves")
    leaves = landed(numbered(narrow, "tree", [*own, "digest"], "merkle-ranges"), "merkle-numbered")
    trees = grow(leaves, fanout)
    subroots = trees.all_roots().select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    tops = landed(numbered(subroots, "tree", ["group"], "merkle-groups"), "merkle-tops")
    forest = grow(tops, fanout)
    last = forest.all_roots().first()
    root = None if last is None else bytes(last["digest"]).hex()
    step = "array<struct<slot:int,siblings:binary>>"
    start = tops.select("tree").distinct().withColumn("path", F.array().cast(step))
    above = forest.paths(start).select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"))
    found = trees.paths(above)
    back = [F.col(places[c]).alias(c) for c in carry]
    return Manifest(found.select(*back, F.col("digest").alias("leaf"), "subroot", "path"), root)


def proof_digest(path: Column) -> Column:
    """Hexadecimal digest of a proof: all siblings from the leaf to the root, left to right, as hexadecimal text."""
    return F.sha2(F.array_join(F.transform(path, lambda s: as_hex(s["siblings"])), "").cast("binary"), 256)


def folded(leaf_hex: Column, path: Column) -> Column:
    """Hexadecimal root that a leaf and the siblings on its path give."""

    def up(node: Column, s: Column) -> Column:
        left = F.substring(s["siblings"], F.lit(1), s["slot"] * WIDTH)
        right = F.substring(s["siblings"], s["slot"] * WIDTH + 1, F.octet_length(s["siblings"]))
        return F.sha2(F.concat(as_hex(left), node, as_hex(right)).cast("binary"), 256)

    return F.aggregate(path, leaf_hex, up)
