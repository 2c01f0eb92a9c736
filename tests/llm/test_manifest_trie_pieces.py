"""Manifest, prefix trie and piece coder against plain versions, on odd and on hot input."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_queries import QUERIES, SF_DIR

from paperweave.llm import conversations, merkle, pieces
from paperweave.llm.ordinals import numbered

# ---- sentence pieces ----


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@pytest.fixture(scope="module")
def coder(model):
    return pieces.Coder(model)


def same(coder, library, texts):
    for text, packed in zip(texts, coder.encode(texts), strict=True):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(packed, "<u4").tolist() == ids, text[:99]
        assert coder.decode(packed).decode() == library.decode(ids), text[:99]


def test_pieces_fuzzed(coder, library):
    draw = random.Random(5)
    stock = ["the quick ", "  ", "▁ a", "\n\n \t", "日本語中文", "éèü", "😀‍", "aaaa", "<s></s><0x0A>", "\x00\x01", "0123456789", "ing tion ", "य़,", "़."]
    texts = ["".join(draw.choice(draw.choice(stock)) if draw.random() < 0.6 else draw.choice(stock) for _ in range(draw.randrange(40))) for _ in range(8000)]
    same(coder, library, texts)
    same(coder, library, [" " * n + w for n in range(70) for w in ("", "the", "日", "x\n", "\n")])
    same(coder, library, [c * n for n in range(70) for c in ("a", "ab", "=", "日", "\t")])


def test_pieces_long_texts(coder, library):
    draw = random.Random(6)
    kinds = [" " * 1_000_000, "a" * 1_000_000, "".join(draw.choices("日本語中文的是一不了", k=1_000_000)), "".join(draw.choices("0123456789abcdef", k=500_000))]
    kinds.append("".join(draw.choices("etaoinshr", k=20_000)))
    start = time.time()
    same(coder, library, kinds)
    assert time.time() - start < 60


def test_pieces_decode_any_ids(coder, library):
    draw = random.Random(7)
    for _ in range(3000):
        ids = [draw.choice([0, 1, 2, 35, 259, draw.randrange(3, 259), draw.randrange(259, 32000)]) for _ in range(draw.randrange(8))]
        assert coder.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids)


def test_pieces_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op13_sentencepiece"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_columns(spark, model, library):
    df = spark.createDataFrame([(None,), ("",), ("same",), ("same",)], "text string")
    got = [r.ids for r in df.select(pieces.encode(spark, F.col("text"), model).alias("ids")).collect()]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[1, 2], [1, 2], *[library.encode("same", add_bos=True, add_eos=True)] * 2]
    back = df.select(pieces.decode(spark, pieces.encode(spark, F.col("text"), model), model).alias("t")).collect()
    assert [bytes(r.t) for r in back] == [b"", b"", b"same", b"same"]
    assert df.limit(0).select(pieces.round_trip(spark, F.col("text"), model)).count() == 0


# ---- manifest ----


def test_numbered(spark):
    draw = random.Random(8)
    rows = [("hot" if n % 3 else f"g{n % 7}", draw.choice([None, *range(400)]), n) for n in range(3000)]
    got = numbered(spark.createDataFrame(rows, "g string, k long, id long"), "g", ["k", "id"], "test-numbered").collect()
    groups = defaultdict(list)
    for g, k, n in rows:
        groups[g].append((k is not None, k or 0, n))
    expected = {n: (i, len(v)) for v in groups.values() for i, (_, _, n) in enumerate(sorted(v))}
    assert {r.id: (r.idx, r.n) for r in got} == expected


def fold_runs(nodes, fanout):
    """Root of hexadecimal digests, and per leaf the siblings of every level as (slot, others)."""
    paths = [[] for _ in nodes]
    spans = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for slot in range(len(run)):
                for leaf in spans[a + slot]:
                    paths[leaf].append((slot, run[:slot] + run[slot + 1 :]))
            up.append(hashlib.sha256("".join(run).encode()).hexdigest())
            above.append([leaf for s in spans[a : a + fanout] for leaf in s])
        nodes, spans = up, above
    return nodes[0], paths


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_against_plain(spark, fanout):
    """Null and repeated ids, a null group, groups of one, a group over several levels, a tampered leaf."""
    rows = [(n, "big", f"t{n}") for n in range(70)] + [(None, "big", None), (5, "big", "t5"), (None, "big", None)]
    rows += [(1, None, "a"), (2, None, "b"), (3, "", "c"), (4, "Zé", "d"), (9, "z" * 3000, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("path", F.lit(1)).withColumn("tree", F.lit("x"))
    leaf = merkle.leaf([F.col("doc_id"), F.col("source"), F.col("text")])
    made = merkle.manifest(df, F.col("source"), ["doc_id"], leaf, carry=["doc_id", "source", "tree"], fanout=fanout)
    got = made.proofs.select(
        "doc_id", "source", "tree", merkle.as_hex(F.col("leaf")).alias("leaf"), merkle.as_hex(F.col("subroot")).alias("subroot"),
        merkle.proof_digest(F.col("path")).alias("proof"), merkle.folded(merkle.as_hex(F.col("leaf")), F.col("path")).alias("again"),
        merkle.folded(F.sha2(F.lit("other").cast("binary"), 256), F.col("path")).alias("changed"),
    ).collect()

    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, hashlib.sha256("".join(map(value, r)).encode()).hexdigest()))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: fold_runs([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, tops = fold_runs([built[g][0] for g in names], fanout)
    expected = []
    for g, top in zip(names, tops):
        for (_, _, own), low in zip(sorted(groups[g]), built[g][1]):
            expected.append((own, built[g][0], hashlib.sha256("".join(d for _, other in low + top for d in other).encode()).hexdigest()))
    assert made.root == root
    assert sorted((r.leaf, r.subroot, r.proof) for r in got) == sorted(expected)
    assert all(r.again == root and r.changed != root and r.tree == "x" for r in got)


def test_manifest_edges(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    leaf = merkle.leaf([F.col("doc_id"), F.col("source"), F.col("text")])
    made = merkle.manifest(df, F.col("source"), ["doc_id"], leaf, carry=["doc_id"])
    (row,) = made.proofs.collect()
    assert made.root == hashlib.sha256(b"1:11:a1:x").hexdigest() == bytes(row.leaf).hex() and row.path == []
    none = merkle.manifest(df.limit(0), F.col("source"), ["doc_id"], leaf, carry=["doc_id"])
    assert none.root is None and none.proofs.count() == 0


# ---- prefix trie ----


def plain_trie(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]].append(prefix)
    out = {}
    for prefix in sorted(members, key=len, reverse=True):
        own = members[prefix]
        saved = (len(own) - 1) * len(prefix[-1][1]) if prefix else 0
        leaves = 0 if kids[prefix] else 1
        for k in kids[prefix]:
            leaves, saved = leaves + out[k][5], saved + out[k][6]
        ends = ",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(prefix))
        up = min(members[prefix[:-1]]) if prefix else None
        out[prefix] = (min(own), len(prefix), up, len(own), len(kids[prefix]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_trie_against_plain(spark, monkeypatch):
    """Null turns, roles and texts, copies over many ranges, a long conversation, a common start, negative ids."""
    draw = random.Random(9)
    turns = []
    for c in range(-150, 500):
        kind = draw.random()
        texts = ["hi", "common"] + [draw.choice(["a", "b", "é😀"]) for _ in range(3)] if kind < 0.5 else ["hi"] * draw.randrange(1, 4)
        texts = [draw.choice(["x", "y", None, ""]) for _ in range(draw.randrange(1, 9))] if kind > 0.9 else texts
        turns += [(c, None if n == 0 and kind < 0.1 else n, draw.choice(["user", None]) if kind > 0.8 else "user", t) for n, t in enumerate(texts)]
    turns += [(777, n, "user", "long") for n in range(700)] + [(None, 0, "user", "nobody")]
    draw.shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("extra"))
    own = defaultdict(list)
    for c, n, role, text in turns:
        if c is not None:
            own[c].append((n is not None, n or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
    expected = plain_trie(whole)
    for size in (1 << 18, 40):
        monkeypatch.setattr(conversations, "RANGE_TURNS", size)
        monkeypatch.setattr(conversations, "LIST_BYTES", 100)
        assert trie_rows(conversations.prefix_trie(conversations.rebuilt(df))) == expected


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.prefix_trie(conversations.rebuilt(spark.createDataFrame([], schema))).count() == 0
    none = spark.createDataFrame([(3, b""), (1, b"")], "conv_id long, path binary")
    assert trie_rows(conversations.prefix_trie(none)) == plain_trie({3: [], 1: []})


def test_ternary_medians():
    tree = conversations.Ternary()
    nodes = [tree.insert([k]) for k in conversations._medians(1000)]
    assert sorted(tree.value) == list(range(1000)) and len({n[0] for n in nodes}) == 1000

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.root) <= 10
