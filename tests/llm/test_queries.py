"""Registered queries on the smallest tables: against their SQL, or against plain Python."""

import base64
import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from check_oracles import DATA, compare, connect
from tokenizers import Tokenizer

import corpus_pipeline
from paperweave.llm.queries import ORACLES, QUERIES

SF_DIR = os.path.join(DATA, os.environ.get("PAPERWEAVE_SF", "sf0.001"))


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert compare(df.columns, df.collect(), con, ORACLES[name]) == []


def held_out(doc_id, by, rest):
    return zlib.crc32(str(doc_id).encode()) % by == rest


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total, expected = 0, {}
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        for at in range(0, len(ids), 4096):
            own = ids[at : at + 4096]
            expected[doc_id, at // 4096] = (at, len(own), zlib.crc32(own.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert len(rows) == len(expected)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences), -(-total // 4096)


def test_packing(spark, docs):
    used, least = check_packing(QUERIES["op1_best_fit_packing"](spark, SF_DIR).collect(), docs)
    assert used <= least + 1


def shingle_sets(texts, size):
    out = {}
    for doc_id, text in texts.items():
        words = text.encode().lower().split()
        out[doc_id] = frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()
    return out


def brute_components(sets, percent):
    """Every pair compared, then the smallest id that links reach."""
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
    return {i: root(i) for i in ids}


def test_near_duplicates(spark, docs):
    rows = QUERIES["op3_minhash_near_dedup"](spark, SF_DIR).collect()
    sets = shingle_sets(docs, 3)
    expected = brute_components(sets, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), c, c == i) for i, c in expected.items()}


def test_toxicity_held_out(spark):
    """Of the held-out labelled rows, most toxic ones (some hold no word that tells) are caught and nearly no clean one is."""
    big = os.path.join(DATA, "sf0.1")
    labels = dict(connect(big).execute("SELECT doc_id, toxic FROM labels").fetchall())
    rows = QUERIES["op4_toxicity"](spark, big).collect()
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for p, t in own if t == 1]
    assert len(toxic) > 50 and sum(toxic) >= 0.85 * len(toxic)
    assert sum(p for p, t in own if t == 0) <= 0.02 * (len(own) - len(toxic))


def test_language_held_out(spark, con):
    known = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op5_language_id"](spark, SF_DIR).collect()
    assert len(rows) == len(known)
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    own = [r.lang_pred == known[r.doc_id] for r in rows if r.held_out]
    assert sum(own) >= 0.97 * len(own)


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.ASCII) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_secrets(spark, docs):
    for r in QUERIES["op7_secret_scans"](spark, SF_DIR).collect():
        spans = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == spans


def test_byte_bpe(spark, docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op8_byte_bpe"](spark, SF_DIR).collect():
        ids = np.array(coder.encode_ordinary(docs[r.doc_id]), dtype="<u4")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_pipeline(spark, docs):
    """Stage by stage against plain versions of their decisions; the end is the whole run."""
    kept = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = kept.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near copies", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF_DIR).collect(), kept.schema)
        assert kept.columns == columns
        after = {r.doc_id: r.text for r in kept.collect()}
        assert all(r.n_chars == len(r.text) for r in kept.collect())
        if name == "quality rules":
            judged = {r.doc_id: r.kept for r in QUERIES["op10_quality_rules"](spark, SF_DIR).collect()}
            assert set(after) == {i for i, ok in judged.items() if ok}
            assert all(set(t.split("\n")) <= set(texts[i].split("\n")) for i, t in after.items())
        elif name == "toxicity":
            toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if r.doc_id in texts}
            clean = [i for i, t in toxic.items() if t == 0]
            bad = [i for i, t in toxic.items() if t == 1]
            assert set(after) < set(texts)
            assert sum(i in after for i in clean) >= 0.95 * len(clean) and sum(i in after for i in bad) <= 0.2 * len(bad)
        elif name == "near copies":
            groups = brute_components(shingle_sets(texts, 5), 80)
            assert set(after) == set(groups.values())
        else:
            assert set(after) == set(texts)
            assert not any(brute_spans(t) for t in after.values())
        texts = after
    used, least = check_packing(corpus_pipeline.run(spark, SF_DIR).collect(), texts)
    assert used <= least + 1
