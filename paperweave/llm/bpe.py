"""Byte-level BPE in both directions by SQL inside the tasks: a recursive DuckDB query per block of words.

A word is a set of rows (word, place, token). Each step joins neighbouring tokens with the merge table, finds
for every word the leftmost pair of least rank and contracts it; words without a pair are done. Decoding joins
ids with the bytes of their tokens and puts them together in order.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import gathered

#: Distinct words, and parts of texts, whose ids a task keeps between batches; beyond it a store starts anew.
KEPT_WORDS, KEPT_PARTS = 600_000, 400_000
#: Words of more bytes than this go through the query that counts runs.
LONG_WORD = 64
#: Bytes of distinct words that one recursive query takes.
BLOCK_BYTES = 1 << 17
#: Tokens that one decoding query takes, a longer text being decoded in several.
BLOCK_TOKENS = 1 << 18

# A row's key is its word and its place in one number, so one sort gives every token its neighbour. Each word's
# leftmost pair of least rank is contracted. Where no token that starts or ends with the new one has a smaller rank
# ("calm"), the next steps would contract the other places of that pair, so they go with it. A pair of equal tokens
# overlaps itself in runs like aaaa: there, short words go pair by pair, long ones take every other pair of a run.
_ENCODE = """
WITH RECURSIVE state(key, tok, step) AS (
  SELECT key, tok, 0 FROM start
  UNION ALL
  (WITH {runs}near AS (
     SELECT *, lead(tok) OVER w AS next, lead(key) OVER w AS next_key FROM {state} WINDOW w AS (ORDER BY key)
   ), ranked AS (
     SELECT n.*, m.rank, m.calm FROM near n LEFT JOIN merges m ON m.a = tok AND m.b = next AND key >> 32 = next_key >> 32
   ), least AS (
     SELECT key >> 32 AS word, min((rank::BIGINT << 32) + (key & 4294967295)) AS low FROM ranked WHERE rank IS NOT NULL GROUP BY 1
   ), hits AS (
     SELECT r.*, coalesce(rank = low >> 32 AND (key & 4294967295 = low & 4294967295 OR calm AND {apart}), false) AS takes
     FROM ranked r JOIN least ON key >> 32 = word
   ), gone AS (
     SELECT next_key AS key FROM hits WHERE takes
   )
   SELECT key, CASE WHEN takes THEN rank ELSE tok END, step + 1 FROM hits ANTI JOIN gone USING (key))
), last AS (
  SELECT key >> 32 AS word, max(step) AS step FROM state GROUP BY 1
)
SELECT (key >> 32)::INT AS word, tok FROM state JOIN last ON key >> 32 = word AND state.step = last.step ORDER BY key
"""
ENCODE = _ENCODE.format(runs="", state="state", apart="tok <> next")
ENCODE_LONG = _ENCODE.format(
    runs="""turns AS (
     SELECT *, coalesce(tok <> lag(tok) OVER w OR key >> 32 <> lag(key) OVER w >> 32, true)::INT AS turn FROM state WINDOW w AS (ORDER BY key)
   ), numbered AS (
     SELECT *, sum(turn) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS run FROM turns
   ), counted AS (
     SELECT *, row_number() OVER (PARTITION BY run ORDER BY key) AS nth FROM numbered
   ), """,
    state="counted",
    apart="(tok <> next OR nth % 2 = 1)",
)

DECODE = """
SELECT doc, bytes FROM ids JOIN vocabulary USING (tok) ORDER BY place
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and a number per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """All pairs of tokens whose joined bytes are a token, by id: ``a, b, rank, calm``.

    ``calm``: no pair with the new token on either side has a smaller rank than the one that made it.
    """
    rows = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    a, b, made = (np.array(x, dtype=np.int32) for x in zip(*rows)) if rows else (np.zeros(0, np.int32),) * 3
    first = np.full(max(ranks.values(), default=0) + 1, np.iinfo(np.int32).max, dtype=np.int32)
    np.minimum.at(first, a, made)
    np.minimum.at(first, b, made)
    return pa.table({"a": a, "b": b, "rank": made, "calm": first[made] > made})


class Coder:
    """A vocabulary loaded into an in-memory DuckDB database of the task."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = read_ranks(content)
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "160MB", "preserve_insertion_order": False})
        self.db.execute("SET enable_progress_bar = false")
        merges = merge_table(self.ranks)  # noqa: F841 named in the SQL
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        vocabulary = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.single = np.full(256, -1, dtype=np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary holds all 256 bytes")
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def learn(self, fresh: set[str]) -> None:
        """Encode distinct words, shortest first, in blocks of bounded size, and keep their packed ids."""
        block: list[tuple[str, bytes]] = []
        size = 0
        for word, raw in sorted(((w, w.encode("utf-8", "replace")) for w in fresh), key=lambda x: len(x[1])):
            whole = self.ranks.get(raw)
            if whole is not None:  # a word that is a token is that token, as the reference coder has it
                self.known[word] = np.uint32(whole).tobytes()
                continue
            if block and (size + len(raw) > BLOCK_BYTES or len(raw) > LONG_WORD >= len(block[-1][1])):
                self._contract(block)
                block, size = [], 0
            block.append((word, raw))
            size += len(raw)
        if block:
            self._contract(block)

    def _contract(self, block: list[tuple[str, bytes]]) -> None:
        lengths = np.array([len(raw) for _, raw in block])
        codes = np.frombuffer(b"".join(raw for _, raw in block), dtype=np.uint8)
        offsets = np.cumsum(lengths) - lengths
        start = pa.table(  # noqa: F841 named in the SQL
            {
                "key": (np.repeat(np.arange(len(block), dtype=np.int64), lengths) << 32) + np.arange(len(codes)) - np.repeat(offsets, lengths),
                "tok": self.single[codes],
            }
        )
        query = ENCODE_LONG if lengths[-1] > LONG_WORD else ENCODE
        found = self.db.sql(query).to_arrow_table()
        flat = found["tok"].to_numpy().astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(found["word"].to_numpy(), minlength=len(block)))).tolist()
        for (word, _), low, high in zip(block, [0, *ends], ends):
            self.known[word] = flat[low:high]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text: little-endian unsigned 32-bit numbers.

        A text is cut before its single spaces, where no match of the pattern can reach across; parts repeat far
        more often than they are new. White space that a match may reach across is left to the pattern as it is.
        """
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if len(self.parts) > KEPT_PARTS:
            self.parts.clear()
        if not texts:
            return []
        texts = [text if text.isascii() else text.encode("utf-8", "replace").decode() for text in texts]
        whole = ["  " in text or text.endswith(" ") for text in texts]
        cut = pc.split_pattern(pa.array(["" if w else text for w, text in zip(whole, texts)], pa.string()), " ")
        coded, offsets = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        # a text's first part has no space before it and stands behind the others
        parts = [" " + part for part in coded.dictionary.to_numpy(zero_copy_only=False)]
        order = coded.indices.to_numpy().copy()
        order[offsets[:-1]] = len(parts) + np.arange(len(texts))
        parts += [text if w else text.split(" ", 1)[0] for w, text in zip(whole, texts)]
        found = list(map(self.parts.get, parts))
        pieces = {part: self.pattern.findall(part) for part, ids in zip(parts, found) if ids is None}
        fresh = {word for words in pieces.values() for word in words if word not in self.known}
        if fresh:
            self.learn(fresh)
        for part, words in pieces.items():
            self.parts[part] = self.known[words[0]] if len(words) == 1 else b"".join(map(self.known.__getitem__, words))
        found = [self.parts[part] if ids is None else ids for part, ids in zip(parts, found)]
        return gathered(found, order, offsets)

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        out = [bytearray() for _ in packed]
        parts = [(k, at) for k, p in enumerate(packed) for at in range(0, len(p), 4 * BLOCK_TOKENS)]
        block: list[tuple[int, np.ndarray]] = []
        held = 0
        for k, at in parts:
            ids = np.frombuffer(packed[k], dtype="<u4", offset=at, count=min(BLOCK_TOKENS, (len(packed[k]) - at) // 4))
            if block and held + len(ids) > BLOCK_TOKENS:
                self._join(block, out)
                block, held = [], 0
            block.append((k, ids))
            held += len(ids)
        if block:
            self._join(block, out)
        return [bytes(x) for x in out]

    def _join(self, block: list[tuple[int, np.ndarray]], out: list[bytearray]) -> None:
        lengths = [len(i) for _, i in block]
        tok = np.concatenate([i for _, i in block]).astype(np.int32)
        ids = pa.table({"doc": np.repeat(np.arange(len(block)), lengths), "place": np.arange(len(tok)), "tok": tok})  # noqa: F841
        found = self.db.sql(DECODE).to_arrow_table()
        sizes = pc.binary_length(found["bytes"]).to_numpy()
        flat = b"".join(found["bytes"].to_numpy())
        ends = np.cumsum(np.bincount(found["doc"].to_numpy(), sizes, len(block))).astype(np.int64).tolist()
        for (k, _), low, high in zip(block, [0, *ends], ends):
            out[k] += flat[low:high]


#: Characters that are encoded together.
BLOCK_CHARS = 1 << 21


@lru_cache(maxsize=2)
def coder(content: bytes, pattern: str) -> Coder:
    return Coder(content, pattern)


def _blocks(batch: pd.Series) -> Iterator[list]:
    """The values of a batch in groups of bounded size; null counts as empty."""
    block, size = [], 0
    for value in batch:
        value = value if isinstance(value, (str, bytes)) else None
        block.append(value)
        size += len(value or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _shared_coder(spark: SparkSession, content: bytes, pattern: str) -> Callable[[], Coder]:
    shared = spark.sparkContext.broadcast(content)
    return lambda: coder(shared.value, pattern)


def encode(spark: SparkSession, text: Column, content: bytes, pattern: str) -> Column:
    """Column of ids of a text, packed as little-endian unsigned 32-bit numbers; a null text is an empty one.

    ``content`` is a rank file of some hundred kilobytes; it is broadcast, whatever the data.
    """
    own = _shared_coder(spark, content, pattern)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x for block in _blocks(batch) for x in own().encode([t or "" for t in block])], dtype=object)

    return ids(text)


def decode(spark: SparkSession, packed: Column, content: bytes, pattern: str) -> Column:
    """Column of the bytes that packed ids stand for; null ids give no bytes, unknown ids are left out."""
    own = _shared_coder(spark, content, pattern)

    @F.pandas_udf("binary")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x for block in _blocks(batch) for x in own().decode([p or b"" for p in block])], dtype=object)

    return texts(packed)


def round_trip(spark: SparkSession, text: Column, content: bytes, pattern: str) -> Column:
    """Column of ``struct<ids binary, decoded binary>``: :func:`encode` and :func:`decode` of its ids in one pass."""
    own = _shared_coder(spark, content, pattern)

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, decoded = [], []
            for block in _blocks(batch):
                packed = own().encode([t or "" for t in block])
                ids += packed
                decoded += own().decode(packed)
            yield pd.DataFrame({"ids": ids, "decoded": decoded})

    return both(text)


def token_numbers(packed: Column) -> Column:
    """How many ids a packed list holds."""
    return (F.octet_length(packed) / 4).cast("bigint")
