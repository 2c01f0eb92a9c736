"""Token sequences of a fixed length, packed by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` ids. Pieces are dealt into blocks of bounded size by a hash; on
every block several islands breed packings. A child takes whole well-filled sequences of one parent, drops the
other parent's sequences that hold the same pieces, and places what was displaced by best fit. Between epochs
islands hand their best packings on to the next island of their block. Sequences with room left are pooled over
all blocks and packed again.
"""

from __future__ import annotations

import json
import os
import random
import re
import sys
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.llm.common import gathered
from paperweave.session import landed, work_path

CAPACITY = 4096
#: Pieces of a block, on average; what one island holds at a time.
BLOCK_PIECES = 4096
ISLANDS = 2
EPOCHS = 3
#: Packings an island keeps, hands on, and children it breeds per epoch.
POPULATION, ELITES, CHILDREN = 6, 2, 20
#: Share of a parent's sequences that a child takes whole.
INJECTED = 0.08
#: Sequences filled less than this are pooled and packed again.
POOLED_BELOW = 0.995
#: Distinct words and parts of texts whose ids a task keeps; beyond it the store starts anew.
KEPT_WORDS = 1_000_000
#: Characters of texts that are coded together, and new words that the tokenizer gets in one call.
BLOCK_CHARS, JOINED_WORDS = 1 << 21, 64
#: What ends the name of an id that ends a word.
WORD_END = "</w>"
#: The steps before the model, for which the words of plain characters are known.
_AS_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
_SPACES = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, _SPACES, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [_SPLIT, _AS_BYTES]},
}
#: Words of characters that no normal form changes, as that pattern cuts them where there is no apostrophe.
_PLAIN = "[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+"
plain_words, is_plain, all_plain = re.compile(_PLAIN).findall, re.compile(_PLAIN).fullmatch, re.compile(f"(?:{_PLAIN})*").fullmatch


class WordCoder:
    """Ids of texts by a tokenizer that ignores case and drops white space, with a store of what it met so far."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are packed as little-endian 32-bit numbers")
        self.tokenizer = Tokenizer.from_str(content)
        self.known: dict[str, bytes] = {}
        # the same model without the steps that leave plain words as they are; a byte of ASCII stands for itself
        rules = json.loads(content)
        self.knows_plain = {k: rules.get(k) for k in KNOWN_STEPS} == KNOWN_STEPS
        rules |= {"normalizer": None, "added_tokens": []}
        spaces = {"type": "WhitespaceSplit"}
        self.bare = Tokenizer.from_str(json.dumps({**rules, "pre_tokenizer": spaces}))
        self.bare_bytes = Tokenizer.from_str(json.dumps({**rules, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [spaces, _AS_BYTES]}}))
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for name, i in names.items() if name.endswith(WORD_END)]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers.

        No rule of the tokenizer reaches across a space or a line break, so the parts between them are coded by
        themselves, each once: the lower-case word, and the mark that ends it.
        """
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not parts:
            return []
        found = list(map(known.get, parts))
        fresh = [(at, self._words_of(parts[at])) for at, ids in enumerate(found) if ids is None]
        self._learn(list({word for _, words in fresh for word in words if word not in known}))
        for at, words in fresh:
            found[at] = known[parts[at]] = known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words))
        return gathered(found, coded.indices.to_numpy(), cut.offsets.to_numpy())

    def _words_of(self, part: str) -> Sequence[str]:
        # the tokenizer does not know the form of a sigma at the end of a word, and takes marks in order before it lowers
        low = part if "Σ" in part or "İ" in part else part.lower()
        if low.isascii() and low.isalpha():
            return (low,)
        # names of added ids begin so
        if self.knows_plain and "<|" not in low and all_plain(low):
            return plain_words(low)
        # after one of these letters a single full stop or comma is a word of its own; others may be taken apart
        # into a letter and a mark, which holds on to what follows
        if low[-1:] in (".", ",") and low[-2:-1].isascii() and low[-2:-1].isalpha():
            return low[:-1], low[-1]
        return (low,)

    def _learn(self, words: list[str]) -> None:
        """Plain words and words of letters go to the tokenizer many at a time: each gives one id that ends a word, its last."""
        plain = [w for w in words if is_plain(w)] if self.knows_plain else []
        self._learn_joined(self.bare, [w for w in plain if w.isascii()])
        self._learn_joined(self.bare_bytes, [w for w in plain if not w.isascii()])
        others = [w for w in words if w not in self.known] if len(plain) < len(words) else []
        self._learn_joined(self.tokenizer, [w for w in others if w.isalpha() and (w.isascii() or is_normalized("NFC", w))])
        for word in words:
            if word not in self.known:
                self.known[word] = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn_joined(self, tokenizer, words: list[str]) -> None:
        for k in range(0, len(words), JOINED_WORDS):
            own = words[k : k + JOINED_WORDS]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(own) or cuts[-1] != len(ids):
                continue  # not as expected: these go one by one
            flat, at = ids.tobytes(), 0
            for word, end in zip(own, (4 * cuts).tolist()):
                self.known[word] = flat[at:end]
                at = end


@lru_cache(maxsize=2)
def word_coder(content: str) -> WordCoder:
    return WordCoder(content)


def tokenized(docs: DataFrame, content: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: ``key, piece, start, length, ids``; the ids are packed as 32-bit numbers.

    Every document ends with ``end_id``; a null or empty text is that id alone. Only a document of more than
    ``capacity`` ids is cut.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def coded(texts: pd.Series) -> Iterator[bytes]:
        coder = word_coder(shared.value)
        block, size = [], 0
        for value in texts:
            block.append(value or "")
            size += len(block[-1])
            if size >= BLOCK_CHARS:
                yield from coder.encode(block)
                block, size = [], 0
        yield from coder.encode(block)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            keys, pieces, held = [], [], 0
            for owner, ids in zip(batch["_key"].array, coded(batch["_text"])):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    own = ids[at : at + 4 * capacity]
                    keys.append(owner)
                    pieces.append((at // (4 * capacity), at // 4, len(own) // 4, own))
                held += len(ids)
                if held > 1 << 24:
                    yield table(keys, pieces)
                    keys, pieces, held = [], [], 0
            if keys:
                yield table(keys, pieces)

    def table(keys: list, pieces: list) -> pd.DataFrame:
        out = pd.DataFrame(pieces, columns=["piece", "start", "length", "ids"])
        out.insert(0, "_key", pd.Series(keys, dtype=object) if any(k is None or k is pd.NA for k in keys) else keys)
        return out

    schema = T.StructType(
        [T.StructField("_key", docs.schema[key].dataType)]
        + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()))]
    )
    narrow = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return narrow.mapInPandas(cut, schema)


# ---- the genetic algorithm, on the pieces of one block ----


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], fills: list[int], capacity: int) -> None:
    """Place items, largest first, each where least room is left; open a new sequence where nothing has room."""
    rooms = sorted((capacity - fill, k) for k, fill in enumerate(fills) if fill < capacity)
    for item in sorted(items, key=lambda i: -sizes[i]):
        size = sizes[item]
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
            bins[k].append(item)
            fills[k] += size
            left = room - size
        else:
            k, left = len(bins), capacity - size
            bins.append([item])
            fills.append(size)
        if left:
            insort(rooms, (left, k))


def fitness(fills: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences first; among equals, rather full and empty ones than even ones."""
    return -len(fills), sum((f / capacity) ** 2 for f in fills)


def crossover(sizes: list[int], taker: list[list[int]], giver: list[list[int]], capacity: int, draw: random.Random) -> list[list[int]]:
    """Whole well-filled sequences of the giver go into the taker; what they displace is placed by best fit."""
    ranked = sorted(giver, key=lambda b: -sum(sizes[i] for i in b))
    good = ranked[: max(1, len(ranked) // 2)]
    taken = draw.sample(good, max(1, min(len(good), round(INJECTED * len(giver)))))
    inside = {i for b in taken for i in b}
    bins, displaced = [list(b) for b in taken], []
    for b in taker:
        if inside.isdisjoint(b):
            bins.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    fills = [sum(sizes[i] for i in b) for b in bins]
    # the emptiest sequences are opened as well: their pieces help to fill the others
    loose = set(sorted(range(len(bins)), key=fills.__getitem__)[: 1 + len(bins) // 100])
    displaced += [i for k in loose for i in bins[k]]
    bins = [b for k, b in enumerate(bins) if k not in loose]
    fills = [f for k, f in enumerate(fills) if k not in loose]
    best_fit(sizes, displaced, bins, fills, capacity)
    return bins


def first_packings(sizes: list[int], capacity: int, draw: random.Random) -> list[list[list[int]]]:
    """Best fit by size, and by sizes that are blurred a little."""
    out = []
    for n in range(POPULATION):
        bins: list[list[int]] = []
        fills: list[int] = []
        if n == 0:
            best_fit(sizes, list(range(len(sizes))), bins, fills, capacity)
        else:
            blurred = sorted(range(len(sizes)), key=lambda i: -sizes[i] * draw.uniform(0.8, 1.0))
            for at in range(0, len(blurred), 64):  # best fit within the blurred order
                best_fit(sizes, blurred[at : at + 64], bins, fills, capacity)
        out.append(bins)
    return out


def evolve(sizes: list[int], packings: list[list[list[int]]], capacity: int, seed: str) -> list[list[list[int]]]:
    """One epoch of an island: its best packings, best first. Ends early once no packing can be better."""
    draw = random.Random(seed)
    least = -(-sum(sizes) // capacity)

    def value(bins: list[list[int]]) -> tuple[int, float]:
        return fitness([sum(sizes[i] for i in b) for b in bins], capacity)

    known = sorted(((value(b), n, b) for n, b in enumerate(packings or first_packings(sizes, capacity, draw))), key=lambda x: (x[0], -x[1]), reverse=True)
    n = len(known)
    for _ in range(CHILDREN):
        if not known or len(known[0][2]) <= least:
            break
        taker, giver = (known[min(draw.randrange(len(known)), draw.randrange(len(known)))][2] for _ in range(2))
        child = crossover(sizes, taker, giver, capacity, draw)
        n += 1
        known.append((value(child), n, child))
        known.sort(key=lambda x: (x[0], -x[1]), reverse=True)
        del known[POPULATION:]
    return [b for _, _, b in known[:ELITES]]


def _coded(bins: list[list[int]], n: int) -> bytes:
    own = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(bins):
        own[b] = k
    return own.tobytes()


def _bins(coded: bytes) -> list[list[int]]:
    own = np.frombuffer(coded, dtype=np.int32)
    out: list[list[int]] = [[] for _ in range(int(own.max()) + 1 if len(own) else 0)]
    for i, k in enumerate(own.tolist()):
        out[k].append(i)
    return out


_ISLAND = "_block long, _island int, _uids binary, _sizes binary, _best array<binary>"


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, salt: int = 0, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``_uid, length, sequence_id, offset, fill`` for pieces ``_uid, length`` below the capacity.

    A block is dealt by a hash of the unique ``_uid``, so equal lengths or keys do not meet in one block. A
    sequence is named by its smallest ``_uid``.
    """
    n = pieces.count()
    blocks = max(1, -(-n // block_pieces))
    dealt = pieces.select("_uid", "length", F.pmod(F.xxhash64("_uid", F.lit(salt)), F.lit(blocks)).alias("_block"))

    def gather(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_uid")
        return pd.DataFrame({"_block": own["_block"].iloc[:1], "_uids": [own["_uid"].to_numpy(np.int64).tobytes()], "_sizes": [own["length"].to_numpy(np.int64).tobytes()]})

    def breed(epoch: int, own: pd.DataFrame) -> pd.DataFrame:
        home = own[own["_sizes"].notna()].iloc[0]
        sizes = np.frombuffer(home["_sizes"], dtype=np.int64).tolist()
        packings = [_bins(b) for best in own.sort_values("_from")["_best"] if best is not None for b in best]
        best = evolve(sizes, packings, capacity, f"{salt} {home['_block']} {home['_island']} {epoch}")
        return pd.DataFrame({"_block": [home["_block"]], "_island": [home["_island"]], "_uids": [home["_uids"]], "_sizes": [home["_sizes"]], "_best": [[_coded(b, len(sizes)) for b in best]]})

    def epoch_of(epoch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda own: breed(epoch, own)

    gathered = dealt.groupBy("_block").applyInPandas(gather, "_block long, _uids binary, _sizes binary")
    state = gathered.select("*", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("_island"))
    state = state.withColumn("_best", F.lit(None).cast("array<binary>"))
    for epoch in range(EPOCHS):
        home = F.struct("_block", "_island", "_uids", "_sizes", "_best", F.col("_island").alias("_from"))
        # elites move on to the next island, the pieces do not
        guest = F.struct(
            "_block", F.pmod(F.col("_island") + 1, F.lit(ISLANDS)).cast("int").alias("_island"), F.lit(None).cast("binary").alias("_uids"),
            F.lit(None).cast("binary").alias("_sizes"), "_best", F.col("_island").alias("_from"),
        )
        own = state.select(F.inline(F.array(home, guest) if epoch else F.array(home)))
        state = own.groupBy("_block", "_island").applyInPandas(epoch_of(epoch), _ISLAND)

    def settle(own: pd.DataFrame) -> pd.DataFrame:
        first = own.sort_values("_island").iloc[0]
        uids, sizes = np.frombuffer(first["_uids"], dtype=np.int64), np.frombuffer(first["_sizes"], dtype=np.int64).tolist()
        found = [_bins(b) for best in own.sort_values("_island")["_best"] for b in best]
        bins = max(found, key=lambda bins: fitness([sum(sizes[i] for i in b) for b in bins], capacity))
        rows = []
        for b in bins:
            b = sorted(b)
            fill = sum(sizes[i] for i in b)
            at = 0
            for i in b:
                rows.append((int(uids[i]), sizes[i], int(uids[b[0]]), at, fill))
                at += sizes[i]
        return pd.DataFrame(rows, columns=["_uid", "length", "sequence_id", "offset", "fill"])

    return state.groupBy("_block").applyInPandas(settle, "_uid long, length long, sequence_id long, offset long, fill long")


@dataclass
class Packing:
    """``pieces``: key, piece, start, length, ids, ``_uid``; ``places``: ``_uid``, sequence_id, offset."""

    pieces: DataFrame
    places: DataFrame
    key: str

    def table(self, **derived: Column) -> DataFrame:
        """A row per piece with its place; ``derived`` columns are made before the join, which then leaves the ids out."""
        own = self.pieces.select("_uid", F.col("_key").alias(self.key), "piece", "start", "length", *[c.alias(n) for n, c in derived.items()])
        return own.join(self.places, "_uid").drop("_uid")

    def sequences(self) -> DataFrame:
        """``sequence_id, length, ids``: every packed sequence with its ids in order, for writing."""
        whole = self.pieces.select("_uid", "ids").join(self.places, "_uid")
        each = F.sort_array(F.collect_list(F.struct("offset", "ids")))
        rows = whole.groupBy("sequence_id").agg(each.alias("parts"))
        joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
        return rows.select("sequence_id", joined.alias("ids")).withColumn("length", (F.octet_length("ids") / 4).cast("long"))


def pack_documents(
    docs: DataFrame, content: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1, block_pieces: int = BLOCK_PIECES
) -> Packing:
    """Every document in as few sequences of at most ``capacity`` ids as the search finds.

    Repeated rows are packed as often as they stand; a null key is kept; other columns are not read. An empty
    table gives an empty packing. Pieces are written once to the shared folder, with an id each that later
    steps refer to.
    """
    path = work_path(docs.sparkSession, "pieces")
    numbered = tokenized(docs, content, key, text, capacity, end_id).withColumn("_uid", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(path)
    pieces = docs.sparkSession.read.schema(numbered.schema).parquet(path)
    sizes = pieces.select("_uid", "length")
    full = sizes.filter(F.col("length") == capacity).select("_uid", F.col("_uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = [full]
    rest, level, before = sizes.filter(F.col("length") < capacity), 0, None
    while True:
        placed = landed(place_pieces(rest, capacity, level, block_pieces), "places")
        roomy = placed.filter(F.col("fill") < POOLED_BELOW * capacity)
        held = placed.agg(F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("offset") == 0).alias("sequences")).first()
        if before is not None and held["sequences"] >= before[0]:
            done.append(before[1])  # packing the pool again did not help: it stays as it was
            break
        again = roomy.agg(F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("offset") == 0).alias("sequences")).first()
        final = placed.select("_uid", "sequence_id", "offset")
        if held["pieces"] <= block_pieces or again["sequences"] < 2:
            done.append(final)
            break
        done.append(placed.filter(F.col("fill") >= POOLED_BELOW * capacity).select("_uid", "sequence_id", "offset"))
        before = (again["sequences"], roomy.select("_uid", "sequence_id", "offset"))
        rest, level = roomy.select("_uid", "length"), level + 1
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    return Packing(pieces, places, key)
