"""SentencePiece BPE in both directions by vectorised merge rounds in numpy, on blocks of distinct words.

The symbols of all words of a block lie in one flat array. Each round finds every word's smallest pair rank, merges
its leftmost place (all places at once where that cannot change what follows), closes the gaps, and lets go of words
that have no pair left. Only pairs beside a merge are looked up again.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The character that stands for a space in pieces.
BLANK = "▁"
#: Distinct words a task keeps between batches; beyond it the store starts anew. Longer words are not kept.
KEPT_WORDS, KEPT_CHARS = 700_000, 48
#: Symbols of the words that one series of rounds takes; a longer word is a block of its own.
BLOCK_SYMBOLS = 1 << 18
#: Characters of texts that are encoded together.
BLOCK_CHARS = 1 << 22
NONE = np.int32(np.iinfo(np.int32).max)


def _bytewise(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each-byte", _bytewise)


class Pairs:
    """Rank, result and calmness of every pair of symbols whose joined text is a piece; found by binary search."""

    def __init__(self, symbols: dict[str, int], ranked: list[tuple[str, int]]):
        found = {}
        for piece, rank in ranked:
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = (rank, symbols[piece])
        self.keys = np.array(sorted(found), dtype=np.int64)
        self.rank = np.array([found[k][0] for k in self.keys.tolist()] + [NONE], dtype=np.int32)
        self.made = np.array([found[k][1] for k in self.keys.tolist()] + [0], dtype=np.int32)
        # calm: no pair with the new symbol on either side comes before, or ties with, the pair that made it
        first = np.full(max(symbols.values()) + 1, NONE, dtype=np.int32)
        np.minimum.at(first, (self.keys >> 32).astype(np.int64), self.rank[:-1])
        np.minimum.at(first, (self.keys & 0xFFFFFFFF).astype(np.int64), self.rank[:-1])
        self.calm = np.append(first[self.made[:-1]] > self.rank[:-1], False)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair; the last index for what is no pair."""
        if not len(self.keys):
            return np.zeros(len(a), dtype=np.int64)
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))


class Coder:
    """A BPE model with byte fallback that takes texts as they are (no normalisation but blanks for spaces)."""

    def __init__(self, content: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        if model.normalize(" ﬁ  x ") != f"{BLANK}{BLANK}ﬁ{BLANK}{BLANK}x{BLANK}":
            raise ValueError("the model must keep texts as they are and put one blank before them")
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        if any(model.is_unused(i) for i in range(size)):
            raise ValueError("unused pieces are not supported")
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.begin, self.end = model.bos_id(), model.eos_id()
        symbols = {names[i]: i for i in plain}
        single = sorted({c for i in plain for c in names[i]} - set(symbols))
        symbols |= {c: size + n for n, c in enumerate(single)}  # characters that are only parts of pieces
        # ids past the symbols stand for characters that no piece has
        self.symbol_of = np.full(0x110000, -1, dtype=np.int32)
        for c, n in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = n
        self.size = size
        steps = {s: n for n, s in enumerate(sorted({-model.get_score(i) for i in plain}))}
        ranked = [(names[i], steps[-model.get_score(i)]) for i in plain]
        self.runs = self._blank_runs(ranked)
        self.pairs = Pairs(symbols, [x for x in ranked if self.runs is None or BLANK * 2 not in x[0]])
        self.blanks = np.array([symbols.get(BLANK * k, -1) for k in range(1 if self.runs is None else len(self.runs))], dtype=np.int32)
        joins = {(ord(a), ord(b)) for i in plain for a, b in zip(names[i], names[i][1:])}
        self.joins = np.array(sorted(a << 32 | b for a, b in joins), dtype=np.int64)
        # texts may be cut before blanks and beside line ends if no piece reaches across
        cuttable = not any(b == ord(BLANK) != a for a, b in joins) and not any(10 in pair for pair in joins)
        self.words = re.compile(r" *[^ \n]+| +|\n+") if cuttable else re.compile(r".+", re.DOTALL)
        by_byte = {int(names[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        if len(by_byte) < 256:
            raise ValueError("the model must have pieces for all 256 bytes")
        self.by_byte = np.array([by_byte[n] for n in range(256)], dtype="<u4")
        self.bytes_of = [b""] * size
        for i in plain:
            self.bytes_of[i] = names[i].replace(BLANK, " ").encode()
        for n, i in by_byte.items():
            self.bytes_of[i] = bytes([n])
        self.blank_first = np.zeros(size, dtype=bool)
        self.blank_first[[i for i in plain if names[i][0] == BLANK]] = True
        for i in range(size):
            if model.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _blank_runs(ranked: list[tuple[str, int]]) -> np.ndarray | None:
        """How runs of blanks are cut if all pieces of two blanks and more share the last rank and nothing else has it.

        Row m, column q: width of the piece that starts at blank q of a run of m, or 0. What is left of a run when all
        other pairs are merged is then taken from the left; a longest piece joins nothing, so a longer run is longest
        pieces and a rest. Without such a table a run of blanks would need a round for each. None: not such a model.
        """
        last = max((rank for piece, rank in ranked if len(piece) > 1), default=0)
        family = {piece for piece, rank in ranked if rank == last and len(piece) > 1}
        if not family or family != {piece for piece, _ in ranked if BLANK * 2 in piece} or any(set(piece) != {BLANK} for piece in family):
            return None
        widths = {len(piece) for piece in family}
        longest = max(widths)
        table = np.zeros((longest + 1, longest + 1), dtype=np.int64)
        for m in range(1, longest + 1):
            parts = [1] * m
            while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in widths), None)) is not None:
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            table[m, np.cumsum(parts) - parts] = parts
        return table if table[longest, 0] == longest else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit numbers."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        cut = [self.words.findall(" " + text.replace(BLANK, " ")) if text else [] for text in texts]
        known = self.known
        fresh = {word for word in set(chain.from_iterable(cut)) if word not in known}
        new = self._merge_words(fresh) if fresh else {}
        long = {word: ids for word, ids in new.items() if len(word) > KEPT_CHARS}
        known.update((word, ids) for word, ids in new.items() if len(word) <= KEPT_CHARS)
        begin, end = np.uint32(self.begin).tobytes(), np.uint32(self.end).tobytes()
        out = []
        for words in cut:
            ids = [long[w] if w in long else known[w] for w in words] if long else map(known.__getitem__, words)
            out.append(b"".join([begin, *ids, end]))
        return out

    def _merge_words(self, fresh: set[str]) -> dict[str, bytes]:
        done: dict[str, bytes] = {}
        block: list[str] = []
        held = 0
        for word in sorted(fresh, key=len):
            if block and held + len(word) > BLOCK_SYMBOLS:
                done.update(zip(block, self._block(block)))
                block, held = [], 0
            block.append(word)
            held += len(word)
        done.update(zip(block, self._block(block)))
        return done

    def _block(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        chars = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        sym = self.symbol_of[chars]
        sym = np.where(sym < 0, -1 - chars, sym)  # not in any piece: kept as the character itself, below zero
        # a segment is a stretch whose neighbours all stand side by side in some piece: no merge leaves it
        apart = np.ones(len(chars), dtype=bool)
        if len(self.joins):
            key = chars[:-1] << 32 | chars[1:]
            at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
            apart[1:] = self.joins[at] != key
        apart[ends[:-1]] = True
        place, merged = self._rounds(sym, np.flatnonzero(apart))
        return self._packed(place, merged, chars, ends)

    def _rounds(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and symbol of everything that is left when no segment has a pair any more."""
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        lengths = np.diff(np.append(starts, len(sym)))
        place = np.arange(len(sym))
        pair = np.full(len(sym), len(self.pairs.keys))
        inner = np.ones(len(sym), dtype=bool)  # has a right neighbour in its segment
        inner[starts + lengths - 1] = False
        at = np.flatnonzero(inner)
        pair[at] = self.pairs.find(sym[at], sym[at + 1])
        while len(sym):
            rank = self.pairs.rank[pair]
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():
                stays = np.repeat(live, lengths)
                finished.append((place[~stays], sym[~stays]))
                sym, place, pair, inner, rank = sym[stays], place[stays], pair[stays], inner[stays], rank[stays]
                lengths, low = lengths[live], low[live]
                starts = np.cumsum(lengths) - lengths
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, lengths))
            segment = np.searchsorted(starts, hits, side="right") - 1
            first = np.ones(len(hits), dtype=bool)
            first[1:] = segment[1:] != segment[:-1]
            leader = hits[np.flatnonzero(first)[np.cumsum(first) - 1]]
            other = pair[hits] != pair[leader]
            touch = np.zeros(len(hits), dtype=bool)
            touch[1:] = (np.diff(hits) == 1) & ~other[1:] & ~other[:-1]
            if touch.any():  # equal symbols in a row: every other pair of the row, from its left end
                index = np.arange(len(hits))
                taken = (index - np.maximum.accumulate(np.where(touch, 0, index))) % 2 == 0
                hits, segment, first, other = hits[taken], segment[taken], first[taken], other[taken]
            # places go along from the left until one brings a pair that comes first, or holds another pair of that rank
            brings = self._brings_better(sym, pair, inner, hits)
            before = np.cumsum(brings | other) - (brings | other)
            goes = ~other & (before == before[np.flatnonzero(first)[np.cumsum(first) - 1]])
            hits, segment = hits[goes], segment[goes]
            sym[hits] = self.pairs.made[pair[hits]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hits + 1] = False
            lengths = lengths - np.bincount(segment, minlength=len(lengths))
            starts = np.cumsum(lengths) - lengths
            moved = hits - np.arange(len(hits))  # where the merged symbols stand after the gaps are closed
            inner[hits] = inner[hits + 1]
            sym, place, pair, inner = sym[keep], place[keep], pair[keep], inner[keep]
            left = moved[moved > 0] - 1
            for at in (moved[inner[moved]], left[inner[left]]):
                pair[at] = self.pairs.find(sym[at], sym[at + 1])
            pair[moved[~inner[moved]]] = len(self.pairs.keys)
        place = np.concatenate([p for p, _ in finished])
        order = np.argsort(place, kind="stable")
        return place[order], np.concatenate([s for _, s in finished])[order]

    def _brings_better(self, sym: np.ndarray, pair: np.ndarray, inner: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Which merges make a pair, with their neighbours as they then stand, of their own rank or before it."""
        out = np.zeros(len(hits), dtype=bool)
        look = np.flatnonzero(~self.pairs.calm[pair[hits]])
        if not len(look):
            return out
        at = hits[look]
        made, rank = self.pairs.made[pair[at]], self.pairs.rank[pair[at]]
        has_left, has_right = (at > 0) & inner[at - 1], inner[at + 1]
        merged_left = (look > 0) & (hits[look - 1] == at - 2)
        left = np.where(merged_left, made, sym[at - 1])
        right = sym[np.minimum(at + 2, len(sym) - 1)]
        better = has_left & (self.pairs.rank[self.pairs.find(left, made)] <= rank)
        better |= has_right & (self.pairs.rank[self.pairs.find(made, right)] <= rank)
        out[look] = better
        return out

    def _packed(self, place: np.ndarray, sym: np.ndarray, chars: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Symbols of the block as ids: runs of blanks in longest pieces, unknown characters as their bytes."""
        if self.runs is not None and (blank := sym == self.blanks[1]).any():
            begins = np.zeros(len(chars) + 1, dtype=bool)
            begins[0] = begins[ends] = True
            head = blank.copy()
            head[1:] &= ~blank[:-1] | begins[place[1:]]
            at, heads = np.flatnonzero(blank), np.flatnonzero(head)
            run = np.cumsum(head[at]) - 1
            nth, longest = at - heads[run], len(self.runs) - 1
            size = np.bincount(run)[run]
            width = self.runs[np.where(nth // longest < size // longest, longest, size % longest), nth % longest]
            sym[at] = self.blanks[width]
            keep = np.ones(len(sym), dtype=bool)
            keep[at] = width > 0
            sym, place = sym[keep], place[keep]
        other = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(other):
            raw = [chr(c).encode() for c in chars[place[other]].tolist()]
            width = np.ones(len(sym), dtype=np.int64)
            width[other] = [len(r) for r in raw]
            sym, place = np.repeat(sym, width), np.repeat(place, width)
            begin = (np.cumsum(width) - width)[other]
            spread = np.repeat(begin - (np.cumsum(width[other]) - width[other]), width[other]) + np.arange(width[other].sum())
            sym[spread] = self.by_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        flat = sym.astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(place, np.append(0, ends))).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 text of ids: control ids have none, one blank at the front goes, a stray byte becomes U+FFFD."""
        ids = np.frombuffer(packed, dtype="<u4")
        control = (ids == self.begin) | (ids == self.end)
        inside = np.flatnonzero(~control)
        if not len(inside):
            return b""
        joined = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if self.blank_first[ids[inside[0]]]:
            joined = joined[1:]
        try:
            joined.decode()
            if inside[-1] - inside[0] + 1 == len(inside):
                return joined
        except UnicodeDecodeError:
            pass
        # bytes on two sides of a control id are no one character
        parts = [b"".join(map(self.bytes_of.__getitem__, part.tolist())) for part in np.split(ids, np.flatnonzero(control))]
        text = "".join(part.decode("utf-8", "each-byte") for part in parts)
        return (text[1:] if self.blank_first[ids[inside[0]]] else text).encode()


@lru_cache(maxsize=2)
def coder(content: bytes) -> Coder:
    return Coder(content)


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


def _shared(spark: SparkSession, content: bytes) -> Callable[[], Coder]:
    shared = spark.sparkContext.broadcast(content)
    return lambda: coder(shared.value)


def encode(spark: SparkSession, text: Column, content: bytes) -> Column:
    """Column of ids of a text with begin and end ids, packed as little-endian unsigned 32-bit numbers.

    A null text is an empty one: begin and end only. ``content`` is a model file of some 500 kilobytes; it is
    broadcast, whatever the data.
    """
    own = _shared(spark, content)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x for block in _blocks(batch) for x in own().encode([t or "" for t in block])], dtype=object)

    return ids(text)


def decode(spark: SparkSession, packed: Column, content: bytes) -> Column:
    """Column of the UTF-8 bytes of the text that packed ids stand for; null ids give an empty text."""
    own = _shared(spark, content)

    @F.pandas_udf("binary")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([own().decode(p or b"") for p in batch], dtype=object)

    return texts(packed)


def round_trip(spark: SparkSession, text: Column, content: bytes) -> Column:
    """Column of ``struct<ids binary, decoded binary>``: :func:`encode` and :func:`decode` of its ids in one pass."""
    own = _shared(spark, content)

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, decoded = [], []
            for block in _blocks(batch):
                packed = own().encode([t or "" for t in block])
                ids += packed
                decoded += map(own().decode, packed)
            yield pd.DataFrame({"ids": ids, "decoded": decoded})

    return both(text)
