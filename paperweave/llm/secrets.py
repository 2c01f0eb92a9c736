"""Secrets in texts: fixed patterns, and strings in sensitive places that a primed compressor finds new.

A candidate near a word like "credential" (what reads as words is one only as a value after "=" or ":") is compressed by zstandard with a dictionary of the text around it and
of common identifiers. What those already hold costs almost nothing; a key drawn at random costs its own length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "novel"]

# fixed values: the base patterns; letters of the keyword stand in either case, ASCII only
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")

#: Words that make a place sensitive; a candidate stands within REACH characters after one of them.
CONTEXT = ["password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private key", "access key", "signature"]
REACH = 64
LEAST_LENGTH = 16
#: A run may start after "=", so that the value of KEY=value is one; within a run, "=" parts candidates, or pads the last.
RUN = re.compile(r"(?<![A-Za-z0-9+/_~-])[A-Za-z0-9+/_=~-]{16,}")
_PART = re.compile(r"[^=]+(?:=+$)?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CONSONANTS = re.compile(r"(?i)[b-df-hj-np-tv-xz]{5}")
#: Characters on each side of a candidate that prime the compressor.
AROUND = 2000
#: Share of its own length that a candidate must cost.
LEAST_NOVELTY = 0.75
#: A dictionary of identifiers as they stand in code and settings.
IDENTIFIERS = (
    "configuration environment username password_hash access_token refresh_token authorization authentication "
    "client_id client_secret connection_string database_url private_key public_key certificate signature session_id "
    "application/json content-type Bearer Basic https:// http:// www. .com .org localhost 127.0.0.1 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ example placeholder changeme your-api-key-here xxxxxxxxxxxxxxxx "
    "000000000000 111111111111 deadbeef null undefined true false default"
)

_CONTEXT = re.compile("|".join(re.escape(w) for w in CONTEXT))


def novelty(candidate: str, before: str, after: str, identifiers: str = IDENTIFIERS) -> float:
    """Bytes that a candidate adds to its surroundings and the identifiers, as a share of its own bytes."""
    own = candidate.encode()
    primer = "\n".join((identifiers, after, before)).encode("utf-8", "surrogatepass")
    known = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(press.compress(own)) - len(press.compress(b""))) / len(own)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the fixed patterns, in code points; the end is exclusive."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    # a run of 16 and more is the whole run, so nothing shorter has to be matched and dropped
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def reads_as_words(own: str) -> bool:
    """Whether a string without digits is made of what may be words: no long run of consonants, capitals only in front."""
    words = _WORDS.findall(own)
    return _CONSONANTS.search(own) is None and sum(map(len, words)) >= 3 * len(words)


def candidates(run: str, before: str, after: str) -> list[tuple[int, int]]:
    """Places of the strings of a run that may be keys: its long parts, or the whole run if all parts are short.

    ``before`` and ``after`` are the characters around the run. A string that mixes letters and digits counts anywhere,
    the value of an assignment always, and any other string unless it is a name before "=", or reads as words.
    """
    parts = [(m.start(), m.end()) for m in _PART.finditer(run) if m.end() - m.start() >= LEAST_LENGTH] or [(0, len(run))]
    out = []
    for start, end in parts:
        own = run[start:end]
        digits, letters = any(c.isdigit() for c in own), any(c.isalpha() for c in own)
        named = run[end : end + 1] == "=" or (own[-1] == "=" and after != "" and after in "\"'$({")
        assigned = (before + run[:start]).rstrip(" \"'").endswith(("=", ":"))
        if (digits and letters) or ((digits or letters) and not named and (assigned or not reads_as_words(own))):
            out.append((start, end))
    return out


def novel_spans(text: str, taken: list[tuple[int, int, str]], least: float = LEAST_NOVELTY) -> list[tuple[int, int, str]]:
    """Candidates in sensitive places that cost at least ``least`` of their length and touch no span so far."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would move the places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: list[tuple[int, int, str]] = []
    done = 0
    taken = sorted(taken)
    for word in _CONTEXT.finditer(low):
        # a run that starts within reach shows its least length before the end of this window
        while near := RUN.search(text, max(done, word.end()), word.end() + REACH + LEAST_LENGTH):
            run = RUN.match(text, near.start())
            done = run.end()
            for start, end in candidates(run[0], text[max(0, run.start() - 4) : run.start()], text[run.end() : run.end() + 1]):
                start, end = start + run.start(), end + run.start()
                if any(a < end and start < b for a, b, _ in taken):
                    continue
                cost = novelty(text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND])
                if cost >= least:
                    spans.append((start, end, "novel"))
    return spans


def find_spans(text: str | None, least: float = LEAST_NOVELTY) -> list[tuple[int, int, str]]:
    """All spans by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, least), key=lambda s: (s[0], KINDS.index(s[2])))


def secret_spans(text: Column, least: float = LEAST_NOVELTY) -> Column:
    """Column of ``array<struct<kind, start, end>>``: spans by start, then kind, in code points of the whole text.

    Null and empty texts have none. Kinds may overlap; ``novel`` spans overlap no other. One text is held at a
    time, however long.
    """

    @F.pandas_udf("array<struct<kind string, start long, end long>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(x if isinstance(x, str) else None, least)] for x in batch]
            yield pd.Series(found, dtype=object)

    return find(text)


def with_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", least: float = LEAST_NOVELTY) -> DataFrame:
    """The table with one more column, the spans of its texts; a column of that name is replaced."""
    return docs.withColumn(into, secret_spans(F.col(text), least))


def redact(text: str | None, mark: str = "[SECRET]", least: float = LEAST_NOVELTY) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    spans = find_spans(text, least)
    if not spans:
        return text
    out, at, end = [], 0, 0
    for start, stop, _ in spans:
        if start >= end:
            out += [text[at:start], mark]
        end = at = max(end, stop)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All documents with their secrets replaced by a mark and the columns they came with; null stays null."""

    @F.pandas_udf("string")
    def hide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([redact(x if isinstance(x, str) else None, mark) for x in batch], dtype=object)

    out = docs.withColumn(text, hide(F.col(text)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.char_length(F.col(text)).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)
