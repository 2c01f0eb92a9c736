"""Toxicity of a text after undoing its disguises.

A noisy channel turns words into leetspeak, spaces them out or repeats their letters. Odd tokens become a lattice
of what each character may stand for; a Viterbi search finds the spelling that a character trigram model of the
corpus likes best. The restored words and their stems are the features of a logistic model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.language import letter_codes

#: Bound of the labelled rows a model is learned from.
TRAIN_ROWS = 20_000
#: A feature stands in this many toxic rows of the sample at least, and this many deviations more often than by chance.
LEAST_ROWS, LEAST_Z = 4, 4.0
#: Stems are the first letters of a word, of these lengths.
STEMS = range(3, 9)
RIDGE = 0.05
#: Distinct tokens whose features a task keeps; beyond it the store starts anew.
KEPT_TOKENS = 400_000

# fixed values: what a character may stand for in leetspeak
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}
#: Costs of the channel, as negative logarithms: a stand-in, a mark or digit that means nothing, a shortened run.
STAND_IN, DROPPED, SHORTENED = 1.0, 3.0, 0.5

WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_AMID = re.compile(r"[0-9@$!|+€£*._\-]")
_ODD = re.compile(r"[0-9@$!|+€£][^\W\d_]|[^\W\d_][0-9@$|+€£]|([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\W_])(?<![@$!|+€£])(?:[^\W_]|[@$!|+€£])(?:[ .\-_*](?:[^\W_]|[@$!|+€£])){2,}(?![^\W_]|[@$!|+€£])")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_GAPS = re.compile(r"[ .\-_*]")

#: Codes of the character model: a gap, the letters a-z, any other letter.
SYMBOLS = 28


def _symbol(char: str) -> int:
    code = ord(char) - 96
    return code if 1 <= code <= 26 else 27


@dataclass
class CharacterModel:
    """Trigram costs, negative log probabilities, by the codes of two characters and the next."""

    cost: np.ndarray

    @staticmethod
    def of_counts(counts: np.ndarray) -> CharacterModel:
        counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.05
        return CharacterModel((-np.log(counts / counts.sum(axis=2, keepdims=True))).astype(np.float32))


def train_characters(docs: DataFrame, text: str = "text") -> CharacterModel:
    """Trigram counts over every text: summed where the rows are, then by Spark; 28 to the third is all that comes back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for value in batch["_text"]:
                codes = letter_codes(value).astype(np.int64)
                codes = np.where(codes == 0, 0, np.where((codes >= 97) & (codes <= 122), codes - 96, 27))
                codes = np.concatenate([[0, 0], codes, [0]])
                # a word is seen with two gaps before it, as the search starts it
                first, second, third = codes[:-2], codes[1:-1], codes[2:]
                first = np.where(second == 0, 0, first)
                seen = (first * SYMBOLS + second) * SYMBOLS + third
                sums += np.bincount(seen[(second != 0) | (third != 0)], minlength=SYMBOLS**3)
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"gram": used.astype(np.int32), "n": sums[used]})

    table = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInPandas(count, "gram int, n long")
    found = table.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return CharacterModel.of_counts(counts)


def lattice(token: str, doubled: bool = False) -> list[list[tuple[str, float]]]:
    """Per character or run of one character: the spellings it may stand for, each with its cost.

    With ``doubled`` a letter that stands twice may also be one.
    """
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        char, end = token[at], at
        while end < len(token) and token[end] == char:
            end += 1
        run = end - at
        if char.isalpha():
            if run > 2:
                out.append([(char, SHORTENED), (char * 2, SHORTENED)])
            elif run == 2 and doubled:
                out.append([(char * 2, 0.0), (char, SHORTENED)])
            else:
                out.append([(char * run, 0.0)])
        else:
            options = [("", DROPPED if char.isdigit() else STAND_IN)]
            for letter in LEET.get(char, ""):
                options.append((letter, STAND_IN))
                if run > 1:
                    options.append((letter * 2, STAND_IN))
            out.append(options)
        at = end
    return out


def decode(token: str, model: CharacterModel, doubled: bool = False) -> str:
    """The likeliest spelling of a token in lower case: Viterbi over the lattice, a state being the last two letters."""
    cost = model.cost
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(token.lower(), doubled):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (spent, path) in states.items():
            for spelling, price in options:
                x, y, total = a, b, spent + price
                for char in spelling:
                    code = _symbol(char)
                    total += float(cost[x, y, code])
                    x, y = y, code
                held = after.get((x, y))
                if held is None or total < held[0]:
                    after[(x, y)] = (total, (path, spelling) if spelling else path)
        states = after
    _, path = min(((spent + float(cost[a, b, 0]), path) for (a, b), (spent, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, spelling = path
        out.append(spelling)
    return "".join(reversed(out))


def is_odd(token: str) -> bool:
    """Whether a token has a stand-in or mark among its letters, or a letter three times in a row."""
    if _ODD.search(token):
        return True
    first = _LETTER.search(token)
    amid = first and _AMID.search(token, first.end())
    return bool(amid and _LETTER.search(token, amid.end()))


def restore(text: str, model: CharacterModel) -> str:
    """The text with every disguised token replaced by its likeliest spelling; plain tokens stay as they are."""

    def joined(match: re.Match) -> str:
        return decode(_GAPS.sub("", match[0]), model)

    whole = _SPACED.sub(joined, text)
    return re.sub(r"\S+", lambda m: decode(m[0], model) if is_odd(m[0]) else m[0], whole)


def openings(word: str, size: int) -> set[str]:
    """First letters of a word when any of its doubled letters may be one."""
    out, at = {""}, 0
    while at < len(word) and any(len(o) < size for o in out):
        run = 2 if word[at : at + 2] == word[at] * 2 else 1
        out = {o + more if len(o) < size else o for o in out for more in {word[at], word[at : at + run]}}
        at += run
    return {o[:size] for o in out}


def token_features(token: str, model: CharacterModel, doubled: bool = False) -> set[str]:
    """Words of a token and their stems; a disguised token gives those of its restored spelling as well."""
    low = token.lower()
    found = WORD.findall(low)
    if is_odd(low):
        found += WORD.findall(decode(low, model))
    if doubled:
        found += WORD.findall(decode(low, model, True))
    return {f for word in found for f in word_features(word)}


def word_features(word: str) -> list[str]:
    return [f"={word}", *[f"^{word[:n]}" for n in STEMS if n < len(word)]]


def text_tokens(text: str, model: CharacterModel) -> set[str]:
    """Distinct tokens of a text, and the words its spaced-out runs spell."""
    out = set(text.split())
    for match in _SPACED.finditer(text):
        out.add(decode(_GAPS.sub("", match[0]), model))
    return out


@dataclass
class ToxicityModel:
    """Weights of features; ``plain`` and ``known`` remember what tokens without and with features a task has met."""

    characters: CharacterModel
    weights: dict[str, float]
    bias: float
    plain: set[str] = field(default_factory=set)
    known: dict[str, frozenset[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.openings = {name[1 : 1 + STEMS[0]] for name in self.weights}

    def of_token(self, token: str) -> frozenset[str]:
        low = token.lower()
        if is_odd(low):
            found = token_features(token, self.characters, _DOUBLED.search(low) is not None)
            return frozenset(f for f in found if f in self.weights)
        # a word can only carry a feature if it opens like one, perhaps with a letter less
        words = WORD.findall(low)
        kept = [w for w in words if w[: STEMS[0]] in self.openings]
        if _DOUBLED.search(low):
            kept += [decode(w, self.characters, True) for w in words if self._may_be_doubled(w)]
        return frozenset(f for w in kept for f in word_features(w) if f in self.weights)

    def _may_be_doubled(self, word: str) -> bool:
        """Whether a spelling with fewer doubled letters has a feature: the search for the likeliest one is worth it."""
        runs = len(_DOUBLED.findall(word))
        if not runs or openings(word, STEMS[0]).isdisjoint(self.openings):
            return False
        # spellings double with each run, so a word of many runs goes to the search without trying them
        return runs > 4 or any(f in self.weights for w in openings(word, len(word)) if w != word for f in word_features(w))

    def features(self, text: str) -> set[str]:
        out: set[str] = set()
        for token in text_tokens(text, self.characters).difference(self.plain):
            found = self.known.get(token)
            if found is None:
                if len(self.plain) + len(self.known) > KEPT_TOKENS:
                    self.plain.clear()
                    self.known.clear()
                found = self.of_token(token)
                if found:
                    self.known[token] = found
                else:
                    self.plain.add(token)
            out |= found
        return out

    def score(self, text: str | None) -> float:
        total = self.bias + sum(self.weights[f] for f in sorted(self.features(text))) if text else self.bias
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, total))))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Texts of at most about ``most`` labelled keys, drawn by a hash of the key."""
    known = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("_toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64(key, F.lit("toxicity sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.filter(draw < most / max(n, 1)).select(F.col(key).alias("_key"), F.col("_toxic").cast("int").alias("_toxic"))
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # the sample has a fixed bound, whatever the tables, so the texts stay where they are
    return texts.join(F.broadcast(chosen), "_key").select("_text", "_toxic")


def train(
    docs: DataFrame,
    labels: DataFrame,
    characters: CharacterModel,
    key: str = "doc_id",
    text: str = "text",
    train_rows: int = TRAIN_ROWS,
) -> ToxicityModel:
    """A logistic model over the words and stems that set the toxic rows of ``labels`` (key, toxic) apart.

    A key with several labels counts as toxic if one of them says so. Without labels there are no features and
    the score is that of the smoothed prior.
    """
    sample = _sample(docs, labels, key, text, train_rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, set[str]] = {}
        for batch in batches:
            sums: dict[str, list[int]] = {"": [0, 0]}
            for value, toxic in zip(batch["_text"], batch["_toxic"]):
                own: set[str] = {""}
                for token in text_tokens(value, characters):
                    found = cache.get(token)
                    if found is None:
                        if len(cache) > KEPT_TOKENS // 8:
                            cache.clear()
                        found = cache[token] = token_features(token, characters)
                    own |= found
                for name in own:
                    sums.setdefault(name, [0, 0])[1 if toxic else 0] += 1
            yield pd.DataFrame([(k, a, b) for k, (a, b) in sums.items()], columns=["feature", "clean", "toxic"])

    counted = sample.mapInPandas(count, "feature string, clean long, toxic long")
    table = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("_toxic").alias("t")).first()
    n, t = totals["n"] or 0, totals["t"] or 0
    bias = math.log((t + 0.5) / (n - t + 1.5))
    if not t or t == n:
        return ToxicityModel(characters, {}, bias)
    rows = F.col("clean") + F.col("toxic")
    rate = t / n
    z = (F.col("toxic") - rows * rate) / F.sqrt(rows * rate * (1 - rate))
    best = table.filter((F.col("feature") != "") & (F.col("toxic") >= LEAST_ROWS)).withColumn("z", z).filter(F.col("z") >= LEAST_Z)
    # features of a bounded sample: each stands in several toxic rows of it
    names = sorted(r["feature"] for r in best.select("feature").collect())
    model = ToxicityModel(characters, dict.fromkeys(names, 0.0), bias)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {name: k for k, name in enumerate(names)}
        for batch in batches:
            held = [sorted(place[f] for f in shared.value.features(x)) for x in batch["_text"]]
            yield pd.DataFrame({"held": held, "toxic": batch["_toxic"]})

    # equal rows count once with their number
    picked = sample.mapInPandas(select, "held array<int>, toxic int").groupBy("held", "toxic").count().toPandas()
    weights = fit_logistic(picked["held"].to_list(), len(names), picked["toxic"].to_numpy(np.float64), picked["count"].to_numpy(np.float64))
    return ToxicityModel(characters, dict(zip(names, weights[:-1].tolist())), float(weights[-1]))


def fit_logistic(held: list, width: int, target: np.ndarray, n: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Weights by Newton steps with a ridge on all but the last, the constant.

    ``held`` lists the features of each row, so the work follows their number, not rows times features; each step is
    solved by conjugate gradients.
    """
    sizes = np.array([len(h) for h in held], dtype=np.int64)
    place = np.concatenate([np.asarray(h, dtype=np.int64) for h in held]) if len(held) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(held)), sizes)
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-6

    def forth(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=v[place], minlength=len(held)) + v[-1]

    def back(x: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(place, weights=x[row], minlength=width), x.sum())

    weights = np.zeros(width + 1)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(forth(weights), -30, 30)))
        slope = back(n * (p - target)) + penalty * weights
        curve = n * np.maximum(p * (1 - p), 1e-6)
        scale = 1.0 / (back(curve) + penalty)
        step, rest = np.zeros(width + 1), slope.copy()
        way = scale * rest
        size = rest @ way
        for _ in range(4 * (width + 1) + 50):
            if np.abs(rest).max() <= 1e-10 * max(1.0, np.abs(slope).max()):
                break
            bent = back(curve * forth(way)) + penalty * way
            share = size / (way @ bent)
            step += share * way
            rest -= share * bent
            size, before = rest @ (scale * rest), size
            way = scale * rest + size / before * way
        weights -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def toxicity(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """Column of a score between 0 and 1.

    Null and empty texts have the score of a text without any feature. Equal texts have equal scores; a long
    text is scored whole, each feature counting once.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.score(x if isinstance(x, str) else None) for x in batch], dtype="float64")

    return score(text)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """The table with one more column, the score; a column of that name is replaced."""
    return docs.withColumn(into, toxicity(docs.sparkSession, model, F.col(text)))
