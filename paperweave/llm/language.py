"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams where the rows are and sums them per language and bucket; the table of log
probabilities, languages x buckets, is broadcast. Scoring works on Arrow batches: the codes of many texts in
one array, one gather per language and order, one segmented sum per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
#: Buckets for the n-grams of all orders.
BUCKETS = 1 << 15
#: Bound of the sample a language is learned from, in rows; a language with fewer rows gives all of them.
ROWS_PER_LANGUAGE = 10_000
#: Numbers in the table of log probabilities. With more languages than this allows, n-grams share buckets: no language
#: is left out, and the table that is broadcast keeps its size.
CELLS = 1 << 24
FEWEST_BUCKETS = 1 << 8
SMOOTHING = 0.5
#: Characters scored at a time.
BLOCK = 1 << 20
UNKNOWN = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Per code of the first plane: its lower-case code if it is a letter, else 0."""
    global _LETTERS
    if _LETTERS is None:
        table = np.zeros(1 << 16, dtype=np.uint32)
        for code in range(1 << 16):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _LETTERS = table
    return _LETTERS


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters of a text as codes, everything else as 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _letters()[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        known = {c: c if chr(c).isalpha() else 0 for c in np.unique(codes[high]).tolist()}
        out[high] = [known[c] for c in codes[high].tolist()]
    return out


def gram_buckets(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place; -1 where it would hold two gaps or only a gap.

    The array ends with as many results as codes: places without room for a whole n-gram give -1.
    """
    n = len(codes) - order + 1
    out = np.full(len(codes), -1, dtype=np.int64)
    if n <= 0:
        return out
    hashed = np.full(n, order, dtype=np.uint32)
    letters = np.zeros(n, dtype=np.int8)
    for k in range(order):
        part = codes[k : k + n]
        hashed = (hashed ^ part) * _MULTIPLIERS[k]
        hashed ^= hashed >> np.uint32(15)
        letters += part != 0
    keep = letters >= max(1, order - 1)
    out[:n][keep] = (hashed[keep] % np.uint32(buckets)).astype(np.int64)
    return out


@dataclass
class LanguageModel:
    """``weights``: log probability per language and bucket; ``prior``: log share of each language."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...] = ORDERS

    @property
    def buckets(self) -> int:
        return self.weights.shape[1]


def _sampled(docs: DataFrame, key: str, text: str, lang: str, most: int) -> tuple[DataFrame, dict[str, int]]:
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang")
    )
    # one row per language, which the model holds anyway
    counts = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return known, counts
    many = [(name, most / n) for name, n in counts.items() if n > most]
    if not many:
        return known, counts
    # only languages with more rows than the bound are thinned; a row of the model, which is broadcast too, is far
    # larger than one of this list, and without the hint the texts would travel by language
    share = F.broadcast(docs.sparkSession.createDataFrame(many, "_lang string, _share double"))
    draw = F.pmod(F.xxhash64("_key", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.join(share, "_lang", "left").filter(F.col("_share").isNull() | (draw < F.col("_share")))
    return drawn.drop("_share"), counts


def buckets_for(languages: int, buckets: int = BUCKETS) -> int:
    """Buckets halved until the table of so many languages has at most ``CELLS`` numbers, or few buckets are left."""
    while languages * buckets > CELLS and buckets > FEWEST_BUCKETS:
        buckets //= 2
    return buckets


def train(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    orders: tuple[int, ...] = ORDERS,
    buckets: int = BUCKETS,
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """A model of the rows with a text and a language, from at most about ``rows_per_language`` rows of each.

    The sample is drawn by a hash of the key, the same in every run. Every language is learned, however many there are;
    see ``CELLS``. Without any such row the model knows no
    language and every text is unknown.
    """
    sample, counts = _sampled(docs, key, text, lang, rows_per_language)
    languages = sorted(counts)
    buckets = buckets_for(len(languages), buckets)
    if not languages:
        return LanguageModel([], np.zeros((0, buckets), np.float32), np.zeros(0), orders)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, name in zip(batch["_text"], batch["_lang"]):
                row = sums.setdefault(name, np.zeros(buckets, dtype=np.int64))
                codes = letter_codes(value)
                for order in orders:
                    found = gram_buckets(codes, order, buckets)
                    row += np.bincount(found[found >= 0], minlength=buckets)
        for name, row in sums.items():
            used = np.flatnonzero(row)
            yield pd.DataFrame({"lang": name, "bucket": used.astype(np.int32), "n": row[used]})

    counted = sample.select("_text", "_lang").mapInPandas(count, "lang string, bucket int, n long")
    # at most languages x buckets rows, both bounded
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((len(languages), buckets))
    place = {name: k for k, name in enumerate(languages)}
    sums[table["lang"].map(place).to_numpy(np.int64), table["bucket"].to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
    weights = np.log(sums + SMOOTHING) - np.log(sums.sum(axis=1, keepdims=True) + SMOOTHING * buckets)
    rows = np.array([counts[name] for name in languages], dtype=np.float64)
    return LanguageModel(languages, weights.astype(np.float32), np.log(rows / rows.sum()), orders)


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text; unknown with 0 where there is no letter to judge."""
    n = len(texts)
    sums = np.tile(model.prior, (n, 1)) if model.languages else np.zeros((n, 0))
    has_letter = np.zeros(n, dtype=bool)
    block: list[tuple[int, np.ndarray]] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if block:
            codes = np.concatenate([c for _, c in block])
            sizes = np.array([len(c) for _, c in block])
            starts = np.cumsum(sizes) - sizes
            gap = max(model.orders)
            gaps = ((starts + sizes - gap)[:, None] + np.arange(gap)).ravel()
            rows = np.array([k for k, _ in block])
            for order in model.orders:
                found = gram_buckets(codes, order, model.buckets)
                # a gap stands between texts; an n-gram that begins in it would open the next text and weighs nothing
                found[gaps] = -1
                present = found >= 0
                found[~present] = 0
                for place in range(len(model.languages)):
                    weights = model.weights[place][found]
                    weights[~present] = 0
                    sums[rows, place] += np.add.reduceat(weights, starts, dtype=np.float64)
        block.clear()
        held = 0

    for k, text in enumerate(texts):
        if not text:
            continue
        codes = letter_codes(text)
        has_letter[k] = bool(codes.any())
        if has_letter[k] and model.languages:
            gap = np.zeros(max(model.orders), dtype=np.uint32)
            block.append((k, np.concatenate([codes, gap])))
            held += len(codes)
            if held >= BLOCK:
                settle()
    settle()
    names, scores = [UNKNOWN] * n, np.zeros(n)
    if model.languages:
        best = sums.argmax(axis=1)
        share = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for k in np.flatnonzero(has_letter):
            names[k] = model.languages[best[k]]
        scores[has_letter] = share[has_letter]
    return names, scores


def language(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """Column of ``struct<lang string, score double>``.

    Null texts and texts without a letter are ``und`` with score 0; equal texts get equal answers; between
    languages of equal score the first by name wins. Very long texts are scored whole.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = score_texts([x if isinstance(x, str) else None for x in batch], shared.value)
            yield pd.DataFrame({"lang": names, "score": scores})

    return judge(text)


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """The table with one more column, the struct of :func:`language`; a column of that name is replaced."""
    return docs.withColumn(into, language(docs.sparkSession, model, F.col(text)))
