"""Spans in the template's order, models without caps, disguises by doubled letters and marks, clashing names."""

import itertools
import math
import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from paperweave.llm import dedup, language, licenses, quality, toxicity
from paperweave.llm.common import fresh

NOTICE = licenses.TEMPLATES[0][1].split()


def longest_chain(hits, k):
    best = []
    for i, j in sorted(hits):
        best.append((i, j, max([n + min(k, j - b) for a, b, n in best if a < i and b < j], default=k)))
    return max((n for _, _, n in best), default=0)


def brute_licenses(words):
    """Labels and score of every window of diagonals, by trying all chains."""
    labels, score, k = set(), 0.0, licenses.GRAM
    for label, text in licenses.TEMPLATES:
        own = text.split()
        hits = [(i, j) for i in range(len(words) - k + 1) for j in range(len(own) - k + 1) if words[i : i + k] == own[j : j + k]]
        for d in {i - j for i, j in hits}:
            covered = longest_chain([(i, j) for i, j in hits if d <= i - j <= d + licenses.DRIFT], k) / len(own)
            score = max(score, covered)
            if covered >= licenses.LEAST_COVERED:
                labels.add(label)
    return ",".join(sorted(labels)), score


def test_spans_follow_the_template(spark):
    cut = [w for n, w in enumerate(NOTICE) for w in ([w, *["foreign"] * 4] if n % 3 == 2 else [w])]
    thirds = [NOTICE[a : a + 3] for a in range(0, len(NOTICE), 3)]
    draw = random.Random(5)
    values = [
        " ".join(cut), " ".join(w for t in reversed(thirds) for w in t), " ".join(NOTICE[:15] + ["more"] * 8 + NOTICE[15:]),
        " ".join(NOTICE[:10] + NOTICE[14:]), " ".join(NOTICE + ["and"] * 3 + NOTICE), " ".join(NOTICE[25:] + NOTICE[:25]),
    ]
    for _ in range(60):
        own = [*draw.choice(licenses.TEMPLATES)[1].split(), *draw.choice(licenses.TEMPLATES)[1].split()]
        for _ in range(draw.randrange(6)):
            at = draw.randrange(len(own))
            own[at : at + draw.randrange(3)] = draw.choices(own, k=draw.randrange(6))
        values.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    rows = licenses.scan_licenses(docs, phrases=[("no such phrase", "x")]).orderBy("doc_id").collect()
    for r in rows:
        labels, score = brute_licenses(values[r.doc_id].split())
        assert (r.labels, round(r.score, 9)) == (labels, round(score, 9)), values[r.doc_id]
    assert ["mit" in r.labels.split(",") for r in rows[:6]] == [False, False, True, True, True, False]
    assert [(s.first_word, s.end_word) for s in rows[4].spans] == [(0, len(NOTICE)), (len(NOTICE) + 3, 2 * len(NOTICE) + 3)]


def test_any_number_of_languages(spark):
    rows = [(n, f"text of {chr(97 + n % 26) * 5} {n}", f"dirty {n}") for n in range(700)] + [(1000, "the rain and the sun", "en")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 701 and model.weights.size <= language.CELLS and model.buckets == 1 << 14
    assert language.buckets_for(512) == language.BUCKETS and language.buckets_for(10**9) == language.FEWEST_BUCKETS


def test_language_by_counted_probabilities(spark):
    """Scores equal those of probabilities counted n-gram by n-gram."""
    rows = [(1, "the rain and the sun", "en"), (2, "a field of rain", "en"), (3, "der Regen und die Sonne", "de"), (4, "la pluie", "fr")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(text, gap=0):
        # a text that is scored is followed by a gap, so that its last letters count as a word's end
        codes = np.concatenate([language.letter_codes(text), np.zeros(gap, np.uint32)])
        for order in model.orders:
            found = language.gram_buckets(codes, order, model.buckets)
            yield from found[found >= 0].tolist()

    counts = {lang: {} for _, _, lang in rows}
    for _, text, lang in rows:
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    seen = ["the field", "und Regen", "pluie et soleil", "x"]
    names, scores = language.score_texts(seen, model)
    for text, name, score in zip(seen, names, scores):
        logs = {}
        for lang, own in counts.items():
            total = sum(own.values()) + language.SMOOTHING * model.buckets
            prior = math.log(sum(x == lang for _, _, x in rows) / len(rows))
            logs[lang] = prior + sum(math.log((own.get(g, 0) + language.SMOOTHING) / total) for g in grams(text, 3))
        best = max(logs, key=logs.get)
        # alone and among other texts
        assert language.score_texts([text], model)[1][0] == score
        assert name == best and abs(score - 1 / sum(math.exp(x - logs[best]) for x in logs.values())) < 1e-4


def test_decoding_equals_all_spellings(spark):
    docs = spark.createDataFrame([(1, "you are an idiot and a loser, a stupid moron said so")], "doc_id long, text string")
    model = toxicity.train_characters(docs)

    def cost(word):
        codes = [0, 0, *[toxicity._symbol(c) for c in word], 0]
        return sum(float(model.cost[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:]))

    draw = random.Random(8)
    for doubled in (False, True):
        for _ in range(150):
            token = "".join(draw.choice("idotsluu1@0$!.a5") for _ in range(draw.randrange(1, 8)))
            spellings = [("".join(s for s, _ in way), sum(p for _, p in way)) for way in itertools.product(*toxicity.lattice(token, doubled))]
            least = min(cost(s) + p for s, p in spellings)
            found = toxicity.decode(token, model, doubled)
            assert abs(min(cost(s) + p for s, p in spellings if s == found) - least) < 1e-4, token


def test_doubled_letters_and_spaced_marks(spark):
    draw = random.Random(2)
    neutral = [" ".join(draw.choice(["the", "of", "rain", "sun", "walk", "field"]) for _ in range(12)) for _ in range(200)]
    values = [t + (["", " you stupid", "", " you idiot"][n % 4] if n % 2 else "") for n, t in enumerate(neutral)]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, toxicity.train_characters(docs))
    seen = ["the stuupid sun", "sun of i d ! o t rain", "rain 1 d 1 0 t sun", "rain s-t-u-p-!-d", "the sun hello all", "a + b + c = d", "x ! ! !"]
    assert [model.score(t) >= 0.5 for t in seen] == [True] * 4 + [False] * 3
    assert toxicity.openings("stuupid", 3) == {"stu"} and toxicity.openings("aasshole", 3) == {"aas", "ass", "ash"}
    assert toxicity.openings("", 3) == {""} and toxicity.openings("aa", 3) == {"a", "aa"}


def test_every_feature_is_kept(spark):
    """More telling words than the former bound of features: each is learned."""
    words = ["q" + "".join(p) + "z" for p in itertools.islice(itertools.product("abcdefghij", repeat=3), 120)]
    rows = [(5 * n + m, f"the rain {w}") for n, w in enumerate(words) for m in range(4)]
    rows += [(10_000 + n, "the rain of the sun") for n in range(9 * len(words) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels, toxicity.train_characters(docs.limit(50)))
    assert {f"={w}" for w in words} <= set(model.weights) and len(model.weights) > 120
    assert all(model.score(f"sun {w}") > 0.5 for w in words) and model.score("sun") < 0.5


def test_logistic_fit_has_no_slope(spark):
    draw = np.random.default_rng(3)
    held = [np.flatnonzero(draw.random(30) < 0.1) for _ in range(400)]
    target, n = (draw.random(400) < 0.3).astype(float), draw.integers(1, 4, 400).astype(float)
    weights = toxicity.fit_logistic(held, 30, target, n)
    matrix = np.zeros((400, 31))
    matrix[:, -1] = 1
    for k, h in enumerate(held):
        matrix[k, h] = 1
    penalty = np.r_[np.full(30, toxicity.RIDGE), 1e-6]
    slope = matrix.T @ (n * (1 / (1 + np.exp(-matrix @ weights)) - target)) + penalty * weights
    assert np.abs(slope).max() < 1e-5
    assert toxicity.fit_logistic([np.zeros(0, int)], 0, np.array([1.0]), np.array([1.0])).shape == (1,)


def test_columns_of_any_name_stay(spark, tmp_path):
    assert fresh(["a", "__X", "__x_"], "__x") == "__x__"
    text = "The rain fell on the field while we walked home along the river."
    names = ["doc_id", "text", "lang", "source", "n_chars", "__quality", "__md5", "__keyhash", "__toxicity"]
    docs = spark.createDataFrame([(1, text, "en", "s", len(text), "q", "m", "k", "t")] * 2, ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [tuple(r)[5:] for r in quality.clean_documents(docs).collect()] == [("q", "m", "k", "t")] * 2
    assert [tuple(r)[5:] for r in dedup.drop_near_duplicates(docs).collect()] == [("q", "m", "k", "t")]
    assert [tuple(r)[5:] for r in corpus_pipeline.toxicity_filter(spark, docs, str(tmp_path)).collect()] == [("q", "m", "k", "t")] * 2
