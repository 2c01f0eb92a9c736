"""Operators against brute force and against hot keys."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paperweave.functions import similarity
from paperweave.functions.similarity import score, weighted_score
from paperweave.operators import features, harmonise, joins, linear, matching, metrics, sampling, selection
from paperweave.operators.distribution import labels_by_threshold, quota
from paperweave.operators.triples import scalar_view, statements_by_subject
from paperweave.plans import experiment
from paperweave.sources import readers
from paperweave.streaming import rate
from paperweave.streaming.rate import rate_window


def titles(count, seed):
    """Random titles with near copies, short ones and repetitive ones."""
    rng = random.Random(seed)
    words = ["graph", "spectral", "theory", "of", "random", "deep", "learning", "für", "the", "x", "cell", "quantum"]
    made = ["", "a", "ab", "aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaab", "la la la la la la la la la la la la"]
    while len(made) < count:
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
        made.append(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t))
            t = rng.choice([t[:i] + t[i + 1 :], t[:i] + "z" + t[i:], t[:i] + "q" + t[i + 1 :]])
            made.append(t)
    return sorted(set(made))


@pytest.mark.parametrize(("least", "hot"), [(96, 20_000), (96, 3), (90, 20_000)])
def test_similar_texts_misses_nothing(spark, monkeypatch, least, hot):
    monkeypatch.setattr(matching, "HOT_GRAM", hot)
    left, right = titles(160, 1), titles(160, 2)
    a = spark.createDataFrame(list(enumerate(left)), "id long, text string")
    b = spark.createDataFrame(list(enumerate(right)), "id long, text string")
    got = {(r.left_id, r.right_id) for r in matching.similar_texts(a, b, least).collect()}
    expected = {
        (i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x != y and score(x, y) >= least
    }
    assert expected and got == expected


def test_match_by_title_takes_the_first_candidate(spark):
    papers = spark.createDataFrame([(1, "Deep Learning for Graph Theory"), (2, "Nothing like it"), (3, None)], "paper_id long, title string")
    found = spark.createDataFrame([("deep learning for graph theory", 7), ("deep learning for graph theori", 3), ("deep learning", 1)], "title string, rank long")
    got = {r.paper_id: r.match and r.match["rank"] for r in matching.match_by_title(papers, found).collect()}
    assert got == {1: 3, 2: None, 3: None}


def test_validation_levels(spark):
    rows = [
        ("T of everything", "T OF EVERYTHING", "['A B']", ["C D"], "", "", 1, False),
        ("T of everything", "T of everything", "['A B']", ["C D"], "10.1/7", "10.1/7", 2, True),
        ("T of everything", "T of everything", "['Ann Bee']", ["Ann Bee"], "", "10.1/7", 2, True),
    ]
    df = spark.createDataFrame(rows, "title string, t string, author string, a array<string>, doi string, d string, score int, valid boolean")
    match = F.struct(F.col("t").alias("title"), F.col("a").alias("authors"), F.col("d").alias("doi")).alias("match")
    checked = matching.validate_match(df.select("title", "author", "doi", F.col("score").alias("s"), F.col("valid").alias("v"), match))
    assert all((r.score, r.valid) == (r.s, r.v) for r in checked.collect())


def test_lookup_join_with_a_hot_key(spark):
    left = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    left = left.unionByName(spark.createDataFrame([(5000, None)], "id long, k string"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k9", 3)], "k string, v int")
    plain = sorted(left.join(right, "k", "left").select("id", "k", "v").collect(), key=str)
    salted = joins.lookup_join(left, right, "k", hot_rows=100).select("id", "k", "v")
    assert sorted(salted.collect(), key=str) == plain


@pytest.mark.parametrize("limit", [0, 1, 37, 999, 1000, 5000])
def test_first_by_hash_is_exact(spark, limit):
    df = spark.range(1500).select("id", F.when(F.col("id") < 1000, "a").otherwise("b").alias("g"), F.md5(F.col("id").cast("string")).alias("d"))
    limits = spark.createDataFrame([("a", limit)], "g string, limit long")
    marked = selection.first_by_hash(df, ["g"], limits, "d").collect()
    wanted = {r.id for r in sorted((r for r in marked if r.g == "a"), key=lambda r: r.d)[:limit]}
    assert {r.id for r in marked if r.picked} == wanted
    assert len(marked) == 1500


def test_first_by_hash_ranks_within_a_slot(spark):
    # all digests share their leading digits, so the whole group is one slot
    df = spark.range(200).select(F.lit("a").alias("g"), F.concat(F.lit("abc"), F.md5(F.col("id").cast("string"))).alias("d"))
    limits = spark.createDataFrame([("a", 55)], "g string, limit long")
    marked = selection.first_by_hash(df, ["g"], limits, "d").collect()
    assert sorted(r.d for r in marked if r.picked) == sorted(r.d for r in marked)[:55]


def test_split_covers_every_label(spark):
    rows = [(i, [f"rare{i}"] if i < 40 else ["common"]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, labels array<string>")
    parted = sampling.random_split(df, 0.5, "id")
    assert joins.uncovered_labels(parted.filter("split = 'test'"), parted.filter("split = 'train'")).count() == 0


def test_thresholds_and_quota(spark):
    dist = spark.createDataFrame([("a", 5), ("b", 30), ("c", 40), ("d", 90)], "label string, cnt long")
    assert [r.label for r in labels_by_threshold(dist, 20, 1).orderBy("rank").collect()] == ["b", "c"]
    got = {r.label: r.quota for r in quota(dist, 100).collect()}
    assert got == {"a": 3, "b": 18, "c": 24, "d": 54}


def test_best_match_prefers_the_longest_below_95(spark):
    rows = [("s", "X", "1", 92), ("s", "Longer name", "2", 90), ("t", "Y", "1", 95), ("t", "Longer name", "2", 94)]
    scored = spark.createDataFrame(rows, "label string, name string, ord string, score int")
    assert {(r.src, r.dst) for r in harmonise.best_match(scored).collect()} == {("s", "Longer name"), ("t", "Y")}


def test_label_scoring_leaves_out_no_good_pair(spark):
    from paperweave.functions.similarity import weighted_score

    labels = ["physics all", "computer vision", "general economics", "bio", "art", "material science", "a b c"]
    names = ["Physics", "Computer Vision and Robotics", "Economics", "Biology", "Arts", "Materials Science", "C B A", "Vision Computer"]
    left = spark.createDataFrame([(x,) for x in labels], "label string")
    right = spark.createDataFrame([(n, f"{i:02}") for i, n in enumerate(names)], "name string, ord string")
    got = {(r.label, r.name) for r in harmonise.score_labels(left, right, top=50).collect() if r.score >= 90}
    assert got == {(x, n) for x in labels for n in names if weighted_score(x, n) >= 90}
    assert got


def test_confusion_cells(spark):
    df = spark.createDataFrame([(1, ["1", "2"], "2"), (2, ["1"], "0")], "id long, labels array<string>, pred string")
    assert {(r.truth, r.pred, r.cnt) for r in metrics.confusion(df).collect()} == {("2", "2", 1), ("1", "0", 1)}


def test_rate_window(spark):
    rows = [(1, "u", "2024-01-01 00:00:00"), (2, "u", "2024-01-01 00:04:00"), (3, "u", "2024-01-01 00:06:00"), (4, "u", "2024-01-01 00:11:00")]
    df = spark.createDataFrame(rows, "id int, key string, t string").withColumn("ts", F.to_timestamp("t"))
    for width in (300, 3600):
        got = {r.id: r.in_span for r in rate_window(df, "key", slice_seconds=width).collect()}
        assert got == {1: 1, 2: 2, 3: 2, 4: 2}


def test_drop_known_doi_keeps_nulls(spark):
    new = spark.createDataFrame([(1, None), (2, "d"), (3, "e")], "id int, doi string")
    corpus = spark.createDataFrame([(None,), ("d",)], "doi string")
    assert sorted(r.id for r in joins.drop_known_doi(new, corpus).collect()) == [1, 3]


def test_read_triples(spark, tmp_path):
    lines = [
        '<http://t/s> <http://t/p> "a \\"b\\" \\u00e9\\n" .',
        '<http://t/s> <http://t/p> "two"@en .',
        '<http://t/s> <http://t/q> <http://t/o> . # note',
        "_:b1 <http://t/q> _:b2 .",
        "# only a comment",
    ]
    (tmp_path / "x.nt").write_text("\n".join(lines))
    got = [tuple(r) for r in readers.read_triples(spark, str(tmp_path)).collect()]
    assert got == [
        ("http://t/s", "http://t/p", 'a "b" é\n', True),
        ("http://t/s", "http://t/p", "two", True),
        ("http://t/s", "http://t/q", "http://t/o", False),
        ("_:b1", "http://t/q", "_:b2", False),
    ]


def test_triples_with_odd_literals(spark, tmp_path):
    long = r'abc \\ \" ' * 130_000
    lines = [
        f'<s> <p> "{long}" .',
        '<s> <p> "a\tb" .',
        r'<s> <p> "x \U0001F600 \\U0001F600 \U00000041é" .',
        "<s> <p> no statement .",
        '<s> <p> "open .',
        "",
    ]
    (tmp_path / "x.nt").write_text("\n".join(lines))
    got = [r.object for r in readers.read_triples(spark, str(tmp_path)).collect()]
    assert got == ['abc \\ " ' * 130_000, "a\tb", "x \U0001F600 \\U0001F600 Aé"]
    assert sorted(r.line for r in readers.unparsed_triples(spark, str(tmp_path)).collect()) == sorted(lines[3:5])


def test_all_authors_of_a_page(spark):
    html = "".join(f'<span data-selenium-selector="author-list">A{n},</span>' for n in range(6))
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert len(readers.extract_page_metadata(pages).first().author) == 4
    assert readers.extract_page_metadata(pages, most_authors=None).first().author == [f"A{n}" for n in range(6)]


def test_subject_label_stands_in_for_a_title(spark):
    rows = [("s1", "P26", "10.1/1", True, "Name 1"), ("s2", "rdf-schema#label", "Own", True, "Name 2")]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string, object_is_literal boolean, subject_label string")
    papers = triples.select(F.col("subject").alias("paper"))
    wide = statements_by_subject(triples, papers)
    got = {r.paper: (r.t, r.d) for r in wide.select("paper", scalar_view(F.col("title")).alias("t"), scalar_view(F.col("doi")).alias("d")).collect()}
    assert got == {"s1": ("Name 1", "10.1/1"), "s2": ("Own", "")}


def test_page_fields_default_places(spark):
    html = (
        '<h1 data-x="1">A <i>title</i></h1><a class="doi__link" href="#">10.1/9</a>'
        '<span class="abstract__text">Text.</span><span data-heap-id="paper-meta-journal">Venue</span>'
        '<li class="paper-meta-item">Biology</li><li class="paper-meta-item">Nothing</li><li class="paper-meta-item">Physics</li>'
        '<span data-selenium-selector="paper-year">2020</span>'
        + "".join(f'<span data-selenium-selector="author-list">A. B{i},</span>' for i in range(6))
    )
    row = readers.extract_page_metadata(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row.title, row.doi, row.abstract, row.publisher, row.research_field, row.year) == (
        "A title", "10.1/9", "Text.", "Venue", "Physics", "2020",
    )
    assert row.author == ["A. B0", "A. B1", "A. B2", "A. B3"]


def test_pipeline_stages_give_the_long_form_weights(spark):
    rows = [(1, "Deep networks of deep graphs"), (2, "Graph theory and networks"), (3, ""), (4, "Random graph")]
    df = spark.createDataFrame(rows, "id long, text string")
    model = features.tfidf_pipeline("text").fit(df)
    vocabulary = model.stages[2].vocabulary
    stages = {}
    for r in model.transform(df).select("id", vector_to_array("features").alias("v")).collect():
        stages.update({(r.id, vocabulary[i]): w for i, w in enumerate(r.v) if w})
    from paperweave.functions import text

    words = df.select("id", text.tokens("text").alias("w")).select("id", text.terms("w").alias("tokens"))
    long = {(r.id, r.term): r.weight for r in features.tfidf(words, "id").collect()}
    assert stages.keys() == long.keys()
    assert all(abs(stages[k] - long[k]) < 1e-9 for k in long)


def test_embedding_query_fits_no_vocabulary(spark, monkeypatch):
    from check_oracles import DATA

    from paperweave.catalog import QUERIES

    def refused(*_):
        raise AssertionError("a vocabulary on the driver")

    monkeypatch.setattr(features.CountVectorizer, "fit", refused)
    rows = QUERIES["embedding_by_name"](spark, f"{DATA}/sf0.001")
    assert rows.columns == ["doc_id", "term", "weight"] and rows.count() > 0


def test_unknown_embedding_is_refused():
    with pytest.raises(ValueError, match="unknown embedding"):
        features.embedding("word2vec")


def test_sentence_stage(spark):
    df = spark.createDataFrame([("First sentence. Second one here. No",)], "text string")
    row = features.embedding("sentence", experiment="title_abstract").fit(df).transform(df).first()
    assert row.features.size == 5120 and row.features.numNonzeros() >= 4


def _linear_rows(spark):
    """Texts of three labels, some with two labels, some without words or without a label."""
    rng = random.Random(1)
    rows = []
    for i in range(300):
        label = rng.choice("abc")
        shared = ["q" + chr(98 + k % 20) + chr(98 + k // 20) for k in range(40)]
        words = " ".join(rng.choice(shared + [label * 2 + chr(98 + k) for k in range(6)]) for _ in range(rng.randrange(15)))
        rows += [(i, words, x) for x in {label, rng.choice("abc") if i % 10 == 0 else label}]
    return spark.createDataFrame([*rows, (900, "qbb", None)], "id long, text string, label string")


def test_linear_blocks_and_label_chunks_agree(spark, monkeypatch):
    """Many small blocks, and labels one at a time, come to the weights' loss of one block that holds everything."""
    rows = _linear_rows(spark)
    whole = linear.train_text(rows, "id", bigrams=False, alpha=1e-3)
    monkeypatch.setattr(linear, "BLOCK_TERMS", 800)
    blocks = linear.train_text(rows, "id", bigrams=False, alpha=1e-3)
    assert whole.steps == 0 and blocks.steps > 0 and whole.labels == blocks.labels == ["a", "b", "c"]
    assert max(abs(a - b) for a, b in zip(whole.loss, blocks.loss)) < 1e-5
    monkeypatch.setattr(linear, "BLOCK_TERMS", 4_000_000)
    monkeypatch.setattr(linear, "LABELS_AT_ONCE", 2)
    chunks = linear.train_text(rows, "id", bigrams=False, alpha=1e-3)
    own = {r.term: r.ws for r in whole.terms.collect()}
    assert {r.term for r in chunks.terms.collect()} == set(own)
    # the constants of labels fitted apart may stop a step apart, so losses are compared
    assert max(abs(a - b) for a, b in zip(whole.loss, chunks.loss)) < 1e-5


def test_linear_blocks_need_few_passes(spark, monkeypatch):
    """With hardly any ridge the common fit of several blocks is done within a few passes over the terms."""
    rows = _linear_rows(spark)
    monkeypatch.setattr(linear, "BLOCK_TERMS", 2500)
    blocks = linear.train_text(rows, "id", bigrams=False)
    monkeypatch.setattr(linear, "BLOCK_TERMS", 4_000_000)
    whole = linear.train_text(rows, "id", bigrams=False)
    assert whole.steps == 0 < blocks.steps <= 40
    assert all(b < a + 1e-4 for a, b in zip(whole.loss, blocks.loss))


def test_linear_scores_and_edges(spark, tmp_path):
    rows = _linear_rows(spark)
    model = linear.train_text(rows, "id", bigrams=False, alpha=1e-3)
    linear.save_linear(model, str(tmp_path / "model"))
    again = linear.load_linear(spark, str(tmp_path / "model"))
    new = spark.createDataFrame([(1, None), (2, ""), (3, "zzz unknown"), (4, "aab aac"), (4, "aab aac"), (5, "bbb qbb")], "id long, text string")
    got = {r.id: r.margins for r in linear.margins(again, new.dropDuplicates(["id"]), "text", ["id"]).collect()}
    assert got[1] == got[2] == got[3] == pytest.approx(model.constants)
    assert max(range(3), key=got[4].__getitem__) == 0 and max(range(3), key=got[5].__getitem__) == 1
    spread = {r.id: r.margins for r in linear.margins(again, new.dropDuplicates(["id"]), "text", ["id"], hot_rows=3).collect()}
    assert all(spread[i] == pytest.approx(got[i]) for i in got)
    assert linear.predict_text(model, new.limit(0), "text", ["id"]).count() == 0
    with pytest.raises(ValueError):
        linear.train_text(rows.filter("label = 'no such'"), "id")


def test_lookup_join_deals_null_keys(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 50).alias("k"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = joins.lookup_join(left, right.hint("shuffle_hash"), "k", salt="id", hot_rows=1000)
    assert joined.count() == 20_000 and joined.filter("v IS NOT NULL").count() == 2000
    placed = left.withColumn("place", F.xxhash64("id")).filter("k IS NULL").select("k", F.pmod("place", F.lit(joins.NULL_PARTS)).cast("int").alias("part"))
    sizes = [r["count"] for r in placed.repartition(16, "k", "part").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_unpublished_run_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no published run"):
        experiment.read_run(spark, str(tmp_path / "nothing"))


def test_trailing_stream_over_batches(spark, tmp_path):
    """Files arrive one by one, some rows too late: what the stream gives out agrees with the table without those."""
    rng = random.Random(2)
    rows = sorted((f"2024-01-01 {n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}", rng.choice("uv")) for n in (rng.randrange(4 * 3600) for _ in range(600)))
    source = tmp_path / "events"
    source.mkdir()
    for k in range(4):
        part = rows[150 * k : 150 * (k + 1)] + ([("2024-01-01 00:00:01", "u")] if k == 3 else [])
        (source / f"{k}.json").write_text("\n".join(f'{{"t": "{t}", "key": "{key}"}}' for t, key in part))
    stream = spark.readStream.schema("t string, key string").option("maxFilesPerTrigger", 1).json(str(source)).withColumn("ts", F.to_timestamp("t"))
    counted = rate.trailing_stream(stream.select("key", "ts"), "key", limit=3, late="1 minute")
    job = counted.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    job.awaitTermination()
    events = spark.createDataFrame(rows, "t string, key string").select("key", F.to_timestamp("t").alias("ts"))
    closed = spark.read.parquet(str(tmp_path / "out"))
    expected = sorted(tuple(r) for r in rate.rate_window(events, "key", limit=3).select("key", "ts", "in_span", "over_limit").collect())
    got = sorted(tuple(r) for r in closed.select("key", "ts", "in_span", "over_limit").collect())
    assert len(got) > 0.9 * len(rows) and set(got) <= set(expected)
    whole = rate.with_open_requests(closed, events, "key", limit=3).select("key", "ts", "in_span", "over_limit")
    assert sorted(tuple(r) for r in whole.collect()) == expected


@pytest.mark.parametrize("weighted", [True, False])
def test_top_of_block_is_brute_force_with_fewer_scores(weighted):
    rng = random.Random(11)
    words = ["science", "computer", "of", "bio", "biology", "physics", "applied", "x", "graph", "äöü", "comp-sci", "sci", "the"]
    draw = lambda: rng.choice([" ", "  ", "-"]).join(rng.choice(words) for _ in range(rng.randrange(6)))
    names, labels = sorted({draw() for _ in range(300)}), sorted({draw() for _ in range(100)})
    order = rng.sample(range(len(names)), len(names))
    got, tried = harmonise.top_of_block(labels, names, order, 5, weighted)
    scorer = weighted_score if weighted else score
    expected = []
    for label in labels:
        scored = sorted((-scorer(label, n), o, n) for n, o in zip(names, order))
        expected += [(label, n, o, -s) for s, o, n in scored[:5]]
    assert sorted(got) == sorted(expected) and tried < 0.6 * len(labels) * len(names)


def test_score_labels_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(harmonise, "NAMES_AT_ONCE", 7)
    monkeypatch.setattr(harmonise, "LABELS_AT_ONCE", 5)
    names = [f"name {chr(97 + n % 26)}{n}" for n in range(40)]
    labels = [f"name {chr(97 + n)}" for n in range(17)]
    left = spark.createDataFrame([(x,) for x in labels], "label string")
    right = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, ord long")
    got = sorted(tuple(r) for r in harmonise.score_labels(left, right, least=0).collect())
    expected = [(x, n, k, -s) for x in labels for s, k, n in sorted((-weighted_score(x, n), k, n) for k, n in enumerate(names))[:5]]
    assert got == sorted(expected)
    assert harmonise.score_labels(left.limit(0), right, least=0).count() == harmonise.score_labels(left, right.limit(0), least=0).count() == 0


def test_author_is_asked_only_where_it_decides(spark):
    """The verdict agrees with that of the whole score for every mix of titles, authors and dois."""
    rows = [
        (t, "Some Title", a, f, d, g)
        for t in ("some title", "another thing entirely") for a, f in (("['Ann Bee']", ["Ann Bee"]), ("['Ann Bee']", ["Zoe Quux"]), (None, None))
        for d, g in (("10.1/7", "10.1/7"), ("10.1/7", "10.9/1234"), ("", None))
    ]
    df = spark.createDataFrame(rows, "title string, t string, author string, a array<string>, doi string, d string")
    df = df.withColumn("match", F.struct(F.col("t").alias("title"), F.col("a").alias("authors"), F.col("d").alias("doi")))
    keys = ["title", "author", "a", "doi", "d"]
    whole = sorted((tuple(map(str, r[:5])), r.valid) for r in matching.validate_match(df).select(*keys, "valid").collect())
    less = sorted((tuple(map(str, r[:5])), r.valid) for r in matching.validate_match(df, whole=False).select(*keys, "valid").collect())
    assert whole == less and {v for _, v in whole} == {True, False}


def test_hashed_vectors_keep_their_width_in_no_task(spark, tmp_path, monkeypatch):
    """Weights as from the dense stages, unseen places included; no stage as wide as the vectors is fitted, and a saved model goes on."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, Normalizer

    from paperweave.sinks.writers import load_model, save_model

    rows = spark.createDataFrame([(1, "red apple red"), (2, ""), (3, "green apple pie"), (3, "green apple pie"), (4, None)], "id int, text string")
    other = spark.createDataFrame([(5, "red unseen pie"), (6, "")], "id int, text string")
    terms = 8 * 8  # apple, green, pie, red and four pairs of them
    width = 1 << (terms - 1).bit_length()
    dense = Pipeline(
        stages=[
            *features.text_stages(), HashingTF(inputCol=features.TERMS, outputCol="_counts", numFeatures=width),
            features.SmoothedIdf("_counts", "_weighted"), Normalizer(inputCol="_weighted", outputCol="features", p=2.0),
        ]
    ).fit(rows.na.fill(""))
    expected = [sorted((r["id"], [round(x, 9) for x in r["features"].toArray()]) for r in dense.transform(d).collect()) for d in (rows.na.fill(""), other)]

    def refuse(*_args, **_kwargs):
        raise AssertionError("a stage as wide as the vectors")

    monkeypatch.setattr(features.SmoothedIdf, "_fit", refuse)
    model = features.embedding("tfidf hashed").fit(rows.na.fill(""))
    save_model(model, str(tmp_path / "m"))
    for m in (model, load_model(str(tmp_path / "m"))):
        got = [sorted((r["id"], [round(x, 9) for x in r["features"].toArray()]) for r in m.transform(d).collect()) for d in (rows.na.fill(""), other)]
        assert got == expected


def test_sentence_vectors_leave_in_slices(spark):
    """No call encodes more texts than the bound on numbers allows, and every slot is as before."""
    most = features.VECTOR_NUMBERS // features.SENTENCE_DIM

    def encode(texts):
        if len(texts) > most:
            raise ValueError(f"{len(texts)} sentences at once")
        return features.hashed_words(texts)

    rows = spark.range(1500, numPartitions=1).select("id", F.concat(F.lit("one two. three four five."), F.repeat(F.lit(" and so on."), (F.col("id") % 9).cast("int"))).alias("text"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    got = features.sentence_vectors(rows, "text", 10, encode=encode).select("id", F.size("vector").alias("n"), total.alias("words")).collect()
    assert len(got) == 1500 and all(r["n"] == 5120 and r["words"] == 5 + 3 * (r["id"] % 9) for r in got)


def test_window_score_steps_over_pieces(monkeypatch):
    """The best of all windows, as brute force has it, with far fewer than all of them looked at."""
    draw = random.Random(7)
    for _ in range(500):
        a, b = ("".join(draw.choice("ab cd") for _ in range(draw.randrange(1, n))) for n in (9, 40))
        a, b = sorted((a, b), key=len)
        assert similarity._window_score(b, a) == max(score(a, b[k : k + len(a)]) for k in range(len(b) - len(a) + 1))
    monkeypatch.setattr(similarity, "score", None)  # pieces are not scored one by one
    assert similarity._window_score("abcd", "x" * 50 + "abxcd" + "y" * 50) == 75


def test_block_with_numbered_terms():
    """Terms of a block are numbered once; loss and slope come from the numbers as from the terms themselves."""
    rows = pd.DataFrame({"block": 0, "labels": [[0], [1, 2], [2, 2]], "terms": [["qb", "qc"], [], ["qc", "qd"]], "ws": [[0.6, 0.8], [], [1.0, 0.5]]})
    encoded = linear._encoded(rows)
    own = encoded[encoded["at"] >= 0]
    assert own["term"].to_list() == ["qb", "qc", "qd", linear.CONSTANT] and encoded["place"].notna().sum() == 1
    block = linear._Block(encoded[encoded["at"] < 0], own.sample(frac=1, random_state=3), 1, 2)
    weights = np.array([[0.1, -0.4], [0.2, 0.3], [-0.5, 0.7], [0.05, -0.1]])
    x = np.array([[0.6, 0.8, 0, 1], [0, 0, 0, 1], [0, 1.0, 0.5, 1]])
    hits, copies = np.array([[0, 0], [1, 1], [0, 2.0]]), np.array([[1.0], [2], [2]])
    m = x @ weights
    loss, slope = block.loss_and_slope(weights)
    assert loss == pytest.approx((copies * np.log1p(np.exp(m)) - hits * m).sum(axis=0))
    assert slope == pytest.approx(x.T @ (copies / (1 + np.exp(-m)) - hits))


def test_stream_reads_a_table_of_one_file_or_many(spark, tmp_path):
    """A table stored as a folder of files gives the stream the same rows as one stored as a single file."""
    from check_oracles import DATA

    from paperweave.catalog import learning
    from paperweave.catalog.tables import Tables

    one = Tables(spark, f"{DATA}/sf0.001")
    one.events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    counts = [learning._run(t, learning._stream(t, "events").select("event_id"), "streamed").count() for t in (one, Tables(spark, str(tmp_path)))]
    assert counts[0] == counts[1] == one.events.count() > 0


def test_experiment_query_runs_both_text_forms(spark, monkeypatch):
    from paperweave.catalog import learning
    from paperweave.catalog.tables import Tables

    asked = []

    def run(corpus, mapping, experiment, key, **options):
        asked.append((experiment, options["embedder"]))
        return experiment_result(spark.createDataFrame([(0.1 * len(asked),)], "f1 double"))

    def experiment_result(scores):
        return experiment.Result(None, None, scores, None, None)

    monkeypatch.setattr(experiment, "run_experiment", run)
    from check_oracles import DATA

    rows = learning.run_experiment(Tables(spark, f"{DATA}/sf0.001")).collect()
    assert asked == [("title", "tfidf"), ("title_abstract", "tfidf")]
    assert [(r["experiment"], r["f1"]) for r in rows] == [("title", 0.1), ("title_abstract", 0.2)]


def test_tfidf_in_small_parts_sends_no_term_per_row(spark, monkeypatch):
    """Weights as by hand over many parts and shards, for null, empty and repeated rows; no exchange holds a row's terms."""
    import math

    from paperweave.operators import parts

    monkeypatch.setattr(parts, "PART_TERMS", 7)
    monkeypatch.setattr(parts, "SHARD_NAMES", 5)
    draw = random.Random(5)
    texts = {k: [draw.choice("abcdefgh") + "x" for _ in range(draw.randrange(6))] for k in range(40)}
    rows = [*((k, t, k % 4 > 0) for k, t in texts.items()), (50, None, True), (51, ["only", "ax"], None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, fit boolean").repartition(3)
    fitted = [set(t or []) for _, t, fit in rows if fit]
    idf = {x: math.log((1 + len(fitted)) / (1 + n)) + 1 for x in {x for t in fitted for x in t} if (n := sum(x in t for t in fitted))}
    expected = {}
    for k, t, _ in rows:
        own = {x: t.count(x) * idf[x] for x in t or [] if x in idf}
        expected.update({(k, x): w / math.sqrt(sum(v * v for v in own.values())) for x, w in own.items()})
    weights = features.tfidf(df, "id", fit=F.col("fit"))
    assert {(r.id, r.term): r.weight for r in weights.collect()} == pytest.approx(expected)
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    # rows that share a key, also a null one, have the length one together
    twice = df.filter("id < 20").withColumn("id", F.when(F.col("id") > 1, F.col("id") % 5))
    lengths = features.tfidf(twice, "id").groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert {r.id for r in lengths} == {None, 0, 1, 2, 3, 4} and all(abs(r.s - 1) < 1e-9 for r in lengths)
    assert features.tfidf(df.limit(0), "id").count() == 0


def _noise_block():
    """A block of 200 rows with random terms, very frequent to single ones, and labels that do not follow from them."""
    rng = np.random.default_rng(4)
    place = [np.unique(np.minimum(rng.zipf(1.3, 30), 400) - 1) for _ in range(200)]
    used, flat = np.unique(np.concatenate(place), return_inverse=True)
    arrays = {
        "a": np.array([len(p) for p in place], np.int32), "b": flat.astype(np.int32), "c": rng.integers(1, 4, len(flat)).astype(np.int32),
        "d": np.stack([np.arange(200), rng.integers(0, 2, 200)], axis=1).astype(np.int32), "e": np.full(200, 0.1),
    }
    terms = {"a": used.astype(np.int64), "b": np.linspace(1, 3, len(used)), "c": np.bincount(flat).astype(np.int32)}
    records = [{"kind": linear.ROWS, "first": 0, "block": 7, **{k: v.tobytes() for k, v in arrays.items()}}]
    records.append({"kind": linear.NAMES, "first": 0, "block": 7, **{k: v.tobytes() for k, v in terms.items()}})
    x = np.zeros((200, len(used)))
    np.add.at(x, (np.repeat(np.arange(200), arrays["a"]), flat), arrays["c"] * terms["b"][flat] * 0.1)
    return records, x, arrays["d"][:, 1]


def test_block_sums_and_a_fit_of_noise_in_few_steps(monkeypatch):
    """Sums by row and term as from the matrix; where labels are noise a fit is at the loss's optimum within few evaluations."""
    records, x, labels = _noise_block()
    monkeypatch.setattr(linear, "ENTRIES_AT_ONCE", 50)
    monkeypatch.setattr(linear, "BY_TERM_AT_ONCE", 70)
    block = linear._Block([dict(r) for r in records])
    rng = np.random.default_rng(1)
    weights, factors = rng.normal(size=(x.shape[1], 3)), rng.normal(size=(200, 3))
    assert block.by_row(weights) == pytest.approx(x @ weights) and block.by_term(factors) == pytest.approx(x.T @ factors)
    assert block.by_term(factors, square=True) == pytest.approx((x * x).T @ factors)
    called = []
    by_row = block.by_row
    block.by_row = lambda w: called.append(1) or by_row(w)
    w, b, loss = linear._fit_label(block, 1, 1e-4, 1000, 1e-6)
    hits = (labels == 1).astype(float)
    m = x @ w + b
    miss = (1 / (1 + np.exp(-m)) - hits) / 200
    assert loss == pytest.approx((np.logaddexp(0, m) - hits * m).mean() + 0.5e-4 * w @ w)
    assert max(np.abs(x.T @ miss + 1e-4 * w).max(), abs(miss.sum())) < 1e-4
    assert len(called) < 100


def test_no_exchange_holds_the_terms_of_a_scored_row(spark):
    """Scoring joins the names of a part with the model, so what is exchanged is one row of sums per text."""
    rows = _linear_rows(spark)
    model = linear.train_text(rows, "id", bigrams=False, alpha=1e-3)
    plan = linear.margins(model, rows.dropDuplicates(["id"]), "text", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "MergeJoin" not in plan and "HashJoin" not in plan and plan.count("Exchange hashpartitioning") <= 1
    # a repeated row counts as one, as its sums meet
    twice = linear.margins(model, rows.filter("id = 3").select("id", "text"), "text", ["id"]).collect()
    assert [r.id for r in twice] == [3]


def test_prior_rows_meet_the_papers_once(spark):
    """Updated papers and the ids without a row read one written table, so no join is done for each of them again."""
    papers = spark.createDataFrame([(1, "10.1/1", "a"), (2, "", "b"), (3, None, "c")], "paper_id long, doi string, title string")
    prior = spark.createDataFrame([(7, "10.1/1", "x"), (8, "10.1/8", "b")], "ord long, doi string, title string")
    updated, todo = joins.update_from(papers, prior, ["doi", "title"])
    assert sorted(map(tuple, updated.collect())) == [(1, "10.1/1", "x"), (2, "10.1/8", "b"), (3, None, "c")]
    assert [r.paper_id for r in todo.collect()] == [3]
    for df in (updated, todo):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_fit_makes_the_terms_once(spark):
    """The width, the frequencies and the number of rows come from terms that are made once."""
    made = spark.sparkContext.accumulator(0)

    def terms(text):
        made.add(1)
        return text.split()

    rows = spark.createDataFrame([("a b",), ("b c",), ("c",)], "text string").select(F.udf(terms, "array<string>")("text").alias("t"))
    model = features.HashedTfidf("t", "features").fit(rows)
    assert model.n == 3 and model.width == 32 and made.value == 3
