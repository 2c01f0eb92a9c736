"""Queries over features, classifiers, experiments and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.catalog import sqltext as q
from paperweave.catalog.labels import _ADDED, _REDUCED
from paperweave.catalog.registry import query
from paperweave.constants import SGD_ALPHA, TUNE_ALPHA, TUNE_TOL, TUNE_TRIALS
from paperweave.functions import text
from paperweave.functions.hashing import hash_fraction, hash_order
from paperweave.operators import features as T
from paperweave.operators import learning as L
from paperweave.operators import linear as N
from paperweave.operators.metrics import macro_scores
from paperweave.operators.nested import explode_labels
from paperweave.plans import experiment as E
from paperweave.session import landed, work_path
from paperweave.sinks.writers import load_model, save_model
from paperweave.streaming.rate import rate_stream, trailing_stream, with_open_requests, with_open_windows
from paperweave.streaming.scoring import write_scores

_TRAIN = f"{q.fraction(q.digest(100, 'doc_id'))} < 0.7"
_UNIGRAMS = f"words AS (SELECT doc_id, {q.tokens('text')} AS tokens FROM documents)"
_TERMS = f"base AS (SELECT doc_id, {q.unigrams(q.tokens('text'))} AS u FROM documents), words AS (SELECT doc_id, {q.with_bigrams('u')} AS tokens FROM base)"
_COUNTED = """
    each AS (SELECT doc_id, unnest(tokens) AS term FROM words),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM each GROUP BY ALL),
"""
_SUMMARY = """
    weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM weighted WHERE w > 0)
    SELECT doc_id, count(*) AS n_terms, round(sum(weight), 5) AS total, round(max(weight), 5) AS top FROM weights GROUP BY doc_id
"""


def _in_train(key: str = "doc_id"):
    return hash_fraction(hash_order(100, F.col(key))) < 0.7


def _tokens(t, bigrams: bool) -> DataFrame:
    words = t.documents.select("doc_id", text.tokens("text").alias("tokens"))
    return words.select("doc_id", text.terms("tokens").alias("tokens")) if bigrams else words


def _summary(weights: DataFrame) -> DataFrame:
    return weights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 5).alias("top")
    )


@query("document_frequency", f"WITH {_UNIGRAMS}, {_COUNTED} df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT * FROM df")
def document_frequency(t) -> DataFrame:
    return T.document_frequency(_tokens(t, False))


@query(
    "tfidf",
    f"""
    WITH {_TERMS}, {_COUNTED}
    df AS (SELECT term, count(*) AS df FROM tf WHERE {_TRAIN} GROUP BY term), n AS (SELECT count(*) AS n FROM documents WHERE {_TRAIN}),
    weighted AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0)::DOUBLE AS w FROM tf JOIN df USING (term), n), {_SUMMARY}
    """,
)
def tfidf(t) -> DataFrame:
    return _summary(T.tfidf(_tokens(t, True), "doc_id", fit=_in_train()))


@query(
    "tfidf_log2",
    f"""
    WITH {_UNIGRAMS}, {_COUNTED}
    df AS (SELECT term, count(*) AS df FROM tf WHERE {_TRAIN} GROUP BY term), n AS (SELECT count(*) AS n FROM documents WHERE {_TRAIN}),
    weighted AS (SELECT doc_id, term, tf * log2(n::DOUBLE / df)::DOUBLE AS w FROM tf JOIN df USING (term), n), {_SUMMARY}
    """,
)
def tfidf_log2(t) -> DataFrame:
    return _summary(T.tfidf_log2(_tokens(t, False), "doc_id", fit=_in_train()))


@query(
    "embedding_by_name",
    f"""
    WITH words AS (SELECT doc_id, {q.unigrams(q.tokens('text'))} AS tokens FROM documents), {_COUNTED} df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
    weighted AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0)::DOUBLE AS w FROM tf JOIN df USING (term), n)
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted
    """,
)
def embedding_by_name(t) -> DataFrame:
    """Every number of the "tfidf" vectors by its term, in long form: no list of the terms leaves Spark's tables."""
    words = t.documents.select("doc_id", text.tokens("text").alias("words"))
    weights = T.tfidf(words.select("doc_id", text.terms("words", bigrams=False).alias("tokens")), "doc_id")
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "embedding_width",
    f"WITH {_TERMS} SELECT (2 ** ceil(log2(8 * (SELECT count(DISTINCT term) FROM (SELECT unnest(tokens) AS term FROM words) t))))::BIGINT AS width, count(*) AS n FROM words WHERE len(tokens) > 0",
)
def embedding_width(t) -> DataFrame:
    """The hashed form follows the number of terms; every text with terms gets a vector of unit length."""
    rows = t.documents.select("doc_id", "text")
    parts = F.unwrap_udt("features")
    vectors = T.embedding("tfidf hashed").fit(rows).transform(rows).select(parts["size"].cast("bigint").alias("width"), parts["values"].alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.filter(F.abs(length - 1) < 1e-6).groupBy("width").agg(F.count(F.lit(1)).alias("n"))


_KEPT = "list_filter(string_split(text, '.'), lambda s: length(s) > 5)[1:10]"
_N_WORDS = f"len(list_filter(string_split_regex(s, '[{q.SPACE_CLASS}]+'), lambda w: w <> ''))"


@query("sentence_vectors", f"SELECT doc_id, 5120 AS n, list_resize(list_transform({_KEPT}, lambda s: {_N_WORDS}::BIGINT), 10, 0::BIGINT) AS words FROM documents")
def sentence_vectors(t) -> DataFrame:
    """Words per sentence slot: a sentence that is lost, moved or not padded shows."""
    vectors = T.sentence_vectors(t.documents.select("doc_id", "text"), "text", 10)
    slots = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.aggregate(F.slice("vector", i * 512 + 1, F.lit(512)), F.lit(0.0), lambda a, x: a + x.cast("double")).cast("bigint"))
    return vectors.select("doc_id", F.size("vector").cast("bigint").alias("n"), slots.alias("words"))


# Classifiers -----------------------------------------------------------------------------------------


def _vectors(t) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("label").cast("string").alias("label"), array_to_vector("embedding").alias("features"))


def _embedding_predictions(t) -> DataFrame:
    rows = _vectors(t)
    model = L.train_classifier(rows.filter(_in_train("vec_id")), Pipeline(stages=[]), "label")
    return L.predict(model, rows.filter(~_in_train("vec_id")), ["vec_id", "label"])


_IN_TRAIN = _TRAIN.replace("doc_id", "vec_id")


@query(
    "train_classifier",
    f"""
    SELECT label::VARCHAR AS label, (SELECT count(*) FROM embeddings WHERE {_IN_TRAIN}) AS n, count(*) AS positive, true AS optimal
    FROM embeddings WHERE {_IN_TRAIN} GROUP BY label
    """,
)
def train_classifier(t) -> DataFrame:
    """Per label: the slope of the training loss at the fitted weights vanishes, computed from the rows anew."""
    rows = _vectors(t).filter(_in_train("vec_id"))
    model = L.train_classifier(rows, Pipeline(stages=[]), "label")
    _, combined, names = model.stages
    fitted = [(name, [float(x) for x in m.coefficients.toArray()], float(m.intercept)) for name, m in zip(names.getLabels(), combined.models)]
    weights = t.spark.createDataFrame(fitted, "name string, w array<double>, b double")
    # one weight row per label, each against every row: labels x rows, as training itself
    each = rows.select(vector_to_array("features").alias("x"), "label").join(F.broadcast(weights), F.lit(True))
    margin = F.aggregate(F.zip_with("w", "x", lambda a, c: a * c), F.col("b"), lambda s, v: s + v)
    miss = 1 / (1 + F.exp(-margin)) - (F.col("label") == F.col("name")).cast("double")
    missed = each.select("name", "label", "w", miss.alias("miss"), F.posexplode(F.concat("x", F.array(F.lit(1.0)))).alias("k", "xk"))
    slope = missed.groupBy("name", "k").agg(
        F.avg(F.col("miss") * F.col("xk")).alias("g"), F.first(F.get("w", F.col("k"))).alias("wk"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == F.col("name")).alias("positive"),
    )
    steep = F.abs(F.col("g") + SGD_ALPHA * F.coalesce("wk", F.lit(0.0)))
    return slope.groupBy(F.col("name").alias("label")).agg(F.max("n").alias("n"), F.max("positive").alias("positive"), (F.max(steep) < 1e-3).alias("optimal"))


def _constants(model: N.LinearModel):
    return F.array(*[F.struct(F.lit(x).alias("name"), F.lit(float(c)).alias("b")) for x, c in zip(model.labels, model.constants)])


@query(
    "train_linear",
    """
    SELECT lang AS label, (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS n, count(*) AS positive, true AS optimal
    FROM documents WHERE lang IS NOT NULL GROUP BY lang
    """,
)
def train_linear(t) -> DataFrame:
    """Per label: no slope of the training loss at the weights' table, computed anew by joins, exceeds 1e-4."""
    rows = t.corpus.select("doc_id", F.col("title").alias("text"), F.col("lang").alias("label")).filter("label IS NOT NULL")
    model = N.train_text(rows, "doc_id")
    weights = T.tfidf(N.text_terms(rows, "text", True, ["doc_id"]), "doc_id", "_tokens")
    labels = F.array(*[F.lit(x) for x in model.labels])
    each = model.terms.select("term", F.explode(F.arrays_zip(labels.alias("name"), F.col("ws").alias("w"))).alias("x")).select("term", "x.*")
    part = weights.join(each, "term").groupBy("doc_id", "name").agg(F.sum(F.col("weight") * F.col("w")).alias("part"))
    # one constant per label: every row against the labels, as training itself
    whole = rows.select("*", F.inline(_constants(model))).join(part, ["doc_id", "name"], "left")
    margin = F.col("b") + F.coalesce("part", F.lit(0.0))
    missed = landed(whole.select("doc_id", "name", "label", (1 / (1 + F.exp(-margin)) - (F.col("label") == F.col("name")).cast("double")).alias("miss")), "missed")
    size = missed.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("name")).alias("positive"), F.abs(F.avg("miss")).alias("flat"))
    summed = weights.join(missed, "doc_id").groupBy("term", "name").agg(F.sum(F.col("weight") * F.col("miss")).alias("g"))
    slope = summed.join(each, ["term", "name"]).join(F.broadcast(size.select("name", "n")), "name")
    steep = slope.groupBy("name").agg(F.max(F.abs(F.col("g") / F.col("n") + SGD_ALPHA * F.col("w"))).alias("steep"))
    return size.join(steep, "name").select(F.col("name").alias("label"), "n", "positive", (F.greatest("steep", "flat") < 1e-4).alias("optimal"))


@query("linear_scores", "SELECT count(*) AS n, count(*) AS n_equal FROM documents")
def linear_scores(t) -> DataFrame:
    """A stored and reloaded model gives every paper the label that its exported weights give by a join per term and label."""
    rows = t.corpus.select("doc_id", F.col("title").alias("text"), F.col("lang").alias("label"))
    path = work_path(t.spark, "linear")
    N.save_linear(N.train_text(rows, "doc_id", bigrams=False), path)
    model = N.load_linear(t.spark, path)
    got = N.predict_text(model, rows, "text", ["doc_id"])
    labels = F.array(*[F.lit(x) for x in model.labels])
    each = model.terms.select("term", "idf", F.explode(F.arrays_zip(labels.alias("name"), F.col("ws").alias("w"))).alias("x")).select("term", "idf", "x.*")
    counts = T.term_counts(N.text_terms(rows, "text", False, ["doc_id"]), "doc_id", "_tokens").join(each, "term")
    x = F.col("tf") * F.col("idf")
    part = counts.groupBy("doc_id", "name").agg((F.sum(x * F.col("w")) / F.sqrt(F.sum(x * x))).alias("part"))
    whole = rows.select("doc_id", F.inline(_constants(model))).join(part, ["doc_id", "name"], "left")
    margin = F.round(F.col("b") + F.coalesce("part", F.lit(0.0)), 9)
    best = whole.groupBy("doc_id").agg(F.collect_list(F.struct(margin.alias("m"), "name")).alias("all"), F.max(margin).alias("top"))
    winners = best.select("doc_id", F.filter("all", lambda x: x["m"] >= F.col("top") - 1e-8)["name"].alias("winners"))
    return winners.join(got, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("winners", F.col("pred"))).alias("n_equal"))


@query("predict_scores")
def predict_scores(t) -> DataFrame:
    rows = _embedding_predictions(t).select(F.col("vec_id").alias("id"), F.array("label").alias("labels"), "pred")
    return macro_scores(rows)


def _log_uniform(name: str, low: float, high: float, i: str) -> str:
    place = f"(({i}) + ('0x' || substr(md5('100:{name}:' || ({i})), 1, 8))::BIGINT / 4294967296.0) / {TUNE_TRIALS}"
    return f"ln({low!r}::DOUBLE) + (ln({high!r}::DOUBLE) - ln({low!r}::DOUBLE)) * {place}"


@query(
    "tune_classifier",
    f"""
    SELECT i::INT AS trial, round({_log_uniform("tol", *TUNE_TOL, "i")}, 6) AS log_tol,
        round({_log_uniform("alpha", *TUNE_ALPHA, f"{TUNE_TRIALS - 1} - i")}, 6) AS log_alpha, true AS is_share
    FROM range({TUNE_TRIALS}) t(i)
    """,
)
def tune_classifier(t) -> DataFrame:
    trials = L.tune(_vectors(t), Pipeline(stages=[]), "vec_id")[1]
    share = (F.col("accuracy") > 0) & (F.col("accuracy") <= 1)
    return trials.select("trial", F.round(F.log("tol"), 6).alias("log_tol"), F.round(F.log("alpha"), 6).alias("log_alpha"), share.alias("is_share"))


@query("label_numbers", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT unnest(labels) AS label FROM predictions) t", "predictions")
def label_numbers(t) -> DataFrame:
    return L.label_numbers(t.predictions)


def _text_models(t):
    """Title model and title and abstract model for the language of a paper, by the published settings."""
    rows = t.corpus.select(F.col("doc_id").alias("paper_id"), "title", "abstract", F.col("lang").alias("label"))
    models = []
    for form in ("title", "title_abstract"):
        train = rows.withColumn("text", text.paper_text(F.col("title"), F.col("abstract"), form))
        models.append(N.train_text(train, "paper_id", bigrams=False))
    return rows, models


def _mostly_right(t, scored: DataFrame) -> DataFrame:
    """Per language: its papers, each scored once, and whether four in five got their language."""
    known = t.documents.select(F.col("doc_id").alias("paper_id"), "lang")
    right = F.avg((F.col("label") == F.col("lang")).cast("double")) >= 0.8
    return known.join(scored, "paper_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), right.alias("mostly_right"))


_BY_LANGUAGE = "SELECT lang, count(*) AS n, true AS mostly_right FROM documents GROUP BY lang"


@query("batch_predict", _BY_LANGUAGE)
def batch_predict(t) -> DataFrame:
    rows, models = _text_models(t)
    return _mostly_right(t, N.batch_predict_text(rows.drop("label"), *models))


@query("save_and_load_model", "SELECT count(*) AS n, count(*) AS n_equal FROM embeddings")
def save_and_load_model(t) -> DataFrame:
    rows = _vectors(t)
    model = L.train_classifier(rows, Pipeline(stages=[]), "label")
    path = work_path(t.spark, "model")
    save_model(model, path)
    one = L.predict(model, rows, ["vec_id"])
    two = L.predict(load_model(path), rows, ["vec_id"]).withColumnRenamed("pred", "again")
    return one.join(two, "vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("again")).alias("n_equal"))


@query("run_experiment")
def run_experiment(t) -> DataFrame:
    """Scores of both text forms, a row each."""
    results = E.run_experiments(t.corpus, t.full_mapping, "doc_id", embedder="tfidf")
    scores = [result.scores.select(F.lit(name).alias("experiment"), "*") for name, result in results.items()]
    return reduce(DataFrame.unionByName, scores)


@query(
    "experiment_report",
    """
    SELECT trim(coalesce(dst, label)) AS label, sum(cnt)::BIGINT AS cnt, string_agg(label, ' ' ORDER BY label) AS codes, true AS in_range,
        (SELECT count(DISTINCT label) FROM (SELECT unnest(categories) AS label FROM corpus) t WHERE label IN (SELECT src FROM full_mapping)) AS in_distribution,
        'tfidf' AS embedder, 2 AS n_results
    FROM (SELECT label, count(*) AS cnt FROM (SELECT unnest(list_distinct(categories)) AS label FROM corpus) t GROUP BY label) d
    JOIN full_mapping ON label = src GROUP BY 1
    """,
    "corpus full_mapping",
)
def experiment_report(t) -> DataFrame:
    """Both text forms with all artefacts, read back: the field table, the stored distribution, scores and settings."""
    path = work_path(t.spark, "run")
    E.run_experiments(t.corpus, t.full_mapping, "doc_id", path=path, embedder="tfidf")
    run = E.read_run(t.spark, path)
    info = run["meta-info"].select(
        F.get_json_object("value", "$.setting.embedder").alias("embedder"), F.size(F.json_object_keys(F.get_json_object("value", "$.result"))).alias("n_results")
    )
    counts = run["distribution"].select(F.size(F.json_object_keys(F.get_json_object("value", "$.all"))).cast("bigint").alias("in_distribution"))
    ok = F.col("precision_title").between(0, 1) & F.col("precision_title_abstract").between(0, 1)
    codes = F.when(F.col("codes") == "-", F.col("label")).otherwise(F.col("codes"))
    table = run["field-table"].select("label", "cnt", codes.alias("codes"), ok.alias("in_range"))
    ((embedder, n_results),), ((in_distribution,),) = info.collect(), counts.collect()
    return table.select("*", F.lit(embedder).alias("embedder"), F.lit(n_results).alias("n_results"), F.lit(in_distribution).alias("in_distribution"))


_ON_SAMPLE = _ADDED.replace("FROM corpus WHERE", "FROM base WHERE")


@query(
    "build_corpus",
    f"""
    WITH {_REDUCED}, base AS (SELECT c.* FROM corpus c JOIN sample USING (doc_id)), {_ON_SAMPLE},
    moved AS (
        SELECT count(*) AS n FROM (
            SELECT categories FROM base UNION ALL SELECT [categories] FROM capped
        ) t WHERE len(list_filter(categories, lambda x: x NOT IN ('src3', 'long'))) = 0
    ),
    counted AS (
        SELECT label, quota AS cnt FROM quotas
        UNION ALL SELECT label, least(cnt, 10) FROM absent WHERE relevant
        UNION ALL SELECT 'nolabel', coalesce(sum(cnt), 0)::BIGINT FROM absent WHERE NOT relevant
        UNION ALL SELECT 'nolabel', n FROM moved
    )
    SELECT label, sum(cnt)::BIGINT AS cnt FROM counted WHERE label NOT IN ('src3', 'long') GROUP BY label
    """,
    "corpus new_papers full_mapping",
)
def build_corpus(t) -> DataFrame:
    base = t.corpus.select("doc_id", "title", "abstract", "doi", "categories")
    return E.build_corpus(base, t.new_papers, t.full_mapping, 400, 18, 15, 10, "doc_id", ["src3", "long"])[1]


@query("explode_training_labels", f"SELECT doc_id, CASE WHEN {_TRAIN} THEN label END AS label FROM (SELECT doc_id, unnest(CASE WHEN {_TRAIN} THEN categories ELSE ['x'] END) AS label FROM corpus) t", "corpus")
def explode_training_labels(t) -> DataFrame:
    rows = t.corpus.withColumn("split", F.when(_in_train(), "train").otherwise("test"))
    return explode_labels(rows, "categories").select("doc_id", "label")


# Streams ---------------------------------------------------------------------------------------------


def _stream(t, table: str) -> DataFrame:
    stored = t.spark.read.parquet(f"{t.sf_dir}/{table}.parquet")
    reader = t.spark.readStream.schema(stored.schema)
    # a stream watches a folder: that of the table's files, or the one that its only file lies in
    if all(f.endswith(f"/{table}.parquet") for f in stored.inputFiles()):
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)
    return reader.parquet(f"{t.sf_dir}/{table}.parquet")


def _run(t, stream: DataFrame, name: str) -> DataFrame:
    out = work_path(t.spark, name)
    job = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    job.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query(
    "rate_stream",
    """
    WITH w AS (
        SELECT event_type, (epoch_us(ts) // 60000000 - i) * 60 AS start
        FROM events, range(5) r(i)
    )
    SELECT start, event_type, count(*) AS in_span, count(*) >= 3 AS over_limit FROM w GROUP BY start, event_type
    """,
)
def rate_stream_query(t) -> DataFrame:
    events = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = _run(t, rate_stream(events, "event_type", limit=3), "rates")
    rows = with_open_windows(closed, t.events.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", limit=3)
    return rows.select(F.unix_seconds("start").alias("start"), "event_type", "in_span", "over_limit")


@query(
    "rate_trailing_stream",
    """
    SELECT event_type, epoch_us(ts) AS micros, count(*) OVER w AS in_span, count(*) OVER w >= 3 AS over_limit FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW)
    """,
)
def rate_trailing_stream(t) -> DataFrame:
    """The trailing count of every event, most of them given out by the stream itself."""
    events = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = _run(t, trailing_stream(events, "event_type", limit=3), "trailing")
    if closed.isEmpty():
        raise ValueError("the stream gave out nothing")
    rows = with_open_requests(closed, t.events.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", limit=3)
    return rows.select("event_type", F.unix_micros("ts").alias("micros"), "in_span", "over_limit")


@query("score_stream", _BY_LANGUAGE)
def score_stream_query(t) -> DataFrame:
    _, models = _text_models(t)
    title = F.regexp_extract("text", r"^[^.\n]*", 0)
    papers = _stream(t, "documents").withColumn("title", title).select(
        F.col("doc_id").alias("paper_id"), "title", F.substring(F.col("text"), F.length("title") + 1, F.length("text")).alias("abstract")
    )
    out = work_path(t.spark, "scored")
    write_scores(papers, *models, out, f"{out}-state").awaitTermination()
    return _mostly_right(t, t.spark.read.parquet(out).select("paper_id", "label"))
