"""Queries over label counts, samples, splits, the corpus and the instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.catalog import sqltext as q
from paperweave.catalog.registry import query
from paperweave.functions.hashing import hash_fraction, hash_order
from paperweave.functions.labels import label_string
from paperweave.operators import corpus as C
from paperweave.operators import distribution as D
from paperweave.operators import instances as I
from paperweave.operators import joins as J
from paperweave.operators import metrics as M
from paperweave.operators import sampling as S
from paperweave.plans import instances as plan

# Common tables of the checking SQL -------------------------------------------------------------------

_DIST = "dist AS (SELECT label, count(*) AS cnt FROM (SELECT DISTINCT doc_id, unnest(categories) AS label FROM corpus) t GROUP BY label)"
_RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, label) AS rank FROM dist)"


@query("label_distribution_multi", f"WITH {_DIST} SELECT label, cnt FROM dist WHERE label IN (SELECT src FROM full_mapping)", "corpus full_mapping")
def label_distribution_multi(t) -> DataFrame:
    return D.label_distribution_multi(t.corpus, t.full_mapping.select(F.col("src").alias("label")))


@query("label_distribution_single", "SELECT label, count(*) AS cnt FROM papers WHERE label <> 'Science' GROUP BY label", "papers")
def label_distribution_single(t) -> DataFrame:
    return D.label_distribution_single(t.papers, "label")


@query("value_counts", "SELECT label, count(*) AS cnt FROM papers GROUP BY label", "papers")
def value_counts(t) -> DataFrame:
    return D.value_counts(t.papers, "label")


@query("label_index", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT unnest(categories) AS label FROM corpus) t", "corpus")
def label_index(t) -> DataFrame:
    return D.label_index(t.corpus.select(F.explode("categories").alias("label")))


@query(
    "completeness_stats",
    """
    SELECT stage, count(*) AS num_papers, count(*) FILTER (doi = '') AS num_dois, count(*) FILTER (publisher = '') AS num_publisher,
           count(*) FILTER (url = '') AS num_urls, count(*) FILTER (label = 'Science') AS num_science_labels
    FROM (SELECT 'papers' AS stage, doi, publisher, url, label FROM papers
          UNION ALL SELECT 'prior', doi, publisher, url, label FROM prior) t GROUP BY stage
    """,
    "papers prior",
)
def completeness_stats(t) -> DataFrame:
    return D.completeness_stats(t.papers, "papers").unionByName(D.completeness_stats(t.prior, "prior"))


@query("label_quota", f"WITH {_DIST}, {_RANKED} SELECT label, cnt, floor(cnt::DOUBLE / (sum(cnt) OVER ())::DOUBLE * 200.0)::BIGINT AS quota FROM ranked WHERE rank <= 10", "corpus")
def label_quota(t) -> DataFrame:
    top = D.top_labels(D.label_distribution_multi(t.corpus), 10).filter("relevant")
    return D.quota(top, 200).select("label", "cnt", "quota")


@query("top_labels", f"WITH {_DIST}, {_RANKED} SELECT label, cnt, rank, rank <= 7 AS relevant FROM ranked", "corpus")
def top_labels(t) -> DataFrame:
    return D.top_labels(D.label_distribution_multi(t.corpus), 7)


@query("drop_rare", f"WITH {_DIST}, {_RANKED} SELECT doc_id FROM corpus WHERE NOT list_has_any(categories, (SELECT list(label) FROM ranked WHERE rank > 12))", "corpus")
def drop_rare(t) -> DataFrame:
    ranked = D.top_labels(D.label_distribution_multi(t.corpus), 12)
    return S.drop_rare(t.corpus, ranked.filter("NOT relevant"), "doc_id").select("doc_id")


@query(
    "labels_by_threshold",
    f"WITH {_DIST} SELECT * FROM (SELECT *, row_number() OVER (ORDER BY cnt, label) AS rank FROM dist WHERE cnt > 20) t WHERE rank <= 16",
    "corpus",
)
def labels_by_threshold(t) -> DataFrame:
    return D.labels_by_threshold(D.label_distribution_multi(t.corpus), 20, 15)


def _drawn(source: str, quotas: str) -> str:
    return f"""
    offered AS (SELECT DISTINCT doc_id, label FROM (SELECT doc_id, unnest(categories) AS label FROM {source}) t WHERE label IN (SELECT label FROM {quotas})),
    assigned AS (SELECT doc_id, arg_min(label, {q.digest(100, 'doc_id', 'label')}) AS drawn_for FROM offered GROUP BY doc_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY drawn_for ORDER BY {q.digest(100, 'doc_id')}) AS rn FROM assigned),
    sample AS (SELECT doc_id, drawn_for FROM placed JOIN {quotas} ON label = drawn_for WHERE rn <= quota)
    """


_QUOTAS = "quotas AS (SELECT label, floor(cnt::DOUBLE / (sum(cnt) OVER ())::DOUBLE * 300.0)::BIGINT AS quota FROM ranked WHERE rank <= 10)"


def _quotas(t) -> DataFrame:
    top = D.top_labels(D.label_distribution_multi(t.corpus), 10).filter("relevant")
    return D.quota(top, 300).select("label", "quota")


@query("sample_proportional", f"WITH {_DIST}, {_RANKED}, {_QUOTAS}, {_drawn('corpus', 'quotas')} SELECT * FROM sample", "corpus")
def sample_proportional(t) -> DataFrame:
    return S.sample_proportional(t.corpus, _quotas(t), "doc_id").select("doc_id", "drawn_for")


@query(
    "sample_shortfall",
    f"""
    WITH {_DIST}, {_RANKED}, {_QUOTAS}, {_drawn('corpus', 'quotas')}
    SELECT label, quota, coalesce(n, 0) AS drawn, quota - coalesce(n, 0) AS missing
    FROM quotas LEFT JOIN (SELECT drawn_for, count(*) AS n FROM sample GROUP BY drawn_for) s ON label = drawn_for
    """,
    "corpus",
)
def sample_shortfall(t) -> DataFrame:
    quotas = _quotas(t)
    return S.shortfall(S.sample_proportional(t.corpus, quotas, "doc_id"), quotas)


@query(
    "sample_capped",
    f"""
    SELECT doc_id, categories FROM (
        SELECT *, row_number() OVER (PARTITION BY categories ORDER BY {q.digest(100, 'doc_id')}) AS rn FROM new_papers WHERE categories <> 'Science'
    ) t WHERE rn <= 12
    """,
    "new_papers",
)
def sample_capped(t) -> DataFrame:
    wanted = D.label_distribution_single(t.new_papers)
    return S.sample_capped(t.new_papers, wanted, 12, "doc_id").select("doc_id", "categories")


@query("shuffle_rows", f"SELECT doc_id, {q.digest(100, 'doc_id')} AS place, text FROM documents")
def shuffle_rows(t) -> DataFrame:
    return S.shuffle(t.documents.select("doc_id", hash_order(100, F.col("doc_id")).alias("place"), "text"), "doc_id")


def _split_sql() -> str:
    seeds = range(100, 108)
    flags = ", ".join(f"{q.fraction(q.digest(s, 'doc_id'))} < 0.7 AS t{i}" for i, s in enumerate(seeds))
    covers = ", ".join(f"bool_and(c{i}) AS t{i}" for i in range(8))
    per = ", ".join(f"bool_or(t{i}) AS c{i}" for i in range(8))
    first = "CASE " + " ".join(f"WHEN t{i} THEN {i}" for i in range(8)) + " ELSE 0 END"
    pick = "CASE seed " + " ".join(f"WHEN {i} THEN t{i}" for i in range(8)) + " END"
    return f"""
    WITH flags AS (SELECT doc_id, categories, {flags} FROM corpus),
    per_label AS (SELECT label, {per} FROM (SELECT * EXCLUDE categories, unnest(categories) AS label FROM flags) t GROUP BY label),
    chosen AS (SELECT {first} AS seed FROM (SELECT {covers} FROM per_label) t),
    drawn AS (SELECT doc_id, categories, {pick} AS train FROM flags, chosen),
    forced AS (
        SELECT arg_min(doc_id, {q.digest(100, 'doc_id')}) AS doc_id FROM (SELECT doc_id, train, unnest(categories) AS label FROM drawn) t
        GROUP BY label HAVING NOT bool_or(train)
    )
    SELECT doc_id, CASE WHEN train OR doc_id IN (SELECT doc_id FROM forced) THEN 'train' ELSE 'test' END AS split FROM drawn
    """


@query("random_split", _split_sql(), "corpus")
def random_split(t) -> DataFrame:
    return S.random_split(t.corpus, 0.7, "doc_id", "categories").select("doc_id", "split")


_COUNTS = f"""
    base AS (
        SELECT label, cnt,
               CASE WHEN cnt = 1 OR (cnt <= 5 AND {q.fraction(q.digest(100, 'label'))} < 0.9) THEN cnt ELSE floor(cnt * 0.7::DOUBLE)::BIGINT END AS n,
               cnt * 0.7::DOUBLE - floor(cnt * 0.7::DOUBLE) AS rest, cnt > 50 AS freq
        FROM label_counts
    ),
    opened AS (SELECT floor(sum(cnt) * 0.7::DOUBLE)::BIGINT - sum(n)::BIGINT AS o, count(*) FILTER (freq) AS f FROM base),
    split_counts AS (
        SELECT label, cnt,
               CASE WHEN freq THEN n + sign(o) * (abs(o) // f + CASE WHEN rk <= abs(o) % f THEN 1 ELSE 0 END) ELSE n END::BIGINT AS n_train
        FROM (SELECT *, row_number() OVER (PARTITION BY freq ORDER BY rest DESC, label) AS rk FROM base) t, opened
    )
"""


@query("split_counts", f"WITH label_counts AS (SELECT label, count(*) AS cnt FROM papers GROUP BY label), {_COUNTS} SELECT * FROM split_counts", "papers")
def split_counts(t) -> DataFrame:
    return S.split_counts(t.papers.groupBy("label").agg(F.count(F.lit(1)).alias("cnt")), 0.7)


_PARTED = f"""
    parted AS (
        SELECT r.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {q.digest(100, 'paper_id')}) <= n_train THEN 'train' ELSE 'test' END AS split
        FROM training r JOIN split_counts USING (label)
    )
"""


@query(
    "stratified_split",
    f"WITH training AS (SELECT paper_id, label FROM papers), label_counts AS (SELECT label, count(*) AS cnt FROM papers GROUP BY label), {_COUNTS}, {_PARTED} SELECT paper_id, label, split FROM parted",
    "papers",
)
def stratified_split(t) -> DataFrame:
    return S.stratified_split(t.papers.select("paper_id", "label"), 0.7, "paper_id")


def _false(rows: str, percentage: float) -> str:
    """Common tables up to ``negatives``: the sampled wrong pairs of the table ``rows``."""
    other = "list_filter(names, lambda x: x <> label)"
    return f"""
    counted AS (SELECT label, count(*) AS cnt FROM {rows} GROUP BY label),
    totals AS (
        SELECT floor(sum(cnt) * {percentage}::DOUBLE)::BIGINT AS n, count(*) AS n_labels,
               coalesce(sum(cnt) FILTER (cnt > 20), 0)::BIGINT AS n_freq, list_sort(list(label)) AS names
        FROM counted
    ),
    firsts AS (
        SELECT paper_id, label, 0 AS draw FROM (
            SELECT paper_id, label, row_number() OVER (PARTITION BY label ORDER BY {q.digest(100, 'paper_id')}) AS rn,
                   dense_rank() OVER (ORDER BY label) AS lr FROM {rows}
        ) t, totals WHERE rn = 1 AND lr <= n
    ),
    common AS (
        SELECT paper_id, label, row_number() OVER (ORDER BY {q.digest(100, 'paper_id')}) AS rn
        FROM {rows} WHERE label IN (SELECT label FROM counted WHERE cnt > 20)
    ),
    others AS (
        SELECT paper_id, label, unnest(range(1, greatest(n - n_labels, 0) // n_freq + CASE WHEN rn <= greatest(n - n_labels, 0) % n_freq THEN 2 ELSE 1 END)) AS draw
        FROM common, totals
    ),
    negatives AS (
        SELECT paper_id, label, draw::BIGINT AS draw,
               {other}[1 + {q.hash_int(q.digest(100, "'false'", 'draw', 'paper_id'))} % greatest(len({other}), 1)] AS false_label
        FROM (SELECT * FROM firsts UNION ALL SELECT * FROM others) t, totals
    )
    """


@query("sample_false", f"WITH {_false('papers', 0.4)} SELECT * FROM negatives", "papers")
def sample_false(t) -> DataFrame:
    return S.sample_false(t.papers.select("paper_id", "label"), 0.4, "paper_id")


@query("sample_false_again", f"WITH {_false('papers', 2.5)} SELECT * FROM negatives", "papers")
def sample_false_again(t) -> DataFrame:
    """More negatives than rows: the rows go round several times."""
    return S.sample_false(t.papers.select("paper_id", "label"), 2.5, "paper_id")


@query("false_instances_full", f"SELECT false AS is_true, 'test' AS file, n.label, {q.describe(['title', 'publisher'])} AS description FROM papers p, (SELECT DISTINCT label FROM papers) n WHERE n.label <> p.label", "papers")
def false_instances_full(t) -> DataFrame:
    return I.false_instances_full(t.papers, t.papers.select("label"), ["title_publisher"]).drop("experiment")


@query("true_instances", f"SELECT true AS is_true, 'test' AS file, label, {q.describe(['title', 'abstract'])} AS description FROM papers WHERE label IN (SELECT src FROM mapping)", "papers mapping")
def true_instances(t) -> DataFrame:
    return I.true_instances(t.papers, t.mapping.select(F.col("src").alias("label")), ["title_abstract"]).drop("experiment")


@query(
    "all_instances",
    f"""
    WITH {_false('papers', 0.4)}
    SELECT 'true' || chr(9) || '[test].txt' || chr(9) || '[' || label || ']' || chr(9) || {q.describe(['title'])} AS value FROM papers
    UNION ALL
    SELECT 'false' || chr(9) || '[test].txt' || chr(9) || '[' || n.false_label || ']' || chr(9) || {q.describe(['p.title'])}
    FROM negatives n JOIN papers p USING (paper_id)
    """,
    "papers",
)
def all_instances(t) -> DataFrame:
    true = I.true_instances(t.papers, t.papers.select("label"), ["title"])
    false = I.false_instances_sampled(t.papers, ["title"], 0.4, "paper_id")
    return I.instance_lines(true.unionByName(false))


@query(
    "build_instances",
    f"""
    WITH complete AS (SELECT paper_id, abstract, author, title, publisher, label FROM papers
                      WHERE label <> 'Science' AND abstract <> '' AND author <> '' AND title <> '' AND publisher <> ''),
    kept AS (SELECT label FROM (SELECT label, count(*) AS cnt, row_number() OVER (ORDER BY count(*), label) AS rk FROM complete GROUP BY label HAVING count(*) > 5) t WHERE rk <= 16),
    training AS (SELECT * FROM complete WHERE label IN (SELECT label FROM kept)),
    label_counts AS (SELECT label, count(*) AS cnt FROM training GROUP BY label),
    {_COUNTS}, {_PARTED}, train AS (SELECT * FROM parted WHERE split = 'train'), {_false('train', 0.4)},
    texts AS (SELECT paper_id, label, split, 'title' AS experiment, {q.describe(['title'])} AS description FROM parted
              UNION ALL SELECT paper_id, label, split, 'title_publisher', {q.describe(['title', 'publisher'])} FROM parted
              UNION ALL SELECT paper_id, label, split, 'title_abstract', {q.describe(['title', 'abstract'])} FROM parted)
    SELECT experiment, split, true AS is_true, 'test' AS file, label, description FROM texts
    UNION ALL SELECT experiment, split, false, 'test', false_label, description FROM texts JOIN negatives USING (paper_id) WHERE split = 'train' AND false_label IS NOT NULL
    UNION ALL SELECT experiment, split, false, 'test', c.label, description FROM texts x, label_counts c WHERE split = 'test' AND c.label <> x.label
    """,
    "papers",
)
def build_instances(t) -> DataFrame:
    return plan.build_instances(t.papers, threshold=5, most=15, with_false=True)


@query("concat_corpora", "SELECT doc_id, array_to_string(categories, ' ') AS categories FROM corpus UNION ALL SELECT doc_id, categories FROM new_papers", "corpus new_papers")
def concat_corpora(t) -> DataFrame:
    one = t.corpus.select("doc_id", label_string(F.col("categories")).alias("categories"))
    return C.concat_corpora(one, t.new_papers.select("doc_id", "categories"))


_LISTED = "['en', 'src3', 'long', 'src7', 'fr']"
LISTED = ["en", "src3", "long", "src7", "fr"]


@query(
    "to_nolabel",
    f"""
    WITH k AS (SELECT doc_id, list_filter(categories, lambda x: NOT list_contains({_LISTED}, x)) AS kept FROM corpus)
    SELECT doc_id, CASE WHEN len(kept) = 0 THEN 'nolabel' ELSE array_to_string(kept, ' ') END AS categories FROM k
    """,
    "corpus",
)
def to_nolabel(t) -> DataFrame:
    return C.to_nolabel(t.corpus, LISTED).select("doc_id", label_string(F.col("categories")).alias("categories"))


_MOVED = f"""
    moved AS (
        SELECT list_filter({_LISTED}, lambda x: list_contains(categories, x))[-1] AS label, count(*) AS moved_cnt
        FROM corpus WHERE len(list_filter(categories, lambda x: NOT list_contains({_LISTED}, x))) = 0 GROUP BY 1
    )
"""


@query("moved_counts", f"WITH {_MOVED} SELECT * FROM moved", "corpus")
def moved_counts(t) -> DataFrame:
    return D.moved_counts(t.corpus, LISTED)


@query(
    "move_to_nolabel",
    f"""
    WITH {_MOVED}, {_DIST}
    SELECT label, sum(cnt)::BIGINT AS cnt FROM (
        SELECT label, cnt FROM dist WHERE NOT list_contains({_LISTED}, label)
        UNION ALL SELECT 'nolabel', moved_cnt FROM moved
    ) t GROUP BY label
    """,
    "corpus",
)
def move_to_nolabel(t) -> DataFrame:
    return D.move_to_nolabel(D.label_distribution_multi(t.corpus), D.moved_counts(t.corpus, LISTED), LISTED)


@query(
    "add_nolabel",
    "SELECT doc_id, 'nolabel' AS categories FROM new_papers WHERE categories IN (SELECT categories FROM new_papers WHERE categories <> 'Science' GROUP BY categories HAVING count(*) < 15)",
    "new_papers",
)
def add_nolabel(t) -> DataFrame:
    rare = D.label_distribution_single(t.new_papers, skip=None).filter("cnt < 15 OR label = 'Science'")
    return C.add_nolabel(t.new_papers, rare).select("doc_id", "categories")


_REDUCED = f"""
    {_DIST}, {_RANKED},
    quotas AS (SELECT label, floor(cnt::DOUBLE / (sum(cnt) OVER ())::DOUBLE * 400.0)::BIGINT AS quota FROM ranked WHERE rank <= 18),
    kept AS (SELECT * FROM corpus WHERE NOT list_has_any(categories, coalesce((SELECT list(label) FROM ranked WHERE rank > 18), []))),
    {_drawn('kept', 'quotas')}
"""


def _reduced(t):
    return C.reduce_by_distribution(t.corpus, t.full_mapping.select(F.col("src").alias("label")), 400, 18, "doc_id")


@query("reduce_by_distribution", f"WITH {_REDUCED} SELECT * FROM sample", "corpus")
def reduce_by_distribution(t) -> DataFrame:
    return _reduced(t)[0].select("doc_id", "drawn_for")


_ADDED = f"""
    fresh AS (SELECT * FROM new_papers n WHERE doi IS NULL OR doi NOT IN (SELECT doi FROM corpus WHERE doi IS NOT NULL)),
    fresh_counts AS (SELECT categories AS label, count(*) AS cnt FROM fresh WHERE categories <> 'Science' GROUP BY 1),
    fresh_ranked AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, label) <= 15 AS relevant FROM fresh_counts),
    absent AS (SELECT * FROM fresh_ranked WHERE label NOT IN (SELECT dst FROM quotas JOIN full_mapping ON src = label)),
    capped AS (
        SELECT doc_id, replace(categories, ' ', '') AS categories FROM (
            SELECT doc_id, categories, row_number() OVER (PARTITION BY categories ORDER BY {q.digest(100, 'doc_id')}) AS rn
            FROM fresh WHERE categories IN (SELECT label FROM absent WHERE relevant)
        ) t WHERE rn <= 10
    )
"""


@query(
    "add_new_data",
    f"""
    WITH {_REDUCED}, {_ADDED}
    SELECT doc_id, array_to_string(categories, ' ') AS categories FROM corpus
    UNION ALL SELECT * FROM capped
    UNION ALL SELECT doc_id, 'nolabel' FROM fresh WHERE categories IN (SELECT label FROM absent WHERE NOT relevant)
    """,
    "corpus new_papers full_mapping",
)
def add_new_data(t) -> DataFrame:
    quotas = _reduced(t)[1].filter("relevant").select("label", "quota")
    base = t.corpus.select("doc_id", "title", "abstract", "doi", "categories")
    merged, _ = C.add_new_data(base, quotas, t.new_papers, t.full_mapping, 15, 10, "doc_id")
    return merged.select("doc_id", label_string(F.col("categories")).alias("categories"))


@query(
    "added_distribution",
    f"""
    WITH {_REDUCED}, {_ADDED}
    SELECT label, quota AS cnt FROM quotas
    UNION ALL SELECT label, least(cnt, 10) FROM absent WHERE relevant
    UNION ALL SELECT 'nolabel', coalesce(sum(cnt), 0)::BIGINT FROM absent WHERE NOT relevant
    """,
    "corpus new_papers full_mapping",
)
def added_distribution(t) -> DataFrame:
    quotas = _reduced(t)[1].filter("relevant").select("label", "quota")
    base = t.corpus.select("doc_id", "title", "abstract", "doi", "categories")
    return C.add_new_data(base, quotas, t.new_papers, t.full_mapping, 15, 10, "doc_id")[1]


@query("drop_known_doi", "SELECT doc_id FROM new_papers WHERE doi IS NULL OR doi NOT IN (SELECT doi FROM corpus WHERE doi IS NOT NULL)", "new_papers corpus")
def drop_known_doi(t) -> DataFrame:
    return J.drop_known_doi(t.new_papers, t.corpus, "doc_id").select("doc_id")


_HALVES = f"halves AS (SELECT categories AS labels, {q.fraction(q.digest(100, 'doc_id'))} < 0.01 AS train FROM corpus)"


@query(
    "uncovered_labels",
    f"""
    WITH {_HALVES} SELECT DISTINCT label FROM (SELECT unnest(labels) AS label FROM halves WHERE NOT train) t
    WHERE label NOT IN (SELECT unnest(labels) FROM halves WHERE train)
    """,
    "corpus",
)
def uncovered_labels(t) -> DataFrame:
    drawn = t.corpus.withColumn("train", hash_fraction(hash_order(100, F.col("doc_id"))) < 0.01).withColumnRenamed("categories", "labels")
    return J.uncovered_labels(drawn.filter("NOT train"), drawn.filter("train"))


@query(
    "labels_absent",
    f"WITH {_DIST}, p AS (SELECT DISTINCT r_name AS label FROM region) SELECT label FROM p WHERE label NOT IN (SELECT dst FROM dist JOIN mapping ON src = label WHERE label < 'src12')",
    "corpus mapping",
)
def labels_absent(t) -> DataFrame:
    frequent = D.label_distribution_multi(t.corpus).filter("label < 'src12'")
    return J.labels_absent(t.region.select(F.col("r_name").alias("label")), frequent, t.mapping)


# Metrics ---------------------------------------------------------------------------------------------

_TRUTH = f"""
    truth AS (
        SELECT p.id, p.batch, p.pred, CASE WHEN list_contains(p.labels, p.pred) THEN p.pred ELSE f.label END AS truth
        FROM predictions p JOIN (
            SELECT id, arg_min(label, {q.digest(100, 'id', 'label')}) AS label FROM (SELECT id, unnest(labels) AS label FROM predictions) t GROUP BY id
        ) f USING (id)
    ),
    cells AS (SELECT {{by}} truth, pred, count(*) AS cnt FROM truth GROUP BY ALL),
    test_labels AS (SELECT DISTINCT {{by}} unnest(labels) AS label FROM predictions),
    precisions AS (
        SELECT {{by}} label, coalesce(p, 0) AS precision FROM test_labels LEFT JOIN (
            SELECT {{by}} pred AS label, sum(CASE WHEN truth = pred THEN cnt ELSE 0 END)::DOUBLE / sum(cnt)::DOUBLE AS p FROM cells GROUP BY ALL
        ) c USING ({{by}} label)
    ),
    recalls AS (SELECT {{by}} truth AS label, sum(CASE WHEN truth = pred THEN cnt ELSE 0 END)::DOUBLE / sum(cnt)::DOUBLE AS recall FROM cells GROUP BY ALL),
    scores AS (
        SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
        FROM (SELECT {{by}} avg(precision) AS precision FROM precisions GROUP BY ALL) a
        {{join}} (SELECT {{by}} avg(recall) AS recall FROM recalls GROUP BY ALL) b {{on}}
    )
"""
_PLAIN = _TRUTH.format(by="", join="CROSS JOIN", on="")
_BATCH = _TRUTH.format(by="batch,", join="JOIN", on="USING (batch)")


@query("confusion", f"WITH {_PLAIN} SELECT truth, pred, cnt FROM cells", "predictions")
def confusion(t) -> DataFrame:
    return M.confusion(t.predictions)


@query("label_precision", f"WITH {_PLAIN} SELECT label, round(precision, 6) AS precision FROM precisions", "predictions")
def label_precision(t) -> DataFrame:
    found = M.label_precision(M.confusion(t.predictions), M.test_labels(t.predictions))
    return found.select("label", F.round("precision", 6).alias("precision"))


@query("macro_precision", f"WITH {_PLAIN} SELECT round(precision, 6) AS precision FROM scores", "predictions")
def macro_precision(t) -> DataFrame:
    return M.macro_scores(t.predictions).select(F.round("precision", 6).alias("precision"))


@query("macro_recall", f"WITH {_PLAIN} SELECT round(recall, 6) AS recall FROM scores", "predictions")
def macro_recall(t) -> DataFrame:
    return M.macro_scores(t.predictions).select(F.round("recall", 6).alias("recall"))


@query("macro_f1", f"WITH {_PLAIN} SELECT round(f1, 6) AS f1 FROM scores", "predictions")
def macro_f1(t) -> DataFrame:
    return M.macro_scores(t.predictions).select(F.round("f1", 6).alias("f1"))


@query("mean_over_batches", f"WITH {_BATCH} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM scores", "predictions")
def mean_over_batches(t) -> DataFrame:
    means = M.mean_over_batches(t.predictions, "batch")
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


_REPORT = f"""
    {_DIST},
    named AS (SELECT coalesce(dst, label) AS label, label AS code, cnt FROM dist LEFT JOIN mapping ON src = label),
    grouped AS (SELECT label, sum(cnt)::BIGINT AS cnt, array_to_string(list_sort(list(code)), ' ') AS codes FROM named GROUP BY label),
    label_map AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM grouped),
    title AS (SELECT idx, round((cnt % 7) / 7.0, 6) AS precision FROM label_map JOIN grouped USING (label)),
    title_abstract AS (SELECT idx, round((cnt % 11) / 11.0, 6) AS precision FROM label_map JOIN grouped USING (label))
"""


def _report(t):
    dist = D.label_distribution_multi(t.corpus)
    named = dist.join(t.mapping, dist["label"] == F.col("src"), "left").select(F.coalesce("dst", dist["label"]).alias("label"), "cnt")
    grouped = named.groupBy("label").agg(F.sum("cnt").alias("cnt"))
    label_map = D.label_index(grouped)
    both = label_map.join(grouped, "label")
    title = both.select("idx", F.round((F.col("cnt") % 7) / 7.0, 6).alias("precision"))
    title_abstract = both.select("idx", F.round((F.col("cnt") % 11) / 11.0, 6).alias("precision"))
    return dist, grouped, label_map, title, title_abstract


@query(
    "report_join",
    f"""
    WITH {_REPORT} SELECT label, cnt, a.precision AS precision_title, b.precision AS precision_title_abstract
    FROM grouped JOIN label_map USING (label) JOIN title a USING (idx) JOIN title_abstract b USING (idx)
    """,
    "corpus mapping",
)
def report_join(t) -> DataFrame:
    _, grouped, label_map, title, title_abstract = _report(t)
    return M.report_join(grouped, label_map, title, title_abstract)


@query(
    "field_table",
    f"""
    WITH {_REPORT} SELECT label, cnt, CASE WHEN codes = label THEN '-' ELSE codes END AS codes,
           a.precision AS precision_title, b.precision AS precision_title_abstract
    FROM grouped JOIN label_map USING (label) JOIN title a USING (idx) JOIN title_abstract b USING (idx)
    """,
    "corpus mapping",
)
def field_table(t) -> DataFrame:
    dist, _, label_map, title, title_abstract = _report(t)
    return M.field_table(dist, t.mapping, label_map, title, title_abstract)
