"""Sampling and splitting by hash order: reproducible, one pass, any group size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.functions.hashing import hash_fraction, hash_int, hash_order
from paperweave.operators.selection import first_by_hash
from paperweave.session import landed


def drop_rare(df: DataFrame, rare: DataFrame, key: str, labels: str = "categories") -> DataFrame:
    """Leave out every paper that holds any of the labels of ``rare``."""
    names = rare.agg(F.sort_array(F.collect_set("label"))).scalar()
    # the label vocabulary is one array value, so the papers are filtered in place, without a shuffle
    return df.filter(~F.arrays_overlap(F.col(labels), names))


def sample_proportional(df: DataFrame, quotas: DataFrame, key: str, seed: int = 100, labels: str = "categories") -> DataFrame:
    """Draw ``quota`` papers per label, no paper twice. Adds ``drawn_for``.

    Each paper stands for the one of its labels with the smallest hash, then the first papers by hash fill
    the quota. A label with too few papers stays short; see :func:`shortfall`.
    """
    known = quotas.agg(F.sort_array(F.collect_set("label"))).scalar()
    offered = F.array_intersect(F.array_distinct(F.col(labels)), known)
    ranked = F.transform("_offered", lambda x: F.struct(hash_order(seed, F.col(key), x).alias("h"), x.alias("label")))
    drawn = df.withColumn("_offered", offered).withColumn("_pick", F.array_min(ranked)).filter(F.col("_pick").isNotNull())
    drawn = drawn.withColumn("drawn_for", F.col("_pick.label")).withColumn("_digest", hash_order(seed, F.col(key)))
    limits = quotas.select(F.col("label").alias("drawn_for"), F.col("quota").alias("limit"))
    marked = first_by_hash(drawn.drop("_pick", "_offered"), ["drawn_for"], limits, "_digest")
    return marked.filter("picked").drop("picked", "_digest")


def shortfall(sample: DataFrame, quotas: DataFrame) -> DataFrame:
    """``label, quota, drawn, missing`` of a proportional sample."""
    drawn = sample.groupBy(F.col("drawn_for").alias("label")).agg(F.count(F.lit(1)).alias("drawn"))
    joined = quotas.select("label", "quota").join(drawn, "label", "left").na.fill(0, ["drawn"])
    return joined.withColumn("missing", F.col("quota") - F.col("drawn"))


def sample_capped(df: DataFrame, labels: DataFrame, most: int, key: str, seed: int = 100, label: str = "categories") -> DataFrame:
    """At most ``most`` rows of each label of ``labels`` (``label``), the first by hash."""
    limits = labels.select(F.col("label").alias(label)).distinct().withColumn("limit", F.lit(most).cast("bigint"))
    marked = first_by_hash(df.withColumn("_digest", hash_order(seed, F.col(key))), [label], limits, "_digest")
    return marked.filter("picked").drop("picked", "_digest")


def shuffle(df: DataFrame, key: str, seed: int = 100) -> DataFrame:
    """Global random order; meant for sinks."""
    return df.orderBy(hash_order(seed, F.col(key)), key)


def random_split(df: DataFrame, share: float, key: str, labels: str = "labels", seeds: tuple[int, ...] = tuple(range(100, 108))) -> DataFrame:
    """Adds ``split`` (train/test) so that each label occurs in the training rows.

    One pass judges all seeds; the first that covers every label counts, else the first one, in which the
    paper with the smallest hash of each uncovered label moves to the training rows.
    """
    draws = [hash_fraction(hash_order(s, F.col(key))) < share for s in seeds]
    per_label = df.select(F.explode(labels).alias("label"), *[d.alias(f"_t{i}") for i, d in enumerate(draws)])
    covered = per_label.groupBy("label").agg(*[F.max(f"_t{i}").alias(f"_t{i}") for i in range(len(seeds))])
    complete = covered.agg(*[F.coalesce(F.min(f"_t{i}"), F.lit(True)).alias(f"_t{i}") for i in range(len(seeds))])
    first = F.coalesce(*[F.when(F.col(f"_t{i}"), F.lit(i)) for i in range(len(seeds))], F.lit(0))
    choice = complete.select(first).scalar()

    flags = F.array(*draws)
    in_train = F.get(flags, choice)
    drawn = df.withColumn("_train", in_train)
    # labels that the chosen seed leaves out, usually none: only their rows are looked at
    missed = covered.filter(~F.get(F.array(*[F.col(f"_t{i}") for i in range(len(seeds))]), choice)).select("label")
    each = df.select(F.explode(labels).alias("label"), key).join(landed(missed, "missed-labels"), "label")
    low = F.min(F.struct(hash_order(seeds[0], F.col(key)).alias("h"), F.col(key).alias("k"))).alias("_low")
    forced = each.groupBy("label").agg(low).select(F.col("_low.k").alias(key)).distinct().withColumn("_forced", F.lit(True))
    # at most one forced paper per label, so label-sized, and written: its size is known to the join
    forced = landed(forced, "forced")
    joined = drawn.join(forced, key, "left")
    train = F.col("_train") | F.coalesce(F.col("_forced"), F.lit(False))
    return joined.withColumn("split", F.when(train, "train").otherwise("test")).drop("_train", "_forced")


def split_counts(dist: DataFrame, ratio: float, seed: int = 100, rare: int = 5, frequent: int = 50) -> DataFrame:
    """``label, cnt, n_train``: rows of each label that go to the training side.

    Every label gives its share rounded down; a rare one gives all its rows with probability 0.9, a single
    row always. What is then missing from (or above) the overall share is spread over the frequent labels,
    the largest remainder first.
    """
    share = F.col("cnt") * F.lit(float(ratio))
    keep_all = (F.col("cnt") == 1) | ((F.col("cnt") <= rare) & (hash_fraction(hash_order(seed, F.col("label"))) < 0.9))
    base = dist.select("label", "cnt").withColumn("n_train", F.when(keep_all, F.col("cnt")).otherwise(F.floor(share)))
    base = base.withColumn("_rest", share - F.floor(share)).withColumn("_freq", F.col("cnt") > frequent)
    whole = Window.partitionBy()
    open_rows = F.floor(F.sum("cnt").over(whole) * F.lit(float(ratio))) - F.sum("n_train").over(whole)
    n_freq = F.sum(F.col("_freq").cast("bigint")).over(whole)
    order = Window.partitionBy("_freq").orderBy(F.col("_rest").desc(), "label")
    ranked = base.withColumn("_open", open_rows).withColumn("_n", n_freq).withColumn("_rank", F.row_number().over(order))
    each = F.floor(F.abs("_open") / F.col("_n"))
    extra = each + (F.col("_rank") <= F.abs("_open") - each * F.col("_n")).cast("bigint")
    adjusted = F.col("n_train") + F.when(F.col("_freq"), F.signum("_open").cast("bigint") * extra).otherwise(F.lit(0))
    bounded = F.greatest(F.lit(0), F.least(F.col("cnt"), adjusted)).cast("bigint")
    return ranked.select("label", "cnt", bounded.alias("n_train"))


def stratified_split(df: DataFrame, ratio: float, key: str, label: str = "label", seed: int = 100) -> DataFrame:
    """Adds ``split`` (train/test) with :func:`split_counts` rows of each label in train, chosen by hash."""
    dist = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    limits = split_counts(dist, ratio, seed).select(F.col("label").alias(label), F.col("n_train").alias("limit"))
    marked = first_by_hash(df.withColumn("_digest", hash_order(seed, F.col(key))), [label], limits, "_digest")
    return marked.withColumn("split", F.when(F.col("picked"), "train").otherwise("test")).drop("picked", "_digest")


def pick_other(labels, own, digest):
    """One of ``labels`` (an array) other than ``own``, chosen by the digest; null if there is none."""
    others = F.array_remove(labels, own)
    return F.get(others, F.pmod(hash_int(digest), F.greatest(F.size(others), F.lit(1))).cast("int"))


def sample_false(train: DataFrame, percentage: float, key: str, label: str = "label", seed: int = 100, frequent: int = 20) -> DataFrame:
    """Training rows paired with a wrong label: ``floor(rows * percentage)`` of them.

    First one row of each label (the first labels, if there are more labels than draws), then rows of
    labels above ``frequent`` in hash order, going round again when they run out. Adds ``draw`` (round
    number) and ``false_label``.
    """
    rows = train.withColumn("_digest", hash_order(seed, F.col(key)))
    # label-sized and read several times
    dist = landed(train.groupBy(label).agg(F.count(F.lit(1)).alias("_cnt")), "label-counts")
    labels = dist.agg(F.sort_array(F.collect_set(label))).scalar()
    totals = dist.agg(
        F.floor(F.sum("_cnt") * F.lit(float(percentage))).cast("bigint").alias("n"),
        F.count(F.lit(1)).alias("n_labels"),
        F.coalesce(F.sum(F.when(F.col("_cnt") > frequent, F.col("_cnt"))), F.lit(0)).alias("n_freq"),
    )
    # one row per label, the least digest: an aggregate, not a sorted group
    lows = rows.groupBy(label).agg(F.min(F.struct("_digest", key)).alias("_low"))
    lows = lows.withColumn("_rank", F.row_number().over(Window.orderBy(label)))
    lows = lows.filter(F.col("_rank") <= totals.select("n").scalar())
    firsts = rows.join(lows.select(F.col(f"_low.{key}").alias(key)), key, "left_semi").withColumn("draw", F.lit(0).cast("bigint"))

    rest = F.greatest(totals.select(F.col("n") - F.col("n_labels")).scalar(), F.lit(0))
    n_freq = totals.select("n_freq").scalar()
    common = rows.join(dist.filter(F.col("_cnt") > frequent).select(label), label, "left_semi").withColumn("_one", F.lit(1))
    part = totals.select(
        F.lit(1).alias("_one"),
        F.when(F.col("n_freq") > 0, F.greatest(F.col("n") - F.col("n_labels"), F.lit(0)) % F.col("n_freq")).alias("limit"),
    )
    marked = first_by_hash(common, ["_one"], part, "_digest")
    rounds = F.floor(rest / F.greatest(n_freq, F.lit(1))) + F.col("picked").cast("bigint")
    repeated = marked.withColumn("_rounds", rounds).filter(F.col("_rounds") > 0)
    repeated = repeated.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rounds"))))
    drawn = firsts.unionByName(repeated.drop("_one", "picked", "_rounds"))
    digest = hash_order(seed, F.lit("false"), F.col("draw"), F.col(key))
    return drawn.withColumn("false_label", pick_other(labels, F.col(label), digest)).drop("_digest")
