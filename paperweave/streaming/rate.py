"""Request counts in a trailing time span, as a table and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperweave.constants import REQUEST_LIMIT, REQUEST_SPAN_SECONDS


def rate_window(
    events: DataFrame,
    key: str,
    ts: str = "ts",
    limit: int = REQUEST_LIMIT,
    span: int = REQUEST_SPAN_SECONDS,
    slice_seconds: int = 3600,
) -> DataFrame:
    """Adds ``in_span``, the requests of the key in the last ``span`` seconds (a request exactly that old
    counts), and ``over_limit``.

    The time line of a key is cut into slices. A request also visits the next slice if it can still count
    there, so each slice is counted on its own and a key with a third of all requests is many small groups.
    """
    if dict(events.dtypes)[ts] == "timestamp_ntz":
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    else:
        micros = F.unix_micros(F.col(ts))
    own, reach = _slices(micros, span, slice_seconds)
    placed = events.withColumn("_micros", micros).withColumn("_own", own).withColumn("_slice", F.explode(F.sequence(own, reach)))
    order = Window.partitionBy(key, "_slice").orderBy("_micros")
    trailing = order.rangeBetween(-span * 1_000_000, Window.currentRow)
    counted = placed.withColumn("in_span", F.count(F.lit(1)).over(trailing))
    kept = counted.filter(F.col("_slice") == F.col("_own")).drop("_micros", "_own", "_slice")
    return kept.withColumn("over_limit", F.col("in_span") >= limit)


def _slices(micros: Column, span: int, slice_seconds: int) -> tuple[Column, Column]:
    """The slice of a time line that a request lies in, and the last one in which it can still count."""
    width = max(slice_seconds, span) * 1_000_000
    return F.floor(micros / F.lit(width)).cast("bigint"), F.floor((micros + F.lit(span * 1_000_000)) / F.lit(width)).cast("bigint")


def trailing_stream(
    events: DataFrame,
    key: str,
    ts: str = "ts",
    limit: int = REQUEST_LIMIT,
    span: int = REQUEST_SPAN_SECONDS,
    late: str = "10 minutes",
    slice_seconds: int = 3600,
) -> DataFrame:
    """:func:`rate_window` on a stream: ``key, ts, in_span, over_limit``, one row per request.

    A request is given out when the watermark has reached its time, as only then all requests of its span are known;
    one that comes behind the watermark is dropped and counts nowhere. The state of a key and slice holds the times
    that wait and those of the last ``span`` seconds, and is dropped when neither is left. A null time is dropped.
    ``ts`` is a timestamp. When a stream ends, :func:`with_open_requests` adds what was still waiting.
    """
    width, reach_back = max(slice_seconds, span) * 1_000_000, span * 1_000_000
    own, reach = _slices(F.col("_micros"), span, slice_seconds)
    timed = events.filter(F.col(ts).isNotNull()).withWatermark(ts, late)
    placed = timed.select(F.col(key).alias("_key"), ts, F.unix_micros(ts).alias("_micros"))
    placed = placed.select("_key", ts, "_micros", F.explode(F.sequence(own, reach)).alias("_slice"))

    def count(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, trail, done = state.get if state.exists else ([], [], None)
        arrived = [] if state.hasTimedOut else [x for batch in batches for x in batch["_micros"].tolist()]
        times = np.array([*waiting, *(x for x in arrived if done is None or x > done)], dtype=np.int64)
        mark = state.getCurrentWatermarkMs() * 1000
        ready = np.sort(times[times <= mark])
        held = np.concatenate([np.array(trail, dtype=np.int64), ready])
        counts = np.searchsorted(held, ready, side="right") - np.searchsorted(held, ready - reach_back, side="left")
        mine = ready // width == group[1]
        waiting, trail = np.sort(times[times > mark]).tolist(), held[held >= mark - reach_back].tolist()
        if waiting or trail:
            state.update((waiting, trail, max(mark, done or mark)))
            # a time waits until the watermark has passed it; what has been counted, for as long as it can count
            until = waiting[0] if waiting else trail[-1] + reach_back
            state.setTimeoutTimestamp(max(-(-until // 1000), mark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"_key": [group[0]] * int(mine.sum()), "_micros": ready[mine], "in_span": counts[mine]})

    kind = dict(events.dtypes)[key]
    counted = placed.groupBy("_key", "_slice").applyInPandasWithState(
        count, f"_key {kind}, _micros long, in_span long", "waiting array<long>, trail array<long>, done long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return counted.select(F.col("_key").alias(key), F.timestamp_micros("_micros").alias(ts), "in_span", (F.col("in_span") >= limit).alias("over_limit"))


def with_open_requests(
    closed: DataFrame, events: DataFrame, key: str, ts: str = "ts", limit: int = REQUEST_LIMIT, span: int = REQUEST_SPAN_SECONDS
) -> DataFrame:
    """What a finished stream gave out, and the requests that still waited at its end, counted from its events as a table.

    Requests of one key and time are given out together, so those that the stream has are told by key and time.
    """
    last = closed.groupBy(key).agg(F.max(ts).alias("_last"))
    known = events.filter(F.col(ts).isNotNull()).join(last.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    # what may count for a waiting request is no older than the last one given out, less the span
    recent = known.filter(F.col("_last").isNull() | (F.col(ts) >= F.col("_last") - F.make_dt_interval(secs=F.lit(span)))).select(events.columns)
    counted = rate_window(recent, key, ts, limit, span).select(key, ts, "in_span", "over_limit")
    out = closed.select(F.col(key).alias("_key"), F.col(ts).alias("_ts")).distinct()
    waiting = counted.join(out, F.col(key).eqNullSafe(F.col("_key")) & (F.col(ts) == F.col("_ts")), "left_anti")
    # requests within the span before the last one given out have their row already, or came too late
    last = last.select(F.col(key).alias("_key"), "_last")
    waiting = waiting.join(last, F.col(key).eqNullSafe(F.col("_key")), "left").filter(F.col("_last").isNull() | (F.col(ts) > F.col("_last")))
    return closed.unionByName(waiting.select(*closed.columns))


def _window_counts(events: DataFrame, key: str, ts: str, limit: int, span: int, slide: int) -> DataFrame:
    window = F.window(F.col(ts), f"{span} seconds", f"{slide} seconds")
    counts = events.groupBy(window, key).agg(F.count(F.lit(1)).alias("in_span"))
    return counts.select(
        F.col("window.start").alias("start"),
        F.col("window.end").alias("end"),
        key,
        "in_span",
        (F.col("in_span") >= limit).alias("over_limit"),
    )


def rate_stream(
    events: DataFrame,
    key: str,
    ts: str = "ts",
    limit: int = REQUEST_LIMIT,
    span: int = REQUEST_SPAN_SECONDS,
    slide: int = 60,
    late: str = "10 minutes",
) -> DataFrame:
    """Requests per key and sliding window on a stream; state is dropped behind the watermark.

    A window is given out once the watermark has passed it. When a stream ends, :func:`with_open_windows` adds
    those that were still open.
    """
    return _window_counts(events.withWatermark(ts, late), key, ts, limit, span, slide)


def with_open_windows(
    closed: DataFrame, events: DataFrame, key: str, ts: str = "ts", limit: int = REQUEST_LIMIT, span: int = REQUEST_SPAN_SECONDS, slide: int = 60
) -> DataFrame:
    """What a finished stream gave out, and the windows that were open at its end, counted from its events as a table.

    Only events from the last closed window on can lie in an open one, so older ones are not read again.
    """
    ended = closed.agg(F.max("start")).scalar()
    recent = events.filter(ended.isNull() | (F.col(ts) >= ended))
    open_ = _window_counts(recent, key, ts, limit, span, slide)
    # a window that starts later is open as a whole; one that starts with the last closed one may miss keys
    missing = open_.filter(ended.isNull() | (F.col("start") >= ended)).join(closed.select("start", key), ["start", key], "left_anti")
    return closed.unionByName(missing.select(*closed.columns))
