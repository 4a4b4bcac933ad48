"""The minute measures, sessions and checks on a stream.

Every function takes and returns a streaming DataFrame, but for the ``run_``
functions, which drain a bounded source. Windows are drained in update mode:
each micro-batch writes the rows it changed under its own id, and of each key the
newest row counts, so a window is there as soon as it has an event and is
replaced when later ones come. What Spark's aggregations cannot carry over is
kept in the state store by key, with event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import streamquality as S
from ..operators.split import lag_in_slices, micros, sum_in_slices
from ..session import scratch_dir

c = F.col
BATCH = "_batch"


def run_bounded(stream: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Drain what the source holds now into a table and stop; a restart goes on where it ended.

    In append mode windows that the watermark has not passed stay in the state; ``run_updated`` gives them too.
    """
    spark = stream.sparkSession
    path = path or scratch_dir(spark, label)
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def newest(rows: DataFrame, keys) -> DataFrame:
    """Of each key the row of the highest batch."""
    rest = [n for n in rows.columns if n not in (*keys, BATCH)]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_row"))
    return picked.select(*keys, "_row.*")


def run_updated(stream: DataFrame, keys, label: str, path: str | None = None) -> DataFrame:
    """Drain what the source holds now and give the newest row of every key, open windows included.

    Runs in update mode. A micro-batch's changed rows go to a folder of its
    number: doing it twice replaces its own rows only, and nothing written
    before is read or moved. The rows of a key are at most the micro-batches
    that changed it, which ends with its window; reading combines them on the
    map side. A restart with the same ``path`` goes on with the stored state.
    """
    spark, schema = stream.sparkSession, stream.schema
    path = path or scratch_dir(spark, label)

    def step(batch: DataFrame, batch_id: int, folder: str) -> None:
        batch.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/data/{batch_id}")

    run_batches(stream, label, step, path, "update")
    return newest(spark.read.schema(StructType([*schema.fields, StructField(BATCH, IntegerType())])).parquet(f"{path}/data/*"), keys)


def run_batches(stream: DataFrame, label: str, step: Callable[[DataFrame, int, str], None], path: str | None = None, mode: str = "append") -> str:
    """Run ``step(batch, batch_id, folder)`` for every micro-batch until the source is drained."""
    path = path or scratch_dir(stream.sparkSession, label)
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: step(df, n, path)).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return path


def _minute(stream: DataFrame, watermark: str):
    return stream.withWatermark("ts", watermark), F.window("ts", "1 minute")


def stream_minute_quality(stream: DataFrame, watermark: str = "10 minutes", sla_ms: int = 30000) -> DataFrame:
    """Count, delay and SLA breaches per minute and domain."""
    d, minute = _minute(stream, watermark)
    out = d.groupBy("profile_id", minute.alias("w"), "service_domain").agg(F.count("*").alias("total_count"), *S.latency_aggs(S.delay(stream), sla_ms))
    return out.select("profile_id", c("w.start").alias("metric_minute"), *[x for x in out.columns if x not in ("profile_id", "w")], S.latency_status(sla_ms).alias("status"))


def stream_duplicates(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Repeats per minute and domain: messages, and messages whose event the minute has not seen.

    The seen events of open minutes are the state, spread by event id; a minute's
    counts are combined before they are shuffled.
    """
    d, minute = _minute(stream, watermark)
    d = d.select("profile_id", minute.alias("w"), "service_domain", "raw_event_id")
    seen = d.dropDuplicates().withColumn("first", F.lit(1))
    out = d.withColumn("first", F.lit(0)).unionByName(seen).groupBy("profile_id", "w", "service_domain").agg(
        F.count_if(c("first") == 0).alias("total_count"), F.count_if(c("first") == 1).alias("events")
    )
    return out.select("profile_id", c("w.start").alias("metric_minute"), "service_domain", "total_count", (c("total_count") - c("events")).alias("duplicate_count"), ((c("total_count") - c("events")) / c("total_count")).alias("duplicate_ratio"))


def stream_completeness(expected: DataFrame, actual: DataFrame, watermark: str = "10 minutes", within: str = "5 minutes", deduplicated: bool = False) -> DataFrame:
    """Expected events with the arrival that followed within the bound, or null once it has passed.

    A deduplicated stream of arrivals already carries its watermark.
    """
    actual = actual if deduplicated else actual.withWatermark("ts", watermark)
    e = expected.withWatermark("ts", watermark).select("profile_id", "raw_event_id", "ts", "service_domain")
    a = actual.select(c("raw_event_id").alias("arrived_id"), c("ts").alias("arrived_ts"))
    near = (c("raw_event_id") == c("arrived_id")) & (c("arrived_ts") >= c("ts")) & (c("arrived_ts") <= c("ts") + F.expr(f"INTERVAL {within}"))
    return e.join(a, near, "leftOuter")


def run_completeness(expected: DataFrame, actual: DataFrame, expected_rows: DataFrame, arrived_until, label: str, watermark: str = "10 minutes", within: str = "5 minutes", path: str | None = None) -> DataFrame:
    """Drain ``stream_completeness`` and add the expected events whose time is not yet over.

    The join gives an arrival at once and an absence when the watermark has
    passed. Events it has given neither of are the newest ones: those of
    ``expected_rows``, the rows the expected stream reads, after the last arrival
    (``arrived_until``) less the watermark and the bound. Only these are held
    against what was given.
    """
    out = run_bounded(stream_completeness(expected, actual, watermark, within, deduplicated=True), label, path=path)
    keys = ["profile_id", "raw_event_id", "ts"]
    recent, given = expected_rows.select(*keys, "service_domain"), out.select(*keys)
    last = expected_rows.agg(F.max("ts")).first()[0]
    if last is not None and arrived_until is not None:  # without arrivals the watermark has not moved
        since = F.lit(min(last, arrived_until)) - F.expr(f"INTERVAL {watermark}") - F.expr(f"INTERVAL {within}")
        recent, given = recent.where(c("ts") >= since), given.where(c("ts") >= since)
    return out.unionByName(recent.join(given, keys, "left_anti"), allowMissingColumns=True)


def stream_sessions(stream: DataFrame, identity: str = "identity", gap_seconds: int = 1800, watermark: str = "1 hour") -> DataFrame:
    """Sessions per identity; a pause of exactly the gap still belongs to the session."""
    w = F.session_window("ts", F.lit(f"{gap_seconds * 1_000_000 + 1} microseconds"))
    out = stream.withWatermark("ts", watermark).groupBy("profile_id", identity, w.alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"))
    return out.select("profile_id", identity, c("w.start").alias("session_start"), "last_ts", "events")


def stream_activity(stream: DataFrame, identity: str = "identity", watermark: str = "1 hour") -> DataFrame:
    """First and last event and their number per identity and minute."""
    d, minute = _minute(stream, watermark)
    out = d.groupBy("profile_id", identity, minute.alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
    return out.select("profile_id", identity, c("w.start").alias("minute"), "first_ts", "last_ts", "events")


def run_sessions(stream: DataFrame, identity: str = "identity", gap_seconds: int = 1800, watermark: str = "1 hour", label: str = "sessions", path: str | None = None) -> DataFrame:
    """Drain the stream into sessions, those that may still go on included.

    Sessions of ``stream_sessions`` are given when they are over. Here the
    minutes of activity are kept up to date instead; as a minute is shorter than
    the gap, no session ends within one, so sessions follow from the minutes.
    """
    if gap_seconds < 60:
        raise ValueError("a gap under a minute may part a minute")
    minutes = run_updated(stream_activity(stream, identity, watermark), ["profile_id", identity, "minute"], label, path)
    d = minutes.withColumn("_first", micros("first_ts")).withColumn("_last", micros("last_ts")).withColumn("_id", F.coalesce(F.concat(F.lit("="), c(identity).cast("string")), F.lit("?")))
    keys = ["profile_id", "_id"]
    d = lag_in_slices(d, keys, ["_first"], None, "_last", "_before")
    d = d.withColumn("_starts", (c("_before").isNull() | (c("_first") - c("_before") > gap_seconds * 1_000_000)).cast("int"))
    d = sum_in_slices(d, keys, ["_first"], None, "_starts", "_session")
    out = d.groupBy(*keys, "_session").agg(F.first(identity).alias(identity), F.min("first_ts").alias("session_start"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"))
    return out.select("profile_id", identity, "session_start", "last_ts", "events")


def stream_dedup_ingest(stream: DataFrame, keys, watermark: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def late_events(stream: DataFrame, limit_ms: int, watermark: str = "10 minutes") -> DataFrame:
    """Events per minute and those whose delay is over the limit."""
    d, minute = _minute(stream, watermark)
    out = d.groupBy("profile_id", minute.alias("w")).agg(F.count("*").alias("events"), F.count_if(S.delay(stream) > limit_ms).alias("late_events"), F.max(S.delay(stream)).alias("max_delay_ms"))
    return out.select("profile_id", c("w.start").alias("metric_minute"), "events", "late_events", "max_delay_ms")


def minute_moments(stream: DataFrame, watermark: str = "10 minutes", k: int = 200) -> DataFrame:
    """Mergeable facts of each minute's delays: number, sum, sum of squares, and a quantile sketch.

    Sums are exact decimals. The sketch's ranks are off by about 1.3 % at k = 200
    (99 % of the time); its size is bounded whatever the number of events.
    """
    d, minute = _minute(stream, watermark)
    v = S.delay(stream).cast("bigint")
    exact = v.cast("decimal(19,0)")
    out = d.groupBy("profile_id", minute.alias("w")).agg(
        F.count("*").alias("n"), F.count(v).alias("valued"), F.sum(exact).alias("s"), F.sum((exact * exact).cast("decimal(38,0)")).alias("ss"), F.kll_sketch_agg_bigint(v, k).alias("sketch")
    )
    return out.select("profile_id", c("w.start").alias("metric_minute"), "n", "valued", "s", "ss", "sketch")


def sliding_windows(moments: DataFrame, minutes: int = 60, quantiles=(0.5, 0.95)) -> DataFrame:
    """Trailing windows of so many minutes, moved a minute at a time, out of the facts of their minutes.

    A minute's one row goes to the windows it is in; events do not.
    """
    ends = F.transform(F.sequence(F.lit(1), F.lit(minutes)), lambda k: F.timestamp_add("MINUTE", k, c("metric_minute")))
    merged = moments.select("*", F.explode(ends).alias("window_end")).groupBy("profile_id", "window_end").agg(
        F.sum("n").alias("events"), F.sum("valued").alias("valued"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    )
    mean = c("s").cast("double") / c("valued")
    spread = (c("ss") * c("valued") - c("s") * c("s")).cast("double") / c("valued") / c("valued")
    picks = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias(f"p{round(q * 100)}_delay_ms") for q in quantiles]
    return merged.select("profile_id", "window_end", "events", mean.alias("avg_delay_ms"), (mean + 3 * F.sqrt(spread)).alias("upper_limit_ms"), *picks)


def judged_windows(windows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Windows with the tuned delay thresholds of their profile: fail or warn where the mean reaches them."""
    return windows.join(thresholds.select("profile_id", "delay_warn", "delay_fail"), "profile_id", "left").withColumn(
        "status", F.when(c("avg_delay_ms") >= c("delay_fail"), "fail").when(c("avg_delay_ms") >= c("delay_warn"), "warn").otherwise("ok")
    )


# --- state beyond aggregations ------------------------------------------------------


def walk_state(stream: DataFrame, keys, columns, watermark: str, walk, out: str, held: str, mode: str = "append") -> DataFrame:
    """``walk(columns, state, watermark_us)`` for each key of a micro-batch, and at its timers with no rows.

    Of a key's rows only ``columns`` (numbers) are sent to Python, in chunks; the
    state of a key is one row in the state store.
    """
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    names = [x.split(" ")[0] for x in out.split(", ")]

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = walk(chunks, state, state.getCurrentWatermarkMs() * 1000)
        if got is not None and len(got):
            for k, v in zip(keys, key):
                got[k] = v
            yield got[[*keys, *names]]

    picked = stream.withColumn("_us", micros("ts")).withWatermark("ts", watermark).select("ts", *keys, *columns)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + out
    return picked.groupBy(*keys).applyInPandasWithState(run, schema, held, mode, GroupStateTimeout.EventTimeTimeout)


def ordering(stream: DataFrame, watermark: str = "10 minutes", forget: str = "7 days") -> DataFrame:
    """Messages whose sequence does not exceed the last one of their domain and partition.

    A micro-batch's messages of one partition are put in order of time, offset,
    sequence and id, and follow the last message of the batches before. The
    state is that message; a partition without messages for ``forget`` of event
    time is forgotten.
    """
    keys = ["profile_id", "service_domain", "stream_partition"]
    order = ["_us", "stream_offset", "sequence_no", "raw_event_id"]
    kept_ms = int(pd.Timedelta(forget).total_seconds() * 1000)

    def walk(chunks, state, mark):
        parts = [p[order].astype("Int64") for p in chunks]
        if state.hasTimedOut or not parts:
            state.remove()
            return None
        d = pd.concat(parts).sort_values(order, ignore_index=True)
        last = state.getOption
        before = last[1] if last is not None else None
        d["prev_seq"] = d["sequence_no"].shift(1)
        d.loc[0, "prev_seq"] = pd.NA if before is None else before
        end = d.iloc[-1]
        at = max(int(end["_us"]), last[0] if last is not None else 0)
        state.update((at, None if pd.isna(end["sequence_no"]) else int(end["sequence_no"])))
        state.setTimeoutTimestamp(max(at // 1000 + kept_ms, mark // 1000 + 1))
        d["violation"] = (d["sequence_no"] <= d["prev_seq"]).fillna(False).astype("int64")
        return d

    found = walk_state(stream, keys, order, watermark, walk, "_us bigint, sequence_no bigint, raw_event_id bigint, prev_seq bigint, violation bigint", "at bigint, seq bigint")
    return found.select(*keys, "raw_event_id", F.timestamp_micros("_us").alias("ts"), "sequence_no", "prev_seq", "violation")


def silences(stream: DataFrame, keys=("profile_id",), limit_seconds: int = 5, watermark: str = "10 minutes", forget: str = "365 days") -> DataFrame:
    """Silences longer than the limit, and the downtime beyond it; also one that still lasts.

    A silence is over when the next event comes (``ts``). While it lasts, a timer
    goes off as the watermark passes the limit and at every advance after that:
    ``ts`` is null and the silence is counted up to the watermark. Rows of the
    same keys and ``since`` replace each other. A chunk of events is reduced to
    the first and last one of every ``limit_seconds``, between which no silence
    lies, so a source of any rate needs memory only for the time it spans.
    """
    keys, limit_us = list(keys), limit_seconds * 1_000_000
    wait_ms, kept_us = (limit_seconds + 1) * 1000, int(pd.Timedelta(forget).total_seconds()) * 1_000_000

    def rows(since: np.ndarray, until: np.ndarray, is_open: bool) -> pd.DataFrame:
        gap = (until - since) // 1_000_000
        d = pd.DataFrame({"since_us": since, "until_us": until, "gap_sec": gap, "downtime_sec": gap - limit_seconds, "is_open": is_open})
        return d[d["gap_sec"] > limit_seconds]

    def walk(chunks, state, mark):
        last = state.getOption
        if state.hasTimedOut:
            if mark - last[0] > kept_us:
                state.remove()
            else:
                state.setTimeoutTimestamp(mark // 1000 + 1)
            return rows(np.array([last[0]]), np.array([mark]), True)
        ends: list[np.ndarray] = []
        for p in chunks:
            ends.append(reduced(p["_us"].dropna().to_numpy(dtype=np.int64)))
            if len(ends) > 64:
                ends = [reduced(np.concatenate(ends))]
        us = reduced(np.concatenate(ends)) if ends else np.array([], dtype=np.int64)
        if last is not None:
            us = np.append(last[0], us[us > last[0]])
        if not len(us):
            return None
        state.update((int(us[-1]),))
        state.setTimeoutTimestamp(max(int(us[-1]) // 1000 + wait_ms, mark // 1000 + 1))
        return rows(us[:-1], us[1:], False)

    def reduced(us: np.ndarray) -> np.ndarray:
        us = np.sort(us)
        slot = us // limit_us
        edge = slot[1:] != slot[:-1]
        return us[np.append(True, edge) | np.append(edge, True)] if len(us) else us

    found = walk_state(stream, keys, ["_us"], watermark, walk, "since_us bigint, until_us bigint, gap_sec bigint, downtime_sec bigint, is_open boolean", "last bigint", "update")
    until = F.when(~c("is_open"), F.timestamp_micros("until_us"))
    return found.select(*keys, F.timestamp_micros("since_us").alias("since"), until.alias("ts"), "gap_sec", "downtime_sec", "is_open")


def stream_ordering(stream: DataFrame, label: str = "ordering", path: str | None = None, **options) -> DataFrame:
    """Drain ``ordering``: every message with the one before it."""
    return run_bounded(ordering(stream, **options), label, path=path)


def no_data_alert(stream: DataFrame, keys=("profile_id",), limit_seconds: int = 5, label: str = "silence", path: str | None = None, **options) -> DataFrame:
    """Drain ``silences``: the newest row of every silence, over or not."""
    return run_updated(silences(stream, keys, limit_seconds, **options), [*keys, "since"], label, path)


def idempotent_step(partition: str) -> Callable[[DataFrame, int, str], None]:
    """Write a batch under its own id; done twice, it replaces what it wrote before."""

    def step(batch: DataFrame, batch_id: int, folder: str) -> None:
        out = batch.withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", partition).parquet(f"{folder}/data")

    return step


def idempotent_sink(stream: DataFrame, partition: str, label: str = "sink", path: str | None = None, times: int = 1) -> DataFrame:
    """Append each batch under its own id. ``times`` over one repeats every batch, as a restart after a failure does."""
    once = idempotent_step(partition)
    folder = run_batches(stream, label, lambda batch, n, out: [once(batch, n, out) for _ in range(times)] and None, path)
    return stream.sparkSession.read.parquet(f"{folder}/data")
