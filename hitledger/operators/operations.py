"""Replay throughput, lag, availability and realism of the pipeline itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import numbers as N
from .quantiles import exact_quantiles
from .split import lag_in_slices, micros, number_in_slices

RUN = ("profile_id", "dt", "run_id")
# a run's facts are repeated so many times, each copy for one part of its rows
SALTS = 64
NO_DATA_SECONDS = 5


def replay_sequence(events: DataFrame, event_id: str, ts: str = "ts", keys=RUN) -> DataFrame:
    """Number the events of each run by time and id."""
    d = events.withColumn("_us", micros(ts))
    return number_in_slices(d, keys, ["_us", event_id], None, "replay_sequence").drop("_us")


def canonical_baseline(canonical: DataFrame, keys=RUN) -> DataFrame:
    """Events per active minute of each run."""
    minutes = canonical.groupBy(*keys, F.date_trunc("minute", "event_time").alias("m")).agg(F.count("*").alias("n"))
    return minutes.groupBy(*keys).agg(
        F.sum("n").alias("canonical_cnt"), F.count("*").alias("active_minutes"), (F.sum("n") / F.count("*")).alias("baseline_tpm")
    )


def replay_join(replay: DataFrame, canonical: DataFrame, keys=RUN) -> DataFrame:
    """Replayed rows with their event time, run bounds and baseline.

    Bounds and baseline have one row per run; the event join is by id. The run
    facts are joined by run and a part of the ids, so that the rows of one run,
    which may be all there are, meet them in many tasks.
    """
    bounds = replay.groupBy(*keys).agg(
        F.min("output_us").alias("replay_start_us"), F.max("output_us").alias("replay_end_us"), F.count("*").alias("replay_event_count")
    )
    per_run = bounds.join(canonical_baseline(canonical, keys), list(keys))
    events = canonical.select(*keys, "canonical_event_id", "event_time")
    salt = F.pmod(F.xxhash64("canonical_event_id"), F.lit(SALTS)).cast("int")
    copies = per_run.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = replay.drop("event_time").join(events, [*keys, "canonical_event_id"]).withColumn("_salt", salt)
    return joined.join(copies, [*keys, "_salt"]).drop("_salt")


def replay_lag(joined: DataFrame, warmup_seconds: int = 0) -> DataFrame:
    """Seconds and events a replayed row is behind an even replay at the baseline rate."""
    elapsed = (F.col("output_us") - F.col("replay_start_us")) / 1_000_000.0
    warm = F.floor(elapsed) <= warmup_seconds
    rate = F.col("baseline_tpm") / 60.0
    return joined.select(
        "*",
        F.when(warm, 0.0).otherwise(F.greatest(F.lit(0.0), elapsed - F.col("replay_sequence") / rate)).alias("lag_sec"),
        F.when(warm, 0.0).otherwise(F.greatest(F.lit(0.0), elapsed * rate - F.col("replay_sequence"))).alias("backlog_size"),
    )


def replay_lag_minute(replay: DataFrame, canonical: DataFrame, warmup_seconds: int = 0) -> DataFrame:
    """Throughput, drop against baseline, lag and backlog per event minute.

    p50 and p95 are the mean of the values at the floor and ceiling rank.
    """
    keys = [*RUN, "minute_ts"]
    rows = replay_lag(replay_join(replay, canonical), warmup_seconds).withColumn("minute_ts", F.date_trunc("minute", "event_time"))
    out = rows.groupBy(*keys).agg(
        F.max("canonical_cnt").alias("expected_event_count"), F.count("*").alias("observed_event_count"), F.max("baseline_tpm").alias("baseline_throughput_per_minute"),
        F.max("lag_sec").alias("freshness_delay_sec_max"), F.avg("backlog_size").alias("backlog_size_avg"), F.max("backlog_size").alias("backlog_size_max"),
    )
    q = exact_quantiles(rows, keys, "lag_sec", {"freshness_delay_sec_p50": 0.50, "freshness_delay_sec_p95": 0.95}, "two_ranks")
    drop = F.greatest(F.lit(0.0), 1 - F.col("observed_event_count") / F.col("baseline_throughput_per_minute"))
    return out.withColumn("throughput_drop_ratio", drop).join(q, keys, "left")


def batch_minute(canonical_counts: DataFrame, batch_input: DataFrame, keys=RUN) -> DataFrame:
    """The batch branch: one row per run, expected against built events."""
    built = batch_input.groupBy(*keys).agg(F.sum("event_count").alias("observed_event_count"))
    j = canonical_counts.join(built, list(keys), "left").fillna(0, subset=["observed_event_count"])
    e, o = F.col("expected_event_count"), F.col("observed_event_count")
    lag = F.greatest(F.lit(0), e - o)
    return j.select("*", F.when(e > 0, F.greatest(F.lit(0.0), 1 - o / F.when(e > 0, e))).alias("throughput_drop_ratio"), lag.alias("backlog_size"))


def perf_day(minutes: DataFrame) -> DataFrame:
    """Day rollup of minutes; counts degraded and severe ones."""
    at = lambda sec, drop: (F.coalesce("freshness_delay_sec_p95", F.lit(0.0)) >= sec) | (F.coalesce("throughput_drop_ratio", F.lit(0.0)) >= drop)
    return minutes.groupBy(*RUN).agg(
        F.count("*").alias("minute_window_count"), F.count_if(F.col("observed_event_count") > 0).alias("active_minute_count"), F.sum("observed_event_count").alias("observed_event_count"),
        F.avg("observed_event_count").alias("throughput_per_minute_avg"), F.max("observed_event_count").alias("max_throughput_per_minute"),
        F.avg("throughput_drop_ratio").alias("throughput_drop_ratio_avg"), F.max("throughput_drop_ratio").alias("throughput_drop_ratio_max"),
        F.avg("freshness_delay_sec_p50").alias("freshness_delay_sec_p50"), F.max("freshness_delay_sec_p95").alias("max_freshness_delay_sec_p95"), F.max("freshness_delay_sec_max").alias("freshness_delay_sec_max"),
        F.avg("backlog_size_avg").alias("backlog_size_avg"), F.max("backlog_size_max").alias("backlog_size_max"),
        F.count_if(at(300, 0.30)).alias("degraded_minute_count"), F.count_if(at(900, 0.60)).alias("severe_minute_count"),
    )


def perf_day_batch(batch_rows: DataFrame) -> DataFrame:
    e, o = F.col("expected_event_count"), F.col("observed_event_count")
    return batch_rows.select(
        *RUN, F.lit(1).alias("minute_window_count"), (o > 0).cast("int").alias("active_minute_count"), "observed_event_count",
        (o / 1440.0).alias("throughput_per_minute_avg"), "throughput_drop_ratio", "backlog_size",
        (o < e).cast("int").alias("degraded_minute_count"), (o == 0).cast("int").alias("severe_minute_count"),
    )


def output_gaps(outputs: DataFrame, keys, us: str, order) -> DataFrame:
    """Longest gap between outputs and the downtime beyond the allowed seconds."""
    d = lag_in_slices(outputs, keys, [us, *order], None, us, "_prev_us")
    gap = F.coalesce(F.floor((F.col(us) - F.col("_prev_us")) / 1_000_000), F.lit(0))
    return d.groupBy(*keys).agg(
        F.max(gap).alias("max_gap_sec"),
        F.sum(F.when(gap > NO_DATA_SECONDS, gap - NO_DATA_SECONDS).otherwise(0)).alias("downtime_sec"),
        F.min(us).alias("first_output_us"), F.max(us).alias("last_output_us"),
    )


def _run_status(out: DataFrame, empty: str, part: str) -> DataFrame:
    o, e = F.col("output_count"), F.col("expected_input_count")
    return (
        out.withColumn("run_status", F.when(o == e, "success").when(o == 0, "failed").otherwise("partial"))
        .withColumn("run_success_flag", (o == e).cast("int"))
        .withColumn("no_data_interval_sec", F.when(F.col("max_gap_sec") > NO_DATA_SECONDS, F.col("max_gap_sec")).otherwise(0))
        .withColumn("failure_reason_code", F.when(o == 0, empty).when(o < e, part))
    )


def replay_gaps(canonical: DataFrame, replay: DataFrame) -> DataFrame:
    """Availability of each replay run: counts, gaps, downtime, status and reason."""
    expected = canonical.groupBy(*RUN).agg(F.count("*").alias("expected_input_count"))
    seen = replay.join(canonical.select(*RUN, "canonical_event_id"), [*RUN, "canonical_event_id"], "left_semi")
    counts = seen.groupBy(*RUN).agg(F.count("*").alias("output_count"))
    gaps = output_gaps(seen.select(*RUN, "output_us", "replay_sequence"), list(RUN), "output_us", ["replay_sequence"])
    out = expected.join(counts, list(RUN), "left").join(gaps, list(RUN), "left").fillna(0)
    return _run_status(out, "no_replay_output", "partial_replay_output")


def batch_gaps(canonical_counts: DataFrame, batch_input: DataFrame) -> DataFrame:
    """The same for the batch builder: gaps between its output rows (created_us, service_domain)."""
    counts = batch_input.groupBy(*RUN).agg(F.sum("event_count").alias("output_count"))
    gaps = output_gaps(batch_input.select(*RUN, "created_us", "service_domain"), list(RUN), "created_us", ["service_domain"])
    out = canonical_counts.withColumnRenamed("expected_event_count", "expected_input_count").join(counts, list(RUN), "left").join(gaps, list(RUN), "left").fillna(0)
    return _run_status(out, "no_batch_output", "partial_batch_output")


def availability_day(runs: DataFrame) -> DataFrame:
    status = F.col("run_status")
    return runs.groupBy("profile_id", "dt").agg(
        F.count("*").alias("run_count"), *[F.count_if(status == s).alias(f"{s}_run_count") for s in ("success", "failed", "partial", "timeout")],
        F.avg("run_success_flag").alias("success_rate"), F.sum("no_data_interval_sec").alias("no_data_interval_sec_sum"), F.max("no_data_interval_sec").alias("no_data_interval_sec_max"),
        F.sum("downtime_sec").alias("downtime_sec_sum"), F.max("downtime_sec").alias("downtime_sec_max"),
        F.greatest(F.lit(0.0), 1 - F.sum("downtime_sec") / 86400.0).alias("availability_ratio"), F.count_if(F.col("output_count") == 0).alias("zero_output_run_count"),
    )


def measurement_operational(replay_counts: DataFrame, perf: DataFrame, availability: DataFrame) -> DataFrame:
    """Day facts of operations, with computed fallbacks for what was not measured."""
    day = ["profile_id", "dt"]
    p = perf.groupBy(*day).agg(
        F.max("throughput_per_minute_avg").alias("_tpm"), F.max("freshness_delay_sec_p50").alias("lag_p50_sec"),
        F.max("max_freshness_delay_sec_p95").alias("lag_p95_sec"), F.max("freshness_delay_sec_max").alias("lag_max_sec"),
    )
    a = availability.select(*day, F.col("availability_ratio").alias("_av"), (F.col("no_data_interval_sec_sum") / 60.0).alias("no_data_gap_minutes"))
    j = replay_counts.join(p, day, "left").join(a, day, "left").fillna(0)
    n = F.col("processed_count")
    return j.select(
        *day, n, F.when((F.col("_tpm") == 0) & (n > 0), n / 1440.0).otherwise(F.col("_tpm")).alias("throughput_per_minute"),
        *[(F.col(f"lag_{k}_sec") * 1000).alias(f"lag_{k}_ms") for k in ("p50", "p95", "max")],
        F.when((F.col("_av") == 0) & (n > 0), 1.0).otherwise(F.col("_av")).alias("availability_ratio"), "no_data_gap_minutes",
    )


REFERENCE_SCENARIOS = ("baseline", "normal", "stable")
# Scenario and the measure it should move.
EXPECTED_DELTA = {
    "source_partial_missing": "completeness", "source_latency_degradation": "timeliness",
    "source_no_data": "availability", "source_schema_drift": "integrity",
}


def measurement_realism(layers: DataFrame) -> DataFrame:
    """Direct deltas of completeness, timeliness, availability and integrity per day.

    ``layers`` has, per scope: source/canonical/batch/stream/replay counts,
    baseline_source and baseline_canonical, latency_delta_ms, suppressed_hours,
    marker_count, no_data_minutes, availability_ratio, schema_flags and scenario_name.
    """
    c = F.col
    drop = N.ratio_drop
    later = [F.when(c(f"{layer}_count") > 0, drop("canonical_count", f"{layer}_count")).otherwise(0.0) for layer in ("batch", "stream", "replay")]
    completeness = F.greatest(drop("baseline_source", "source_count"), drop("baseline_canonical", "canonical_count"), *later)
    late = F.greatest(F.lit(0.0), c("latency_delta_ms").cast("double"))
    timeliness = F.least(F.lit(1.0), late / 3000.0)
    av = c("availability_ratio").cast("double")
    share = lambda name, full: F.least(F.lit(1.0), c(name) / full)
    availability = F.greatest(
        F.when(av > 0, F.greatest(F.lit(0.0), 1 - av)).otherwise(0.0), share("suppressed_hours", 24.0), share("marker_count", 60.0), share("no_data_minutes", 1440.0)
    )
    name = c("scenario_name")
    availability = F.when(
        name == "source_no_data", F.greatest(availability, drop("baseline_source", "source_count"), drop("baseline_canonical", "canonical_count"))
    ).otherwise(availability)
    integrity = F.when((c("schema_flags") > 0) | (name == "source_schema_drift"), 1.0).otherwise(0.0)
    same = lambda layer: (c(f"{layer}_count") == 0) | (c(f"{layer}_count") == c("canonical_count"))
    calm = (
        F.lower(name).isin(*REFERENCE_SCENARIOS) & (c("source_count") > 0) & (c("canonical_count") > 0) & same("batch") & same("stream")
        & (c("suppressed_hours") == 0) & (c("marker_count") == 0) & (late <= 0)
    )
    scores = {"completeness": completeness, "timeliness": timeliness, "availability": availability, "integrity": integrity}
    out = layers
    for n, e in scores.items():
        out = out.withColumn(f"{n}_delta", F.when(calm, 0.0).otherwise(e))
    top = F.greatest(*[c(f"{n}_delta") for n in scores])
    reason = F.when((name == "baseline") & (top > 0.0001), "baseline_direct_delta_nonzero")
    for scenario, n in EXPECTED_DELTA.items():
        reason = reason.when((name == scenario) & (c(f"{n}_delta") <= 0), f"expected_{n}_delta_missing")
    return out.withColumn("realism_status", F.when(reason.isNull(), "PASS").otherwise("WARN")).withColumn(
        "realism_reasons", F.concat_ws(",", F.lit("direct_measurement_delta_calculated"), reason)
    )


def no_data_window(events: DataFrame, start, end, ts: str = "ts", keys=("profile_id",)):
    """Events outside a half-open window, and how many fell inside per scope."""
    inside = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    kept = events.where(~inside)
    removed = events.groupBy(*keys).agg(F.count_if(inside).alias("removed"))
    return kept, removed
