"""Per-minute quality of an event stream, in batch form, and its day rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .joins import union_keys_left_join
from .quantiles import exact_quantiles
from .split import lag_in_slices, micros

MINUTE = ("profile_id", "metric_minute", "service_domain")


def _minute(df: DataFrame) -> DataFrame:
    seen = F.coalesce("producer_ts", "ts") if "producer_ts" in df.columns else F.col("ts")
    return df.withColumn("metric_minute", F.date_trunc("minute", seen)).withColumn(
        "service_domain", F.coalesce("service_domain", F.lit("all"))
    )


def _status(value: Column, fail: float, warn: float, strict: bool = False) -> Column:
    over = (lambda c: value > c) if strict else (lambda c: value >= c)
    return F.when(over(fail), "fail").when(over(warn), "warn").otherwise("ok")


def completeness_join(expected: DataFrame, actual: DataFrame, compat: bool = False) -> DataFrame:
    """Expected events with the number of times they arrived.

    ``compat`` keeps one row per arrival, so repeats raise both counts.
    """
    arrived = actual.groupBy("profile_id", "raw_event_id").agg(F.count("*").alias("arrivals"))
    j = expected.join(arrived, ["profile_id", "raw_event_id"], "left").fillna(0, subset=["arrivals"])
    if compat:
        return j.withColumn("expected_n", F.greatest(F.lit(1), "arrivals")).withColumn("actual_n", F.col("arrivals"))
    return j.withColumn("expected_n", F.lit(1)).withColumn("actual_n", (F.col("arrivals") > 0).cast("int"))


def stream_completeness_minute(expected: DataFrame, actual: DataFrame, compat: bool = False) -> DataFrame:
    j = _minute(completeness_join(expected, actual, compat))
    out = j.groupBy(*MINUTE).agg(F.sum("expected_n").alias("expected_count"), F.sum("actual_n").alias("actual_count"))
    rate = (F.col("expected_count") - F.col("actual_count")) / F.col("expected_count")
    return out.select(
        "*", (F.col("expected_count") - F.col("actual_count")).alias("missing_count"), rate.alias("missing_rate"),
        _status(rate, 0.10, 0.03).alias("status"),
    )


def stream_duplicates_minute(stream: DataFrame) -> DataFrame:
    per_event = _minute(stream).groupBy(*MINUTE, "raw_event_id").agg(F.count("*").alias("n"))
    out = per_event.groupBy(*MINUTE).agg(
        F.sum("n").alias("total_count"), (F.sum("n") - F.count("raw_event_id")).alias("duplicate_count")
    )
    rate = F.col("duplicate_count") / F.col("total_count")
    return out.select("*", rate.alias("duplicate_ratio"), _status(rate, 0.05, 0.01).alias("status"))


def delay(df: DataFrame) -> Column:
    names = [c for c in ("latency_ms", "event_delay_ms") if c in df.columns]
    return F.coalesce(*[F.col(c) for c in names], F.lit(0))


def latency_aggs(d: Column, sla_ms: int):
    return [
        F.avg(d).alias("avg_event_delay_ms"),
        F.max(d).alias("max_event_delay_ms"),
        (F.max("stream_offset") - F.min("stream_offset")).alias("offset_span"),
        F.count_if(d > sla_ms).alias("sla_breach_count"),
    ]


def latency_status(sla_ms: int) -> Column:
    return _status(F.col("avg_event_delay_ms"), sla_ms, sla_ms * 0.3, strict=True)


def stream_latency_minute(stream: DataFrame, sla_ms: int = 30000) -> DataFrame:
    df = _minute(stream)
    out = df.groupBy(*MINUTE).agg(*latency_aggs(delay(df), sla_ms))
    return out.withColumn("status", latency_status(sla_ms))


def ordering_violations(stream: DataFrame) -> DataFrame:
    """Messages whose sequence does not exceed the one before, per domain and partition."""
    df = _minute(stream)
    at = F.coalesce("producer_ts", "ts") if "producer_ts" in df.columns else F.col("ts")
    names = [c for c in ("sequence_no", "stream_offset") if c in df.columns]
    df = df.select(
        *MINUTE, "stream_partition", "stream_offset", "raw_event_id", micros(at).alias("_us"), F.coalesce(*names).alias("curr_seq")
    ).fillna(0, subset=["stream_partition"])
    keys = ["profile_id", "service_domain", "stream_partition"]
    order = ["_us", "stream_offset", "curr_seq", "raw_event_id"]
    out = lag_in_slices(df, keys, order, None, "curr_seq", "prev_seq")
    return out.withColumn("violation", F.coalesce((F.col("curr_seq") <= F.col("prev_seq")).cast("int"), F.lit(0)))


def stream_ordering_minute(stream: DataFrame) -> DataFrame:
    v = ordering_violations(stream)
    gap = F.when(F.col("violation") == 1, F.abs(F.col("curr_seq") - F.col("prev_seq"))).otherwise(0)
    out = v.groupBy(*MINUTE).agg(F.sum("violation").alias("ordering_violation_count"), F.avg(gap).alias("ordering_gap_score"))
    return out.withColumn("status", _status(F.col("ordering_violation_count"), 10, 1))


def risk_score() -> Column:
    part = lambda c, full, top: F.least(F.col(c) / full, F.lit(1.0)) * top
    late = F.least(F.greatest(F.col("avg_event_delay_ms") - 1000, F.lit(0.0)) / 10000.0, F.lit(1.0)) * 35
    return F.greatest(part("missing_rate", 0.10, 85), part("duplicate_ratio", 0.20, 70), part("ordering_gap_score", 20.0, 55), late)


# Measure, cut and name of each stream issue, by priority.
ISSUES = [("missing_rate", 0.01, "missing"), ("duplicate_ratio", 0.02, "duplicate"), ("ordering_gap_score", 5, "ordering"), ("avg_event_delay_ms", 1500, "delay")]


def stream_summary_minute(completeness, duplicates, ordering, latency) -> DataFrame:
    """The four minute facts on the union of their keys, with one risk score and issue flags."""
    keys = list(MINUTE)
    picked = {
        "c": completeness.select(*keys, "missing_rate"),
        "d": duplicates.select(*keys, "duplicate_ratio"),
        "o": ordering.select(*keys, "ordering_gap_score"),
        "l": latency.select(*keys, "avg_event_delay_ms"),
    }
    out = union_keys_left_join(picked, keys, [i[0] for i in ISSUES])
    flags = F.concat_ws(",", *[F.when(F.col(m) >= cut, name) for m, cut, name in ISSUES])
    return out.select("*", risk_score().alias("stream_risk_score"), flags.alias("issue_flags"))


def stream_summary_day(minutes: DataFrame) -> DataFrame:
    issue = None
    for m, cut, name in ISSUES:
        hit = F.max(m) >= cut
        issue = F.when(hit, name) if issue is None else issue.when(hit, name)
    return minutes.groupBy("profile_id", F.to_date("metric_minute").alias("dt"), "service_domain").agg(
        F.avg("missing_rate").alias("avg_missing_rate"), F.max("missing_rate").alias("max_missing_rate"),
        F.avg("duplicate_ratio").alias("avg_duplicate_ratio"), F.max("duplicate_ratio").alias("max_duplicate_ratio"),
        F.max("ordering_gap_score").alias("max_ordering_gap_score"),
        F.count_if(F.col("ordering_gap_score") >= 5).alias("total_ordering_violations"),
        F.avg("avg_event_delay_ms").alias("avg_event_delay_ms"), F.max("avg_event_delay_ms").alias("max_event_delay_ms"),
        F.max("stream_risk_score").alias("stream_risk_score"), issue.alias("primary_stream_issue"),
    )


def weighted_rollup(completeness, duplicates, latency) -> DataFrame:
    """Day rates weighted by the counts of the minutes."""
    day = ["profile_id", "dt"]
    d = lambda f: f.withColumn("dt", F.to_date("metric_minute"))
    c = d(completeness).groupBy(*day).agg(F.sum("expected_count").alias("expected_count"), F.sum("actual_count").alias("actual_count"), F.sum("missing_count").alias("missing_count"))
    u = d(duplicates).groupBy(*day).agg(F.sum("total_count").alias("total_count"), F.sum("duplicate_count").alias("duplicate_count"))
    lat = d(latency).groupBy(*day).agg(F.avg("avg_event_delay_ms").alias("avg_delay_ms"), F.max("max_event_delay_ms").alias("max_delay_ms"), F.sum("sla_breach_count").alias("sla_breach_count"))
    out = c.join(u, day, "full_outer").join(lat, day, "full_outer")
    rate = lambda a, b: F.round(F.col(a) / F.when(F.col(b) > 0, F.col(b)), 6)
    return out.select("*", rate("missing_count", "expected_count").alias("weighted_missing_rate"), rate("duplicate_count", "total_count").alias("weighted_duplicate_ratio"))


def measurement_stream(minute_day: DataFrame, ordering: DataFrame, canonical_counts: DataFrame) -> DataFrame:
    """Day facts of the stream layer from minute facts."""
    day = ["profile_id", "dt"]
    o = ordering.withColumn("dt", F.to_date("metric_minute")).groupBy(*day).agg(F.sum("ordering_violation_count").alias("ordering_error_count"))
    j = minute_day.join(o, day, "left").join(canonical_counts, day, "left").fillna(0)
    n = F.col("total_count")
    per = lambda c: F.when(n > 0, F.col(c) / F.when(n > 0, n)).otherwise(0.0)
    can = F.col("canonical_count")
    return j.select(
        *day, n.alias("stream_event_count"), "duplicate_count", per("duplicate_count").alias("duplicate_rate"), "ordering_error_count",
        per("ordering_error_count").alias("ordering_error_rate"), "avg_delay_ms", F.col("max_delay_ms").alias("latency_max_ms"),
        F.when(can > 0, n / F.when(can > 0, can)).when(n > 0, 1.0).otherwise(0.0).alias("completeness_rate"),
        (n / 1440.0).alias("throughput_per_minute"),
    )


# Quantiles, bounds and fallbacks of the tuned thresholds.
TUNING = {
    "missing_rate": dict(warn=0.30, fail=0.80, low=0.01, high=0.05, factor=1.8, top=0.25, warn_default=0.02, fail_default=0.10),
    "duplicate_ratio": dict(warn=0.30, fail=0.80, low=0.02, high=0.08, factor=1.8, top=0.25, warn_default=0.03, fail_default=0.10),
    "ordering_gap_score": dict(warn=0.50, fail=0.85, low=4.0, high=12.0, factor=1.5, top=None, warn_default=5.0, fail_default=12.0),
    "avg_event_delay_ms": dict(warn=0.35, fail=0.80, low=300.0, high=1200.0, factor=1.8, top=None, warn_default=400.0, fail_default=1200.0),
}


def auto_threshold_tuner(minutes: DataFrame, keys=("profile_id",)) -> DataFrame:
    """Warn and fail thresholds from the positive minute values of each measure.

    The measures are laid under each other, so one sort ranks the values of all of them.
    """
    keys = list(keys)
    values = F.array(*[F.struct(F.lit(m).alias("_m"), F.col(m).cast("double").alias("_value")) for m in TUNING])
    long = minutes.select(*keys, F.inline(values)).where("_value > 0")
    name_of = lambda q: f"_q{round(100 * q)}"
    shares = sorted({t[k] for t in TUNING.values() for k in ("warn", "fail")})
    ranked = exact_quantiles(long, [*keys, "_m"], "_value", {name_of(q): q for q in shares}, "linear")
    picked = [F.max(F.when(F.col("_m") == m, F.array(name_of(t["warn"]), name_of(t["fail"])))).alias(f"_{m}") for m, t in TUNING.items()]
    # a key without any positive value has the fallbacks; null keys stay apart, as in the rows
    named = minutes.select(*keys).distinct()
    found = ranked.groupBy(*keys).agg(*picked)
    wide = named.join(found.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[f"_{m}" for m in TUNING]), [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)], "left")
    out = []
    for m, t in TUNING.items():
        q, name = F.col(f"_{m}"), m.replace("_rate", "").replace("_ratio", "").replace("_gap_score", "").replace("avg_event_", "").replace("_ms", "")
        warn = F.least(F.greatest(F.lit(t["low"]), F.round(q[0], 6)), F.lit(t["high"]))
        fail = F.greatest(F.round(q[1], 6), F.round(warn * t["factor"], 6))
        if t["top"] is not None:
            fail = F.least(fail, F.lit(t["top"]))
        out += [F.when(q.isNull(), t["warn_default"]).otherwise(warn).alias(f"{name}_warn"), F.when(q.isNull(), t["fail_default"]).otherwise(fail).alias(f"{name}_fail")]
    return wide.select(*keys, *out)


def stream_validation(layers: DataFrame) -> DataFrame:
    """Four rules per day over the layer counts.

    ``layers`` has canonical_count, stream_count, missing_id_count, duplicate_key_count and stream_risk.
    """
    can, n = F.col("canonical_count"), F.col("stream_count")
    share = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    lost = (n == 0) & (can > 0)

    def rule(name, group, observed, expected, status, severity):
        return F.struct(F.lit(name).alias("rule_name"), F.lit(group).alias("rule_group"), observed.cast("double").alias("observed_value"),
                        expected.cast("double").alias("expected_value"), status.alias("validation_status"), severity.alias("severity"))

    flag = lambda c: (F.when(F.col(c) > 0, "warn").otherwise("pass"), F.when(F.col(c) > 0, "medium").otherwise("info"))
    rules = [
        rule("canonical_stream_count_aligned", "lineage", n, can, F.when(lost, "fail").when(n != can, "warn").otherwise("pass"),
             F.when(lost, "high").when(n != can, "medium").otherwise("info")),
        rule("canonical_event_id_present", "completeness", share("missing_id_count"), F.lit(0), *flag("missing_id_count")),
        rule("duplicate_canonical_key_check", "duplicate", share("duplicate_key_count"), F.lit(0), *flag("duplicate_key_count")),
        rule("stream_summary_available", "risk", F.coalesce("stream_risk", F.lit(0.0)), F.lit(0), F.lit("pass"), F.lit("info")),
    ]
    return layers.select("profile_id", "dt", F.inline(F.array(*rules)))


SEVERITY_RANK = {"high": 4, "medium": 3, "low": 2, "info": 1}


def stream_validation_summary(rules: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for p in SEVERITY_RANK.items() for x in p])
    names = F.create_map(*[F.lit(x) for k, v in SEVERITY_RANK.items() for x in (v, k)])
    status = F.col("validation_status")
    out = rules.groupBy("profile_id", "dt").agg(
        F.count("*").alias("total_rules"), *[F.count_if(status == s).alias(f"{s}_count") for s in ("pass", "warn", "fail")],
        F.max(F.try_element_at(rank, F.col("severity"))).alias("_rank"),
    )
    score = (F.col("fail_count") * 2 + F.col("warn_count")) / F.greatest("total_rules", F.lit(1))
    return out.select("*", F.try_element_at(names, F.col("_rank")).alias("highest_severity"), F.round(score, 6).alias("validation_score")).drop("_rank")
