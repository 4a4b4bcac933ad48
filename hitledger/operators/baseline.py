"""Rolling baselines, control limits, expected values, thresholds and statistical evidence.

All inputs are day facts. A window is never a range join: each history row is
sent to the target days it serves, and the group-by that follows combines on
the map side.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N
from .quantiles import exact_quantiles

BASELINE = "baseline"
SERIES = ("dimension_type", "dimension_key", "metric_name")


def to_targets(history: DataFrame, targets: DataFrame, days: int = 30, include_target: bool = False, day: str = "dt") -> DataFrame:
    """Each history row once per target day whose trailing window holds it.

    ``targets`` has profile_id and target_date; it is spread over the days of
    its windows, so history rows are copied only where a target needs them.
    """
    last = F.col("target_date") if include_target else F.date_sub("target_date", 1)
    window = F.explode(F.sequence(F.date_sub("target_date", days), last)).alias(day)
    return history.join(targets.select("profile_id", "target_date").distinct().select("profile_id", "target_date", window), ["profile_id", day])


def _stats(v: str, percentiles: dict[str, float]):
    out = [F.avg(v).alias("mean_value"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("sd_value")]
    return out + [F.percentile(v, F.lit(p)).alias(n) for n, p in percentiles.items()]


def metric_baseline(history: DataFrame, targets: DataFrame, days: int = 30, include_target: bool = False) -> DataFrame:
    """Mean, population deviation and percentiles of each metric over the window."""
    rows = to_targets(history.where(F.col("scenario_name") == BASELINE), targets, days, include_target)
    return rows.groupBy("profile_id", "target_date", "metric_scope", "metric_name").agg(
        *_stats("current_value", {"p50_value": 0.50, "p95_value": 0.95, "p99_value": 0.99}), F.count("current_value").alias("sample_days")
    )


def distribution_baseline(history: DataFrame, targets: DataFrame, days: int = 30, include_target: bool = False) -> DataFrame:
    rows = to_targets(history.where(F.coalesce("scenario_name", F.lit(BASELINE)) == BASELINE), targets, days, include_target)
    return rows.groupBy("profile_id", "target_date", "dimension_name", "dimension_value").agg(
        F.avg("event_count").alias("baseline_count_avg"), F.stddev_pop("event_count").alias("baseline_count_std"),
        F.avg("event_ratio").alias("baseline_ratio_avg"), F.stddev_pop("event_ratio").alias("baseline_ratio_std"),
        F.percentile("event_ratio", F.lit(0.5)).alias("baseline_ratio_p50"), F.percentile("event_ratio", F.lit(0.95)).alias("baseline_ratio_p95"),
        F.count_distinct("dt").alias("sample_days"),
    )


# Scope, name and source column of the metrics compared day by day.
DELTA_METRICS = [
    ("behavior_volume", "event_count"), ("behavior_volume", "pv"), ("behavior_volume", "uv"), ("behavior_volume", "visit"),
    ("behavior_funnel", "conversion_rate"), ("behavior_funnel", "collector_capture_rate"), ("behavior_funnel", "estimated_missing_rate"),
    ("observability", "web_hits"), ("observability", "wc_hits"), ("observability", "canonical_behavior_events"),
    ("observability", "collection_gap_rate"), ("observability", "canonical_gap_rate"), ("observability", "checkout_missing_rate"),
    ("observability", "product_missing_rate"), ("observability", "uv_gap_rate"),
]


def metric_rows(wide: DataFrame, keys=("profile_id", "dt", "scenario_name"), metrics=DELTA_METRICS) -> DataFrame:
    """Wide day facts as (metric_scope, metric_name, current_value)."""
    items = [
        F.struct(F.lit(s).alias("metric_scope"), F.lit(n).alias("metric_name"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("current_value"))
        for s, n in metrics if n in wide.columns
    ]
    extra = ["web_hits"] if "web_hits" in wide.columns else []
    return wide.select(*keys, *[F.col(c).cast("double").alias("day_web_hits") for c in extra], F.inline(F.array(*items)))


def _delta_parts(current: Column, base: Column, std: Column):
    delta = current - base
    rate = F.abs(delta) / F.greatest(F.abs(base), F.lit(1.0))
    z = F.when(std > 0, F.abs(delta) / F.greatest(std, F.lit(1e-9))).otherwise(0.0)
    return delta, rate, z


def metric_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each metric against its baseline, with the rules for a missing one."""
    b = baseline.select("profile_id", F.col("target_date").alias("dt"), "metric_scope", "metric_name", F.col("mean_value").alias("_avg"), F.col("sd_value").alias("_sd"))
    j = current.join(b, ["profile_id", "dt", "metric_scope", "metric_name"], "left")
    name, calm, none = F.col("metric_name"), F.col("scenario_name") == BASELINE, F.col("_avg").isNull()
    rate_like = name.endswith("gap_rate") | name.endswith("missing_rate")
    in_obs = F.col("metric_scope") == "observability"
    web = F.col("day_web_hits") if "day_web_hits" in current.columns else F.lit(0.0)
    collected = none & ~rate_like & in_obs & name.isin("wc_hits", "canonical_behavior_events") & (web > 0)
    source = none & ~rate_like & in_obs & (name == "web_hits")
    zero = none & rate_like & ~calm
    base = F.when(zero, 0.0).when(collected, web).when(source, F.col("current_value")).otherwise(F.col("_avg"))
    sd = F.when(none, F.when(zero | collected | source, 0.0)).otherwise(F.col("_sd"))
    status = (
        F.when(zero, "baseline_available_zero_expected").when(collected, "same_run_webserver_expected").when(source, "same_run_source_reference")
        .when(~none, "baseline_available").when(calm, "BASELINE_SELF_REFERENCE").otherwise("BASELINE_MISSING_REVIEW")
    )
    j = j.select("*", base.alias("baseline_value_avg"), sd.alias("baseline_value_std"), status.alias("baseline_status"))
    cur, av = F.col("current_value"), F.col("baseline_value_avg")
    delta, rate, z = _delta_parts(cur, av, F.col("baseline_value_std"))
    calm0 = lambda e: F.when(av.isNotNull(), e).when(calm, 0.0)
    score = F.when(av.isNotNull(), F.greatest(F.least(rate / 0.20, F.lit(1.0)), F.least(z / 5.0, F.lit(1.0)))).otherwise(0.0)
    known = F.col("baseline_status").startswith("baseline_available")
    score = F.when(rate_like & known, F.greatest(score, F.least(F.abs(cur) / 0.20, F.lit(1.0)))).otherwise(score)
    out = j.select("*", calm0(delta).alias("absolute_delta"), calm0(rate).alias("delta_rate"), calm0(z).alias("z_score"), score.alias("risk_score"))
    label = F.when(F.col("baseline_status") == "BASELINE_MISSING_REVIEW", F.col("baseline_status")).otherwise(N.level_band("risk_score", "status"))
    return out.withColumn("risk_status", label).drop("_avg", "_sd")


def distribution_shift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Share of each dimension value against its baseline share."""
    keys = ["profile_id", "dt", "dimension_name", "dimension_value"]
    b = baseline.withColumnRenamed("target_date", "dt").select(*keys, "baseline_count_avg", "baseline_ratio_avg", "baseline_ratio_std")
    j = current.join(b, keys, "left")
    have, calm = F.col("baseline_ratio_avg").isNotNull(), F.col("scenario_name") == BASELINE
    delta = F.abs(F.col("event_ratio") - F.col("baseline_ratio_avg"))
    sd = F.coalesce("baseline_ratio_std", F.lit(0.0))
    z = F.when(sd > 0, delta / F.greatest(sd, F.lit(1e-9))).otherwise(0.0)
    return j.select(
        *keys, "scenario_name", F.col("event_count").alias("current_count"), F.col("event_ratio").alias("current_ratio"),
        F.when(have, F.col("baseline_count_avg")).when(calm, F.col("event_count")).alias("baseline_count_avg"),
        F.when(have, F.col("baseline_ratio_avg")).when(calm, F.col("event_ratio")).alias("baseline_ratio_avg"),
        F.when(have, delta).when(calm, 0.0).alias("ratio_delta"), F.when(have, z).when(calm, 0.0).alias("z_score"),
        F.when(have, F.least(F.lit(1.0), F.greatest(delta / 0.20, z / 5.0))).otherwise(0.0).alias("distribution_shift_score"),
        F.when(have, "baseline_available").when(calm, "BASELINE_SELF_REFERENCE").otherwise("BASELINE_MISSING_REVIEW").alias("baseline_status"),
    )


def resolve_baseline(scopes: DataFrame, baseline: DataFrame, same_run=("source_wc_collection_missing",)) -> DataFrame:
    """Which baseline a scope uses, and how far its analysis can be trusted."""
    have = baseline.groupBy("profile_id", F.col("target_date").alias("dt")).agg(F.lit(1).alias("baseline_available"))
    j = scopes.join(have, ["profile_id", "dt"], "left").fillna(0, subset=["baseline_available"])
    own = F.col("scenario_name").isin(*same_run)
    ok = F.col("baseline_available") == 1
    policy = F.when(own, "same_run_evidence_baseline").when(ok, "use_baseline_snapshot").otherwise("BASELINE_MISSING_REVIEW")
    return j.select("*", policy.alias("fallback_policy"), F.when(ok | own, "high").otherwise("low").alias("analysis_confidence"))


# --- gap features and their profiles -----------------------------------------


def feature_snapshot(metric_gap: DataFrame, url_gap: DataFrame, client_gap: DataFrame, scope=("profile_id", "dt", "scenario_name")) -> DataFrame:
    """Gap tables as (dimension_type, dimension_key, metric_name, value) rows, one per key.

    Platform, app and SDK levels are measured at their own level, not overwritten
    by their finest rows.
    """
    head = [*scope, *SERIES, "metric_value", "webserver_value", "wc_value", "missing_value", "source_table"]
    base = metric_gap.select(
        *scope, "dimension_type", F.col("dimension_value").alias("dimension_key"), F.concat("metric_name", F.lit("_gap_rate")).alias("metric_name"),
        F.col("gap_rate").alias("metric_value"), F.col("web_value").alias("webserver_value"), "wc_value", "missing_value", F.lit("metric_gap").alias("source_table"),
    )
    levels = base.where("metric_name = 'event_count_gap_rate' AND dimension_type <> 'all'").withColumn("metric_name", F.lit("collection_gap_rate")).withColumn("source_table", F.lit("app_gap"))

    def rates(rows: DataFrame, kind: str, keys) -> DataFrame:
        one = lambda name, m, rate: F.struct(
            F.lit(name).alias("metric_name"), F.col(rate).alias("metric_value"), F.col(f"web_{m}").cast("double").alias("webserver_value"),
            F.col(f"wc_{m}").cast("double").alias("wc_value"),
        )
        long = rows.select(*scope, F.concat_ws("|", *keys).alias("dimension_key"),
                           F.inline(F.array(one("collection_gap_rate", "event_count", "missing_rate"), one("uv_gap_rate", "uv", "uv_missing_rate"))))
        lost = F.greatest(F.lit(0.0), F.col("webserver_value") - F.col("wc_value"))
        return long.select("*", F.lit(kind).alias("dimension_type"), lost.alias("missing_value"), F.lit(f"{kind}_gap").alias("source_table"))

    app = ("app_platform", "app_version", "sdk_version")
    url = rates(url_gap, "url", (*app, "surface_path"))
    client = rates(client_gap, "client", (*app, "device_type", "browser_family", "os_family"))
    out = base.select(*head)
    for part in (levels, url, client):
        out = out.unionByName(part.select(*head))
    return out


def _quality(days: Column, min_days: int):
    score = F.when(days <= 0, 0.0).otherwise(F.least(F.lit(1.0), days / float(max(1, min_days))))
    status = F.when(days <= 0, "missing").when(days >= min_days, "usable").otherwise("low_sample")
    return score, status


def _by_type(rows: DataFrame) -> DataFrame:
    """Rows of a target once as rolling history, and once more on its own weekday."""
    same = F.dayofweek("dt") == F.dayofweek("target_date")
    kinds = F.array_compact(F.array(F.lit("rolling_30d"), F.when(same, F.lit("same_weekday"))))
    return rows.withColumn("baseline_type", F.explode(kinds))


def _sum(values: str, of=lambda x: x) -> Column:
    """Sum in the order of the array, so that it does not depend on partitions."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))


def _share(q: float) -> Column:
    """Linear percentile of the sorted values ``_s``."""
    at = (F.size("_s") - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    lo, hi = F.get("_s", low), F.get("_s", F.least(low + 1, F.size("_s") - 1))
    return lo * (low + 1 - at) + hi * (at - low)


def stat_profile(features: DataFrame, targets: DataFrame, days: int = 30, min_days: int = 3, include_target: bool = False) -> DataFrame:
    """Rolling and same-weekday profile of every gap metric, with control limits.

    A series has one value a day, so its history is an array that the calendar
    bounds. History rows are shuffled once; a target day takes its window, and
    the days of its own weekday, out of the array, and sums run in order of the
    days.
    """
    rows = features.where(F.col("scenario_name") == BASELINE)
    history = rows.groupBy("profile_id", *SERIES).agg(F.array_sort(F.collect_list(F.struct("dt", F.col("metric_value").cast("double").alias("v")))).alias("_h"))
    asked = targets.select("profile_id", "target_date").distinct().groupBy("profile_id").agg(F.collect_list("target_date").alias("_t"))
    d = history.join(asked, "profile_id").select("profile_id", *SERIES, "_h", F.explode("_t").alias("target_date"))
    last = F.col("target_date") if include_target else F.date_sub("target_date", 1)
    window = F.filter("_h", lambda x: (x["dt"] >= F.date_sub("target_date", days)) & (x["dt"] <= last))
    d = d.select("profile_id", "target_date", *SERIES, F.explode(F.array(window)).alias("_w")).where(F.size("_w") > 0)
    weekday = F.filter("_w", lambda x: F.dayofweek(x["dt"]) == F.dayofweek("target_date"))
    kinds = F.array(F.struct(F.lit("rolling_30d").alias("baseline_type"), F.col("_w").alias("_x")), F.struct(F.lit("same_weekday").alias("baseline_type"), weekday.alias("_x")))
    d = d.select("profile_id", "target_date", *SERIES, F.inline(kinds)).where(F.size("_x") > 0)
    d = d.withColumn("_v", F.array_compact(F.transform("_x", lambda x: x["v"]))).withColumn("_s", F.array_sort("_v")).withColumn("_n", F.nullif(F.size("_v"), F.lit(0)))
    d = d.withColumn("mean_value", _sum("_v") / F.col("_n"))
    deviation = F.sqrt(_sum("_v", lambda x: (x - F.col("mean_value")) * (x - F.col("mean_value"))) / F.col("_n"))
    shares = {"median_value": 0.50, "p75_value": 0.75, "p90_value": 0.90, "p95_value": 0.95, "p99_value": 0.99}
    out = d.select(
        "profile_id", "target_date", "baseline_type", *SERIES, F.size(F.array_distinct(F.transform("_x", lambda x: x["dt"]))).alias("sample_days"),
        "mean_value", F.coalesce(deviation, F.lit(0.0)).alias("sd_value"), *[F.when(F.col("_n").isNotNull(), _share(q)).alias(n) for n, q in shares.items()],
        F.array_min("_v").alias("min_value"), F.array_max("_v").alias("max_value"),
    )
    m, sd = F.col("mean_value"), F.col("sd_value")
    score, status = _quality(F.col("sample_days"), min_days)
    return out.select(
        "*", F.greatest(F.lit(0.0), m - 3 * sd).alias("lower_control_limit"), (m + 3 * sd).alias("upper_control_limit"),
        score.alias("quality_score"), status.alias("baseline_status"),
    )


def baseline_reference(features: DataFrame, targets: DataFrame, days: int = 30, min_days: int = 3, include_target: bool = False) -> DataFrame:
    """Window bounds, day count and usability per target and baseline type; a row even without data."""
    days_seen = features.where(F.col("scenario_name") == BASELINE).select("profile_id", "dt").distinct()
    seen = _by_type(to_targets(days_seen, targets, days, include_target)).groupBy("profile_id", "target_date", "baseline_type").agg(F.count("*").alias("sample_days"))
    policy = {"rolling_30d": "primary", "same_weekday": "fallback_to_rolling_30d_when_low_sample"}
    kinds = F.array(*[F.struct(F.lit(k).alias("baseline_type"), F.lit(p).alias("fallback_policy")) for k, p in policy.items()])
    all_rows = targets.select("profile_id", "target_date").distinct().select("profile_id", "target_date", F.inline(kinds))
    j = all_rows.join(seen, ["profile_id", "target_date", "baseline_type"], "left").fillna(0, subset=["sample_days"])
    score, _ = _quality(F.col("sample_days"), min_days)
    return j.select(
        "*", F.date_sub("target_date", days).alias("baseline_start_date"), (F.col("target_date") if include_target else F.date_sub("target_date", 1)).alias("baseline_end_date"),
        (F.col("sample_days") >= min_days).cast("int").alias("is_usable"), score.alias("quality_score"),
    )


def select_baseline(profile: DataFrame) -> DataFrame:
    """One profile per series: a usable same-weekday one, else rolling, else the best left."""
    kind, ok = F.col("baseline_type"), F.col("baseline_status") == "usable"
    rank = F.when((kind == "same_weekday") & ok, 3).when(kind == "rolling_30d", 2).otherwise(1)
    keys = ["profile_id", "target_date", *SERIES]
    rest = [c for c in profile.columns if c not in keys]
    return profile.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(rank, "quality_score")).alias("b")).select(*keys, "b.*")


def baseline_compare(features: DataFrame, profile: DataFrame) -> DataFrame:
    """Current gap metrics against their selected profile; only the upper limit can be breached."""
    b = select_baseline(profile).withColumnRenamed("target_date", "dt").drop("source_table")
    j = features.join(b, ["profile_id", "dt", *SERIES])
    cur, m, sd, up = (F.col(c) for c in ("metric_value", "mean_value", "sd_value", "upper_control_limit"))
    delta = cur - m
    z = F.when(F.coalesce(F.abs(sd) < 1e-12, F.lit(True)), F.when(F.abs(delta) < 1e-12, 0.0).otherwise(999.0)).otherwise(delta / F.when(F.abs(sd) >= 1e-12, sd))
    breach = F.coalesce((cur > up).cast("int"), F.lit(0))
    band = F.when(cur.isNull(), "unknown")
    for p in (99, 95, 90, 75):
        band = band.when(cur >= F.col(f"p{p}_value"), f"p{p}_plus")
    zz = F.coalesce(F.abs(z), F.lit(0.0))
    severity = (
        F.when(cur.isNull() | (F.col("sample_days") <= 0), "unknown").when((breach == 1) & (zz >= 5), "critical")
        .when((breach == 1) | (zz >= 3), "warning").when(zz >= 2, "watch").otherwise("normal")
    )
    return j.select(
        *[c for c in features.columns], F.col("baseline_type").alias("selected_baseline_type"), m.alias("baseline_mean"), sd.alias("baseline_sd"), up.alias("baseline_upper_control_limit"),
        "sample_days", F.col("quality_score").alias("baseline_quality_score"), "baseline_status", delta.alias("baseline_delta"), z.alias("z_score"),
        band.otherwise("normal_band").alias("percentile_band"), breach.alias("control_limit_breach"), severity.alias("severity"),
    )


def recent_mean(features: DataFrame, targets: DataFrame, days: int = 7) -> DataFrame:
    """Mean and day count of the last ``days`` calendar days, the target included."""
    rows = to_targets(features.where(F.col("scenario_name") == BASELINE), targets, days - 1, include_target=True)
    return rows.groupBy("profile_id", "target_date", *SERIES).agg(F.avg("metric_value").alias("recent_mean"), F.count_distinct("dt").alias("recent_sample_days"))


MODEL_WEIGHTS = {"rolling": 0.50, "weekday": 0.30, "recent": 0.20}
# Least source volume for a dimension to be judged.
VOLUME_FLOORS = {"url": 100, "client": 100, "app_version": 50, "sdk_version": 50, "app_sdk": 50}


def expected_metric(features: DataFrame, profile: DataFrame, recent: DataFrame, min_days: int = 3, recent_days: int = 7) -> DataFrame:
    """Expected value from rolling, weekday and recent means; weights of missing parts are shared out."""
    keys = ["profile_id", "dt", *SERIES]
    kind = F.col("baseline_type")
    pick = lambda t, c: F.max(F.when(kind == t, F.col(c)))
    p = profile.withColumnRenamed("target_date", "dt").groupBy(*keys).agg(
        pick("rolling_30d", "mean_value").alias("rolling_mean"), pick("rolling_30d", "sd_value").alias("_rsd"), pick("rolling_30d", "sample_days").alias("_rdays"), pick("rolling_30d", "quality_score").alias("_rq"),
        pick("same_weekday", "mean_value").alias("weekday_mean"), pick("same_weekday", "sample_days").alias("_wdays"), pick("same_weekday", "quality_score").alias("_wq"),
    )
    j = features.join(p, keys, "left").join(recent.withColumnRenamed("target_date", "dt").withColumnRenamed("recent_mean", "_recent"), keys, "left")
    j = j.fillna(0, subset=["_rsd", "_rdays", "_rq", "_wdays", "_wq", "recent_sample_days"])
    c = F.col
    weekday_ok = c("weekday_mean").isNotNull() & (c("_wdays") >= min_days)
    by = lambda w, r: F.when(weekday_ok, c(w)).otherwise(c(r))
    j = j.select(
        "*", by("weekday_mean", "rolling_mean").alias("selected_baseline_mean"), by("_wdays", "_rdays").alias("selected_sample_days"), by("_wq", "_rq").alias("baseline_quality_score")
    ).withColumn("recent_7d_mean", F.coalesce("_recent", "selected_baseline_mean"))
    parts = {"rolling": c("rolling_mean"), "weekday": c("selected_baseline_mean"), "recent": c("recent_7d_mean")}
    total = sum(F.when(v.isNotNull(), MODEL_WEIGHTS[n]).otherwise(0.0) for n, v in parts.items())
    summed = sum(F.coalesce(v * MODEL_WEIGHTS[n], F.lit(0.0)) for n, v in parts.items())
    j = j.withColumn("expected_value", F.when(total > 0, summed / F.when(total > 0, total)))
    cur, e, sd = c("metric_value"), c("expected_value"), c("_rsd")
    delta = cur - e
    rate = F.when(F.abs(e) >= 1e-12, delta / F.when(F.abs(e) >= 1e-12, F.abs(e))).when(F.abs(delta) < 1e-12, 0.0)
    days, near = c("selected_sample_days"), c("recent_sample_days")
    model = F.when(days <= 0, "missing_baseline").when(days < min_days, "low_sample").when(near < min(3, min_days), "low_recent_sample").otherwise("usable")
    volume = F.coalesce(c("webserver_value"), F.lit(0.0))
    low = F.lit(False)
    for t, floor in VOLUME_FLOORS.items():
        low = low | ((c("dimension_type") == t) & (volume < floor))
    dim = F.when(low, "low_volume").otherwise("ok")
    trust = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("baseline_quality_score")) * 0.7 + F.least(F.lit(1.0), near / float(recent_days)) * 0.3)
    return j.select(
        *features.columns, "rolling_mean", "weekday_mean", "recent_7d_mean", "selected_baseline_mean", "selected_sample_days", c("_rdays").alias("rolling_sample_days"), "recent_sample_days", "baseline_quality_score",
        "expected_value", F.greatest(F.lit(0.0), e - 3 * sd).alias("expected_lower"), (e + 3 * sd).alias("expected_upper"), delta.alias("expected_delta"), rate.alias("expected_delta_rate"),
        F.coalesce((cur > e + 3 * sd).cast("int"), F.lit(0)).alias("expected_breach"), trust.alias("expected_confidence"), model.alias("model_status"), dim.alias("dimension_quality_status"),
        F.when((model == "usable") & (dim == "ok"), "usable").when(model == "missing_baseline", "missing").otherwise("low_quality").alias("quality_status"),
    )


# Policy of each dimension, its default levels and least row count.
POLICIES = {
    "sensitive": (("all", "app_platform", "sdk_version"), (0.04, 0.08, 0.20)),
    "version_sensitive": (("app_version", "app_sdk"), (0.04, 0.08, 0.18)),
    "volume_guarded": (("url", "client"), (0.08, 0.15, 0.30)),
    "default": ((), (0.05, 0.10, 0.25)),
}
MIN_ROWS = {"url": 100, "client": 100, "app_version": 30, "app_sdk": 30}


def threshold_calibration(expected: DataFrame, scope=("profile_id", "dt", "scenario_name"), min_days: int = 3) -> DataFrame:
    """Watch, warning and critical level per dimension type and metric, never below policy or each other."""
    keys = [*scope, "dimension_type", "metric_name"]
    rows = expected.withColumn("_v", F.abs(F.coalesce("expected_delta_rate", F.lit(0.0))))
    out = rows.groupBy(*keys).agg(
        F.max("rolling_sample_days").alias("sample_days"), F.count("*").alias("row_count"), F.avg("_v").alias("mean_value"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("sd_value")
    )
    # a url dimension has a row per path: its percentiles are searched slice by slice
    out = out.join(exact_quantiles(rows, keys, "_v", {"p90_value": 0.90, "p95_value": 0.95, "p99_value": 0.99}, "linear"), keys)
    dim = F.col("dimension_type")
    policy, least = F.lit("default"), F.lit(1)
    for name, (dims, _) in POLICIES.items():
        policy = F.when(dim.isin(*dims), name).otherwise(policy) if dims else policy
    for d, n in MIN_ROWS.items():
        least = F.when(dim == d, n).otherwise(least)
    level = lambda k: F.coalesce(*[F.when(F.col("dimension_policy") == n, cuts[k]) for n, (_, cuts) in POLICIES.items()])
    out = out.select("*", policy.alias("dimension_policy"), least.alias("min_sample_count"))
    out = out.withColumn("watch_threshold", F.greatest(level(0), F.col("p90_value")))
    out = out.withColumn("warning_threshold", F.greatest(level(1), F.col("p95_value"), F.col("watch_threshold")))
    out = out.withColumn("critical_threshold", F.greatest(level(2), F.col("p99_value"), F.col("warning_threshold")))
    quality = F.when(F.col("sample_days") >= min_days, "usable").otherwise("low_sample")
    guarded = (F.col("dimension_policy") == "volume_guarded") & (F.col("row_count") < F.col("min_sample_count"))
    return out.select("*", quality.alias("quality_status"), F.when(guarded, "low_volume").otherwise(quality).alias("calibration_status"))


# --- statistical evidence ----------------------------------------------------

EVIDENCE_LEVELS = ([(0.75, "critical"), (0.55, "warning"), (0.30, "watch"), (0.08, "low")], "stable")


def history_snapshot(delta: DataFrame, targets: DataFrame, days: int = 30) -> DataFrame:
    """The baseline rows of the trailing window, keyed by target day."""
    rows = delta.where(F.col("scenario_name") == BASELINE).withColumn("history_date", F.col("dt"))
    return to_targets(rows, targets, days, include_target=True)


def statistical_evidence(current: DataFrame, history: DataFrame, value: str, series=("metric_scope", "metric_name"), domain: str = "batch_metric_delta",
                         days: int = 30, min_days: int = 3, floor_zero: bool = True) -> DataFrame:
    """Each current value against its baseline history: z, percentile, limits, one score.

    Uses the sample deviation; the percentile counts values up to and including the current one.
    """
    keys = ["profile_id", "dt", "scenario_name", *series]
    past = to_targets(history.where(F.col("scenario_name") == BASELINE), current.select("profile_id", F.col("dt").alias("target_date")), days, include_target=True)
    past = past.select("profile_id", F.col("target_date").alias("_t"), *series, F.col(value).alias("_h"), F.col("dt").alias("_d"))
    cur = current.select(*keys, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("current_value"))
    j = cur.join(past.withColumnRenamed("_t", "dt"), ["profile_id", "dt", *series], "left")
    out = j.groupBy(*keys, "current_value").agg(
        F.avg("_h").alias("baseline_mean"), F.when(F.count("_h") > 0, F.coalesce(F.stddev_samp("_h"), F.lit(0.0))).otherwise(0.0).alias("baseline_sd"),
        F.count_distinct("_d").alias("sample_days"), F.round(100 * F.avg(F.when(F.col("_h").isNotNull(), (F.col("_h") <= F.col("current_value")).cast("double"))), 4).alias("historical_percentile"),
    )
    return score_evidence(out, domain, min_days, floor_zero)


def score_evidence(stats: DataFrame, domain: str, min_days: int = 3, floor_zero: bool = True) -> DataFrame:
    c = F.col
    m, sd, x, days, pct = c("baseline_mean"), c("baseline_sd"), c("current_value"), c("sample_days"), c("historical_percentile")
    delta = x - m
    rate = F.when(m.isNotNull() & (F.abs(m) > 0), F.abs(delta) / F.when(F.abs(m) > 0, F.abs(m))).otherwise(F.abs(delta))
    low = m - 3 * sd
    low = F.greatest(F.lit(0.0), low) if floor_zero else low
    out = stats.select(
        "*", F.lit(domain).alias("evidence_domain"), delta.alias("baseline_delta"), rate.alias("baseline_delta_rate"), F.when(sd > 0, delta / F.when(sd > 0, sd)).otherwise(0.0).alias("z_score"),
        F.when(m.isNotNull(), low).alias("control_limit_lower"), (m + 3 * sd).alias("control_limit_upper"),
    )
    breach = F.coalesce((x > c("control_limit_upper")) | (x < c("control_limit_lower")), F.lit(False)).cast("int")
    step = F.when(pct >= 99, 1.0).when(pct >= 95, 0.7).when(pct >= 90, 0.4).otherwise(0.0)
    cap = lambda e: F.least(F.coalesce(F.abs(e), F.lit(0.0)), F.lit(1.0))
    score = N.clamp01(0.35 * cap(c("z_score") / 5) + 0.25 * step + 0.25 * c("control_limit_breach") + 0.15 * cap(c("baseline_delta_rate") / 0.25))
    out = out.withColumn("control_limit_breach", breach)
    out = out.withColumn("statistical_score", F.when(days < min_days, 0.0).otherwise(score))
    enough = days >= min_days
    return out.select(
        "*", N.level_band("statistical_score", EVIDENCE_LEVELS).alias("statistical_significance"),
        F.when(enough, 1.0).otherwise(F.least(F.lit(0.99), days / float(min_days))).alias("baseline_quality_score"),
        F.when(enough, "history_available").otherwise("LOW_SAMPLE_HISTORY").alias("baseline_status"),
        F.when(~enough, "LOW_SAMPLE_HISTORY").when(c("statistical_score") >= 0.3, "SIGNAL").otherwise("PASS").alias("analysis_status"),
    )


def co_movement(evidence: DataFrame, scope=("profile_id", "dt", "scenario_name", "evidence_domain")) -> DataFrame:
    """Share of a domain's metrics that moved, on every row of the domain."""
    per = evidence.groupBy(*scope).agg(F.count_if(F.col("statistical_score") >= 0.3).alias("affected_metrics"), F.count("*").alias("_n"))
    share = F.col("affected_metrics") / F.col("_n")
    level = F.when(share >= 0.5, "high").when(share >= 0.25, "medium").when(share > 0, "low").otherwise("none")
    per = per.select(*scope, "affected_metrics", share.alias("co_movement_score"), level.alias("co_movement_level"))
    return evidence.join(per, list(scope))


def reference_rows(expected: DataFrame) -> DataFrame:
    """Expected-model rows as evidence that carries no statistical score."""
    return expected.select(
        "profile_id", "dt", "scenario_name", F.lit("observability_expected").alias("evidence_domain"), *SERIES, F.col("metric_value").alias("current_value"), "expected_value", "expected_delta",
        "expected_delta_rate", F.col("selected_sample_days").alias("sample_days"), "baseline_quality_score", F.col("model_status").alias("baseline_status"),
        F.lit(0.0).alias("statistical_score"), F.lit("stable").alias("statistical_significance"), F.lit("REFERENCE_DOMAIN_NOT_STATISTICAL").alias("analysis_status"),
    )


ENRICHED = ("historical_percentile", "control_limit_lower", "control_limit_upper", "control_limit_breach", "statistical_score", "statistical_significance", "baseline_quality_score", "co_movement_score")


def enrich_update(delta: DataFrame, evidence: DataFrame, keys=("profile_id", "dt", "scenario_name", "metric_scope", "metric_name")) -> DataFrame:
    """Metric deltas with the evidence columns of the same metric."""
    return delta.join(evidence.select(*keys, *ENRICHED), list(keys), "left")


PAIR_SCORES = (
    "event_count_delta", "pv_delta", "uv_delta", "visit_delta", "collection_gap", "canonical_gap", "checkout_missing", "product_missing",
    "behavior_distortion", "conversion_distortion", "session_fragmentation", "observability_gap",
)


def pair_co_movement(scores: DataFrame, keys=("profile_id", "dt", "scenario_name"), names=PAIR_SCORES) -> DataFrame:
    """The unordered pairs of a fixed list of day scores and how they move together."""
    have = [n for n in names if n in scores.columns]
    items = [
        F.struct(F.lit(f"{a}__{b}").alias("metric_pair"), F.lit(a).alias("left_metric"), F.lit(b).alias("right_metric"),
                 F.coalesce(F.col(a), F.lit(0.0)).alias("left_score"), F.coalesce(F.col(b), F.lit(0.0)).alias("right_score"))
        for a, b in combinations(have, 2)
    ]
    out = scores.select(*keys, F.inline(F.array(*items)))
    coupled = N.clamp01(F.sqrt(F.abs(F.col("left_score") * F.col("right_score"))))
    out = out.select("*", coupled.alias("coupled_score"), F.abs(F.col("left_score") - F.col("right_score")).alias("directional_gap"))
    kind = F.when(F.col("coupled_score") >= 0.60, "coupled_high_risk_movement").when(F.col("coupled_score") >= 0.20, "coupled_warning_movement").otherwise("neutral_or_decoupled_movement")
    return out.select("*", kind.alias("co_movement_type"), N.level_band("coupled_score", ([(0.60, "FAIL"), (0.20, "WARN")], "PASS")).alias("anomaly_status"))


def correlation(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """Pearson correlation of finite pairs; null below two pairs or without variance."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    ok = df.where(fine(x) & fine(y))
    out = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("_c"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"))
    use = (F.col("n") >= 2) & (F.col("_sx") > 0) & (F.col("_sy") > 0)
    return out.select(*keys, "n", F.when(use, F.col("_c")).alias("correlation"))


def psi(actual: DataFrame, base: DataFrame, value: str, keys, bins: int = 10) -> DataFrame:
    """Population stability index over the base's quantile bins; 0 where it cannot be built.

    Values of ``actual`` outside the base range fall into the outer bins.
    """
    keys = list(keys)
    wanted = {f"q{k}": k / bins for k in range(bins + 1)}
    cuts = exact_quantiles(base, keys, value, wanted, "linear").select(*keys, F.array_sort(F.array_distinct(F.array(*wanted))).alias("_cuts"))
    both = actual.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_a")).unionByName(base.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_a"))).where("_v IS NOT NULL")
    # intervals are closed above, the first one below too
    inner = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    bin_no = F.greatest(F.lit(1), F.least(inner, F.size("_cuts") - 1))
    counts = both.join(cuts, keys).groupBy(*keys, bin_no.alias("_bin"), F.size("_cuts").alias("_k")).agg(
        F.sum("_a").alias("a"), F.sum(1 - F.col("_a")).alias("b")
    )
    cells = cuts.where(F.size("_cuts") >= 3).select(*keys, F.explode(F.sequence(F.lit(1), F.size("_cuts") - 1)).alias("_bin"))
    full = cells.join(counts.drop("_k"), [*keys, "_bin"], "left").fillna(0, subset=["a", "b"])
    full = full.select(*keys, (F.col("a") + 0.5).alias("a"), (F.col("b") + 0.5).alias("b"))
    total = full.groupBy(*keys).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    score = full.join(total, keys).groupBy(*keys).agg(F.sum((p - q) * F.log(p / q)).alias("_s"))
    size = both.groupBy(*keys).agg(F.sum("_a").alias("_na"), F.sum(1 - F.col("_a")).alias("_nb"))
    enough = (F.col("_na") >= 2) & (F.col("_nb") >= 2)
    return size.join(score, keys, "left").select(*keys, F.when(enough, N.clamp01("_s")).otherwise(0.0).alias("psi"))


def metric_distribution(operational: DataFrame, metrics, keys=("profile_id",)) -> DataFrame:
    """Count, mean, sample deviation and percentiles of each operational metric."""
    items = F.array(*[F.struct(F.lit(m).alias("metric_name"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("v")) for m in metrics])
    q = {"p50_value": 0.50, "p75_value": 0.75, "p90_value": 0.90, "p95_value": 0.95, "p99_value": 0.99}
    return operational.select(*keys, F.inline(items)).groupBy(*keys, "metric_name").agg(
        F.count("*").alias("sample_count"), F.avg("v").alias("mean_value"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd_value"),
        F.min("v").alias("min_value"), *[F.percentile("v", F.lit(p)).alias(n) for n, p in q.items()], F.max("v").alias("max_value"),
    )


def threshold_profile(distribution: DataFrame, keys=("profile_id",)) -> DataFrame:
    return distribution.select(
        *keys, "metric_name", F.col("p95_value").alias("warn_threshold"), F.col("p99_value").alias("critical_threshold"),
        F.col("mean_value").alias("baseline_mean"), F.col("sd_value").alias("baseline_sd"),
    )


def feature_drift(snapshot: DataFrame, features, keys=("profile_id",), rows: int = 30) -> DataFrame:
    """Each feature against the last ``rows`` baseline rows before its day.

    Baseline rows are numbered by day; a target asks for its numbers, so the
    join is by equality.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("dt", "scenario_name")
    base = snapshot.where(F.col("scenario_name") == BASELINE).withColumn("_no", F.row_number().over(order))
    upto = base.groupBy(*keys, "dt").agg(F.count("*").alias("_c"))
    days = snapshot.select(*keys, "dt").distinct().join(upto, [*keys, "dt"], "left").fillna(0, subset=["_c"])
    before = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_hi", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    asks = days.where("_hi > 0").select(*keys, "dt", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_hi") - rows + 1), F.col("_hi"))).alias("_no"))
    long = lambda d, *head: d.select(*head, F.inline(F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("v")) for f in features])))
    past = asks.join(long(base, *keys, "_no"), [*keys, "_no"]).groupBy(*keys, "dt", "feature_name").agg(
        F.avg("v").alias("baseline_mean"), F.when(F.count("v") >= 2, F.stddev_pop("v")).alias("baseline_std")
    )
    now = long(snapshot, *keys, "dt", "scenario_name").withColumnRenamed("v", "feature_value")
    j = now.join(past, [*keys, "dt", "feature_name"], "left")
    z = F.when(F.col("baseline_std") > 0, (F.col("feature_value") - F.col("baseline_mean")) / F.when(F.col("baseline_std") > 0, F.col("baseline_std")))
    j = j.withColumn("z_score", z)
    drift = F.coalesce((F.abs("z_score") >= 3).cast("int"), F.lit(0))
    return j.select("*", drift.alias("drift_flag"), (F.coalesce(F.abs("z_score"), F.lit(0.0)) * 0.1).alias("importance_score"), F.when(drift == 1, "REVIEW").otherwise("PASS").alias("diagnostic_status"))


def previous_and_moving(scores: DataFrame, series, keys=("profile_id",), day: str = "dt", rows: int = 7) -> DataFrame:
    """Previous value (0 at the start), difference and trailing mean of day scores."""
    w = Window.partitionBy(*keys).orderBy(day)
    near = w.rowsBetween(-(rows - 1), 0)
    out = []
    for s in series:
        prev = F.lag(s, 1, 0.0).over(w)
        out += [prev.alias(f"{s}_prev"), (F.col(s) - prev).alias(f"{s}_diff"), F.avg(s).over(near).alias(f"{s}_ma{rows}")]
    return scores.select("*", *out)
