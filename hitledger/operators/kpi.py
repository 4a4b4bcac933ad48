"""Sessions, hourly and daily behavior measures, day inputs and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N, text as X
from .split import BUCKET, in_slices, micros

DAY = ("profile_id", "dt")
SESSION_GAP = 1800

# Group and layer of each measure.
GROUPS = {
    "user_activity": ("daily_active_users", "page_view_count", "avg_session_duration_sec", "new_user_ratio"),
    "auth_security": ("login_success_count", "auth_attempt_count", "auth_success_count", "auth_fail_count", "auth_success_rate", "auth_fail_rate", "otp_request_count", "risk_login_count"),
    "financial_service": ("loan_view_count", "loan_apply_start_count", "loan_apply_submit_count", "card_apply_start_count", "card_apply_submit_count", "card_apply_submit_rate"),
    "system_operation": ("raw_event_count", "collector_event_count", "batch_event_count", "estimated_missing_rate", "schema_change_count", "batch_delay_sec"),
}
# Event names each counter adds up.
COUNTERS = {
    "login_success_count": ("login_success", "auth_success"),
    "auth_attempt_count": ("auth_attempt", "auth_success", "auth_fail"),
    "auth_success_count": ("auth_success",),
    "auth_fail_count": ("auth_fail",),
    "otp_request_count": ("otp_request",),
    "risk_login_count": ("risk_login",),
    "loan_view_count": ("loan_view",),
    "loan_apply_start_count": ("loan_apply_start",),
    "loan_apply_submit_count": ("loan_apply_submit",),
    "card_apply_start_count": ("card_apply_start",),
    "card_apply_submit_count": ("card_apply_submit",),
}


def load_success(df: DataFrame) -> DataFrame:
    if "load_status" not in df.columns:
        return df
    return df.where(F.coalesce("load_status", F.lit("success")) == "success")


def named_hits(events: DataFrame, identity_mode: str = "uid_pcid_ip", pv_mode: str = "view_only") -> DataFrame:
    """Hits with identity, semantic event name and page view flag."""
    df, row = X.with_hit_row(load_success(events))
    df = df.withColumn("identity", X.identity_key(row, identity_mode)).withColumn("is_pv", X.is_pageview(row, pv_mode))
    return X.with_event_name(df, "semantic_event", "batch", pv_mode)


def sessionize(views: DataFrame, identity: str = "identity", ts: str = "ts", event_id: str = "event_id", gap: int = SESSION_GAP, keys=DAY) -> DataFrame:
    """Number the sessions of each identity: a new one starts after a gap longer than ``gap`` seconds.

    ``keys`` with the day restart sessions at midnight; without it they go on.
    Returns keys, identity, event id, _us, session_seq and session_start_us.
    An identity of very many views is walked in slices; whether a slice's first
    row opens a session, and which session was open, comes from those before it.
    """
    keys = [*keys, identity]
    rows = views.select(*keys, event_id, micros(ts).alias("_us"))
    rows = in_slices(rows, keys, "_us")
    near = Window.partitionBy(*keys, BUCKET).orderBy("_us", event_id)
    so_far = near.rowsBetween(Window.unboundedPreceding, 0)
    limit = gap * 1_000_000
    # 1 where a later row opens a session; the first row of a slice is settled below
    opens = (F.col("_us") - F.lag("_us").over(near) > limit).cast("bigint")
    walked = rows.withColumn("_opens", F.coalesce(opens, F.lit(0)))
    walked = walked.withColumn("_opened", F.sum("_opens").over(so_far)).withColumn("_begin", F.min("_us").over(so_far)).withColumn(
        "_start", F.max(F.when(F.col("_opens") == 1, F.col("_us"))).over(so_far)
    )
    slices = walked.where(F.col(BUCKET).isNotNull()).groupBy(*keys, BUCKET).agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.sum("_opens").alias("_n"), F.max("_start").alias("_inner")
    )
    along = Window.partitionBy(*keys).orderBy(BUCKET)
    until = along.rowsBetween(Window.unboundedPreceding, 0)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    before = F.lag("_last").over(along)
    slices = slices.withColumn("_head", (before.isNull() | (F.col("_first") - before > limit)).cast("bigint"))
    slices = slices.withColumn("_tail", F.coalesce("_inner", F.when(F.col("_head") == 1, F.col("_first"))))
    carry = slices.select(
        *keys, BUCKET,
        (F.sum(F.col("_n") + F.col("_head")).over(until) - F.col("_n")).alias("_base"),
        F.when(F.col("_head") == 1, F.col("_first")).otherwise(F.last("_tail", ignorenulls=True).over(earlier)).alias("_open"),
    )
    # an identity that stays whole opens its first session with its first row
    return walked.join(F.broadcast(carry), [*keys, BUCKET], "left").select(
        *keys, event_id, "_us", (F.coalesce("_base", F.lit(1)) + F.col("_opened")).alias("session_seq"), F.coalesce("_start", "_open", "_begin").alias("session_start_us")
    )


def _hour() -> Column:
    return F.hour(F.timestamp_micros("_us"))


def session_hour_visits(sessions: DataFrame, keys=DAY, identity: str = "identity") -> DataFrame:
    """Sessions seen per hour; one spanning hours counts in each."""
    per = sessions.select(*keys, _hour().alias("hh"), identity, "session_seq").distinct()
    return per.groupBy(*keys, "hh").agg(F.count("*").alias("visit"))


def running_session_duration(sessions: DataFrame) -> DataFrame:
    """Whole seconds since the session start at every page view."""
    sec = F.floor((F.col("_us") - F.col("session_start_us")) / 1_000_000)
    return sessions.withColumn("duration_sec", F.greatest(F.lit(0), sec))


def _hour_parts(hits: DataFrame) -> DataFrame:
    """Per hour, identity and session: counts, ready for distinct counting."""
    views = running_session_duration(sessionize(hits.where("is_pv").select(*DAY, "ts", "identity", "event_id")))
    return views.groupBy(*DAY, _hour().alias("hh"), "identity", "session_seq").agg(
        F.count("*").alias("pv"), F.sum("duration_sec").alias("dur")
    )


def _hour_count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(*DAY, F.hour("ts").alias("hh")).agg(F.count("*").alias(name))


def hourly_counts(events: DataFrame, raw: DataFrame, collected: DataFrame, **modes) -> DataFrame:
    """All counters of an hour in one wide row; every hour with any event has one."""
    hits = named_hits(events, **modes)
    parts = _hour_parts(hits)
    # visits and visitors from the reduced rows: one session row each
    per_user = parts.groupBy(*DAY, "hh", "identity").agg(F.count("*").alias("v"), F.sum("pv").alias("pv"), F.sum("dur").alias("dur"))
    views = per_user.groupBy(*DAY, "hh").agg(
        F.count("*").alias("uv"), F.sum("v").alias("visit"), F.sum("pv").alias("pv"), F.sum("dur").alias("dur")
    )
    name = F.col("semantic_event")
    named = hits.groupBy(*DAY, F.hour("ts").alias("hh")).agg(
        *[F.count_if(name.isin(*names)).alias(c) for c, names in COUNTERS.items()], F.count("*").alias("batch_event_count")
    )
    out = named.join(views, [*DAY, "hh"], "full_outer")
    out = out.join(_hour_count(raw, "raw_event_count"), [*DAY, "hh"], "full_outer")
    return out.join(_hour_count(collected, "collector_event_count"), [*DAY, "hh"], "full_outer").fillna(0)


def daily_users(events: DataFrame, lookback_days: int = 30, **modes) -> DataFrame:
    """Active users of a day (from page views) and those not seen in the lookback window.

    History counts every hit, activity only page views.
    """
    hits = named_hits(events, **modes)
    seen = hits.groupBy(*DAY, "identity").agg(F.max(F.col("is_pv").cast("int")).alias("viewed"))
    gap = F.datediff("dt", F.lag("dt").over(Window.partitionBy("profile_id", "identity").orderBy("dt")))
    fresh = gap.isNull() | (gap > lookback_days)
    return seen.withColumn("fresh", fresh).where("viewed = 1").groupBy(*DAY).agg(
        F.count("*").alias("users"), F.count_if("fresh").alias("new_users")
    )


def _rate(num: str, den: str) -> Column:
    return N.ratio(num, den, 6)


def _metric_rows(level: str):
    """(measure, value, numerator, denominator) of the wide counters."""
    plain = lambda n, c=None: (n, F.col(c or n), F.col(c or n), F.lit(None))
    missing = F.greatest(F.lit(0), F.col("raw_event_count") - F.col("batch_event_count"))
    avg = F.round(F.coalesce(F.col("dur") / F.greatest(F.col("pv"), F.lit(1)), F.lit(0.0)), 6)
    rows = [
        plain("daily_active_users", "uv"), plain("page_view_count", "pv"), ("avg_session_duration_sec", avg, avg, F.lit(None)),
        ("new_user_ratio", _rate("new_users", "users"), F.col("new_users"), F.col("users")),
        *[plain(c) for c in ("login_success_count", "auth_attempt_count", "auth_success_count", "auth_fail_count")],
        ("auth_success_rate", _rate("auth_success_count", "auth_attempt_count"), F.col("auth_success_count"), F.col("auth_attempt_count")),
        ("auth_fail_rate", _rate("auth_fail_count", "auth_attempt_count"), F.col("auth_fail_count"), F.col("auth_attempt_count")),
        *[plain(c) for c in ("otp_request_count", "risk_login_count", "loan_view_count", "loan_apply_start_count", "loan_apply_submit_count",
                             "card_apply_start_count", "card_apply_submit_count")],
        ("card_apply_submit_rate", _rate("card_apply_submit_count", "card_apply_start_count"), F.col("card_apply_submit_count"), F.col("card_apply_start_count")),
        *[plain(c) for c in ("raw_event_count", "collector_event_count", "batch_event_count")],
        ("estimated_missing_rate", F.when(F.col("raw_event_count") > 0, F.round(missing / F.col("raw_event_count"), 6)).otherwise(0.0), missing, F.col("raw_event_count")),
    ]
    if level == "day":
        zero = F.lit(0)
        rows += [("schema_change_count", zero, zero, F.lit(None)), ("batch_delay_sec", zero, zero, F.lit(None))]
    return rows


def _long(wide: DataFrame, keys, level: str) -> DataFrame:
    group = {m: g for g, ms in GROUPS.items() for m in ms}
    items = [
        F.struct(
            F.lit(n).alias("metric_name"), F.lit(group[n]).alias("metric_group"), v.cast("double").alias("metric_value"),
            num.cast("double").alias("numerator_value"), den.cast("double").alias("denominator_value"),
        )
        for n, v, num, den in _metric_rows(level)
    ]
    return wide.select(*keys, F.inline(F.array(*items)))


def kpi_hours(hours: DataFrame, users: DataFrame) -> DataFrame:
    wide = hours.join(users, list(DAY), "left").fillna(0, subset=["users", "new_users"])
    return _long(wide, [*DAY, "hh"], "hour")


def kpi_days(hours: DataFrame, users: DataFrame) -> DataFrame:
    sums = [c for c in hours.columns if c not in (*DAY, "hh", "uv", "visit")]
    day = hours.groupBy(*DAY).agg(*[F.sum(c).alias(c) for c in sums])
    wide = day.join(users, list(DAY), "left").fillna(0, subset=["users", "new_users"]).withColumn("uv", F.col("users"))
    return _long(wide, list(DAY), "day")


def behavior_kpi_hourly(events, raw, collected, lookback_days: int = 30, **modes) -> DataFrame:
    """22 measures per hour. The new user ratio repeats the value of the day."""
    return kpi_hours(hourly_counts(events, raw, collected, **modes), daily_users(events, lookback_days, **modes))


def behavior_kpi_daily(events, raw, collected, lookback_days: int = 30, **modes) -> DataFrame:
    """24 measures per day; rates are taken of the summed counts."""
    return kpi_days(hourly_counts(events, raw, collected, **modes), daily_users(events, lookback_days, **modes))


def hourly_long(hours: DataFrame) -> DataFrame:
    items = [F.struct(F.lit(n).alias("metric_nm"), F.col(c).cast("double").alias("metric_val")) for n, c in (("visit", "visit"), ("uv", "uv"), ("pageview", "pv"))]
    return hours.select(*DAY, "hh", F.inline(F.array(*items)))


def hourly_wide(long: DataFrame) -> DataFrame:
    return long.groupBy(*DAY, "hh").pivot("metric_nm", ["visit", "uv", "pageview"]).agg(F.sum("metric_val")).fillna(0)


def batch_input_day(canonical: DataFrame, keys=(*DAY, "service_domain")) -> DataFrame:
    """Volume, users, sessions, conversions, server errors and latency per domain."""
    reduced = canonical.groupBy(*keys, "uid", "sid").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("is_conversion") == 1).alias("conv"),
        F.count_if(F.col("status").cast("string").isin("500", "502", "503", "504")).alias("err"),
        F.sum("latency_ms").alias("lat"), F.count("latency_ms").alias("lat_n"), F.min("source_gen_run_id").alias("run"),
    )
    return reduced.groupBy(*keys).agg(
        F.sum("n").alias("event_count"), F.count_distinct("uid").alias("unique_user_count"), F.count_distinct("sid").alias("unique_session_count"),
        F.sum("conv").alias("conversion_count"), F.sum("err").alias("error_count"),
        (F.sum("lat") / F.sum("lat_n")).alias("avg_latency_ms"), F.min("run").alias("source_gen_run_id"),
    )


def measurement_batch(hourly_w: DataFrame, daily: DataFrame, coverage: DataFrame) -> DataFrame:
    """Day facts of the batch layer from hourly sums, daily measures and mapping coverage.

    Funnel starts and submits are found by measure name; explicit names are preferred.
    """
    v, name = F.col("metric_value"), F.col("metric_name")
    sum_like = lambda p: F.coalesce(F.sum(F.when(name.rlike(p), v)), F.lit(0.0))
    one = lambda n: F.coalesce(F.max(F.when(name == n, v)), F.lit(0.0))
    picked = ("raw_event_count", "collector_event_count", "batch_event_count", "estimated_missing_rate", "avg_session_duration_sec",
              "new_user_ratio", "auth_attempt_count", "auth_success_count", "auth_fail_count", "auth_success_rate", "auth_fail_rate")
    d = daily.groupBy(*DAY).agg(
        *[one(n).alias(n) for n in picked],
        sum_like("_start_count$").alias("_s1"), sum_like("_submit_count$").alias("_e1"),
        sum_like("(_start_count|view_count)$").alias("_s0"), sum_like("(_submit_count|success_count|complete_count)$").alias("_e0"),
    )
    w = hourly_w.groupBy(*DAY).agg(*[F.sum(c).alias(c) for c in ("visit", "uv", "pageview")])
    j = d.join(w, list(DAY), "left").join(coverage, list(DAY), "left").fillna(0)
    explicit = F.col("_s1") > 0
    j = j.withColumn("funnel_start_count", F.when(explicit, F.col("_s1")).otherwise(F.col("_s0"))).withColumn(
        "funnel_submit_count", F.when(explicit, F.col("_e1")).otherwise(F.col("_e0")))
    raw, batch = F.col("raw_event_count"), F.col("batch_event_count")
    return j.select(
        *DAY, *picked, "visit", "uv", F.col("pageview").alias("pv"), "funnel_start_count", "funnel_submit_count", "mapping_coverage", "unmapped_event_count",
        N.ratio("funnel_submit_count", "funnel_start_count").alias("conversion_rate"),
        N.ratio("pageview", "uv").alias("pv_per_uv"), N.ratio("visit", "uv").alias("visit_per_uv"), N.ratio("pageview", "visit").alias("pv_per_visit"),
        F.when(raw > 0, batch / F.when(raw > 0, raw)).when(batch > 0, 1.0).otherwise(0.0).alias("collector_capture_rate"),
    )


# Dimensions of a behavior distribution and the columns they may come from.
DISTRIBUTION_DIMS = {
    "event_name": ("semantic_event", "event_name", "event_type"),
    "page_type": ("page_type",),
    "device": ("device_type",),
    "stage": ("funnel_stage",),
    "channel": ("channel", "cc"),
}


def distribution(df: DataFrame, scope=DAY, dims: dict | None = None, ts: str = "ts") -> DataFrame:
    """Count and share of each value of each dimension; blank values read ``unknown``."""
    dims = DISTRIBUTION_DIMS if dims is None else dims
    items = []
    for dim, candidates in dims.items():
        found = next((c for c in candidates if c in df.columns), None)
        if found:
            value = F.coalesce(F.nullif(F.col(found).cast("string"), F.lit("")), F.lit("unknown"))
            items.append(F.struct(F.lit(dim).alias("dimension_name"), value.alias("dimension_value")))
    if ts in df.columns:
        items.append(F.struct(F.lit("hour").alias("dimension_name"), X.hour_label(ts).alias("dimension_value")))
    counts = df.select(*scope, F.inline(F.array(*items))).groupBy(*scope, "dimension_name", "dimension_value").agg(F.count("*").alias("event_count"))
    return share_of_total(counts, [*scope, "dimension_name"], "event_count")


def share_of_total(counts: DataFrame, keys, count: str) -> DataFrame:
    """Each count over the total of its keys (a join on pre-aggregated totals)."""
    total = counts.groupBy(*keys).agg(F.sum(count).alias("total_event_count"))
    return counts.join(total, list(keys)).withColumn("event_ratio", F.col(count) / F.col("total_event_count"))
