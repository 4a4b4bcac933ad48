"""Rolling baselines, thresholds and statistical evidence of the day facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline as B, gaps as G
from ..session import materialize
from . import behavior, stream
from .fixtures import RELATIONS
from .gaps import gap_sql, measures, sides
from .registry import query

SCOPE = "profile_id, dt, scenario_name"
HEAD = "profile_id dt:date scenario_name"

RELATIONS["delta_wide"] = f"""SELECT o.*, event_count, pv, uv, visit, conversion / event_count AS conversion_rate, wc_hits / web_hits AS collector_capture_rate, collection_gap_rate AS estimated_missing_rate
  FROM observability_day o JOIN ({measures('', 'collected')}) m USING ({SCOPE})"""
_PAIRS = ", ".join(f"{{'s': '{s}', 'n': '{n}', 'v': CAST({n} AS DOUBLE)}}" for s, n in B.DELTA_METRICS)
RELATIONS["delta_rows"] = f"SELECT {SCOPE}, day_web_hits, m.s AS metric_scope, m.n AS metric_name, m.v AS current_value FROM (SELECT {SCOPE}, CAST(web_hits AS DOUBLE) AS day_web_hits, unnest([{_PAIRS}]) AS m FROM delta_wide) x"
RELATIONS["target_days"] = "SELECT DISTINCT profile_id, dt AS target_date FROM source_hits"
RELATIONS["metric_base"] = """SELECT h.profile_id, t.target_date, metric_scope, metric_name, avg(current_value) AS mean_value, stddev_pop(current_value) AS sd_value, quantile_cont(current_value, 0.5) AS p50_value,
  quantile_cont(current_value, 0.95) AS p95_value, quantile_cont(current_value, 0.99) AS p99_value, count(current_value) AS sample_days
  FROM delta_rows h JOIN target_days t ON h.profile_id = t.profile_id AND h.dt BETWEEN t.target_date - 30 AND t.target_date - 1 WHERE scenario_name = 'baseline' GROUP BY ALL"""


def delta_wide(i):
    obs = G.observability_measurement(i.source_hits, i.collected_hits, i.collected_hits.where("value >= 8"))
    m = G.hit_metrics(G.segment_columns(i.collected_hits), ())
    j = obs.join(m, list(G.SCOPE))
    return (
        j.withColumn("conversion_rate", F.col("conversion") / F.col("event_count"))
        .withColumn("collector_capture_rate", F.col("wc_hits") / F.col("web_hits")).withColumn("estimated_missing_rate", F.col("collection_gap_rate"))
    )


def targets(df):
    return df.select("profile_id", F.col("dt").alias("target_date")).distinct()


def delta_rows(i):
    return B.metric_rows(materialize(delta_wide(i), "day-facts"))


@query("metric_rows", "A25", f"{HEAD} metric_scope metric_name current_value:d", "SELECT * FROM delta_rows")
def metric_rows(i):
    return B.metric_rows(delta_wide(i))


BASE_COLS = "profile_id target_date:date metric_scope metric_name mean_value:d sd_value:d p50_value:d p95_value:d p99_value:d sample_days:i"


@query("metric_baseline", "B01 W11", BASE_COLS, "SELECT * FROM metric_base")
def metric_baseline(i):
    rows = delta_rows(i)
    return B.metric_baseline(rows, targets(rows))


RELATIONS["distribution_base"] = """SELECT h.profile_id, t.target_date, dimension_name, dimension_value, avg(event_count) AS baseline_count_avg, stddev_pop(event_count) AS baseline_count_std, avg(event_ratio) AS baseline_ratio_avg,
  stddev_pop(event_ratio) AS baseline_ratio_std, quantile_cont(event_ratio, 0.5) AS baseline_ratio_p50, quantile_cont(event_ratio, 0.95) AS baseline_ratio_p95, count(DISTINCT dt) AS sample_days
  FROM distribution_day h JOIN target_days t ON h.profile_id = t.profile_id AND h.dt BETWEEN t.target_date - 30 AND t.target_date - 1 WHERE scenario_name = 'baseline' GROUP BY ALL"""


@query("distribution_baseline", "B02", "profile_id target_date:date dimension_name dimension_value baseline_count_avg:d baseline_count_std:d baseline_ratio_avg:d baseline_ratio_std:d baseline_ratio_p50:d baseline_ratio_p95:d sample_days:i",
       "SELECT * FROM distribution_base")
def distribution_baseline(i):
    d = behavior.distributed(i)
    return B.distribution_baseline(d, targets(d))


RELATIONS["metric_delta_day"] = """SELECT *, CASE WHEN baseline_status = 'BASELINE_MISSING_REVIEW' THEN baseline_status WHEN risk_score >= 0.6 THEN 'FAIL' WHEN risk_score >= 0.2 THEN 'WARN' ELSE 'PASS' END AS risk_status FROM (
  SELECT *, CASE WHEN rate_like AND baseline_status LIKE 'baseline_available%' THEN greatest(s0, least(abs(current_value) / 0.2, 1)) ELSE s0 END AS risk_score FROM (
  SELECT *, CASE WHEN b IS NOT NULL THEN d ELSE CASE WHEN calm THEN 0 END END AS absolute_delta, CASE WHEN b IS NOT NULL THEN r ELSE CASE WHEN calm THEN 0 END END AS delta_rate, CASE WHEN b IS NOT NULL THEN z ELSE CASE WHEN calm THEN 0 END END AS z_score,
    CASE WHEN b IS NOT NULL THEN greatest(least(r / 0.2, 1), least(z / 5, 1)) ELSE 0 END AS s0, b AS baseline_value_avg, sd AS baseline_value_std FROM (
  SELECT *, current_value - b AS d, abs(current_value - b) / greatest(abs(b), 1) AS r, CASE WHEN sd > 0 THEN abs(current_value - b) / greatest(sd, 1e-9) ELSE 0 END AS z FROM (
  SELECT c.*, CASE WHEN mean_value IS NOT NULL THEN 'baseline_available' WHEN rate_like AND NOT calm THEN 'baseline_available_zero_expected' WHEN c.metric_name IN ('wc_hits', 'canonical_behavior_events') AND day_web_hits > 0 THEN 'same_run_webserver_expected'
      WHEN c.metric_name = 'web_hits' THEN 'same_run_source_reference' WHEN calm THEN 'BASELINE_SELF_REFERENCE' ELSE 'BASELINE_MISSING_REVIEW' END AS baseline_status,
    CASE WHEN mean_value IS NOT NULL THEN mean_value WHEN rate_like AND NOT calm THEN 0 WHEN c.metric_name IN ('wc_hits', 'canonical_behavior_events') AND day_web_hits > 0 THEN day_web_hits WHEN c.metric_name = 'web_hits' THEN current_value END AS b,
    CASE WHEN mean_value IS NOT NULL THEN sd_value WHEN (rate_like AND NOT calm) OR c.metric_name IN ('wc_hits', 'canonical_behavior_events', 'web_hits') THEN 0 END AS sd
  FROM (SELECT *, scenario_name = 'baseline' AS calm, metric_name LIKE '%gap_rate' OR metric_name LIKE '%missing_rate' AS rate_like FROM delta_rows) c LEFT JOIN metric_base m ON c.profile_id = m.profile_id AND c.dt = m.target_date AND c.metric_scope = m.metric_scope AND c.metric_name = m.metric_name) q) v) w) y"""


def metric_deltas(i):
    rows = delta_rows(i)
    return B.metric_delta(rows, B.metric_baseline(rows, targets(rows)))


@query("metric_delta", "B03", f"{HEAD} metric_scope metric_name current_value:d baseline_value_avg:d baseline_value_std:d absolute_delta:d delta_rate:d z_score:d risk_score:d risk_status baseline_status", "SELECT * FROM metric_delta_day")
def metric_delta(i):
    return metric_deltas(i)


RELATIONS["shift_day"] = """SELECT *, CASE WHEN have THEN least(1, greatest(d / 0.2, z / 5)) ELSE 0 END AS distribution_shift_score, CASE WHEN have THEN d WHEN calm THEN 0 END AS ratio_delta, CASE WHEN have THEN z WHEN calm THEN 0 END AS z_score,
  CASE WHEN have THEN 'baseline_available' WHEN calm THEN 'BASELINE_SELF_REFERENCE' ELSE 'BASELINE_MISSING_REVIEW' END AS baseline_status FROM (
  SELECT *, CASE WHEN sd > 0 THEN d / greatest(sd, 1e-9) ELSE 0 END AS z FROM (
  SELECT profile_id, dt, scenario_name, dimension_name, dimension_value, event_count AS current_count, event_ratio AS current_ratio, b.baseline_ratio_avg IS NOT NULL AS have, scenario_name = 'baseline' AS calm,
    coalesce(b.baseline_count_avg, CASE WHEN scenario_name = 'baseline' THEN event_count END) AS baseline_count_avg, coalesce(b.baseline_ratio_avg, CASE WHEN scenario_name = 'baseline' THEN event_ratio END) AS baseline_ratio_avg,
    abs(event_ratio - b.baseline_ratio_avg) AS d, coalesce(b.baseline_ratio_std, 0) AS sd
  FROM distribution_day c LEFT JOIN (SELECT profile_id, target_date AS dt, * EXCLUDE (profile_id, target_date) FROM distribution_base) b USING (profile_id, dt, dimension_name, dimension_value)) x) y"""


def shifts(i):
    d = materialize(behavior.distributed(i), "distribution")
    return B.distribution_shift(d, B.distribution_baseline(d, targets(d)))


@query("distribution_shift", "B04", f"{HEAD} dimension_name dimension_value current_count:i current_ratio:d baseline_count_avg:d baseline_ratio_avg:d ratio_delta:d z_score:d distribution_shift_score:d baseline_status", "SELECT * FROM shift_day")
def distribution_shift(i):
    return shifts(i)


@query("resolve_baseline", "B08", f"{HEAD} baseline_available:i fallback_policy analysis_confidence",
       f"""SELECT {SCOPE}, coalesce(a, 0) AS baseline_available, CASE WHEN scenario_name = 'collection_missing' THEN 'same_run_evidence_baseline' WHEN a = 1 THEN 'use_baseline_snapshot' ELSE 'BASELINE_MISSING_REVIEW' END AS fallback_policy,
  CASE WHEN a = 1 OR scenario_name = 'collection_missing' THEN 'high' ELSE 'low' END AS analysis_confidence FROM (SELECT DISTINCT {SCOPE} FROM source_hits) s LEFT JOIN (SELECT DISTINCT profile_id, target_date AS dt, 1 AS a FROM metric_base) b USING (profile_id, dt)""")
def resolve_baseline(i):
    rows = delta_rows(i)
    return B.resolve_baseline(i.source_hits.select(*G.SCOPE).distinct(), B.metric_baseline(rows, targets(rows)), ("collection_missing",))


# --- gap features -------------------------------------------------------------


APP = "app_platform, app_version, sdk_version"


def rate_rows(kind: str, dims: str) -> str:
    key = " || '|' || ".join(d.strip() for d in dims.split(","))
    return " UNION ALL ".join(
        f"SELECT {SCOPE}, '{kind}' AS dimension_type, {key} AS dimension_key, '{n}' AS metric_name, {r} AS metric_value, web_{m} AS webserver_value, wc_{m} AS wc_value, greatest(0, web_{m} - wc_{m}) AS missing_value, '{kind}_gap' AS source_table FROM ({gap_sql(dims)}) g"
        for n, m, r in (("collection_gap_rate", "event_count", "missing_rate"), ("uv_gap_rate", "uv", "uv_missing_rate")))


RELATIONS["gap_features"] = f"""SELECT {SCOPE}, dimension_type, dimension_value AS dimension_key, metric_name || '_gap_rate' AS metric_name, gap_rate AS metric_value, web_value AS webserver_value, wc_value, missing_value, 'metric_gap' AS source_table FROM metric_gap_day
  UNION ALL SELECT {SCOPE}, dimension_type, dimension_value, 'collection_gap_rate', gap_rate, web_value, wc_value, missing_value, 'app_gap' FROM metric_gap_day WHERE metric_name = 'event_count' AND dimension_type <> 'all'
  UNION ALL {rate_rows('url', APP + ', surface_path')} UNION ALL {rate_rows('client', APP + ', device_type, browser_family, os_family')}"""
FEATURE_COLS = f"{HEAD} dimension_type dimension_key metric_name metric_value:d"


def gap_features(i):
    s, c = sides(i)
    return B.feature_snapshot(G.metric_gap(s, c), G.gap_by_url(s, c), G.gap_by_client(s, c))


@query("feature_snapshot", "B05", f"{FEATURE_COLS} webserver_value:d wc_value:d missing_value:d source_table", "SELECT * FROM gap_features")
def feature_snapshot(i):
    return gap_features(i)


_P = ", ".join(f"quantile_cont(metric_value, {q}) AS {n}" for n, q in (("median_value", 0.5), ("p75_value", 0.75), ("p90_value", 0.9), ("p95_value", 0.95), ("p99_value", 0.99)))
RELATIONS["gap_profile"] = f"""SELECT *, greatest(0, mean_value - 3 * sd_value) AS lower_control_limit, mean_value + 3 * sd_value AS upper_control_limit, least(1, sample_days / 3) AS quality_score, CASE WHEN sample_days >= 3 THEN 'usable' ELSE 'low_sample' END AS baseline_status FROM (
  SELECT * EXCLUDE (vs), sqrt(list_sum([(x - mean_value) * (x - mean_value) for x in vs]) / len(vs)) AS sd_value FROM (SELECT *, list_sum(vs) / len(vs) AS mean_value FROM (
  SELECT profile_id, target_date, baseline_type, dimension_type, dimension_key, metric_name, count(DISTINCT dt) AS sample_days, list(metric_value ORDER BY dt, metric_value) AS vs, {_P}, min(metric_value) AS min_value, max(metric_value) AS max_value FROM (
  SELECT f.*, target_date, unnest(CASE WHEN dayofweek(dt) = dayofweek(target_date) THEN ['rolling_30d', 'same_weekday'] ELSE ['rolling_30d'] END) AS baseline_type FROM gap_features f JOIN target_days t ON f.profile_id = t.profile_id AND f.dt BETWEEN t.target_date - 30 AND t.target_date - 1
  WHERE scenario_name = 'baseline') x GROUP BY ALL) y) u) v"""
PROFILE_COLS = "profile_id target_date:date baseline_type dimension_type dimension_key metric_name sample_days:i mean_value:d sd_value:d median_value:d p75_value:d p90_value:d p95_value:d p99_value:d min_value:d max_value:d lower_control_limit:d upper_control_limit:d quality_score:d baseline_status"


@query("stat_profile", "B06", PROFILE_COLS, "SELECT * FROM gap_profile")
def stat_profile(i):
    f = gap_features(i)
    return B.stat_profile(f, targets(i.source_hits))


@query("baseline_reference", "B07", "profile_id target_date:date baseline_type sample_days:i fallback_policy is_usable:i quality_score:d baseline_start_date:date baseline_end_date:date",
       """SELECT t.profile_id, t.target_date, k AS baseline_type, coalesce(n, 0) AS sample_days, CASE k WHEN 'rolling_30d' THEN 'primary' ELSE 'fallback_to_rolling_30d_when_low_sample' END AS fallback_policy, CASE WHEN coalesce(n, 0) >= 3 THEN 1 ELSE 0 END AS is_usable,
  least(1, coalesce(n, 0) / 3) AS quality_score, t.target_date - 30 AS baseline_start_date, t.target_date - 1 AS baseline_end_date FROM (SELECT *, unnest(['rolling_30d', 'same_weekday']) AS k FROM target_days) t
  LEFT JOIN (SELECT t.target_date, k, count(DISTINCT dt) AS n FROM (SELECT DISTINCT dt FROM source_hits WHERE scenario_name = 'baseline') h JOIN (SELECT target_date, unnest(['rolling_30d', 'same_weekday']) AS k FROM target_days) t
    ON h.dt BETWEEN t.target_date - 30 AND t.target_date - 1 AND (k = 'rolling_30d' OR dayofweek(h.dt) = dayofweek(t.target_date)) GROUP BY ALL) c USING (target_date, k)""")
def baseline_reference(i):
    days = i.source_hits.select(*G.SCOPE).distinct()
    return B.baseline_reference(days, targets(days))


RELATIONS["gap_selected"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, target_date, dimension_type, dimension_key, metric_name ORDER BY CASE WHEN baseline_type = 'same_weekday' AND baseline_status = 'usable' THEN 3 WHEN baseline_type = 'rolling_30d' THEN 2 ELSE 1 END DESC, quality_score DESC) AS pick FROM gap_profile) x WHERE pick = 1"""


def profiled(i):
    f = materialize(gap_features(i), "gap-features")
    return f, B.stat_profile(f, targets(i.source_hits))


@query("select_baseline", "J12", PROFILE_COLS, "SELECT * FROM gap_selected")
def select_baseline(i):
    return B.select_baseline(B.stat_profile(gap_features(i), targets(i.source_hits)))


@query("baseline_compare", "B09", f"{FEATURE_COLS} selected_baseline_type baseline_mean:d baseline_delta:d z_score:d percentile_band control_limit_breach:i severity",
       """SELECT *, CASE WHEN control_limit_breach = 1 AND abs(z_score) >= 5 THEN 'critical' WHEN control_limit_breach = 1 OR abs(z_score) >= 3 THEN 'warning' WHEN abs(z_score) >= 2 THEN 'watch' ELSE 'normal' END AS severity FROM (
  SELECT f.*, b.baseline_type AS selected_baseline_type, mean_value AS baseline_mean, metric_value - mean_value AS baseline_delta, CASE WHEN sd_value < 1e-12 THEN CASE WHEN abs(metric_value - mean_value) < 1e-12 THEN 0 ELSE 999 END ELSE (metric_value - mean_value) / sd_value END AS z_score,
  CASE WHEN metric_value >= p99_value THEN 'p99_plus' WHEN metric_value >= p95_value THEN 'p95_plus' WHEN metric_value >= p90_value THEN 'p90_plus' WHEN metric_value >= p75_value THEN 'p75_plus' ELSE 'normal_band' END AS percentile_band,
  CASE WHEN metric_value > upper_control_limit THEN 1 ELSE 0 END AS control_limit_breach FROM gap_features f JOIN gap_selected b ON f.profile_id = b.profile_id AND f.dt = b.target_date AND f.dimension_type = b.dimension_type AND f.dimension_key = b.dimension_key AND f.metric_name = b.metric_name) x""")
def baseline_compare(i):
    f, p = profiled(i)
    return B.baseline_compare(f, p)


RELATIONS["gap_recent"] = """SELECT f.profile_id, t.target_date, dimension_type, dimension_key, metric_name, avg(metric_value) AS recent_mean, count(DISTINCT dt) AS recent_sample_days FROM gap_features f JOIN target_days t
  ON f.profile_id = t.profile_id AND f.dt BETWEEN t.target_date - 6 AND t.target_date WHERE scenario_name = 'baseline' GROUP BY ALL"""


@query("recent_mean", "W10", "profile_id target_date:date dimension_type dimension_key metric_name recent_mean:d recent_sample_days:i", "SELECT * FROM gap_recent")
def recent_mean(i):
    return B.recent_mean(gap_features(i), targets(i.source_hits))


RELATIONS["gap_expected"] = """SELECT *, CASE WHEN model_status = 'usable' AND dimension_quality_status = 'ok' THEN 'usable' WHEN model_status = 'missing_baseline' THEN 'missing' ELSE 'low_quality' END AS quality_status,
  greatest(0, expected_value - 3 * rsd) AS expected_lower, expected_value + 3 * rsd AS expected_upper, CASE WHEN metric_value > expected_value + 3 * rsd THEN 1 ELSE 0 END AS expected_breach FROM (
  SELECT *, metric_value - expected_value AS expected_delta, CASE WHEN abs(expected_value) >= 1e-12 THEN (metric_value - expected_value) / abs(expected_value) WHEN abs(metric_value - expected_value) < 1e-12 THEN 0 END AS expected_delta_rate,
    CASE WHEN selected_sample_days <= 0 THEN 'missing_baseline' WHEN selected_sample_days < 3 THEN 'low_sample' WHEN recent_sample_days < 3 THEN 'low_recent_sample' ELSE 'usable' END AS model_status,
    CASE WHEN dimension_type IN ('url', 'client') AND webserver_value < 100 THEN 'low_volume' WHEN dimension_type IN ('app_version', 'sdk_version', 'app_sdk') AND webserver_value < 50 THEN 'low_volume' ELSE 'ok' END AS dimension_quality_status,
    least(1, greatest(0, baseline_quality_score) * 0.7 + least(1, recent_sample_days / 7) * 0.3) AS expected_confidence FROM (
  SELECT *, CASE WHEN rolling_mean IS NULL AND sel IS NULL AND rec IS NULL THEN NULL ELSE (coalesce(rolling_mean * 0.5, 0) + coalesce(sel * 0.3, 0) + coalesce(rec * 0.2, 0)) / (CASE WHEN rolling_mean IS NULL THEN 0 ELSE 0.5 END + CASE WHEN sel IS NULL THEN 0 ELSE 0.3 END + CASE WHEN rec IS NULL THEN 0 ELSE 0.2 END) END AS expected_value FROM (
  SELECT f.*, r.mean_value AS rolling_mean, coalesce(r.sd_value, 0) AS rsd, coalesce(r.sample_days, 0) AS rolling_sample_days, coalesce(q.recent_sample_days, 0) AS recent_sample_days, CASE WHEN w.sample_days >= 3 THEN w.mean_value ELSE r.mean_value END AS sel,
    CASE WHEN w.sample_days >= 3 THEN w.sample_days ELSE coalesce(r.sample_days, 0) END AS selected_sample_days, CASE WHEN w.sample_days >= 3 THEN w.quality_score ELSE coalesce(r.quality_score, 0) END AS baseline_quality_score,
    coalesce(q.recent_mean, CASE WHEN w.sample_days >= 3 THEN w.mean_value ELSE r.mean_value END) AS rec
  FROM gap_features f JOIN target_days t ON f.profile_id = t.profile_id AND f.dt = t.target_date LEFT JOIN (SELECT * FROM gap_profile WHERE baseline_type = 'rolling_30d') r ON f.profile_id = r.profile_id AND f.dt = r.target_date AND f.dimension_type = r.dimension_type AND f.dimension_key = r.dimension_key AND f.metric_name = r.metric_name
  LEFT JOIN (SELECT * FROM gap_profile WHERE baseline_type = 'same_weekday') w ON f.profile_id = w.profile_id AND f.dt = w.target_date AND f.dimension_type = w.dimension_type AND f.dimension_key = w.dimension_key AND f.metric_name = w.metric_name
  LEFT JOIN gap_recent q ON f.profile_id = q.profile_id AND f.dt = q.target_date AND f.dimension_type = q.dimension_type AND f.dimension_key = q.dimension_key AND f.metric_name = q.metric_name) a) b) c"""


def expected(i):
    f, p = profiled(i)
    days = targets(i.source_hits)
    now = f.join(days.withColumnRenamed("target_date", "dt"), ["profile_id", "dt"], "left_semi")
    return B.expected_metric(now, p, B.recent_mean(f, days))


@query("expected_metric", "B10", f"{FEATURE_COLS} rolling_mean:d selected_sample_days:i recent_sample_days:i baseline_quality_score:d expected_value:d expected_lower:d expected_upper:d expected_delta:d expected_delta_rate:d expected_breach:i expected_confidence:d model_status dimension_quality_status quality_status",
       "SELECT * FROM gap_expected")
def expected_metric(i):
    return expected(i)


RELATIONS["gap_thresholds"] = f"""SELECT *, CASE WHEN dimension_policy = 'volume_guarded' AND row_count < min_sample_count THEN 'low_volume' ELSE quality_status END AS calibration_status FROM (
  SELECT *, greatest(d3, p99_value, warning_threshold) AS critical_threshold FROM (SELECT *, greatest(d2, p95_value, watch_threshold) AS warning_threshold FROM (SELECT *, greatest(d1, p90_value) AS watch_threshold FROM (
  SELECT {SCOPE}, dimension_type, metric_name, max(rolling_sample_days) AS sample_days, count(*) AS row_count, avg(v) AS mean_value, coalesce(stddev_samp(v), 0) AS sd_value, quantile_cont(v, 0.9) AS p90_value, quantile_cont(v, 0.95) AS p95_value, quantile_cont(v, 0.99) AS p99_value,
    CASE WHEN dimension_type IN ('all', 'app_platform', 'sdk_version') THEN 'sensitive' WHEN dimension_type IN ('app_version', 'app_sdk') THEN 'version_sensitive' ELSE 'volume_guarded' END AS dimension_policy,
    CASE WHEN dimension_type IN ('url', 'client') THEN 100 WHEN dimension_type IN ('app_version', 'app_sdk') THEN 30 ELSE 1 END AS min_sample_count, CASE WHEN dimension_type IN ('url', 'client') THEN 0.08 ELSE 0.04 END AS d1,
    CASE WHEN dimension_type IN ('url', 'client') THEN 0.15 ELSE 0.08 END AS d2, CASE WHEN dimension_type IN ('url', 'client') THEN 0.3 WHEN dimension_type IN ('app_version', 'app_sdk') THEN 0.18 ELSE 0.2 END AS d3,
    CASE WHEN max(rolling_sample_days) >= 3 THEN 'usable' ELSE 'low_sample' END AS quality_status FROM (SELECT *, abs(coalesce(expected_delta_rate, 0)) AS v FROM gap_expected) e GROUP BY ALL) a) b) c) d"""


@query("threshold_calibration", "B11", f"{HEAD} dimension_type metric_name sample_days:i row_count:i mean_value:d sd_value:d p90_value:d p95_value:d p99_value:d dimension_policy min_sample_count:i watch_threshold:d warning_threshold:d critical_threshold:d quality_status calibration_status",
       "SELECT * FROM gap_thresholds")
def threshold_calibration(i):
    return B.threshold_calibration(materialize(expected(i), "expected"))


@query("reference_rows", "B15", f"{HEAD} evidence_domain dimension_type dimension_key metric_name current_value:d expected_value:d sample_days:i statistical_score:d analysis_status",
       f"""SELECT {SCOPE}, 'observability_expected' AS evidence_domain, dimension_type, dimension_key, metric_name, metric_value AS current_value, expected_value, selected_sample_days AS sample_days, 0 AS statistical_score, 'REFERENCE_DOMAIN_NOT_STATISTICAL' AS analysis_status FROM gap_expected""")
def reference_rows(i):
    return B.reference_rows(expected(i))


# --- statistical evidence -----------------------------------------------------

RELATIONS["delta_history"] = """SELECT h.profile_id, t.target_date, h.dt AS history_date, scenario_name, metric_scope, metric_name, current_value, risk_score FROM metric_delta_day h JOIN target_days t ON h.profile_id = t.profile_id AND h.dt BETWEEN t.target_date - 30 AND t.target_date WHERE scenario_name = 'baseline'"""


@query("history_snapshot", "B14", "profile_id target_date:date history_date:date scenario_name metric_scope metric_name current_value:d risk_score:d", "SELECT * FROM delta_history")
def history_snapshot(i):
    d = materialize(metric_deltas(i), "delta")
    return B.history_snapshot(d, targets(d))


RELATIONS["evidence_day"] = """SELECT *, CASE WHEN statistical_score >= 0.75 THEN 'critical' WHEN statistical_score >= 0.55 THEN 'warning' WHEN statistical_score >= 0.3 THEN 'watch' WHEN statistical_score >= 0.08 THEN 'low' ELSE 'stable' END AS statistical_significance,
  CASE WHEN sample_days >= 3 THEN 1 ELSE least(0.99, sample_days / 3) END AS baseline_quality_score, CASE WHEN sample_days < 3 THEN 'LOW_SAMPLE_HISTORY' WHEN statistical_score >= 0.3 THEN 'SIGNAL' ELSE 'PASS' END AS analysis_status FROM (
  SELECT *, CASE WHEN sample_days < 3 THEN 0 ELSE least(1, 0.35 * least(abs(z_score) / 5, 1) + 0.25 * CASE WHEN historical_percentile >= 99 THEN 1 WHEN historical_percentile >= 95 THEN 0.7 WHEN historical_percentile >= 90 THEN 0.4 ELSE 0 END + 0.25 * control_limit_breach + 0.15 * least(abs(baseline_delta_rate) / 0.25, 1)) END AS statistical_score FROM (
  SELECT *, current_value - m AS baseline_delta, CASE WHEN abs(m) > 0 THEN abs(current_value - m) / abs(m) ELSE abs(current_value - m) END AS baseline_delta_rate, CASE WHEN sd > 0 THEN (current_value - m) / sd ELSE 0 END AS z_score,
    CASE WHEN current_value > m + 3 * sd OR current_value < greatest(0, m - 3 * sd) THEN 1 ELSE 0 END AS control_limit_breach, m AS baseline_mean, sd AS baseline_sd FROM (
  SELECT c.profile_id, c.dt, c.scenario_name, c.metric_scope, c.metric_name, c.risk_score AS current_value, avg(h.risk_score) AS m, coalesce(stddev_samp(h.risk_score), 0) AS sd, count(DISTINCT h.history_date) AS sample_days,
    round(100 * avg(CASE WHEN h.risk_score <= c.risk_score THEN 1.0 ELSE 0.0 END), 4) AS historical_percentile, 'batch_metric_delta' AS evidence_domain
  FROM metric_delta_day c LEFT JOIN delta_history h ON c.profile_id = h.profile_id AND c.dt = h.target_date AND c.metric_scope = h.metric_scope AND c.metric_name = h.metric_name GROUP BY ALL) a) b) d"""
EV_COLS = f"{HEAD} evidence_domain metric_scope metric_name current_value:d baseline_mean:d baseline_sd:d sample_days:i historical_percentile:d z_score:d control_limit_breach:i statistical_score:d statistical_significance baseline_quality_score:d analysis_status"


def evidence(i):
    d = materialize(metric_deltas(i), "delta")
    return d, B.statistical_evidence(d, d, "risk_score")


@query("statistical_evidence", "B12", EV_COLS, "SELECT * FROM evidence_day")
def statistical_evidence(i):
    return evidence(i)[1]


RELATIONS["moved_day"] = f"""SELECT e.*, affected_metrics, share AS co_movement_score, CASE WHEN share >= 0.5 THEN 'high' WHEN share >= 0.25 THEN 'medium' WHEN share > 0 THEN 'low' ELSE 'none' END AS co_movement_level FROM evidence_day e
  JOIN (SELECT {SCOPE}, evidence_domain, count(*) FILTER (statistical_score >= 0.3) AS affected_metrics, count(*) FILTER (statistical_score >= 0.3) / count(*) AS share FROM evidence_day GROUP BY ALL) s USING ({SCOPE}, evidence_domain)"""


@query("co_movement", "B13", f"{HEAD} evidence_domain metric_scope metric_name statistical_score:d affected_metrics:i co_movement_score:d co_movement_level", "SELECT * FROM moved_day")
def co_movement(i):
    return B.co_movement(evidence(i)[1])


@query("enrich_update", "J14", f"{HEAD} metric_scope metric_name current_value:d risk_score:d historical_percentile:d control_limit_breach:i statistical_score:d statistical_significance co_movement_score:d",
       f"""SELECT {SCOPE}, metric_scope, metric_name, d.current_value, d.risk_score, historical_percentile, control_limit_breach, statistical_score, statistical_significance, co_movement_score FROM metric_delta_day d LEFT JOIN (SELECT * EXCLUDE (current_value) FROM moved_day) m USING ({SCOPE}, metric_scope, metric_name)""")
def enrich_update(i):
    d, e = evidence(i)
    return B.enrich_update(d, B.co_movement(e))


PAIR_IN = ("collection_gap", "canonical_gap", "checkout_missing", "product_missing", "observability_gap")
RELATIONS["pair_scores"] = f"SELECT {SCOPE}, collection_gap_rate AS collection_gap, canonical_gap_rate AS canonical_gap, checkout_missing_rate AS checkout_missing, product_missing_rate AS product_missing, least(1, greatest(collection_gap_rate * 3, canonical_gap_rate * 3)) AS observability_gap FROM observability_day"


@query("pair_co_movement", "B16", f"{HEAD} metric_pair left_score:d right_score:d coupled_score:d directional_gap:d co_movement_type anomaly_status",
       f"""SELECT *, CASE WHEN coupled_score >= 0.6 THEN 'coupled_high_risk_movement' WHEN coupled_score >= 0.2 THEN 'coupled_warning_movement' ELSE 'neutral_or_decoupled_movement' END AS co_movement_type, CASE WHEN coupled_score >= 0.6 THEN 'FAIL' WHEN coupled_score >= 0.2 THEN 'WARN' ELSE 'PASS' END AS anomaly_status FROM (
  SELECT l.*, l.v AS left_score, r.v AS right_score, l.n || '__' || r.n AS metric_pair, least(1, sqrt(abs(l.v * r.v))) AS coupled_score, abs(l.v - r.v) AS directional_gap FROM
  (SELECT {SCOPE}, n, v, list_position({list(PAIR_IN)}, n) AS k FROM pair_scores UNPIVOT (v FOR n IN ({", ".join(PAIR_IN)}))) l JOIN (SELECT {SCOPE}, n, v, list_position({list(PAIR_IN)}, n) AS k FROM pair_scores UNPIVOT (v FOR n IN ({", ".join(PAIR_IN)}))) r
  ON l.dt = r.dt AND l.profile_id = r.profile_id AND l.scenario_name = r.scenario_name AND l.k < r.k) x""")
def pair_co_movement(i):
    o = G.observability_measurement(i.source_hits, i.collected_hits, i.collected_hits.where("value >= 8"))
    s = o.select(*G.SCOPE, F.col("collection_gap_rate").alias("collection_gap"), F.col("canonical_gap_rate").alias("canonical_gap"), F.col("checkout_missing_rate").alias("checkout_missing"),
                 F.col("product_missing_rate").alias("product_missing"), F.least(F.lit(1.0), F.greatest(F.col("collection_gap_rate") * 3, F.col("canonical_gap_rate") * 3)).alias("observability_gap"))
    return B.pair_co_movement(s)


@query("correlation", "B17", "app_platform n:i correlation:d", "SELECT app_platform, count(*) AS n, corr(value, status) AS correlation FROM source_hits GROUP BY ALL")
def correlation(i):
    return B.correlation(i.source_hits, "value", "status", ["app_platform"])


@query("psi", "B18", "app_platform psi:d",
       """SELECT app_platform, least(1, greatest(0, sum((pa - pb) * ln(pa / pb)))) AS psi FROM (SELECT *, a / sum(a) OVER (PARTITION BY app_platform) AS pa, b / sum(b) OVER (PARTITION BY app_platform) AS pb FROM (
  SELECT app_platform, bin, count(*) FILTER (act) + 0.5 AS a, count(*) FILTER (NOT act) + 0.5 AS b FROM (SELECT app_platform, act, greatest(1, least(len(list_filter(cuts, lambda c: c < latency)), len(cuts) - 1)) AS bin FROM (
  SELECT app_platform, CAST(latency_ms AS DOUBLE) AS latency, false AS act FROM source_hits UNION ALL SELECT app_platform, CAST(latency_ms AS DOUBLE), true FROM collected_hits) r JOIN
  (SELECT app_platform, list_sort(list_distinct(quantile_cont(CAST(latency_ms AS DOUBLE), [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS cuts FROM source_hits GROUP BY ALL) q USING (app_platform)) x GROUP BY ALL) y) z GROUP BY app_platform""")
def psi(i):
    v = F.col("latency_ms").cast("double").alias("latency")
    return B.psi(i.collected_hits.select("app_platform", v), i.source_hits.select("app_platform", v), "latency", ["app_platform"])


OPS = ("throughput_per_minute", "lag_p50_ms", "lag_p95_ms", "lag_max_ms", "availability_ratio", "processed_count")
RELATIONS["ops_distribution"] = f"""SELECT profile_id, metric_name, count(*) AS sample_count, avg(v) AS mean_value, stddev_samp(v) AS sd_value, min(v) AS min_value, quantile_cont(v, 0.5) AS p50_value, quantile_cont(v, 0.75) AS p75_value, quantile_cont(v, 0.9) AS p90_value,
  quantile_cont(v, 0.95) AS p95_value, quantile_cont(v, 0.99) AS p99_value, max(v) AS max_value FROM (SELECT profile_id, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in OPS)} FROM operational_day) o UNPIVOT (v FOR metric_name IN ({", ".join(OPS)})) GROUP BY ALL"""


@query("metric_distribution", "B19", "profile_id metric_name sample_count:i mean_value:d sd_value:d min_value:d p50_value:d p75_value:d p90_value:d p95_value:d p99_value:d max_value:d", "SELECT * FROM ops_distribution")
def metric_distribution(i):
    return B.metric_distribution(materialize(stream.operational(i), "operational"), OPS)


@query("threshold_profile", "B20", "profile_id metric_name warn_threshold:d critical_threshold:d baseline_mean:d baseline_sd:d",
       "SELECT profile_id, metric_name, p95_value AS warn_threshold, p99_value AS critical_threshold, mean_value AS baseline_mean, sd_value AS baseline_sd FROM ops_distribution")
def threshold_profile(i):
    return B.threshold_profile(B.metric_distribution(materialize(stream.operational(i), "operational"), OPS))


DRIFT = ("web_hits", "wc_hits", "collection_gap_rate", "uv_gap_rate")


@query("feature_drift", "B22", f"{HEAD} feature_name feature_value:d baseline_mean:d baseline_std:d z_score:d drift_flag:i importance_score:d diagnostic_status",
       f"""SELECT *, CASE WHEN abs(z_score) >= 3 THEN 1 ELSE 0 END AS drift_flag, coalesce(abs(z_score), 0) * 0.1 AS importance_score, CASE WHEN abs(z_score) >= 3 THEN 'REVIEW' ELSE 'PASS' END AS diagnostic_status FROM (
  SELECT *, CASE WHEN baseline_std > 0 THEN (feature_value - baseline_mean) / baseline_std END AS z_score FROM (
  SELECT c.profile_id, c.dt, c.scenario_name, c.feature_name, c.v AS feature_value, avg(h.v) AS baseline_mean, CASE WHEN count(h.v) >= 2 THEN stddev_pop(h.v) END AS baseline_std FROM
  (SELECT {SCOPE}, feature_name, v FROM (SELECT {SCOPE}, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in DRIFT)} FROM observability_day) o UNPIVOT (v FOR feature_name IN ({", ".join(DRIFT)}))) c LEFT JOIN
  (SELECT {SCOPE}, feature_name, v FROM (SELECT {SCOPE}, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in DRIFT)} FROM observability_day) o UNPIVOT (v FOR feature_name IN ({", ".join(DRIFT)})) WHERE scenario_name = 'baseline') h
  ON c.profile_id = h.profile_id AND c.feature_name = h.feature_name AND h.dt < c.dt GROUP BY ALL) x) y""")
def feature_drift(i):
    o = G.observability_measurement(i.source_hits, i.collected_hits, i.collected_hits.where("value >= 8"))
    return B.feature_drift(materialize(o, "snapshot"), DRIFT)


@query("previous_and_moving", "W09", f"{HEAD} web_hits:i web_hits_prev:d web_hits_diff:d web_hits_ma7:d collection_gap_rate_ma7:d",
       f"""SELECT {SCOPE}, web_hits, lag(CAST(web_hits AS DOUBLE), 1, 0.0) OVER w AS web_hits_prev, web_hits - lag(CAST(web_hits AS DOUBLE), 1, 0.0) OVER w AS web_hits_diff, avg(web_hits) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS web_hits_ma7,
  avg(collection_gap_rate) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS collection_gap_rate_ma7 FROM observability_day WINDOW w AS (PARTITION BY profile_id ORDER BY dt)""")
def previous_and_moving(i):
    o = G.observability_measurement(i.source_hits, i.collected_hits, i.collected_hits.where("value >= 8"))
    o = o.withColumn("web_hits", F.col("web_hits").cast("double"))
    return B.previous_and_moving(o, ["web_hits", "collection_gap_rate"])
