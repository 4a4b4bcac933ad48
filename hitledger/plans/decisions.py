"""Evidence, root causes, patterns, risk, classes and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import decisions as D, evidence as E, gaps as G
from ..session import materialize
from . import baselines, behavior
from .fixtures import RELATIONS
from .gaps import gap_sql, sides
from .registry import query

S = "profile_id, dt, scenario_name"
HEAD = "profile_id dt:date scenario_name"


def band(x, cuts=((0.75, "critical"), (0.55, "high"), (0.30, "warning"), (0.08, "low")), floor="stable"):
    return "CASE " + " ".join(f"WHEN {x} >= {c} THEN '{n}'" for c, n in cuts) + f" ELSE '{floor}' END"


def status(x):
    return band(x, ((0.6, "FAIL"), (0.2, "WARN")), "PASS")


def inlist(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


# --- behavior scores ------------------------------------------------------------

RELATIONS["contributions"] = " UNION ALL ".join(
    f"SELECT {S}, '{f}' AS score_family, metric_scope AS input_metric_scope, metric_name AS input_metric_name, risk_score AS metric_risk_score, CAST({w} AS DOUBLE) AS weight, least(1, risk_score * {w}) AS contribution_score FROM metric_delta_day WHERE scenario_name <> 'baseline' AND metric_scope = '{s}' AND metric_name IN {inlist(m)}"
    for f, s, m, w in R.CONTRIBUTIONS)


def facts(i):
    d = materialize(baselines.metric_deltas(i), "delta")
    return d, materialize(baselines.shifts(i), "shift"), materialize(baselines.B.statistical_evidence(d, d, "risk_score"), "evidence")


@query("score_contributions", "E01", f"{HEAD} score_family input_metric_scope input_metric_name metric_risk_score:d weight:d contribution_score:d", "SELECT * FROM contributions")
def score_contributions(i):
    return E.score_contributions(baselines.metric_deltas(i))


def top(scope, names):
    return f"coalesce(max(risk_score) FILTER (metric_scope = '{scope}' AND metric_name IN {inlist(names)}), 0)"


RELATIONS["stat_top"] = f"SELECT {S}, max(statistical_score) AS stat FROM evidence_day GROUP BY ALL"
RELATIONS["behavior_scores"] = f"""SELECT *, {status('batch_overall_score')} AS analysis_status, CASE WHEN batch_overall_score <= 0 THEN 'none' ELSE top.n END AS dominant_batch_signal FROM (
  SELECT *, greatest(behavior_distortion_score, conversion_distortion_score, session_fragmentation_score, mapping_risk_score, batch_quality_score, statistical_evidence_score) AS batch_overall_score,
    list_reduce([{", ".join(f"{{'s': CAST({n}_score AS DOUBLE), 'n': '{n}'}}" for n in ("behavior_distortion", "conversion_distortion", "session_fragmentation", "mapping_risk", "batch_quality"))}], lambda a, b: CASE WHEN b.s > a.s THEN b ELSE a END) AS top,
    CASE WHEN kd OR ks THEN 'baseline_available' WHEN scenario_name = 'baseline' THEN 'BASELINE_SELF_REFERENCE' ELSE 'BASELINE_MISSING_REVIEW' END AS baseline_status FROM (
  SELECT {S}, kd, ks, on_ * greatest(volume, shift, collection, collector) AS behavior_distortion_score, on_ * greatest(funnel, collection * 0.7) AS conversion_distortion_score, on_ * greatest(visits, collection * 0.45) AS session_fragmentation_score,
    on_ * (1 - mapping_coverage) AS mapping_risk_score, 0.0 AS batch_quality_score, on_ * stat AS statistical_evidence_score FROM (
  SELECT {S}, CASE WHEN scenario_name = 'baseline' THEN 0.0 ELSE 1.0 END AS on_, {top('behavior_volume', R.VOLUME_METRICS)} AS volume, {top('observability', R.COLLECTION_METRICS)} AS collection, {top('observability', R.COLLECTOR_COUNTS)} AS collector,
    {top('behavior_funnel', R.FUNNEL_METRICS)} AS funnel, {top('behavior_volume', ('visit',))} AS visits, bool_or(baseline_status = 'baseline_available') AS kd FROM metric_delta_day GROUP BY ALL) d
  JOIN (SELECT {S}, max(distribution_shift_score) AS shift, bool_or(baseline_status = 'baseline_available') AS ks FROM shift_day GROUP BY ALL) h USING ({S}) JOIN (SELECT profile_id, dt, mapping_coverage FROM coverage_day) v USING (profile_id, dt) JOIN stat_top USING ({S})) x) y"""
BEHAVIOR_COLS = f"{HEAD} behavior_distortion_score:d conversion_distortion_score:d session_fragmentation_score:d mapping_risk_score:d batch_quality_score:d statistical_evidence_score:d batch_overall_score:d dominant_batch_signal baseline_status analysis_status"


def behavior_scores(i, d, s, e):
    cov = behavior.coverage(i).select("profile_id", "dt", "mapping_coverage").join(d.select(*E.SCOPE).distinct(), ["profile_id", "dt"])
    return E.batch_behavior_score(d, s, cov, e)


@query("batch_behavior_score", "E02", BEHAVIOR_COLS, "SELECT * FROM behavior_scores")
def batch_behavior_score(i):
    return behavior_scores(i, *facts(i))


VOL = f"coalesce(max(risk_score) FILTER (metric_scope IN ('behavior_volume', 'observability') AND metric_name IN {inlist(E.VOLUME_SHIFT)}), 0)"
RELATIONS["distribution_scores"] = f"""SELECT *, CASE WHEN batch_distribution_score >= 0.2 THEN 'batch_distribution_shift' ELSE 'none' END AS distribution_signal, CASE WHEN md OR ms THEN 'BASELINE_MISSING_REVIEW' ELSE {status('batch_distribution_score')} END AS analysis_status FROM (
  SELECT *, greatest(ratio_shift_score, volume_shift_score, st) AS batch_distribution_score FROM (SELECT {S}, md, ms, on_ * shift AS ratio_shift_score, on_ * volume AS volume_shift_score, on_ * stat AS st FROM (
  SELECT {S}, CASE WHEN scenario_name = 'baseline' THEN 0.0 ELSE 1.0 END AS on_, {VOL} AS volume, bool_or(baseline_status = 'BASELINE_MISSING_REVIEW') AS md FROM metric_delta_day GROUP BY ALL) d
  JOIN (SELECT {S}, max(distribution_shift_score) AS shift, bool_or(baseline_status = 'BASELINE_MISSING_REVIEW') AS ms FROM shift_day GROUP BY ALL) h USING ({S}) JOIN stat_top USING ({S})) x) y"""


@query("distribution_analysis", "E03", f"{HEAD} ratio_shift_score:d volume_shift_score:d batch_distribution_score:d distribution_signal analysis_status", "SELECT * FROM distribution_scores")
def distribution_analysis(i):
    return E.distribution_analysis(*facts(i))


RELATIONS["hour_scores"] = f"""SELECT *, CASE WHEN (md OR ms) AND time_pattern_score <= 0 THEN 'BASELINE_MISSING_REVIEW' ELSE {status('time_pattern_score')} END AS analysis_status FROM (
  SELECT {S}, ratio AS ratio_shift_score, cnt AS count_delta_score, volume AS batch_volume_score, least(1, greatest(0, ratio, cnt - volume * 0.5)) AS localized_time_distortion_score, least(1, greatest(ratio, cnt, volume * 0.7)) AS time_pattern_score, dominant_hour, dominant_hour_delta_rate, md, ms FROM (
  SELECT {S}, max(distribution_shift_score) AS ratio, least(1, max(rate) / 0.2) AS cnt, max(rate) AS dominant_hour_delta_rate, first(dimension_value ORDER BY rate DESC, dimension_value) AS dominant_hour, bool_or(baseline_status = 'BASELINE_MISSING_REVIEW') AS ms
    FROM (SELECT *, abs(current_count - coalesce(baseline_count_avg, 0)) / greatest(abs(coalesce(baseline_count_avg, 0)), 1) AS rate FROM shift_day WHERE dimension_name = 'hour') r GROUP BY ALL) h
  JOIN (SELECT {S}, {VOL} AS volume, bool_or(baseline_status = 'BASELINE_MISSING_REVIEW') AS md FROM metric_delta_day GROUP BY ALL) d USING ({S})) x"""


@query("time_pattern", "E04 T05", f"{HEAD} ratio_shift_score:d count_delta_score:d batch_volume_score:d localized_time_distortion_score:d time_pattern_score:d dominant_hour dominant_hour_delta_rate:d analysis_status", "SELECT * FROM hour_scores")
def time_pattern(i):
    d, s, _ = facts(i)
    return E.time_pattern(s, d)


FAMILY = "CASE score_family WHEN 'behavior_distortion' THEN 1 WHEN 'collection_effect' THEN 2 WHEN 'conversion_distortion' THEN 3 WHEN 'session_fragmentation' THEN 4 ELSE 9 END"
RELATIONS["top_contributions"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY contribution_score DESC, {FAMILY}, CASE WHEN input_metric_name IN ('event_count', 'pv', 'pv_count', 'pageview_count') THEN 1 ELSE 5 END, input_metric_name, input_metric_scope) AS rn FROM contributions) x WHERE rn = 1"""


@query("top_contribution", "T06", f"{HEAD} score_family input_metric_name contribution_score:d", "SELECT * FROM top_contributions")
def top_contribution(i):
    return E.top_contribution(E.score_contributions(baselines.metric_deltas(i)))


RELATIONS["anomaly_day"] = f"""SELECT *, greatest(batch_score, collection_score) AS anomaly_score, {status('greatest(batch_score, collection_score)')} AS anomaly_status, CASE WHEN collection_score >= 0.6 AND batch_score >= 0.6 THEN 'observed_kpi_distortion_from_collection_loss' WHEN collection_score >= 0.2 THEN 'observability_collection_anomaly'
  WHEN batch_score >= 0.2 THEN 'batch_behavior_distortion' ELSE 'none' END AS anomaly_signal FROM (
  SELECT {S}, least(1, greatest(gap, coalesce(collected, 0))) AS collection_score, least(1, greatest(behavior, distribution, coalesce(contribution, 0), metric * 0.5, stat)) AS batch_score, coalesce(t.score_family, 'none') AS top_score_family, coalesce(t.input_metric_name, 'none') AS top_metric_name, coalesce(t.contribution_score, 0) AS top_contribution_score
  FROM (SELECT {S}, greatest(batch_overall_score, behavior_distortion_score, conversion_distortion_score, session_fragmentation_score) AS behavior FROM behavior_scores) b JOIN (SELECT {S}, batch_distribution_score AS distribution FROM distribution_scores) d USING ({S})
  JOIN (SELECT {S}, greatest(collection_gap_rate * 3, canonical_gap_rate * 3, checkout_missing_rate * 2, product_missing_rate * 2, uv_gap_rate * 2) AS gap FROM observability_day) o USING ({S}) JOIN (SELECT {S}, max(risk_score) AS metric FROM metric_delta_day GROUP BY ALL) m USING ({S}) JOIN stat_top USING ({S})
  LEFT JOIN (SELECT {S}, max(contribution_score) AS contribution, max(contribution_score) FILTER (input_metric_scope = 'observability') AS collected FROM contributions GROUP BY ALL) c USING ({S}) LEFT JOIN top_contributions t USING ({S})) x"""


def observed(i):
    return G.observability_measurement(i.source_hits, i.collected_hits, i.collected_hits.where("value >= 8"))


@query("behavior_anomaly", "E05", f"{HEAD} collection_score:d batch_score:d anomaly_score:d anomaly_signal anomaly_status top_score_family top_metric_name top_contribution_score:d", "SELECT * FROM anomaly_day")
def behavior_anomaly(i):
    d, s, e = facts(i)
    b = materialize(behavior_scores(i, d, s, e), "behavior")
    return E.behavior_anomaly(b, E.distribution_analysis(d, s, e), observed(i), E.score_contributions(d), d, e)


# --- score rows: one scope per user and day, all scores from whole-number sums -----

_V = "CAST(floor(value * 100) AS BIGINT)"
RELATIONS["score_rows"] = f"""SELECT profile_id, dt, scenario_name, n, r1 / (n * 10000) AS a, least(CAST(1 AS DOUBLE), r2 / 20000) AS b, least(CAST(1 AS DOUBLE), r3 / n) AS c, least(CAST(1 AS DOUBLE), r4 / (n * 2)) AS d, CAST(s1 % 1000 AS DOUBLE) / 1000 AS e, CAST(s2 % 700 AS DOUBLE) / 700 AS f, CAST(s1 % 77 AS DOUBLE) / 77 AS g,
  s1 % 400 AS k1, s2 % 300 AS k2, s1 % 130 AS k3, s2 % 60 AS k4, CASE s2 % 6 WHEN 0 THEN 'completeness' WHEN 1 THEN 'latency_performance' WHEN 2 THEN 'availability' WHEN 3 THEN 'schema_validation' WHEN 4 THEN 'low' ELSE 'other' END AS family FROM (
  SELECT *, CAST(s1 AS DOUBLE) AS r1, CAST(s2 AS DOUBLE) AS r2, CAST(s3 AS DOUBLE) AS r3, CAST(s4 AS DOUBLE) AS r4 FROM (
  SELECT concat('p', CAST(user_id AS STRING)) AS profile_id, CAST(ts AS DATE) AS dt, CASE WHEN day(CAST(ts AS DATE)) % 4 = 0 THEN 'baseline' ELSE 'source_wc_collection_missing' END AS scenario_name, count(*) AS n, CAST(sum({_V}) AS BIGINT) AS s1, max({_V}) AS s2,
  count(CASE WHEN event_type = 'error' THEN 1 END) AS s3, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS s4 FROM events GROUP BY user_id, CAST(ts AS DATE)) x) y"""
CALM = "scenario_name = 'baseline'"
RELATIONS["runtime_rows"] = "SELECT *, a * 0.4 AS behavior_distortion_score, b AS batch_distribution_score, c * 0.5 AS duplicate_rate, d * 0.3 AS late_event_rate, 1 - e * 0.4 AS availability_score, 0.95 AS performance_score, g * 0.2 AS error_rate, CASE WHEN k4 < 20 THEN 0.0 ELSE f * 0.6 END AS completeness_delta, 0.0 AS timeliness_delta, 0.0 AS availability_delta, 0.0 AS integrity_delta FROM score_rows"


@query("runtime_evidence", "E06 T04", f"{HEAD} batch_evidence_score:d stream_evidence_score:d operational_evidence_score:d realism_evidence_score:d runtime_evidence_score:d dominant_runtime_signal evidence_level",
       f"""SELECT *, CASE WHEN runtime_evidence_score <= 0 THEN 'none' ELSE top.n END AS dominant_runtime_signal, {band('runtime_evidence_score', ((0.75, 'critical'), (0.5, 'high'), (0.25, 'warning')), 'low')} AS evidence_level FROM (
  SELECT *, greatest(batch_evidence_score, stream_evidence_score, operational_evidence_score, realism_evidence_score) AS runtime_evidence_score, list_reduce([{", ".join(f"{{'s': CAST({n}_evidence_score AS DOUBLE), 'n': '{n}'}}" for n in ("batch", "stream", "operational", "realism"))}], lambda x, y: CASE WHEN y.s > x.s THEN y ELSE x END) AS top FROM (
  SELECT {S}, on_ * least(1, greatest(behavior_distortion_score, batch_distribution_score)) AS batch_evidence_score, on_ * least(1, greatest(duplicate_rate, late_event_rate)) AS stream_evidence_score, on_ * least(1, greatest(1 - availability_score, 1 - performance_score, error_rate)) AS operational_evidence_score,
  on_ * completeness_delta AS realism_evidence_score FROM (SELECT *, CASE WHEN {CALM} AND completeness_delta <= 0.0001 THEN 0.0 ELSE 1.0 END AS on_ FROM runtime_rows) r) x) y""")
def runtime_evidence(i):
    return E.runtime_evidence(i.runtime_rows)


OBS_PARTS = ("collection_completeness", "canonical_observability_gap", "uv_observability_gap", "journey_stage_distortion", "statistical_signal", "kpi_false_degradation")
RELATIONS["observability_scores"] = f"""SELECT *, {band('observability_overall_score', ((0.65, 'high'), (0.35, 'warning')), 'low')} AS risk_level, top.n AS dominant_observability_signal, CASE WHEN observability_overall_score < 0.08 THEN 'None' WHEN top.n IN ('collection_completeness', 'canonical_observability_gap') THEN 'WC Collection Completeness Risk'
  WHEN top.n = 'kpi_false_degradation' THEN 'False KPI Degradation Risk' ELSE 'Operational Observability Distortion' END AS recommended_semantic_risk FROM (
  SELECT *, greatest({", ".join(OBS_PARTS)}) * 0.7 + ({" + ".join(OBS_PARTS)}) / 6 * 0.3 AS observability_overall_score, list_reduce([{", ".join(f"{{'s': CAST({n} AS DOUBLE), 'n': '{n}'}}" for n in OBS_PARTS)}], lambda x, y: CASE WHEN y.s > x.s THEN y ELSE x END) AS top FROM (
  SELECT *, greatest(collection_completeness, canonical_observability_gap, journey_stage_distortion) AS kpi_false_degradation FROM (
  SELECT {S}, least(1, collection_gap_rate * 3) AS collection_completeness, least(1, canonical_gap_rate * 3) AS canonical_observability_gap, least(1, uv_gap_rate * 2) AS uv_observability_gap, least(1, greatest(checkout_missing_rate, product_missing_rate) * 2) AS journey_stage_distortion, 0.0 AS statistical_signal FROM observability_day) a) b) d"""


@query("observability_analysis", "E07", f"{HEAD} collection_completeness:d canonical_observability_gap:d uv_observability_gap:d journey_stage_distortion:d kpi_false_degradation:d observability_overall_score:d risk_level dominant_observability_signal recommended_semantic_risk",
       "SELECT * FROM observability_scores")
def observability_analysis(i):
    return E.observability_analysis(observed(i))


@query("observability_actions", "E17", f"{HEAD} action_rank:i action_type recommended_action score:d",
       f"""SELECT {S}, r AS action_rank, action_type, recommended_action, observability_overall_score AS score FROM observability_scores JOIN (SELECT * FROM (VALUES {", ".join(f"('{k}', {n}, '{a}', '{t}')" for k, v in R.OBSERVABILITY_ACTIONS.items() for n, (a, t) in enumerate(v, 1))}) AS t(label, r, action_type, recommended_action)) a
  ON recommended_semantic_risk = label WHERE observability_overall_score >= 0.15""")
def observability_actions(i):
    return D.observability_actions(E.observability_analysis(observed(i)))


@query("source_anomaly_trace", "E22", f"{HEAD} anomaly_type source_layer affected_count:i total_count:i affected_ratio:d original_count:i final_count:i",
       f"SELECT {S}, 'wc_collection_missing' AS anomaly_type, 'wc_collector' AS source_layer, collection_gap_count AS affected_count, web_hits AS total_count, collection_gap_rate AS affected_ratio, web_hits AS original_count, wc_hits AS final_count FROM observability_day WHERE collection_gap_count > 0")
def source_anomaly_trace(i):
    return D.source_anomaly_trace(observed(i))


# --- root causes ---------------------------------------------------------------------

APP = "app_platform, app_version, sdk_version"
FULL = [("event_count", "missing_rate"), *[(m, f"{m}_missing_rate") for m in ("pv", "uv", "visit", "conversion")]]
SHORT = [("event_count", "missing_rate"), ("uv", "uv_missing_rate")]


def cand(rel, dim, value, source, missing, rates, rows="1", total=None):
    total = total or f"sum({missing}) OVER (PARTITION BY {S})"
    items = ", ".join(f"{{'n': '{n}', 'r': CAST(coalesce({r}, 0) AS DOUBLE)}}" for n, r in rates)
    return f"SELECT {S}, {dim} AS root_cause_dimension, {value} AS root_cause_value, '{source}' AS source_table, {rows} AS evidence_row_count, CASE WHEN {total} > 0 THEN greatest(0, least(1, {missing} / {total})) ELSE 0 END AS segment_concentration, [{items}] AS rates FROM ({rel}) q"


def slash(*names):
    return " || '/' || ".join(names)


IDR = [("uid", "uid_missing_rate"), ("login_user", "login_user_gap_rate"), ("identity_integrity", "identity_integrity_gap")]
SHR = [("url_distribution", "distribution_shift_score"), ("url_undercount", "under_rate"), ("url_overcount", "over_rate")]
KPR = [("purchase_event", "purchase_event_gap_rate"), ("conversion", "conversion_gap_rate"), ("revenue_proxy", "revenue_proxy_gap_rate"), ("business_kpi", "business_kpi_distortion_score")]
_alt = lambda m, a: f"CASE WHEN sum({m}) OVER (PARTITION BY {S}) > 0 THEN sum({m}) OVER (PARTITION BY {S}) ELSE sum({a}) OVER (PARTITION BY {S}) END"
MG = ", ".join(f"max(gap_rate) FILTER (metric_name = '{m}') AS {m}" for m in ("event_count", "pv", "uv", "visit", "conversion"))
RELATIONS["cause_rows"] = " UNION ALL ".join([
    cand(gap_sql(APP), "'app_version'", slash("app_platform", "app_version", "sdk_version"), "app_gap", "missing_count", FULL),
    cand(gap_sql("app_platform, sdk_version"), "'sdk_version'", slash("app_platform", "sdk_version"), "sdk_gap", "missing_count", FULL),
    cand(gap_sql(APP + ", surface_path"), "'url_path'", "surface_path", "url_gap", "missing_count", SHORT),
    cand(gap_sql(APP + ", device_type, browser_family, os_family"), "'client'", slash("app_platform", "device_type", "browser_family", "os_family"), "client_gap", "missing_count", SHORT),
    cand(f"SELECT {S}, dimension_type, dimension_value, sum(missing_value) AS missing_count, count(*) AS nr, {MG} FROM metric_gap_day GROUP BY ALL", "'metric_' || dimension_type", "dimension_value", "metric_gap", "missing_count", [(m, m) for m in ("event_count", "pv", "uv", "visit", "conversion")], "nr"),
    cand("SELECT * FROM identity_gap_day", "'app_version'", slash("app_platform", "app_version", "sdk_version"), "identity_gap", "uid_missing_count", IDR, total=_alt("uid_missing_count", "identity_integrity_gap")),
    cand("SELECT * FROM url_shift_day", "'sdk_version'", slash("app_platform", "sdk_version"), "url_semantic_gap", "(under_count + over_count)", SHR, total=_alt("(under_count + over_count)", "distribution_shift_score")),
    cand("SELECT *, greatest(purchase_event_gap_rate, conversion_gap_rate, revenue_proxy_gap_rate, business_kpi_distortion_score) AS tp FROM kpi_gap_day", "'business_kpi'", "'all:all'", "business_kpi_gap", "tp", KPR, total="CASE WHEN business_kpi_distortion_score > 0 THEN business_kpi_distortion_score ELSE tp END"),
])
RELATIONS["causes"] = f"""SELECT *, {band('propagation_strength', ((0.7, 'high'), (0.4, 'medium')), 'x').replace("ELSE 'x'", "WHEN propagation_strength > 0 THEN 'low' ELSE 'none'")} AS propagation_level, {band('statistical_severity_score')} AS statistical_severity_level, {band('root_cause_confidence', ((0.8, 'high'), (0.55, 'medium'), (0.3, 'low')), 'weak')} AS confidence_level,
  {band('root_cause_confidence', ((0.55, 'SIGNAL'), (0.3, 'WATCH')), 'PASS')} AS analysis_status FROM (
  SELECT *, least(1, 0.3 * segment_concentration + 0.25 * multi + 0.25 * statistical_severity_score + 0.2 * propagation_strength) AS root_cause_confidence FROM (
  SELECT *, greatest(least(1, greatest(mx, av) * 3) * 0.65, kpi_distortion_score * 0.55) AS statistical_severity_score, least(1, 0.55 * multi + CASE WHEN affected_metrics >= 3 THEN 0.2 ELSE 0 END) AS propagation_strength FROM (
  SELECT *, least(1, affected_metrics / 5) AS multi FROM (
  SELECT {S}, root_cause_dimension, root_cause_value, source_table, evidence_row_count, segment_concentration, len(list_filter(rates, lambda x: x.r > 0.01)) AS affected_metrics, array_to_string(list_transform(list_filter(rates, lambda x: x.r > 0.01), lambda x: x.n), ',') AS affected_metric_list,
    list_max(list_transform(rates, lambda x: x.r)) AS mx, list_avg(list_transform(rates, lambda x: x.r)) AS av, list_avg(list_transform(rates, lambda x: least(x.r, 1))) AS kpi_distortion_score FROM cause_rows) a) b) c) d"""
CAUSE = "segment_concentration:d affected_metrics:i affected_metric_list propagation_strength:d propagation_level statistical_severity_score:d statistical_severity_level kpi_distortion_score:d root_cause_confidence:d confidence_level analysis_status"


def causes(i):
    w, k = sides(i)
    shifted = k.withColumn("surface_path", F.when(F.col("value") > 200, "/order/pizza").otherwise(F.col("surface_path")))
    # gap facts are written once and read by every later layer
    gaps = [G.gap_by_app(w, k), G.gap_by_sdk(w, k), G.gap_by_url(w, k), G.gap_by_client(w, k), G.metric_gap(w, k), G.identity_gap(w, k), G.url_semantic_gap(w, shifted), G.business_kpi_gap(w, k)]
    return E.root_cause_candidates(*[materialize(g, "gaps") for g in gaps])


@query("root_cause_candidates", "E08", f"{HEAD} root_cause_dimension root_cause_value source_table evidence_row_count:i {CAUSE}", "SELECT * FROM causes")
def root_cause_candidates(i):
    return causes(i)


RELATIONS["merged_causes"] = f"""SELECT c.* EXCLUDE (source_table, evidence_row_count, rn), m.source_table, m.evidence_row_count FROM (SELECT *, row_number() OVER (PARTITION BY {S}, root_cause_dimension, root_cause_value ORDER BY round(root_cause_confidence, 9) DESC, affected_metrics DESC, source_table DESC) AS rn FROM causes) c
  JOIN (SELECT {S}, root_cause_dimension, root_cause_value, array_to_string(list_sort(list_distinct(list(source_table))), ',') AS source_table, sum(evidence_row_count) AS evidence_row_count FROM causes GROUP BY ALL) m USING ({S}, root_cause_dimension, root_cause_value) WHERE rn = 1"""
MERGED = f"{HEAD} root_cause_dimension root_cause_value source_table evidence_row_count:i affected_metrics:i root_cause_confidence:d confidence_level analysis_status"


@query("merge_candidates", "E09", MERGED, "SELECT * FROM merged_causes")
def merge_candidates(i):
    return E.merge_candidates(causes(i))


RELATIONS["ranked_causes"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY round(root_cause_confidence, 9) DESC, root_cause_dimension, root_cause_value) AS root_cause_rank FROM merged_causes) x WHERE root_cause_rank <= 20"


def ranked(i):
    return E.top_root_causes(E.merge_candidates(causes(i)), i.source_hits.select(*G.SCOPE))


@query("top_root_causes", "W12 T03", f"{HEAD} root_cause_rank:i root_cause_dimension root_cause_value affected_metrics:i root_cause_confidence:d confidence_level analysis_status", "SELECT * FROM ranked_causes")
def top_root_causes(i):
    return ranked(i)


# --- propagation, evidence, pattern, risk --------------------------------------------

RELATIONS["propagation_rows"] = """SELECT *, e AS behavior_transaction_match_rate, f AS transaction_state_match_rate, k1 AS behavior_only_count, k2 AS transaction_only_count, k3 + 5 AS behavior_transaction_matched_count, k1 + k2 + k3 + 5 AS behavior_transaction_total_count, k4 AS orphan_state_count, k3 AS transaction_without_state_count,
  k2 AS transaction_state_matched_count, k2 + k3 + k4 AS transaction_state_total_count, g * 0.4 AS payment_order_gap, c * 0.2 AS coupon_reconciliation_gap, d * 0.3 AS refund_transition_gap, e * 0.5 AS conversion_gap, k4 * 3 AS propagation_distortion_count, k1 * 9 AS behavior_event_count, k2 AS transaction_event_count, k3 AS state_event_count,
  a * 0.2 AS batch_behavior_score, 0.0 AS batch_conversion_score, b * 0.3 AS obs_gap_score, c * 0.6 AS statistical_score, k4 % 9 AS sample_days, 0.0 AS baseline_quality_score, k4 % 2 AS evidence_rows, d * 0.4 AS runtime_evidence_score FROM score_rows"""
_DOM = ", ".join(f"{{'s': CAST({d}_impact_score AS DOUBLE), 'n': '{d}'}}" for d in E.DOMAINS)
RELATIONS["propagated"] = f"""SELECT *, CASE WHEN propagation_strength >= 0.85 THEN 'critical' WHEN propagation_strength >= 0.7 THEN 'high' ELSE {band('propagation_strength')} END AS propagation_level FROM (
  SELECT *, len(doms) AS affected_domain_count, '[' || array_to_string(list_transform(doms, lambda x: '"' || x || '"'), ',') || ']' AS affected_domains, CASE WHEN {CALM} THEN 0 ELSE least(1, 0.3 * behavior_impact_score + 0.22 * greatest(transaction_impact_score, attribution_impact_score) + 0.18 * conversion_impact_score + 0.15 * state_impact_score + 0.1 * len(doms) / 5 + 0.05 * greatest(statistical_score, runtime_evidence_score)) END AS propagation_strength,
    least(1, 0.4 * least(1, log10(greatest(behavior_event_count + transaction_event_count + state_event_count, behavior_transaction_total_count + transaction_state_total_count) + 1) / 4) + 0.25 * evidence_rows + 0.2 * least(1, sample_days / 7) + 0.15 * CASE WHEN sample_days >= 3 THEN 0.8 ELSE 0.35 END) AS reconciliation_confidence FROM (
  SELECT *, CASE WHEN {CALM} THEN [] WHEN len(hit) > 0 THEN list_transform(hit, lambda x: x.n) WHEN greatest({", ".join(f"{d}_impact_score" for d in E.DOMAINS)}) > 0 THEN [best.n] ELSE [] END AS doms FROM (
  SELECT *, list_filter([{_DOM}], lambda x: x.s >= 0.1) AS hit, list_reduce([{_DOM}], lambda x, y: CASE WHEN y.s > x.s THEN y ELSE x END) AS best FROM (
  SELECT *, least(1, greatest(batch_behavior_score, obs_gap_score, bt * 0.35, bo * 1.2)) AS behavior_impact_score, least(1, greatest(bt * 0.65, tx * 2, payment_order_gap, coupon_reconciliation_gap)) AS transaction_impact_score, least(1, greatest(ts_ * 0.85, orp * 1.25, nos * 1.5, refund_transition_gap)) AS state_impact_score,
    least(1, greatest(conversion_gap, obs_gap_score * 0.75)) AS conversion_impact_score, least(1, greatest(bo * 1.5, tx * 2, coupon_reconciliation_gap, propagation_distortion_count / bt_n)) AS attribution_impact_score FROM (
  SELECT *, 1 - behavior_transaction_match_rate AS bt, 1 - transaction_state_match_rate AS ts_, greatest(behavior_transaction_total_count, 1) AS bt_n, least(1, behavior_only_count / greatest(behavior_transaction_total_count, 1)) AS bo, least(1, transaction_only_count / greatest(behavior_transaction_total_count, 1)) AS tx,
    least(1, orphan_state_count / greatest(transaction_state_total_count, 1)) AS orp, least(1, transaction_without_state_count / greatest(transaction_state_total_count, 1)) AS nos FROM propagation_rows) r) t) u) v) w"""


@query("propagation_evidence", "E10", f"{HEAD} behavior_impact_score:d transaction_impact_score:d state_impact_score:d conversion_impact_score:d attribution_impact_score:d propagation_strength:d propagation_level affected_domain_count:i affected_domains reconciliation_confidence:d",
       "SELECT * FROM propagated")
def propagation_evidence(i):
    return E.propagation_evidence(i.propagation_rows)


RELATIONS["gap_input_day"] = f"""SELECT {S}, least(1, greatest(ca, cs, identity_integrity_score, semantic_shift_score)) AS segment_concentration, identity_integrity_score, semantic_shift_score, max_gap_rate, greatest(mc, kc) AS conversion_gap_rate, greatest(mp, kp) AS pv_gap_rate FROM
  (SELECT {S}, concentration AS ca FROM app_concentration_day) a JOIN (SELECT {S}, max(greatest(identity_integrity_gap, uid_missing_rate, login_user_gap_rate)) AS identity_integrity_score FROM identity_gap_day GROUP BY ALL) i USING ({S})
  JOIN (SELECT {S}, max(greatest(distribution_shift_score, under_rate, over_rate)) AS semantic_shift_score FROM url_shift_day GROUP BY ALL) u USING ({S})
  JOIN (SELECT {S}, max(gap_rate) AS max_gap_rate, max(gap_rate) FILTER (metric_name = 'conversion') AS mc, max(gap_rate) FILTER (metric_name IN ('pv', 'event_count')) AS mp FROM metric_gap_day GROUP BY ALL) m USING ({S})
  JOIN (SELECT {S}, greatest(conversion_gap_rate, purchase_event_gap_rate) AS kc, pv_gap_rate AS kp FROM kpi_gap_day) k USING ({S})
  JOIN (SELECT {S}, least(1, greatest(0, greatest(max(missing_count / nullif(tm, 0) - web_event_count / nullif(tw, 0)) * 1.6, max(missing_rate) * 0.75))) AS cs FROM (SELECT *, sum(missing_count) OVER w AS tm, sum(web_event_count) OVER w AS tw FROM ({gap_sql('app_platform, sdk_version')}) g WINDOW w AS (PARTITION BY {S})) x GROUP BY ALL) s USING ({S})"""


@query("gap_inputs", "E11 A36", f"{HEAD} segment_concentration:d identity_integrity_score:d semantic_shift_score:d max_gap_rate:d conversion_gap_rate:d pv_gap_rate:d", "SELECT * FROM gap_input_day")
def gap_inputs(i):
    w, k = sides(i)
    shifted = k.withColumn("surface_path", F.when(F.col("value") > 200, "/order/pizza").otherwise(F.col("surface_path")))
    return E.gap_inputs(G.gap_by_app(w, k), G.gap_by_sdk(w, k), G.identity_gap(w, k), G.url_semantic_gap(w, shifted), G.metric_gap(w, k), G.business_kpi_gap(w, k))


RELATIONS["evidence_rows"] = """SELECT profile_id, dt, scenario_name, k1 % 7 AS affected_domain_count, 1 - e * 0.3 AS behavior_transaction_match_rate, 1 - f * 0.4 AS transaction_state_match_rate, k1 % 9 AS behavior_only_count, k2 % 11 AS transaction_only_count, k3 AS transaction_without_state_count, k4 + 40 AS orphan_state_count,
  k3 AS behavior_transaction_matched_count, CASE WHEN k4 < 40 THEN c * 0.3 ELSE b END AS statistical_score, CASE WHEN k4 < 45 THEN g * 0.2 ELSE a END AS cross_domain_strength, d AS runtime_evidence_score, CASE WHEN k3 < 70 THEN g * 0.14 ELSE e END AS segment_concentration, CASE WHEN k2 < 150 THEN g * 0.09 ELSE f END AS identity_integrity_score,
  CASE WHEN k1 < 200 THEN e * 0.3 ELSE 0.05 END AS semantic_shift_score, f AS max_gap_rate, CASE WHEN k4 < 15 THEN e ELSE c * 0.2 END AS conversion_gap_rate, CASE WHEN k2 < 200 THEN g * 0.11 ELSE f * 0.3 END AS pv_gap_rate, b * 0.9 AS reconciliation_confidence, c AS stream_evidence_score, d AS operational_evidence_score, a * 0.3 AS batch_evidence_score, 0.1 AS realism_evidence_score, CASE k4 % 5 WHEN 0 THEN 'app_version' WHEN 1 THEN 'sdk_version' WHEN 2 THEN 'url_path' WHEN 3 THEN 'client' ELSE 'none' END AS root_cause_dimension,
  'none' AS root_cause_label, g AS root_cause_confidence FROM score_rows"""
_EV = ("reconciliation_gap_score", "propagation_score", "amplification_score", "distortion_score", "transaction_loss_score", "customer_impact_score", "baseline_evidence", "statistical", "propagation", "impact", "concentration", "criticality", "identity_integrity", "semantic_shift")
RELATIONS["evidenced"] = f"""SELECT * EXCLUDE ({", ".join(_EV)}), {", ".join(f"CASE WHEN {CALM} THEN 0 ELSE {e} END AS {e}" for e in _EV)}, CASE WHEN {CALM} THEN 1 ELSE 1 - max_gap_rate * 0.25 END AS visibility_score FROM (
  SELECT *, least(1, 0.88 * least(1, greatest(0.4 * reconciliation_gap_score + 0.2 * distortion_score + 0.15 * transaction_loss_score + 0.1 * propagation_score + 0.15 * propagation, statistical, 0.85 * propagation)) + 0.12 * runtime_evidence_score) AS baseline_evidence, greatest(customer_impact_score, transaction_loss_score, reconciliation_gap_score) AS impact,
    CASE WHEN conversion_gap_rate >= 0.5 AND traffic_preservation >= 0.45 THEN greatest(0.75, business_kpi_distortion) WHEN conversion_gap_rate >= 0.3 AND traffic_preservation >= 0.3 THEN greatest(0.45, business_kpi_distortion * 0.85) ELSE conversion_gap_rate * 0.35 END AS criticality FROM (
  SELECT *, 0.65 * conversion_gap_rate + 0.35 * traffic_preservation AS business_kpi_distortion, 0.35 * distortion_score + 0.25 * reconciliation_gap_score + 0.2 * propagation_score AS customer_impact_score FROM (
  SELECT *, (1 - behavior_transaction_match_rate) * 0.25 + (1 - transaction_state_match_rate) * 0.2 AS reconciliation_gap_score, transaction_without_state_count / greatest(transaction_without_state_count + orphan_state_count, 1) AS propagation_score, behavior_only_count / greatest(behavior_only_count + behavior_transaction_matched_count, 1) AS amplification_score,
    behavior_only_count / greatest(behavior_only_count + 1, 1) * 0.22 + transaction_only_count / greatest(behavior_only_count + transaction_only_count, 1) * 0.1 AS distortion_score, transaction_only_count / greatest(behavior_only_count + transaction_only_count, 1) AS transaction_loss_score, statistical_score AS statistical, least(1, cross_domain_strength) AS propagation,
    segment_concentration AS concentration, identity_integrity_score AS identity_integrity, semantic_shift_score AS semantic_shift, CASE WHEN pv_gap_rate <= 0.02 THEN 1 WHEN pv_gap_rate <= 0.12 THEN 1 - pv_gap_rate / 0.12 * 0.55 ELSE 0 END AS traffic_preservation FROM evidence_rows) p) q) r"""


@query("reliability_evidence", "E11", f"{HEAD} " + " ".join(f"{e}:d" for e in (*_EV, "traffic_preservation", "business_kpi_distortion", "visibility_score")), "SELECT * FROM evidenced")
def reliability_evidence(i):
    return E.reliability_evidence(i.evidence_rows)


HB = "greatest(baseline_evidence, statistical)"
HURT = "greatest(transaction_loss_score, customer_impact_score, impact)"
P_RULES = [
    ("stable", f"{CALM} OR greatest({HB}, impact, propagation, concentration, criticality) < 0.08", "1"),
    ("silent_distortion", "criticality >= 0.6 AND business_kpi_distortion >= 0.6 AND traffic_preservation >= 0.3", f"0.35 * criticality + 0.3 * business_kpi_distortion + 0.2 * traffic_preservation + 0.15 * {HB}"),
    ("localized_failure", "concentration >= 0.15", f"0.5 * concentration + 0.3 * {HB} + 0.2 * greatest(impact, criticality)"),
    ("reconciliation_failure", f"reconciliation_gap_score >= 0.15 AND {HURT} >= 0.08", f"0.45 * reconciliation_gap_score + 0.35 * {HURT} + 0.2 * {HB}"),
    ("systemic_failure", f"propagation >= 0.55 AND greatest({HB}, impact) >= 0.2", f"0.45 * propagation + 0.35 * {HB} + 0.2 * impact"),
    ("emerging_reliability_degradation", "true", f"0.4 * {HB} + 0.25 * impact + 0.2 * propagation + 0.15 * greatest(concentration, criticality)"),
]


def case(rules, k):
    return "CASE " + " ".join(f"WHEN {r[1]} THEN " + (f"'{r[0]}'" if k == 0 else f"least(1, {r[2]})") for r in rules) + " END"


RELATIONS["patterned"] = f"SELECT *, {case(P_RULES, 0)} AS risk_pattern, {case(P_RULES, 1)} AS pattern_confidence FROM evidenced"
LOCAL = "risk_pattern = 'localized_failure'"
M_RULES = [
    ("none", f"risk_pattern = 'stable' OR {CALM}", "1"), ("critical_event_loss", "risk_pattern = 'silent_distortion' AND criticality >= 0.6", "greatest(criticality, business_kpi_distortion, pattern_confidence)"),
    ("identity_integrity_breakage", f"{LOCAL} AND identity_integrity >= greatest(semantic_shift, 0.1) AND traffic_preservation >= 0.3", "greatest(identity_integrity, concentration, pattern_confidence)"),
    ("semantic_attribution_distortion", f"{LOCAL} AND semantic_shift >= 0.1 AND traffic_preservation >= 0.3 AND pv_gap_rate <= 0.25", "greatest(semantic_shift, concentration, pattern_confidence)"),
    ("collection_completeness_loss", LOCAL, "greatest(concentration, pattern_confidence, 1 - traffic_preservation)"), ("cross_domain_mapping_gap", "risk_pattern = 'reconciliation_failure'", "greatest(reconciliation_confidence, pattern_confidence)"),
    ("systemic_observability_degradation", "risk_pattern = 'systemic_failure'", "greatest(propagation, pattern_confidence)"), ("emerging_reliability_degradation", "true", "pattern_confidence"),
]
RELATIONS["mechanized"] = f"SELECT *, {case(M_RULES, 0)} AS failure_mechanism, {case(M_RULES, 1)} AS mechanism_confidence FROM patterned"
TERMS = {
    "baseline_evidence": "baseline_evidence", "statistical": "statistical", "propagation": "propagation", "impact": "impact", "concentration": "concentration", "criticality": "criticality", "pattern_confidence": "pattern_confidence",
    "pattern_or_mechanism": "greatest(pattern_confidence, mechanism_confidence)", "identity_or_shift": "greatest(identity_integrity, semantic_shift)", "customer_impact": "customer_impact_score", "transaction_loss": "transaction_loss_score", "kpi_distortion": "impact",
    "affected_domains": "least(1, affected_domain_count / 5)", "runtime_impact": "least(1, 0.35 * runtime_evidence_score + 0.2 * stream_evidence_score + 0.25 * operational_evidence_score + 0.1 * batch_evidence_score + 0.1 * realism_evidence_score)",
}


def weights(table):
    total = lambda w: "least(1, " + " + ".join(f"{x} * {TERMS[n]}" for n, x in w.items()) + ")"
    return f"CASE WHEN risk_pattern = 'stable' OR {CALM} THEN 0 " + " ".join(f"WHEN risk_pattern = '{p}' THEN {total(w)}" for p, w in table.items() if p != "other") + f" ELSE {total(table['other'])} END"


RELATIONS["risked"] = f"""SELECT *, {band('overall_risk_score')} AS final_risk_level, CASE WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium' WHEN confidence_score > 0 THEN 'low' ELSE 'unknown' END AS confidence_level FROM (
  SELECT *, likelihood_score * impact_score AS overall_risk_score, greatest(reconciliation_confidence, pattern_confidence, mechanism_confidence) AS confidence_score FROM (SELECT *, {weights(R.LIKELIHOOD)} AS likelihood_score, {weights(R.IMPACT)} AS impact_score FROM mechanized) x) y"""


def evidenced(i):
    return E.reliability_evidence(i.evidence_rows)


def risked(i):
    return D.risk(D.failure_mechanism(D.pattern(evidenced(i))))


@query("pattern", "E12", f"{HEAD} risk_pattern pattern_confidence:d", "SELECT * FROM patterned")
def pattern(i):
    return D.pattern(evidenced(i))


@query("failure_mechanism", "E13", f"{HEAD} risk_pattern failure_mechanism mechanism_confidence:d", "SELECT * FROM mechanized")
def failure_mechanism(i):
    return D.failure_mechanism(D.pattern(evidenced(i)))


@query("risk", "E14", f"{HEAD} risk_pattern likelihood_score:d impact_score:d overall_risk_score:d final_risk_level confidence_score:d confidence_level", "SELECT * FROM risked")
def risk(i):
    return risked(i)


_CLS = ", ".join(f"('{p}', '{v[0]}', '{v[1]}', '{v[2]}', '{v[3]}')" for p, v in R.CLASSES.items())
OFF = f"risk_pattern = 'stable' OR {CALM} OR overall_risk_score < 0.08"
RELATIONS["classified"] = f"""SELECT r.* EXCLUDE (root_cause_confidence), cls AS classification, ck AS catalog_key, tpl AS narrative_template_id, rule AS mapping_rule_id, CASE WHEN {OFF} THEN 'NONE' WHEN failure_mechanism IN ('identity_integrity_breakage', 'semantic_attribution_distortion', 'critical_event_loss', 'collection_completeness_loss') THEN upper(failure_mechanism)
  WHEN root_cause_dimension = 'app_version' THEN 'APP_VERSION_TAGGING_BREAKAGE' WHEN root_cause_dimension = 'sdk_version' THEN 'SDK_COMPATIBILITY_OR_COLLECTION_BREAKAGE' WHEN root_cause_dimension = 'url_path' THEN 'URL_TAGGING_BREAKAGE' WHEN root_cause_dimension = 'client' THEN 'CLIENT_COVERAGE_GAP' ELSE 'UNKNOWN_ROOT_CAUSE' END AS root_cause_candidate,
  CASE WHEN {OFF} THEN 0 ELSE greatest(confidence_score, r.root_cause_confidence, mechanism_confidence) END AS root_cause_confidence FROM risked r JOIN (SELECT * FROM (VALUES {_CLS}) AS t(p, cls, ck, tpl, rule)) t ON p = CASE WHEN final_risk_level = 'stable' THEN 'stable' ELSE risk_pattern END"""


@query("classify", "E15", f"{HEAD} risk_pattern classification catalog_key narrative_template_id mapping_rule_id root_cause_candidate root_cause_confidence:d", "SELECT * FROM classified")
def classify(i):
    return D.classify(risked(i))


def _esc(t):
    return t.replace("'", "''")


_ACT = ", ".join(f"('{k}', {n}, '{_esc(a)}', '{_esc(t)}', '{m}')" for k, v in R.ACTIONS.items() for n, (a, t, m) in enumerate(v, 1))
ACTED = f"{CALM} OR classification = 'None' OR final_risk_level = 'stable' OR overall_risk_score < 0.08"
RELATIONS["acted"] = f"""SELECT {S}, n AS action_rank, action_type, recommended_action, metric AS evidence_metric, CASE WHEN metric IN ('overall_risk_score', 'authority_risk_level') THEN overall_risk_score ELSE 1 END AS evidence_value, 'authority_action' AS action_layer FROM classified JOIN (SELECT * FROM (VALUES {_ACT}) AS t(k, n, action_type, recommended_action, metric)) a
  ON k = CASE WHEN {ACTED} OR risk_pattern = 'stable' THEN 'stable' WHEN risk_pattern = 'localized_failure' THEN CASE WHEN failure_mechanism IN ('identity_integrity_breakage', 'semantic_attribution_distortion') THEN failure_mechanism ELSE 'localized_failure' END WHEN risk_pattern = 'emerging_reliability_degradation' THEN 'other' ELSE risk_pattern END"""
RELATIONS["support_causes"] = """SELECT profile_id, dt, scenario_name, k AS root_cause_rank, CASE (k1 + k * k2) % 5 WHEN 0 THEN 'app_version' WHEN 1 THEN 'sdk_version' WHEN 2 THEN 'url_path' WHEN 3 THEN 'client' ELSE 'business_kpi' END AS root_cause_dimension, concat('seg', CAST(k1 + k AS STRING)) AS root_cause_value, g AS root_cause_confidence FROM score_rows, (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6)) AS t(k)) ks"""
_REF = [("app_version", "app_version"), ("sdk_version", "sdk_version"), ("url_path", "url"), ("client", "client")]
_REFV = ", ".join(f"('{d}', '{key}', '{_esc(kind)}', '{_esc(s.split('{}')[0])}', '{_esc(s.split('{}')[1])}')" for (d, _), (_, key, kind, s) in zip(_REF, R.REFERENCE_ACTIONS))
RELATIONS["supported"] = f"""SELECT {S}, main.n + row_number() OVER (PARTITION BY {S} ORDER BY root_cause_rank, key) AS action_rank, action_type, head || root_cause_value || tail AS recommended_action, 'root_cause_confidence' AS evidence_metric, root_cause_confidence AS evidence_value, 'reference_obs_action' AS action_layer FROM (
  SELECT *, row_number() OVER (PARTITION BY {S}, key ORDER BY root_cause_rank) AS rn FROM support_causes JOIN (SELECT * FROM (VALUES {_REFV}) AS t(d, key, action_type, head, tail)) t ON d = root_cause_dimension WHERE root_cause_rank <= 5) f
  JOIN (SELECT {S}, count(*) AS n FROM acted WHERE action_type <> 'no action' GROUP BY ALL) main USING ({S}) WHERE rn = 1"""


@query("recommend_actions", "E16 W13", f"{HEAD} action_rank:i action_type recommended_action evidence_metric evidence_value:d action_layer", "SELECT * FROM acted UNION ALL SELECT * FROM supported")
def recommend_actions(i):
    return D.recommend_actions(D.classify(risked(i)), i.support_causes)


RELATIONS["override_rows"] = "SELECT profile_id, dt, scenario_name, e AS observability_overall_score, CASE WHEN k4 < 20 THEN 'None' ELSE 'WC Collection Completeness Risk' END AS recommended_semantic_risk FROM score_rows WHERE value_ok"
RELATIONS["override_rows"] = RELATIONS["override_rows"].replace(" WHERE value_ok", "")


@query("semantic_override", "E17", f"{HEAD} dominant_semantic_risk semantic_confidence:d max_raw_score:d overridden:i",
       f"""SELECT {S}, coalesce(lbl, classification) AS dominant_semantic_risk, CASE WHEN lbl IS NOT NULL THEN 1 ELSE root_cause_confidence END AS semantic_confidence, CASE WHEN lbl IS NOT NULL THEN sc ELSE overall_risk_score END AS max_raw_score, CASE WHEN lbl IS NOT NULL THEN 1 ELSE 0 END AS overridden FROM classified
  FULL JOIN (SELECT {S}, recommended_semantic_risk AS lbl, observability_overall_score AS sc FROM override_rows WHERE observability_overall_score >= 0.15 AND recommended_semantic_risk <> 'None') o USING ({S})""")
def semantic_override(i):
    return D.semantic_override(D.classify(risked(i)), i.override_rows)


RELATIONS["dimension_rows"] = "SELECT profile_id, dt, scenario_name, family AS expected_risk_family, CASE WHEN k4 < 20 THEN 0.0 ELSE e * 0.5 END AS completeness_delta, CASE WHEN k3 < 60 THEN 0.0 ELSE f * 0.8 END AS timeliness_delta, CASE WHEN k2 < 200 THEN 0.0 ELSE g END AS availability_delta, 0.0 AS integrity_delta, c * 0.2 AS batch_quality_score, 0.0 AS mapping_risk_score, CASE WHEN k4 < 20 THEN 0.0 ELSE a * 0.3 END AS behavior_distortion_score, d * 0.1 AS conversion_distortion_score, CASE WHEN k4 < 20 THEN 0.0 ELSE b * 0.2 END AS session_fragmentation_score, 0.0 AS identity_anomaly_score, 0.0 AS channel_imbalance_score, c * 0.4 AS batch_overall_score FROM score_rows"
_D5 = ("completeness", "timeliness", "availability", "integrity", "consistency")
_S5 = ("integrity", "completeness", "timeliness", "consistency", "availability")


def _best(names):
    items = ", ".join(f"{{'s': CAST({n}_score AS DOUBLE), 'n': '{n.title()}'}}" for n in names)
    return f"list_reduce([{items}], lambda x, y: CASE WHEN y.s > x.s THEN y ELSE x END)"


def _of(name):
    return "CASE " + name + " " + " ".join(f"WHEN '{n.title()}' THEN {n}_score" for n in _D5) + " ELSE 0 END"


_EXP = "CASE expected_risk_family WHEN 'completeness' THEN 'Completeness' WHEN 'latency_performance' THEN 'Timeliness' WHEN 'availability' THEN 'Availability' WHEN 'schema_validation' THEN 'Integrity' WHEN 'low' THEN 'None'"
_BIG = lambda cut: f"len(list_filter([{', '.join(f'{n}_score' for n in _D5)}], lambda x: x > {cut}))"
_MEAN = f"coalesce(list_avg(list_filter([{', '.join(f'CAST({n}_score AS DOUBLE)' for n in _D5)}], lambda x: x > 0.05)), 0)"
RELATIONS["dimensioned"] = f"""SELECT *, least(1, greatest(CASE WHEN source_delta >= 0.7 OR {_BIG(0.2)} >= 2 THEN propagation_score ELSE 0 END, conversion_distortion_score * 0.7)) AS amplification_score FROM (
  SELECT *, greatest(CASE WHEN source_delta = 0 THEN 0 ELSE 1 - semantic_alignment_score END, behavior_distortion_score, conversion_distortion_score) AS distortion_score, greatest(source_delta, {_MEAN}, batch_overall_score) AS propagation_score, greatest(source_delta, batch_overall_score) AS drift_score, CASE WHEN {_BIG(0.05)} >= 2 THEN {_MEAN} ELSE source_delta END AS correlation_score,
    CASE dominant_dimension WHEN 'Completeness' THEN 'batch_stream' WHEN 'Timeliness' THEN 'stream_operational' WHEN 'Availability' THEN 'operational' WHEN 'Integrity' THEN 'batch' WHEN 'Consistency' THEN 'batch_cross_metric' ELSE 'integrated' END AS dominant_layer FROM (
  SELECT *, CASE WHEN expected_dimension = 'None' AND source_delta = 0 THEN 1 WHEN expected_dimension = dominant_dimension THEN 1 ELSE 0 END AS semantic_alignment_score FROM (SELECT *, {_of('dominant_dimension')} AS source_delta FROM (
  SELECT *, CASE WHEN expected_dimension <> 'None' AND {_of('expected_dimension')} > 0 THEN expected_dimension WHEN greatest({", ".join(f"{n}_score" for n in _D5)}) <= 0.0001 THEN 'None' ELSE top.n END AS dominant_dimension FROM (SELECT *, {_EXP} ELSE top.n END AS expected_dimension FROM (SELECT *, {_best(_D5)} AS top FROM (
  SELECT *, greatest(completeness_delta, batch_quality_score) AS completeness_score, timeliness_delta AS timeliness_score, availability_delta AS availability_score, greatest(behavior_distortion_score, conversion_distortion_score) AS integrity_score, session_fragmentation_score AS consistency_score FROM dimension_rows) a) b) c) d) e) f) g"""


@query("dimension_reliability", "E18", f"{HEAD} expected_dimension dominant_dimension source_delta:d semantic_alignment_score:d distortion_score:d propagation_score:d drift_score:d amplification_score:d correlation_score:d dominant_layer", "SELECT * FROM dimensioned")
def dimension_reliability(i):
    return D.dimension_reliability(i.dimension_rows)


_SEC = ", ".join(f"{{'s': CAST(CASE WHEN dominant_semantic = '{n.title()}' THEN -1 ELSE {n}_score END AS DOUBLE), 'n': '{n.title()}'}}" for n in _S5)
RELATIONS["semantic_day"] = f"""SELECT *, CASE WHEN sec.s > 0.05 THEN sec.n ELSE 'None' END AS secondary_semantic FROM (SELECT *, {_of('dominant_semantic')} AS semantic_confidence, list_reduce([{_SEC}], lambda x, y: CASE WHEN y.s > x.s THEN y ELSE x END) AS sec FROM (
  SELECT *, CASE WHEN {_of('exp5')} > 0 THEN exp5 WHEN greatest({", ".join(f"{n}_score" for n in _S5)}) <= 0.0001 THEN 'None' ELSE sb.n END AS dominant_semantic FROM (SELECT *, {_EXP} ELSE 'Unknown' END AS exp5, {_best(_S5)} AS sb FROM dimensioned) a) b) c"""
RELATIONS["unified_day"] = f"""SELECT *, {band('round(overall_score, 9)', ((0.8, 'CRITICAL'), (0.5, 'HIGH'), (0.2, 'WARN')), 'STABLE')} AS overall_level FROM (SELECT *, least(1, semantic_confidence + amplification_score * 0.15 + distortion_score * 0.1 + drift_score * 0.1) AS overall_score FROM semantic_day) x"""


def semantic(i):
    return D.semantic_dimension(D.dimension_reliability(i.dimension_rows))


@query("semantic_dimension", "E19 T08", f"{HEAD} dominant_semantic secondary_semantic semantic_confidence:d", "SELECT * FROM semantic_day")
def semantic_dimension(i):
    return semantic(i)


@query("unified_score", "E19", f"{HEAD} overall_score:d overall_level", "SELECT * FROM unified_day")
def unified_score(i):
    return D.unified_score(semantic(i))


_RA = ", ".join(f"('{k}', '{_esc(a)}', '{_esc(b)}', '{p}')" for k, (a, b, p) in R.DIMENSION_ACTIONS.items())


@query("rule_action", "E20", f"{HEAD} dominant_semantic recommended_action root_cause_direction priority alignment_score:d",
       f"""SELECT *, CASE WHEN dominant_semantic = 'None' OR semantic_confidence <= 0.0001 THEN 1 ELSE semantic_confidence END AS alignment_score FROM semantic_day JOIN (SELECT * FROM (VALUES {_RA}) AS t(k, recommended_action, root_cause_direction, priority)) t
  ON k = CASE WHEN semantic_confidence <= 0.0001 THEN 'None' ELSE dominant_semantic END""")
def rule_action(i):
    return D.rule_action(semantic(i))


RELATIONS["case_hits"] = """SELECT profile_id, dt, uid, CASE event_type WHEN 'error' THEN 'CASE-OFFER-001' WHEN 'click' THEN 'CASE-REC-002' ELSE 'none' END AS scenario_id, CASE WHEN value < 120 THEN 'drift' ELSE '' END AS schema_flag,
  CASE event_type WHEN 'error' THEN 'offer_delivery_missing' WHEN 'click' THEN 'kpi_semantic_mismatch' ELSE 'none' END AS reconciliation_flag, CASE event_type WHEN 'error' THEN 'offer' WHEN 'click' THEN 'recommendation' ELSE 'browse' END AS funnel_stage, CASE WHEN value < 90 THEN 'loan' ELSE 'card' END AS financial_product, value FROM source_hits"""
RELATIONS["case_day"] = """SELECT *, case_count / total_count AS case_event_ratio FROM (SELECT profile_id, dt, scenario_id AS case_id, count(*) AS case_count, count(*) AS drift_count, count(*) AS reconciliation_count, count(DISTINCT uid) AS affected_uid_count FROM case_hits WHERE scenario_id <> 'none' AND schema_flag = 'drift' AND (scenario_id = 'CASE-REC-002' OR financial_product = 'loan') GROUP BY ALL) c
  JOIN (SELECT profile_id, dt, count(*) AS total_count FROM case_hits GROUP BY ALL) t USING (profile_id, dt)"""


@query("case_evidence", "A34", "profile_id dt:date case_id case_count:i drift_count:i reconciliation_count:i affected_uid_count:i total_count:i case_event_ratio:d", "SELECT * FROM case_day")
def case_evidence(i):
    return D.case_evidence(i.case_hits)


RELATIONS["case_scores"] = "SELECT profile_id, dt, CAST(count(CASE WHEN value < 70 THEN 1 END) AS DOUBLE) / count(*) AS integrity_score, CAST(count(CASE WHEN value < 30 THEN 1 END) AS DOUBLE) / count(*) AS completeness_score, 0.05 AS timeliness_score, 0.6 AS consistency_score, 0.0 AS availability_score FROM source_hits GROUP BY profile_id, dt"


@query("case_rule_decision", "E21", "profile_id dt:date case_id case_count:i integrity_score:d completeness_score:d timeliness_score:d consistency_score:d availability_score:d dominant_semantic_risk secondary_semantic_risk final_risk_level recommended_action priority overall_risk_score:d",
       """SELECT profile_id, dt, case_id, case_count, greatest(integrity_score, 0.65) AS integrity_score, greatest(completeness_score, CASE case_id WHEN 'CASE-OFFER-001' THEN 0.3 ELSE 0 END) AS completeness_score, greatest(timeliness_score, CASE case_id WHEN 'CASE-OFFER-001' THEN 0.1 ELSE 0 END) AS timeliness_score,
  greatest(consistency_score, CASE case_id WHEN 'CASE-OFFER-001' THEN 0.55 ELSE 0.65 END) AS consistency_score, availability_score, 'Integrity' AS dominant_semantic_risk, CASE case_id WHEN 'CASE-OFFER-001' THEN 'Completeness' ELSE 'Consistency' END AS secondary_semantic_risk, 'HIGH' AS final_risk_level,
  CASE case_id WHEN 'CASE-OFFER-001' THEN 'offer event schema reconciliation' ELSE 'recommendation KPI semantic mapping validation' END AS recommended_action, 'P1' AS priority, 1.0 AS overall_risk_score FROM case_day JOIN case_scores USING (profile_id, dt)""")
def case_rule_decision(i):
    return D.case_rule_decision(D.case_evidence(i.case_hits), i.case_scores)
