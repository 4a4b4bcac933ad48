"""Data-quality checks, reports and what-if damage over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D, quality as Q, whatif as W
from ..session import materialize
from . import baselines, decisions
from .fixtures import RELATIONS
from .registry import query

S = "profile_id, dt, scenario_name"
HEAD = "profile_id dt:date scenario_name"
DAY = "profile_id dt:date"

RELATIONS["expected_scenarios"] = "SELECT DISTINCT profile_id, dt, 'baseline' AS expected_scenario FROM source_hits"


@query("scenario_identity_audit", "Q01", f"table_name {HEAD} row_count:i mismatch_count:i",
       " UNION ALL ".join(f"SELECT '{n}' AS table_name, {S}, count(*) AS row_count, count(*) FILTER (scenario_name <> 'baseline') AS mismatch_count FROM {r} GROUP BY profile_id, dt, scenario_name" for n, r in (("source", "source_hits"), ("collected", "collected_hits"))))
def scenario_identity_audit(i):
    return Q.scenario_identity_audit({"source": i.source_hits, "collected": i.collected_hits}, i.expected_scenarios)


RELATIONS["rerun_hits"] = f"SELECT profile_id, dt, scenario_name, hit_id, CASE WHEN value < 100 THEN 11 WHEN value < 180 THEN 12 ELSE 13 END AS source_gen_run_id FROM source_hits"
RELATIONS["active_runs"] = f"SELECT DISTINCT {S}, 12 AS active_run FROM source_hits"


@query("single_active_run", "Q02", f"{HEAD} run_count:i runs",
       f"SELECT * FROM (SELECT {S}, count(DISTINCT source_gen_run_id) AS run_count, array_to_string(list_sort(list_distinct(list(CAST(source_gen_run_id AS VARCHAR)))), ',') AS runs FROM rerun_hits GROUP BY ALL) x WHERE run_count > 1")
def single_active_run(i):
    return Q.single_active_run(i.rerun_hits)


@query("superseded_runs", "Q03", f"{HEAD} source_gen_run_id:i", "SELECT DISTINCT profile_id, dt, scenario_name, source_gen_run_id FROM rerun_hits WHERE source_gen_run_id < 12")
def superseded_runs(i):
    return Q.superseded_runs(i.rerun_hits, i.active_runs)


@query("purge_superseded", "Q03", f"{DAY} kept:i", "SELECT profile_id, dt, count(*) AS kept FROM rerun_hits WHERE source_gen_run_id >= 12 GROUP BY ALL")
def purge_superseded(i):
    return Q.purge_superseded(i.rerun_hits, i.active_runs).groupBy("profile_id", "dt").agg(F.count("*").alias("kept"))


@query("metadata_completeness", "Q04", f"{DAY} total:i null_or_blank:i status",
       "SELECT profile_id, dt, count(*) AS total, count(*) FILTER (uid IS NULL OR device_type = '') AS null_or_blank, CASE WHEN count(*) FILTER (uid IS NULL OR device_type = '') = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM source_hits GROUP BY ALL")
def metadata_completeness(i):
    return Q.metadata_completeness(i.source_hits, ["app_platform", "uid", "device_type"], ["profile_id", "dt"])


@query("expected_minus_seen", "U04 Q04", f"{DAY} event_type",
       "SELECT profile_id, dt, e AS event_type FROM (SELECT DISTINCT profile_id, dt FROM source_hits) d, (SELECT unnest(['view', 'click', 'refund']) AS e) r WHERE NOT EXISTS (SELECT 1 FROM source_hits s WHERE s.profile_id = d.profile_id AND s.dt = d.dt AND s.event_type = r.e)")
def expected_minus_seen(i):
    return Q.expected_minus_seen(i.source_hits, "event_type", ["view", "click", "refund"], ["profile_id", "dt"])


RELATIONS["contract_rows"] = """SELECT profile_id, dt, CASE k4 % 5 WHEN 0 THEN 'behavior_only_anomaly' WHEN 1 THEN 'transaction_missing_anomaly' WHEN 2 THEN 'state_missing_anomaly' ELSE 'baseline' END AS scenario_name, k1 AS behavior_event_count, CASE WHEN k2 < 40 THEN 0 ELSE k2 END AS transaction_event_count, CASE WHEN k3 < 30 THEN 0 ELSE k3 END AS state_event_count,
  e AS behavior_transaction_match_rate, f AS transaction_state_match_rate, k1 % 3 AS behavior_only_count, k2 % 2 AS transaction_only_count, k3 % 3 AS transaction_without_state_count FROM score_rows"""


@query("reconciliation_contract", "Q05", f"{HEAD} n_failures:i contract_status",
       """SELECT *, CASE WHEN n_failures = 0 THEN 'PASS' ELSE 'FAIL' END AS contract_status FROM (SELECT *, CASE WHEN behavior_event_count <= 0 THEN 1 ELSE 0 END + CASE scenario_name WHEN 'behavior_only_anomaly' THEN (CASE WHEN transaction_event_count <> 0 THEN 1 ELSE 0 END + CASE WHEN state_event_count <> 0 THEN 1 ELSE 0 END)
  WHEN 'transaction_missing_anomaly' THEN (CASE WHEN transaction_event_count <= 0 THEN 1 ELSE 0 END + CASE WHEN behavior_transaction_match_rate >= 0.8 AND behavior_only_count <= 0 AND transaction_only_count <= 0 THEN 1 ELSE 0 END)
  WHEN 'state_missing_anomaly' THEN (CASE WHEN transaction_event_count <= 0 THEN 1 ELSE 0 END + CASE WHEN state_event_count > 0 AND transaction_state_match_rate >= 0.8 AND transaction_without_state_count <= 0 THEN 1 ELSE 0 END)
  ELSE (CASE WHEN transaction_event_count <= 0 THEN 1 ELSE 0 END + CASE WHEN state_event_count <= 0 THEN 1 ELSE 0 END) END AS n_failures FROM contract_rows) x""")
def reconciliation_contract(i):
    return Q.reconciliation_contract(i.contract_rows).withColumn("n_failures", F.size("failures"))


def evidence(i):
    return baselines.evidence(i)[1]


@query("scenario_sensitivity", "Q07", "profile_id scenario_name days:i row_count:i max_score:d max_abs_z:d sensitivity",
       """SELECT a.*, CASE WHEN scenario_name = 'baseline' THEN 'REFERENCE' WHEN max_score > b THEN 'PASS' ELSE 'FAIL' END AS sensitivity FROM (SELECT profile_id, scenario_name, count(DISTINCT dt) AS days, count(*) AS row_count, max(statistical_score) AS max_score, max(abs(z_score)) AS max_abs_z FROM evidence_day GROUP BY ALL) a
  JOIN (SELECT profile_id, max(statistical_score) AS b FROM evidence_day WHERE scenario_name = 'baseline' GROUP BY ALL) s USING (profile_id)""")
def scenario_sensitivity(i):
    return Q.scenario_sensitivity(evidence(i))


@query("evidence_meaning", "Q08", f"{HEAD} evidence_domain row_count:i min_sample_days:i max_sample_days:i enough_sample_rows:i nonzero_sd_rows:i nonzero_sd_ratio:d percentile_rows:i max_score:d meaning",
       f"""SELECT *, nonzero_sd_rows / row_count AS nonzero_sd_ratio, CASE WHEN max_sample_days >= 3 AND percentile_rows > 0 THEN 'MEANINGFUL' ELSE 'WEAK' END AS meaning FROM (SELECT {S}, evidence_domain, count(*) AS row_count, min(sample_days) AS min_sample_days, max(sample_days) AS max_sample_days, count(*) FILTER (sample_days >= 3) AS enough_sample_rows,
  count(*) FILTER (baseline_sd > 0) AS nonzero_sd_rows, count(historical_percentile) AS percentile_rows, max(statistical_score) AS max_score FROM evidence_day GROUP BY ALL) x""")
def evidence_meaning(i):
    return Q.evidence_meaning(evidence(i))


@query("evidence_calendar_coverage", "Q16", f"{DAY} scenario_name evidence_domain row_count:i max_score:d coverage",
       f"""SELECT {S}, evidence_domain, count(*) AS row_count, max(statistical_score) AS max_score, 'FOUND' AS coverage FROM evidence_day GROUP BY ALL UNION ALL SELECT profile_id, dt, NULL, NULL, 0, NULL, 'MISSING' FROM (SELECT DISTINCT profile_id, dt + 20 AS dt FROM source_hits) c WHERE dt NOT IN (SELECT dt FROM evidence_day)""")
def evidence_calendar_coverage(i):
    days = i.source_hits.select("profile_id", F.date_add("dt", 20).alias("dt")).distinct()
    return Q.evidence_calendar_coverage(evidence(i), days)


def decided(i):
    return D.classify(decisions.risked(i))


@query("baseline_false_positive", "Q09", f"{HEAD} overall_risk_score:d final_risk_level classification false_actions:i status",
       f"SELECT {S}, overall_risk_score, final_risk_level, classification, 0 AS false_actions, CASE WHEN overall_risk_score <= 0.08 AND final_risk_level IN ('stable', 'low') AND classification = 'None' THEN 'PASS' ELSE 'FAIL' END AS status FROM classified WHERE scenario_name = 'baseline'")
def baseline_false_positive(i):
    d = materialize(decided(i), "decisions")
    return Q.baseline_false_positive(d, D.authority_actions(d))


RELATIONS["expectations"] = """SELECT DISTINCT scenario_name, CASE WHEN scenario_name = 'baseline' THEN 'none' ELSE 'business_semantic' END AS expected_semantic_family, CASE WHEN scenario_name = 'baseline' THEN 'no action' ELSE 'audit' END AS expected_action, CASE WHEN scenario_name = 'baseline' THEN 'low' ELSE 'low_or_warning' END AS escalation_expectation FROM score_rows"""
RELATIONS["first_actions"] = f"SELECT {S}, action_type AS recommended_action FROM acted WHERE action_rank = 1"
RELATIONS["calibrated"] = f"""SELECT {S}, classification, recommended_action, final_risk_level, sm AS semantic_match, am AS action_match, em AS escalation_match, CASE WHEN sm = 1 AND am = 1 AND em = 1 THEN 'PASS' WHEN scenario_name = 'baseline' THEN 'MISMATCH' ELSE 'REVIEW' END AS calibration_result,
  concat_ws(';', CASE WHEN sm = 0 THEN 'semantic' END, CASE WHEN am = 0 THEN 'action' END, CASE WHEN em = 0 THEN 'escalation' END) AS review_reason FROM (
  SELECT {S}, classification, recommended_action, final_risk_level, CASE WHEN scenario_name = 'baseline' THEN CASE WHEN classification = 'None' THEN 1 ELSE 0 END WHEN classification = 'Business Semantic Distortion' THEN 1 ELSE 0 END AS sm,
    CASE WHEN scenario_name = 'baseline' THEN CASE WHEN recommended_action = 'no action' THEN 1 ELSE 0 END WHEN recommended_action LIKE '%audit%' THEN 1 ELSE 0 END AS am, CASE WHEN scenario_name = 'baseline' THEN CASE WHEN final_risk_level IN ('stable', 'low') THEN 1 ELSE 0 END WHEN final_risk_level IN ('low', 'warning') THEN 1 ELSE 0 END AS em
  FROM classified JOIN first_actions USING ({S})) x"""


def calibrated(i):
    d = materialize(decided(i), "decisions")
    first = D.authority_actions(d).where("action_rank = 1").select(*Q.SCOPE, F.col("action_type").alias("recommended_action"))
    return Q.calibration_review(d.join(first, list(Q.SCOPE)), i.expectations)


@query("calibration_review", "Q10", f"{HEAD} classification recommended_action final_risk_level semantic_match:i action_match:i escalation_match:i calibration_result review_reason", "SELECT * FROM calibrated")
def calibration_review(i):
    return calibrated(i)


@query("calibration_summary", "Q11", "scenario_name calibration_result cnt:i", "SELECT scenario_name, calibration_result, count(*) AS cnt FROM calibrated GROUP BY ALL")
def calibration_summary(i):
    return Q.calibration_summary(calibrated(i))


@query("source_contract_check", "Q13", f"{DAY} line_count:i missing_key_lines:i unsorted_lines:i unique_pcid:i uid_lines:i uid_cookie_rate:d contract_status",
       """SELECT *, round(uid_lines / line_count, 5) AS uid_cookie_rate, CASE WHEN missing_key_lines = 0 AND unsorted_lines = 0 THEN 'PASS' ELSE 'FAIL' END AS contract_status FROM (SELECT profile_id, dt, count(*) AS line_count, 0 AS missing_key_lines, count(*) FILTER (ts < prev) AS unsorted_lines, count(DISTINCT pcid) AS unique_pcid, count(*) AS uid_lines
  FROM (SELECT *, lag(ts) OVER (PARTITION BY profile_id, dt ORDER BY hit_id + CASE WHEN value > 150 THEN 3.5 ELSE 0 END) AS prev FROM tails) x GROUP BY ALL) y""")
def source_contract_check(i):
    return Q.source_contract_check(i.tails, F.col("hit_id") + F.when(F.col("value") > 150, 3.5).otherwise(0.0))


@query("hourly_shape", "Q13", f"{DAY} hh:i visits:i page_views:i pv_per_visit:d", "SELECT profile_id, dt, hour(ts) AS hh, count(DISTINCT sid) AS visits, count(*) AS page_views, count(*) / count(DISTINCT sid) AS pv_per_visit FROM source_hits GROUP BY ALL")
def hourly_shape(i):
    return Q.hourly_shape(i.source_hits)


RELATIONS["effect_counts"] = """SELECT profile_id, dt, CASE event_type WHEN 'view' THEN 'source_campaign_spike' WHEN 'click' THEN 'source_weather_drop' WHEN 'signup' THEN 'source_system_degraded' WHEN 'error' THEN 'source_no_data' ELSE 'other' END AS scenario_id, hour(ts) AS created_at, count(*) AS row_count, count(CASE WHEN value > 60 THEN 1 END) AS affected_row_count
  FROM source_hits GROUP BY profile_id, dt, CASE event_type WHEN 'view' THEN 'source_campaign_spike' WHEN 'click' THEN 'source_weather_drop' WHEN 'signup' THEN 'source_system_degraded' WHEN 'error' THEN 'source_no_data' ELSE 'other' END, hour(ts)"""


@query("scenario_effect_check", "Q14", f"{DAY} scenario_id row_count:i affected_row_count:i row_delta:i row_ratio:d affected_ratio:d validation_status",
       """SELECT *, row_count - 3 AS row_delta, row_count / 3 AS row_ratio, affected_row_count / row_count AS affected_ratio, CASE scenario_id WHEN 'source_campaign_spike' THEN CASE WHEN row_count > 3 AND affected_row_count > 0 THEN 'PASS' ELSE 'FAIL' END WHEN 'source_weather_drop' THEN CASE WHEN affected_row_count > 0 AND row_count <= 3 THEN 'PASS' ELSE 'NEEDS_MORE_EVIDENCE' END
  WHEN 'source_system_degraded' THEN CASE WHEN affected_row_count > 0 THEN 'PASS' ELSE 'FAIL' END WHEN 'source_no_data' THEN CASE WHEN affected_row_count > 0 AND row_count < 3 THEN 'PASS' ELSE 'NEEDS_MORE_EVIDENCE' END ELSE 'PASS' END AS validation_status
  FROM (SELECT profile_id, dt, scenario_id, arg_max(row_count, created_at) AS row_count, arg_max(affected_row_count, created_at) AS affected_row_count FROM effect_counts GROUP BY ALL) x""")
def scenario_effect_check(i):
    base = i.source_hits.select("profile_id").distinct().withColumn("baseline_rows", F.lit(3))
    return Q.scenario_effect_check(i.effect_counts, base)


RELATIONS["marked_lines"] = """SELECT scenario_name AS scenario_id, concat('log-', CAST(dt AS STRING)) AS file_name, concat('x schema_version=1; scenario_id=s; drift=', CASE WHEN scenario_name = 'baseline' THEN 'off' ELSE 'on' END, CASE WHEN value > 300 THEN '; weather=rain' ELSE '' END, CASE WHEN value > 100 THEN '; affected=1' ELSE '' END) AS line FROM source_hits"""


@query("marker_contract", "Q15", "file_name scenario_id row_count:i drift_on_count:i drift_off_count:i affected_count:i weather_alias_count:i reasons status",
       """SELECT *, concat_ws(',', CASE WHEN weather_alias_count > 0 THEN 'weather_alias_present' END, CASE WHEN scenario_id <> 'baseline' AND affected_count = 0 THEN 'anomaly_not_activated' END) AS reasons, CASE WHEN weather_alias_count > 0 OR (scenario_id <> 'baseline' AND affected_count = 0) THEN 'FAIL' ELSE 'PASS' END AS status FROM (
  SELECT file_name, scenario_id, count(*) AS row_count, count(*) FILTER (contains(line, 'drift=on')) AS drift_on_count, count(*) FILTER (contains(line, 'drift=off')) AS drift_off_count, count(*) FILTER (contains(line, 'affected=1')) AS affected_count, count(*) FILTER (contains(line, 'weather=')) AS weather_alias_count FROM marked_lines GROUP BY ALL) x""")
def marker_contract(i):
    return Q.marker_contract(i.marked_lines, "line", ["file_name"])


# --- reports ----------------------------------------------------------------------------


def chain(i):
    return Q.count_chain({"stage": i.source_hits, "collector": i.collected_hits, "raw": i.collected_hits.where("value >= 6"), "canonical": i.collected_hits.where("value >= 8")})


RELATIONS["chain_counts"] = """SELECT profile_id, dt, 0 AS layer_no, 'stage' AS layer, count(*) AS cnt FROM source_hits GROUP BY ALL UNION ALL SELECT profile_id, dt, 1, 'collector', count(*) FROM collected_hits GROUP BY ALL
  UNION ALL SELECT profile_id, dt, 2, 'raw', count(*) FROM collected_hits WHERE value >= 6 GROUP BY ALL UNION ALL SELECT profile_id, dt, 3, 'canonical', count(*) FROM collected_hits WHERE value >= 8 GROUP BY ALL"""


@query("count_chain", "A31 U01", f"{DAY} layer_no:i layer cnt:i delta:i drop_rate:d",
       "SELECT *, cnt - lag(cnt) OVER w AS delta, round((lag(cnt) OVER w - cnt) / lag(cnt) OVER w, 6) AS drop_rate FROM chain_counts WINDOW w AS (PARTITION BY profile_id, dt ORDER BY layer_no)")
def count_chain(i):
    return chain(i)


@query("collector_delta", "J15 A31", f"{DAY} stage_count:i collector_count:i raw_count:i canonical_count:i stage_to_collector_delta:i estimated_collector_drop_rate:d estimated_collector_dup_rate:d",
       """SELECT *, stage_count - collector_count AS stage_to_collector_delta, round((stage_count - collector_count) / stage_count, 6) AS estimated_collector_drop_rate, round((collector_count - stage_count) / stage_count, 6) AS estimated_collector_dup_rate FROM (
  SELECT profile_id, dt, max(cnt) FILTER (layer = 'stage') AS stage_count, max(cnt) FILTER (layer = 'collector') AS collector_count, max(cnt) FILTER (layer = 'raw') AS raw_count, max(cnt) FILTER (layer = 'canonical') AS canonical_count FROM chain_counts GROUP BY ALL) x""")
def collector_delta(i):
    return Q.collector_delta(chain(i))


@query("canonical_coverage", "A28", f"{DAY} canonical_event_count:i uid_coverage:d pcid_coverage:d schema_flag_count:i",
       "SELECT profile_id, dt, count(*) AS canonical_event_count, round(avg(CASE WHEN uid IS NOT NULL THEN 1 ELSE 0 END), 6) AS uid_coverage, 1.0 AS pcid_coverage, count(*) FILTER (schema_flag <> '') AS schema_flag_count FROM (SELECT *, 'c' AS pcid FROM case_hits) x GROUP BY ALL")
def canonical_coverage(i):
    return Q.canonical_coverage(i.case_hits.withColumn("pcid", F.lit("c")))


@query("anomaly_trace", "A30", f"{DAY} scenario_id schema_flag reconciliation_flag canonical_event_count:i", "SELECT profile_id, dt, scenario_id, schema_flag, reconciliation_flag, count(*) AS canonical_event_count FROM case_hits GROUP BY ALL")
def anomaly_trace(i):
    return Q.anomaly_trace(i.case_hits, ("scenario_id", "schema_flag", "reconciliation_flag"))


@query("score_distribution", "A32", "scenario_name final_risk_level classification cnt:i avg_risk_score:d", "SELECT scenario_name, final_risk_level, classification, count(*) AS cnt, avg(overall_risk_score) AS avg_risk_score FROM classified GROUP BY ALL")
def score_distribution(i):
    return Q.score_distribution(decided(i))


@query("artifact_coverage", "A33", f"{HEAD} semantic_rows:i risk_rows:i action_rows:i ml_rows:i ai_score_rows:i artifact_ok",
       f"""SELECT *, CASE WHEN semantic_rows > 0 AND risk_rows > 0 AND action_rows > 0 AND ml_rows > 0 AND ai_score_rows > 0 THEN 'PASS' ELSE 'FAIL' END AS artifact_ok FROM (SELECT {S}, {", ".join(f"coalesce({n}, 0) AS {n}_rows" for n in ("semantic", "risk", "action", "ml", "ai_score"))} FROM (SELECT DISTINCT {S} FROM source_hits) k
  {" ".join(f"LEFT JOIN (SELECT {S}, count(*) AS {n} FROM collected_hits WHERE value > {v} GROUP BY ALL) t_{n} USING ({S})" for n, v in (("semantic", 100), ("risk", 150), ("action", 200), ("ml", 250), ("ai_score", 180)))}) x""")
def artifact_coverage(i):
    part = lambda v: i.collected_hits.where(f"value > {v}")
    return Q.artifact_coverage(i.source_hits, {"semantic": part(100), "risk": part(150), "action": part(200), "ml": part(250), "ai_score": part(180)})


RELATIONS["timeline"] = """SELECT profile_id, dt, hour(ts) AS hh, min(CASE WHEN event_type = 'error' THEN 'rain' END) AS weather_type, min(CASE WHEN value > 200 THEN 'sale' END) AS campaign_flag, CASE WHEN max(value) > 200 THEN 'Degraded' WHEN max(value) > 150 THEN 'collector_drop' WHEN max(value) > 140 THEN 'submit_partial_loss' ELSE 'normal' END AS system_flag,
  1 + CAST(count(*) AS DOUBLE) / 128 AS volume_multiplier, CAST(1 AS DOUBLE) AS conversion_multiplier, 1 + CAST(floor(max(value) / 100) AS DOUBLE) / 4 AS timeout_multiplier, 1 + CAST(floor(max(value) / 50) AS DOUBLE) / 8 AS retry_multiplier FROM source_hits GROUP BY profile_id, dt, hour(ts)"""
RELATIONS["timeline_days"] = "SELECT profile_id, dt, arg_min(weather_type, hh) FILTER (weather_type IS NOT NULL) AS weather_type, arg_min(campaign_flag, hh) FILTER (campaign_flag IS NOT NULL) AS campaign_flag, arg_min(system_flag, hh) AS system_flag, avg(volume_multiplier) AS volume_multiplier, avg(timeout_multiplier) AS timeout_multiplier, avg(retry_multiplier) AS retry_multiplier FROM timeline GROUP BY ALL"


@query("exogenous_day", "A35", f"{DAY} weather_type campaign_flag system_flag volume_multiplier:d timeout_multiplier:d retry_multiplier:d", "SELECT * FROM timeline_days")
def exogenous_day(i):
    return Q.exogenous_day(i.timeline)


@query("exogenous_lookup", "J18", f"{DAY} hits:i system_flag volume_multiplier:d", "SELECT profile_id, dt, hits, system_flag, volume_multiplier FROM (SELECT profile_id, dt, count(*) AS hits FROM source_hits GROUP BY ALL) f LEFT JOIN timeline_days USING (profile_id, dt)")
def exogenous_lookup(i):
    return Q.exogenous_lookup(i.source_hits.groupBy("profile_id", "dt").agg(F.count("*").alias("hits")), Q.exogenous_day(i.timeline))


@query("timeline_performance", "A37", f"{DAY} system_flag timeout_count:d queue_backlog:d retry_count:d partial_fail_count:d",
       """SELECT profile_id, dt, f AS system_flag, CASE WHEN f IN ('degraded', 'auth_delay') THEN 100 * (t - 1) ELSE 0 END AS timeout_count, CASE WHEN f IN ('degraded', 'auth_delay') THEN 80 * (t - 1) ELSE 0 END AS queue_backlog, CASE WHEN f IN ('degraded', 'collector_drop') THEN 120 * (r - 1) ELSE 0 END AS retry_count,
  CASE WHEN f = 'submit_partial_loss' THEN 35 ELSE 0 END AS partial_fail_count FROM (SELECT DISTINCT profile_id, dt, lower(system_flag) AS f, timeout_multiplier AS t, retry_multiplier AS r FROM timeline) x""")
def timeline_performance(i):
    return Q.timeline_performance(i.timeline)


@query("dataset_freshness", "A38", "dataset row_count:i max_date:date",
       "SELECT 'events' AS dataset, count(*) AS row_count, max(CAST(ts AS DATE)) AS max_date FROM events UNION ALL SELECT 'orders', count(*), max(CAST(o_orderdate AS DATE)) FROM orders UNION ALL SELECT 'lineitem', count(*), max(CAST(l_shipdate AS DATE)) FROM lineitem")
def dataset_freshness(i):
    return Q.dataset_freshness({"events": (i.events, "ts"), "orders": (i.orders, "o_orderdate"), "lineitem": (i.lineitem, "l_shipdate")})


@query("status_mix", "A39", f"{DAY} status cnt:i", "SELECT profile_id, dt, event_type AS status, count(*) AS cnt FROM source_hits GROUP BY ALL")
def status_mix(i):
    return Q.status_mix(i.source_hits, "event_type")


@query("trend_union", "U05", "profile_id time:date series value:d", "SELECT profile_id, dt AS time, series, value FROM (SELECT profile_id, dt, collection_gap_rate, uv_gap_rate FROM observability_day) o UNPIVOT (value FOR series IN (collection_gap_rate, uv_gap_rate))")
def trend_union(i):
    return Q.trend_union(decisions.observed(i), "dt", ["collection_gap_rate", "uv_gap_rate"])


# --- what-if damage ---------------------------------------------------------------------

IOS = "app_platform = 'ios_app' AND event_type = 'purchase'"


def ios_purchases(df):
    return W.target_match(df.columns, platform="ios_app", conversion_only=True, events="purchase")


@query("target_match", "X02", "app_platform hits:i targeted:i", f"SELECT app_platform, count(*) AS hits, count(*) FILTER ({IOS}) AS targeted FROM source_hits GROUP BY ALL")
def target_match(i):
    s = i.source_hits
    return s.groupBy("app_platform").agg(F.count("*").alias("hits"), F.count_if(ios_purchases(s)).alias("targeted"))


@query("missing_rate", "X01", "hit_id:i rate:d",
       """SELECT hit_id, greatest(CASE WHEN event_type IN ('purchase') THEN 0.3 WHEN event_type = 'view' THEN 0.2 ELSE 0.05 END, CASE WHEN contains(ua, 'iPhone') THEN 0.25 ELSE 0 END) AS rate FROM source_hits""")
def missing_rate(i):
    return i.source_hits.select("hit_id", W.missing_rate(0.05, 0.3, 0.2, 0.25).alias("rate"))


@query("drop_rows", "X01", "hit_id:i", f"SELECT hit_id FROM source_hits WHERE NOT ({IOS})")
def drop_rows(i):
    s = i.source_hits
    return W.drop_rows(s, F.when(ios_purchases(s), 1.0).otherwise(0.0), "hit_id")


@query("duplicate_rows", "X03", "hit_id:i copy_no:i dup_group_id", f"SELECT hit_id, 0 AS copy_no, CAST(NULL AS VARCHAR) AS dup_group_id FROM source_hits UNION ALL SELECT hit_id, 1, concat('duplicate_', hit_id) FROM source_hits WHERE {IOS}")
def duplicate_rows(i):
    s = i.source_hits
    return W.duplicate_rows(s, F.when(ios_purchases(s), 1.0).otherwise(0.0), "hit_id")


@query("volume_spike", "X03", "hit_id:i copy_no:i ts:ts", "SELECT hit_id, k AS copy_no, ts + k * INTERVAL 1 MILLISECOND AS ts FROM source_hits, (SELECT unnest([0, 1, 2]) AS k) c")
def volume_spike(i):
    return W.volume_spike(i.source_hits, 3.0, "hit_id")


@query("delay_rows", "X04", "hit_id:i ts:ts latency_ms:i", f"SELECT hit_id, CASE WHEN {IOS} THEN ts + INTERVAL 4500 MILLISECOND ELSE ts END AS ts, CASE WHEN {IOS} THEN latency_ms + 4500 ELSE latency_ms END AS latency_ms FROM source_hits")
def delay_rows(i):
    return W.delay_rows(i.source_hits, 4500, ios_purchases(i.source_hits))


@query("skew_time_days", "X04", "dt:date moved_days:i n:i", "SELECT dt, 0 AS moved_days, count(*) AS n FROM source_hits GROUP BY dt")
def skew_time_days(i):
    out = W.skew_time(i.source_hits, 7200, 1.0, "hit_id")
    return out.groupBy("dt").agg(F.count_if(F.to_date("ts") != F.col("dt")).alias("moved_days"), F.count("*").alias("n"))


@query("reorder_blocks", "X05", f"{DAY} hit_id:i arrival_no:i",
       "SELECT profile_id, dt, hit_id, b * 5 + 1 + least((b + 1) * 5, total) - rn AS arrival_no FROM (SELECT *, (rn - 1) // 5 AS b FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, dt ORDER BY ts, hit_id) AS rn, count(*) OVER (PARTITION BY profile_id, dt) AS total FROM source_hits) x) y")
def reorder_blocks(i):
    return W.reorder_blocks(i.source_hits, 5, "hit_id")


@query("flip_conversion", "X06", f"{DAY} conversions:i", "SELECT profile_id, dt, 0 AS conversions FROM source_hits GROUP BY ALL")
def flip_conversion(i):
    return W.flip_conversion(i.source_hits, -1.0, "hit_id").groupBy("profile_id", "dt").agg(F.sum("is_conversion").alias("conversions"))


@query("corrupt_identity", "X07", "hit_id:i uid kv_raw", rf"SELECT hit_id, CASE WHEN {IOS} THEN NULL ELSE uid END AS uid, CASE WHEN {IOS} THEN regexp_replace(kv_raw, '(^|[;&\s])uid=[^;&\s]*', '\1uid=', 'g') ELSE kv_raw END AS kv_raw FROM tails")
def corrupt_identity(i):
    return W.corrupt_identity(i.tails, 1.0, ios_purchases(i.tails), "hit_id")


@query("collapse_url", "X07", "hit_id:i path", "SELECT hit_id, CASE WHEN sdk_version = 'sdk-2' THEN '/order/pizza' ELSE path END AS path FROM source_hits")
def collapse_url(i):
    return W.collapse_url(i.source_hits, "*", "/order/pizza", 1.0, W.target_match(i.source_hits.columns, sdk_version="sdk-2"), "hit_id")


@query("inject_errors", "X08", f"{DAY} errors:i slow:i burst_minutes:i", f"SELECT profile_id, dt, count(*) FILTER (status = 503 OR ({IOS})) AS errors, count(*) FILTER (latency_ms = 4501 OR ({IOS})) AS slow, count(*) FILTER ({IOS}) AS burst_minutes FROM source_hits GROUP BY ALL")
def inject_errors(i):
    s = i.source_hits
    out = W.inject_errors(s.withColumn("was", F.col("ts")), 1.0, 1.0, 4501, 1.0, 730, "hit_id", where=ios_purchases(s))
    at = (F.hour("ts") == 12) & (F.minute("ts") == 10) & (F.col("ts") != F.col("was"))
    return out.groupBy("profile_id", "dt").agg(F.count_if(F.col("status") == 503).alias("errors"), F.count_if(F.col("latency_ms") == 4501).alias("slow"), F.count_if(at).alias("burst_minutes"))


@query("perturbation_trace", "X09", "profile_id source_rows:i dropped_rows:i duplicate_rows:i ts_changed_rows:i uid_changed_rows:i",
       f"SELECT profile_id, count(*) AS source_rows, count(*) FILTER (value < 5) AS dropped_rows, count(*) FILTER (value >= 5 AND ({IOS})) AS duplicate_rows, count(*) FILTER (value >= 5 AND app_platform = 'pc_web') AS ts_changed_rows, count(*) FILTER (value >= 5 AND uid IS NOT NULL AND app_version = 'app-2') AS uid_changed_rows FROM source_hits GROUP BY ALL")
def perturbation_trace(i):
    s = i.source_hits
    d = W.drop_rows(s, F.when(F.col("value") < 5, 1.0).otherwise(0.0), "hit_id")
    d = W.delay_rows(d, 1000, F.col("app_platform") == "pc_web")
    d = W.corrupt_identity(d, 1.0, F.col("app_version") == "app-2", "hit_id")
    d = W.duplicate_rows(d, F.when(ios_purchases(s), 1.0).otherwise(0.0), "hit_id")
    return W.perturbation_trace(s, d, "hit_id")


RELATIONS["scenario_registry"] = """SELECT concat('p', CAST(user_id AS STRING)) AS profile_id, CASE user_id % 5 WHEN 0 THEN 'weather_drop' WHEN 1 THEN 'campaign_spike' WHEN 2 THEN 'partial_missing' WHEN 3 THEN 'delay_auth' ELSE 'baseline' END AS scenario_name, CASE user_id % 2 WHEN 0 THEN 'medium' ELSE 'high' END AS intensity,
  min(CAST(ts AS DATE)) AS dt_from, max(CAST(ts AS DATE)) AS dt_to FROM events GROUP BY user_id"""


@query("scenario_timeline", "X10", f"{DAY} scenario_name mode state_level target_service_domain missing_rate:d delay_ms:i volume_multiplier:d conversion_multiplier:d timeout_multiplier:d",
       """SELECT profile_id, CAST(d AS DATE) AS dt, scenario_name, CASE WHEN scenario_name = 'delay_auth' THEN 'delay' ELSE scenario_name END AS mode, intensity AS state_level, CASE WHEN scenario_name = 'delay_auth' THEN 'auth' END AS target_service_domain, CASE WHEN scenario_name IN ('weather_drop', 'partial_missing') THEN CASE intensity WHEN 'medium' THEN 0.08 ELSE 0.15 END ELSE 0 END AS missing_rate,
  CASE WHEN scenario_name IN ('weather_drop', 'delay_auth') THEN CASE intensity WHEN 'medium' THEN 5000 ELSE 15000 END ELSE 0 END AS delay_ms, CASE WHEN scenario_name IN ('weather_drop', 'partial_missing') THEN CASE intensity WHEN 'medium' THEN 0.92 ELSE 0.8 END WHEN scenario_name = 'campaign_spike' THEN CASE intensity WHEN 'medium' THEN 1.5 ELSE 2 END ELSE 1 END AS volume_multiplier,
  CASE WHEN scenario_name = 'weather_drop' THEN CASE intensity WHEN 'medium' THEN 0.75 ELSE 0.55 END WHEN scenario_name = 'campaign_spike' THEN 1.1 ELSE 1 END AS conversion_multiplier, CASE WHEN scenario_name IN ('weather_drop', 'delay_auth') THEN CASE intensity WHEN 'medium' THEN 1.5 ELSE 2 END ELSE 1 END AS timeout_multiplier
  FROM (SELECT *, unnest(generate_series(CAST(dt_from AS TIMESTAMP), CAST(dt_to AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM scenario_registry) x""")
def scenario_timeline(i):
    return W.scenario_timeline(i.scenario_registry)
