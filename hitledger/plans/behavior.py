"""Sessions, hourly and daily behavior measures, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J, kpi as K
from ..session import materialize
from .fixtures import RELATIONS
from .registry import query

DAY = "profile_id, dt"
# events of the batch layer, with their cookie tail
RELATIONS["batch_events"] = "SELECT *, hit_id AS event_id FROM tails WHERE value >= 6"
RELATIONS["named_events"] = """SELECT *, coalesce('UID:' || uid, 'PCID:' || pcid) AS identity, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_pv,
  CASE event_type WHEN 'signup' THEN CASE WHEN value < 40 THEN 'auth_success' ELSE 'auth_fail' END WHEN 'view' THEN 'page_view' ELSE 'other' END AS semantic_event FROM batch_events"""
RELATIONS["view_sessions"] = """SELECT *, sum(is_new) OVER (PARTITION BY profile_id, dt, identity ORDER BY ts, event_id) AS session_seq FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS is_new
  FROM named_events WHERE is_pv = 1 WINDOW w AS (PARTITION BY profile_id, dt, identity ORDER BY ts, event_id)) x"""
RELATIONS["timed_views"] = """SELECT *, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY profile_id, dt, identity, session_seq)) / 1000000) AS BIGINT) AS duration_sec FROM view_sessions"""
RELATIONS["hour_facts"] = f"""SELECT {DAY}, hh, {", ".join(f"coalesce({c}, 0) AS {c}" for c in
  ("uv", "visit", "pv", "dur", "ok", "bad", "batch_event_count", "raw_event_count", "collector_event_count"))} FROM
  (SELECT {DAY}, hour(ts) AS hh, count(*) AS batch_event_count, count(*) FILTER (semantic_event = 'auth_success') AS ok, count(*) FILTER (semantic_event = 'auth_fail') AS bad FROM named_events GROUP BY ALL) a
  FULL JOIN (SELECT {DAY}, hour(ts) AS hh, count(DISTINCT identity) AS uv, count(DISTINCT (identity, session_seq)) AS visit, count(*) AS pv, sum(duration_sec) AS dur FROM timed_views GROUP BY ALL) v USING ({DAY}, hh)
  FULL JOIN (SELECT {DAY}, hour(ts) AS hh, count(*) AS raw_event_count FROM source_hits GROUP BY ALL) r USING ({DAY}, hh)
  FULL JOIN (SELECT {DAY}, hour(ts) AS hh, count(*) AS collector_event_count FROM collected_hits GROUP BY ALL) c USING ({DAY}, hh)"""
RELATIONS["day_users"] = f"""SELECT {DAY}, count(*) AS users, count(*) FILTER (NOT EXISTS (SELECT 1 FROM named_events h WHERE h.identity = t.identity AND h.dt < t.dt AND h.dt >= t.dt - 30)) AS new_users
  FROM (SELECT DISTINCT {DAY}, identity FROM named_events WHERE is_pv = 1) t GROUP BY ALL"""
RELATIONS["day_facts"] = f"""SELECT f.*, coalesce(users, 0) AS uv, coalesce(users, 0) AS users, coalesce(new_users, 0) AS new_users FROM
  (SELECT {DAY}, {", ".join(f"sum({c}) AS {c}" for c in ("pv", "dur", "ok", "bad", "batch_event_count", "raw_event_count", "collector_event_count"))} FROM hour_facts GROUP BY ALL) f LEFT JOIN day_users USING ({DAY})"""


def long_sql(rel: str, keys: str, day: bool) -> str:
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / {b}, 6) ELSE 0 END"
    lost = "greatest(0, raw_event_count - batch_event_count)"
    rows = [("daily_active_users", "user_activity", "uv", "uv", "NULL"), ("page_view_count", "user_activity", "pv", "pv", "NULL"),
            ("avg_session_duration_sec", "user_activity", "round(dur / greatest(pv, 1), 6)", "round(dur / greatest(pv, 1), 6)", "NULL"),
            ("new_user_ratio", "user_activity", rate("new_users", "users"), "new_users", "users"),
            ("login_success_count", "auth_security", "ok", "ok", "NULL"), ("auth_attempt_count", "auth_security", "ok + bad", "ok + bad", "NULL"),
            ("auth_success_count", "auth_security", "ok", "ok", "NULL"), ("auth_fail_count", "auth_security", "bad", "bad", "NULL"),
            ("auth_success_rate", "auth_security", rate("ok", "(ok + bad)"), "ok", "ok + bad"), ("auth_fail_rate", "auth_security", rate("bad", "(ok + bad)"), "bad", "ok + bad"),
            *[(n, "auth_security", "0", "0", "NULL") for n in ("otp_request_count", "risk_login_count")],
            *[(n, "financial_service", "0", "0", "NULL") for n in ("loan_view_count", "loan_apply_start_count", "loan_apply_submit_count", "card_apply_start_count", "card_apply_submit_count")],
            ("card_apply_submit_rate", "financial_service", "0", "0", "0"),
            *[(n, "system_operation", n, n, "NULL") for n in ("raw_event_count", "collector_event_count", "batch_event_count")],
            ("estimated_missing_rate", "system_operation", rate(lost, "raw_event_count"), lost, "raw_event_count")]
    if day:
        rows += [(n, "system_operation", "0", "0", "NULL") for n in ("schema_change_count", "batch_delay_sec")]
    items = ", ".join(
        f"{{'n': '{n}', 'g': '{g}', 'v': CAST({v} AS DOUBLE), 'a': CAST({a} AS DOUBLE), 'b': CAST({b} AS DOUBLE)}}" for n, g, v, a, b in rows
    )
    return f"SELECT {keys}, m.n AS metric_name, m.g AS metric_group, m.v AS metric_value, m.a AS numerator_value, m.b AS denominator_value FROM (SELECT {keys}, unnest([{items}]) AS m FROM {rel}) x"


RELATIONS["metric_hours"] = long_sql(f"(SELECT h.*, coalesce(users, 0) AS users, coalesce(new_users, 0) AS new_users FROM hour_facts h LEFT JOIN day_users USING ({DAY}))", f"{DAY}, hh", False)
RELATIONS["metric_days"] = long_sql("day_facts", DAY, True)
LONG = "metric_name metric_group metric_value:d numerator_value:d denominator_value:d"


def named(i):
    return K.named_hits(i.batch_events)


def sessions(i):
    return K.sessionize(named(i).where("is_pv").select("profile_id", "dt", "ts", "identity", "event_id"))


@query("sessionize", "W01", "profile_id dt:date identity event_id:i session_seq:i", "SELECT * FROM view_sessions")
def sessionize(i):
    return sessions(i)


@query("session_hour_visits", "W02", "profile_id dt:date hh:i visit:i",
       f"SELECT {DAY}, hour(ts) AS hh, count(DISTINCT (identity, session_seq)) AS visit FROM view_sessions GROUP BY ALL")
def session_hour_visits(i):
    return K.session_hour_visits(sessions(i))


@query("running_session_duration", "W03", "event_id:i duration_sec:i", "SELECT event_id, duration_sec FROM timed_views")
def running_session_duration(i):
    return K.running_session_duration(sessions(i))


@query("behavior_kpi_hourly", "A12", f"profile_id dt:date hh:i {LONG}", "SELECT * FROM metric_hours")
def behavior_kpi_hourly(i):
    return K.behavior_kpi_hourly(i.batch_events, i.source_hits, i.collected_hits)


@query("behavior_kpi_daily", "A13", f"profile_id dt:date {LONG}", "SELECT * FROM metric_days")
def behavior_kpi_daily(i):
    return K.behavior_kpi_daily(i.batch_events, i.source_hits, i.collected_hits)


def hours(i):
    return K.hourly_counts(i.batch_events, i.source_hits, i.collected_hits)


@query("hourly_long", "A14", "profile_id dt:date hh:i metric_nm metric_val:d",
       f"SELECT {DAY}, hh, metric_nm, metric_val FROM (SELECT {DAY}, hh, visit, uv, pv AS pageview FROM hour_facts) f UNPIVOT (metric_val FOR metric_nm IN (visit, uv, pageview))")
def hourly_long(i):
    return K.hourly_long(hours(i))


@query("hourly_wide", "A14", "profile_id dt:date hh:i visit:d uv:d pageview:d", f"SELECT {DAY}, hh, visit, uv, pv AS pageview FROM hour_facts")
def hourly_wide(i):
    return K.hourly_wide(K.hourly_long(hours(i)))


@query("batch_input_day", "A15",
       "profile_id dt:date service_domain event_count:i unique_user_count:i unique_session_count:i conversion_count:i error_count:i avg_latency_ms:d source_gen_run_id:i",
       f"""SELECT {DAY}, service_domain, count(*) AS event_count, count(DISTINCT uid) AS unique_user_count, count(DISTINCT sid) AS unique_session_count,
  sum(is_conversion) AS conversion_count, count(*) FILTER (status = 503) AS error_count, avg(latency_ms) AS avg_latency_ms, min(source_gen_run_id) AS source_gen_run_id
  FROM collected_hits GROUP BY ALL""")
def batch_input_day(i):
    return K.batch_input_day(i.collected_hits)


RELATIONS["coverage_day"] = f"""SELECT {DAY}, domain, total_events, mapped_events, unmapped_events, mapped_events / total_events AS mapping_coverage,
  CASE WHEN mapped_events / total_events >= 0.98 THEN 'PASS' ELSE 'WARN' END AS status FROM (
  SELECT {DAY}, 'all' AS domain, count(*) AS total_events, count(*) FILTER (path LIKE '/product/%' OR path LIKE '/search%' OR path LIKE '/order/%') AS mapped_events,
  count(*) FILTER (NOT (path LIKE '/product/%' OR path LIKE '/search%' OR path LIKE '/order/%')) AS unmapped_events FROM collected_hits GROUP BY ALL) x"""


def coverage(i):
    return J.mapping_coverage(i.collected_hits, i.event_mapping, ["profile_id", "dt"])


@query("mapping_coverage_day", "A27", "profile_id dt:date total_events:i mapped_events:i unmapped_events:i mapping_coverage:d status", "SELECT * FROM coverage_day")
def mapping_coverage_day(i):
    return coverage(i)


BATCH_PICK = ("raw_event_count", "collector_event_count", "batch_event_count", "estimated_missing_rate", "avg_session_duration_sec",
              "new_user_ratio", "auth_attempt_count", "auth_success_count", "auth_fail_count", "auth_success_rate", "auth_fail_rate")
RELATIONS["batch_day"] = f"""SELECT *, CASE WHEN pv > 0 AND uv > 0 THEN pv / uv ELSE 0 END AS pv_per_uv, CASE WHEN uv > 0 THEN visit / uv ELSE 0 END AS visit_per_uv, CASE WHEN visit > 0 THEN pv / visit ELSE 0 END AS pv_per_visit,
  CASE WHEN funnel_start_count > 0 THEN funnel_submit_count / funnel_start_count ELSE 0 END AS conversion_rate, batch_event_count / raw_event_count AS collector_capture_rate FROM (
  SELECT d.*, w.visit, w.uv, w.pv, mapping_coverage, unmapped_events AS unmapped_event_count FROM (
  SELECT {DAY}, {", ".join(f"max(metric_value) FILTER (metric_name = '{n}') AS {n}" for n in BATCH_PICK)},
  sum(metric_value) FILTER (metric_name IN ('loan_view_count', 'page_view_count')) AS funnel_start_count, sum(metric_value) FILTER (metric_name IN ('login_success_count', 'auth_success_count')) AS funnel_submit_count
  FROM metric_days GROUP BY ALL) d JOIN (SELECT {DAY}, sum(visit) AS visit, sum(uv) AS uv, sum(pv) AS pv FROM hour_facts GROUP BY ALL) w USING ({DAY}) JOIN coverage_day USING ({DAY})) x"""
BATCH_COLS = "profile_id dt:date " + " ".join(f"{n}:d" for n in (*BATCH_PICK, "visit", "uv", "pv", "funnel_start_count", "funnel_submit_count", "conversion_rate", "mapping_coverage", "unmapped_event_count", "pv_per_uv", "visit_per_uv", "pv_per_visit", "collector_capture_rate"))


def measured_batch(i):
    # hour facts are written once; every later layer reads them
    h = materialize(hours(i), "hours")
    daily = K.kpi_days(h, K.daily_users(i.batch_events))
    cov = coverage(i).select("profile_id", "dt", "mapping_coverage", F.col("unmapped_events").alias("unmapped_event_count"))
    return K.measurement_batch(K.hourly_wide(K.hourly_long(h)), daily, cov)


@query("measurement_batch", "A16", BATCH_COLS, "SELECT * FROM batch_day")
def measurement_batch(i):
    return measured_batch(i)


RELATIONS["distribution_day"] = f"""SELECT {DAY}, scenario_name, d AS dimension_name, v AS dimension_value, n AS event_count, sum(n) OVER (PARTITION BY {DAY}, scenario_name, d) AS total_event_count,
  n / sum(n) OVER (PARTITION BY {DAY}, scenario_name, d) AS event_ratio FROM (
  SELECT {DAY}, scenario_name, d, v, count(*) AS n FROM (
  SELECT {DAY}, scenario_name, 'event_name' AS d, event_type AS v FROM collected_hits UNION ALL SELECT {DAY}, scenario_name, 'page_type', coalesce(nullif(page_type, ''), 'unknown') FROM collected_hits
  UNION ALL SELECT {DAY}, scenario_name, 'device', coalesce(nullif(device_type, ''), 'unknown') FROM collected_hits UNION ALL SELECT {DAY}, scenario_name, 'stage', funnel_stage FROM collected_hits
  UNION ALL SELECT {DAY}, scenario_name, 'channel', coalesce(nullif(channel, ''), 'unknown') FROM collected_hits UNION ALL SELECT {DAY}, scenario_name, 'hour', lpad(CAST(hour(ts) AS VARCHAR), 2, '0') FROM collected_hits) u GROUP BY ALL) c"""


def distributed(i):
    return K.distribution(i.collected_hits, ("profile_id", "dt", "scenario_name"))


@query("distribution", "A17 W08", "profile_id dt:date scenario_name dimension_name dimension_value event_count:i total_event_count:i event_ratio:d", "SELECT * FROM distribution_day")
def distribution(i):
    return distributed(i)
