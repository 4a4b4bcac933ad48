"""Stream quality per minute and day, replay performance and availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import operations as O, streamquality as S
from .fixtures import RELATIONS
from .registry import query

M = "profile_id, metric_minute, service_domain"
MIN = "date_trunc('minute', ts) AS metric_minute"
RELATIONS["complete_minutes"] = f"""SELECT *, missing_count / expected_count AS missing_rate, CASE WHEN missing_count / expected_count >= 0.10 THEN 'fail' WHEN missing_count / expected_count >= 0.03 THEN 'warn' ELSE 'ok' END AS status FROM (
  SELECT profile_id, {MIN}, service_domain, count(*) AS expected_count, count(*) FILTER (hit) AS actual_count, count(*) FILTER (NOT hit) AS missing_count
  FROM (SELECT e.*, e.raw_event_id IN (SELECT raw_event_id FROM stream_events) AS hit FROM expected_events e) x GROUP BY ALL) y"""
RELATIONS["duplicate_minutes"] = f"""SELECT *, duplicate_count / total_count AS duplicate_ratio, CASE WHEN duplicate_count / total_count >= 0.05 THEN 'fail' WHEN duplicate_count / total_count >= 0.01 THEN 'warn' ELSE 'ok' END AS status FROM (
  SELECT profile_id, {MIN}, service_domain, count(*) AS total_count, count(*) - count(DISTINCT raw_event_id) AS duplicate_count FROM stream_events GROUP BY ALL) x"""
RELATIONS["latency_minutes"] = f"""SELECT *, CASE WHEN avg_event_delay_ms > 10000 THEN 'fail' WHEN avg_event_delay_ms > 3000 THEN 'warn' ELSE 'ok' END AS status FROM (
  SELECT profile_id, {MIN}, service_domain, avg(event_delay_ms) AS avg_event_delay_ms, max(event_delay_ms) AS max_event_delay_ms, max(stream_offset) - min(stream_offset) AS offset_span,
  count(*) FILTER (event_delay_ms > 10000) AS sla_breach_count FROM stream_events GROUP BY ALL) x"""
RELATIONS["order_rows"] = """SELECT *, CASE WHEN curr_seq <= prev_seq THEN 1 ELSE 0 END AS violation FROM (
  SELECT *, sequence_no AS curr_seq, lag(sequence_no) OVER (PARTITION BY profile_id, service_domain, stream_partition ORDER BY ts, stream_offset, sequence_no) AS prev_seq FROM stream_events) x"""
RELATIONS["order_minutes"] = f"""SELECT *, CASE WHEN ordering_violation_count >= 10 THEN 'fail' WHEN ordering_violation_count >= 1 THEN 'warn' ELSE 'ok' END AS status FROM (
  SELECT profile_id, {MIN}, service_domain, sum(violation) AS ordering_violation_count, avg(CASE WHEN violation = 1 THEN abs(curr_seq - prev_seq) ELSE 0 END) AS ordering_gap_score FROM order_rows GROUP BY ALL) y"""
RELATIONS["summary_minutes"] = f"""SELECT *, greatest(least(missing_rate / 0.10, 1) * 85, least(duplicate_ratio / 0.20, 1) * 70, least(ordering_gap_score / 20, 1) * 55, least(greatest(avg_event_delay_ms - 1000, 0) / 10000, 1) * 35) AS stream_risk_score,
  concat_ws(',', CASE WHEN missing_rate >= 0.01 THEN 'missing' END, CASE WHEN duplicate_ratio >= 0.02 THEN 'duplicate' END, CASE WHEN ordering_gap_score >= 5 THEN 'ordering' END, CASE WHEN avg_event_delay_ms >= 1500 THEN 'delay' END) AS issue_flags FROM (
  SELECT {M}, coalesce(missing_rate, 0) AS missing_rate, coalesce(duplicate_ratio, 0) AS duplicate_ratio, coalesce(ordering_gap_score, 0) AS ordering_gap_score, coalesce(avg_event_delay_ms, 0) AS avg_event_delay_ms
  FROM (SELECT {M} FROM complete_minutes UNION SELECT {M} FROM duplicate_minutes UNION SELECT {M} FROM order_minutes UNION SELECT {M} FROM latency_minutes) k
  LEFT JOIN complete_minutes USING ({M}) LEFT JOIN duplicate_minutes USING ({M}) LEFT JOIN order_minutes USING ({M}) LEFT JOIN latency_minutes USING ({M})) z"""
HEAD = "profile_id metric_minute:ts service_domain"


def completeness(i):
    return S.stream_completeness_minute(i.expected_events, i.stream_events)


def latency(i):
    return S.stream_latency_minute(i.stream_events, 10000)


def summary(i):
    s = i.stream_events
    return S.stream_summary_minute(completeness(i), S.stream_duplicates_minute(s), S.stream_ordering_minute(s), latency(i))


@query("stream_completeness_minute", "A18 J07", f"{HEAD} expected_count:i actual_count:i missing_count:i missing_rate:d status", "SELECT * FROM complete_minutes")
def stream_completeness_minute(i):
    return completeness(i)


@query("stream_completeness_joined", "J07", f"{HEAD} expected_count:i actual_count:i",
       f"""SELECT e.profile_id, date_trunc('minute', e.ts) AS metric_minute, e.service_domain, count(*) AS expected_count, count(s.raw_event_id) AS actual_count
  FROM expected_events e LEFT JOIN stream_events s ON e.raw_event_id = s.raw_event_id GROUP BY ALL""")
def stream_completeness_joined(i):
    return S.stream_completeness_minute(i.expected_events, i.stream_events, compat=True)


@query("stream_duplicates_minute", "A19", f"{HEAD} total_count:i duplicate_count:i duplicate_ratio:d status", "SELECT * FROM duplicate_minutes")
def stream_duplicates_minute(i):
    return S.stream_duplicates_minute(i.stream_events)


@query("stream_latency_minute", "A20", f"{HEAD} avg_event_delay_ms:d max_event_delay_ms:i offset_span:i sla_breach_count:i status", "SELECT * FROM latency_minutes")
def stream_latency_minute(i):
    return latency(i)


@query("ordering_violations", "W04", "profile_id service_domain stream_partition:i raw_event_id:i curr_seq:i prev_seq:i violation:i", "SELECT * FROM order_rows")
def ordering_violations(i):
    return S.ordering_violations(i.stream_events)


@query("stream_ordering_minute", "W04", f"{HEAD} ordering_violation_count:i ordering_gap_score:d status", "SELECT * FROM order_minutes")
def stream_ordering_minute(i):
    return S.stream_ordering_minute(i.stream_events)


@query("stream_summary_minute", "A21 J09 U02", f"{HEAD} missing_rate:d duplicate_ratio:d ordering_gap_score:d avg_event_delay_ms:d stream_risk_score:d issue_flags", "SELECT * FROM summary_minutes")
def stream_summary_minute(i):
    return summary(i)


RELATIONS["stream_days"] = """SELECT profile_id, CAST(metric_minute AS DATE) AS dt, service_domain, avg(missing_rate) AS avg_missing_rate, max(missing_rate) AS max_missing_rate, avg(duplicate_ratio) AS avg_duplicate_ratio,
  max(duplicate_ratio) AS max_duplicate_ratio, max(ordering_gap_score) AS max_ordering_gap_score, count(*) FILTER (ordering_gap_score >= 5) AS total_ordering_violations, avg(avg_event_delay_ms) AS avg_event_delay_ms,
  max(avg_event_delay_ms) AS max_event_delay_ms, max(stream_risk_score) AS stream_risk_score,
  CASE WHEN max(missing_rate) >= 0.01 THEN 'missing' WHEN max(duplicate_ratio) >= 0.02 THEN 'duplicate' WHEN max(ordering_gap_score) >= 5 THEN 'ordering' WHEN max(avg_event_delay_ms) >= 1500 THEN 'delay' END AS primary_stream_issue
  FROM summary_minutes GROUP BY ALL"""


@query("stream_summary_day", "A22", "profile_id dt:date service_domain avg_missing_rate:d max_missing_rate:d avg_duplicate_ratio:d max_duplicate_ratio:d max_ordering_gap_score:d total_ordering_violations:i avg_event_delay_ms:d max_event_delay_ms:d stream_risk_score:d primary_stream_issue",
       "SELECT * FROM stream_days")
def stream_summary_day(i):
    return S.stream_summary_day(summary(i))


RELATIONS["weighted_days"] = """SELECT *, round(missing_count / expected_count, 6) AS weighted_missing_rate, round(duplicate_count / total_count, 6) AS weighted_duplicate_ratio FROM
  (SELECT profile_id, CAST(metric_minute AS DATE) AS dt, sum(expected_count) AS expected_count, sum(actual_count) AS actual_count, sum(missing_count) AS missing_count FROM complete_minutes GROUP BY ALL) c
  JOIN (SELECT profile_id, CAST(metric_minute AS DATE) AS dt, sum(total_count) AS total_count, sum(duplicate_count) AS duplicate_count FROM duplicate_minutes GROUP BY ALL) u USING (profile_id, dt)
  JOIN (SELECT profile_id, CAST(metric_minute AS DATE) AS dt, avg(avg_event_delay_ms) AS avg_delay_ms, max(max_event_delay_ms) AS max_delay_ms, sum(sla_breach_count) AS sla_breach_count FROM latency_minutes GROUP BY ALL) l USING (profile_id, dt)"""


def weighted(i):
    return S.weighted_rollup(completeness(i), S.stream_duplicates_minute(i.stream_events), latency(i))


@query("weighted_rollup", "A29", "profile_id dt:date expected_count:i actual_count:i missing_count:i total_count:i duplicate_count:i avg_delay_ms:d max_delay_ms:d sla_breach_count:i weighted_missing_rate:d weighted_duplicate_ratio:d",
       "SELECT * FROM weighted_days")
def weighted_rollup(i):
    return weighted(i)


@query("measurement_stream", "A25", "profile_id dt:date stream_event_count:i duplicate_count:i duplicate_rate:d ordering_error_count:i ordering_error_rate:d avg_delay_ms:d latency_max_ms:d completeness_rate:d throughput_per_minute:d",
       """SELECT profile_id, dt, total_count AS stream_event_count, duplicate_count, duplicate_count / total_count AS duplicate_rate, v AS ordering_error_count, v / total_count AS ordering_error_rate,
  avg_delay_ms, max_delay_ms AS latency_max_ms, total_count / n AS completeness_rate, total_count / 1440 AS throughput_per_minute FROM weighted_days
  JOIN (SELECT profile_id, CAST(metric_minute AS DATE) AS dt, sum(ordering_violation_count) AS v FROM order_minutes GROUP BY ALL) o USING (profile_id, dt)
  JOIN (SELECT profile_id, dt, count(*) AS n FROM source_hits GROUP BY ALL) c USING (profile_id, dt)""")
def measurement_stream(i):
    counts = i.source_hits.groupBy("profile_id", "dt").agg(F.count("*").alias("canonical_count"))
    return S.measurement_stream(weighted(i), S.stream_ordering_minute(i.stream_events), counts)


def tuned(col, warn, fail, low, high, factor, top):
    cap = f"least({{}}, {top})" if top else "{}"
    q = f"quantile_cont({col}, {{}}) FILTER ({col} > 0)"
    w = f"least(greatest({low}, round({q.format(warn)}, 6)), {high})"
    return w, cap.format(f"greatest(round({q.format(fail)}, 6), round({w} * {factor}, 6))")


_T = {n: tuned(*a) for n, a in {
    "missing": ("missing_rate", 0.30, 0.80, 0.01, 0.05, 1.8, 0.25), "duplicate": ("duplicate_ratio", 0.30, 0.80, 0.02, 0.08, 1.8, 0.25),
    "ordering": ("ordering_gap_score", 0.50, 0.85, 4.0, 12.0, 1.5, None), "delay": ("avg_event_delay_ms", 0.35, 0.80, 300.0, 1200.0, 1.8, None)}.items()}


@query("auto_threshold_tuner", "B21", "profile_id missing_warn:d missing_fail:d duplicate_warn:d duplicate_fail:d ordering_warn:d ordering_fail:d delay_warn:d delay_fail:d",
       f"SELECT profile_id, {', '.join(f'{w} AS {n}_warn, {f} AS {n}_fail' for n, (w, f) in _T.items())} FROM summary_minutes GROUP BY profile_id")
def auto_threshold_tuner(i):
    return S.auto_threshold_tuner(summary(i))


RELATIONS["validation_layers"] = """SELECT profile_id, dt, canonical_count, coalesce(stream_count, 0) AS stream_count, 0 AS missing_id_count, coalesce(duplicate_key_count, 0) AS duplicate_key_count, coalesce(stream_risk, 0) AS stream_risk FROM
  (SELECT profile_id, CAST(ts AS DATE) AS dt, count(*) AS canonical_count FROM expected_events GROUP BY ALL) c LEFT JOIN
  (SELECT profile_id, CAST(ts AS DATE) AS dt, count(*) AS stream_count FROM stream_events GROUP BY ALL) s USING (profile_id, dt) LEFT JOIN
  (SELECT profile_id, dt, count(*) AS duplicate_key_count FROM (SELECT profile_id, CAST(ts AS DATE) AS dt, raw_event_id FROM stream_events GROUP BY ALL HAVING count(*) > 1) d GROUP BY ALL) u USING (profile_id, dt) LEFT JOIN
  (SELECT profile_id, dt, max(stream_risk_score) AS stream_risk FROM stream_days GROUP BY ALL) r USING (profile_id, dt)"""
RELATIONS["validation_rules"] = """SELECT profile_id, dt, r.n AS rule_name, r.g AS rule_group, r.o AS observed_value, r.e AS expected_value, r.s AS validation_status, r.v AS severity FROM (SELECT profile_id, dt, unnest([
  {'n': 'canonical_stream_count_aligned', 'g': 'lineage', 'o': CAST(stream_count AS DOUBLE), 'e': CAST(canonical_count AS DOUBLE), 's': CASE WHEN stream_count = 0 THEN 'fail' WHEN stream_count <> canonical_count THEN 'warn' ELSE 'pass' END, 'v': CASE WHEN stream_count = 0 THEN 'high' WHEN stream_count <> canonical_count THEN 'medium' ELSE 'info' END},
  {'n': 'canonical_event_id_present', 'g': 'completeness', 'o': missing_id_count / greatest(stream_count, 1), 'e': 0.0, 's': 'pass', 'v': 'info'},
  {'n': 'duplicate_canonical_key_check', 'g': 'duplicate', 'o': duplicate_key_count / greatest(stream_count, 1), 'e': 0.0, 's': CASE WHEN duplicate_key_count > 0 THEN 'warn' ELSE 'pass' END, 'v': CASE WHEN duplicate_key_count > 0 THEN 'medium' ELSE 'info' END},
  {'n': 'stream_summary_available', 'g': 'risk', 'o': CAST(stream_risk AS DOUBLE), 'e': 0.0, 's': 'pass', 'v': 'info'}]) AS r FROM validation_layers) x"""


def layers(i):
    day = ["profile_id", "dt"]
    canonical = i.expected_events.groupBy("profile_id", F.to_date("ts").alias("dt")).agg(F.count("*").alias("canonical_count"))
    per_id = i.stream_events.groupBy("profile_id", F.to_date("ts").alias("dt"), "raw_event_id").agg(F.count("*").alias("n"))
    stream = per_id.groupBy(*day).agg(F.sum("n").alias("stream_count"), F.sum(F.when(F.col("raw_event_id").isNull(), F.col("n")).otherwise(0)).alias("missing_id_count"),
                                      F.count_if(F.col("raw_event_id").isNotNull() & (F.col("n") > 1)).alias("duplicate_key_count"))
    risk = S.stream_summary_day(summary(i)).groupBy(*day).agg(F.max("stream_risk_score").alias("stream_risk"))
    return canonical.join(stream, day, "left").join(risk, day, "left").fillna(0)


@query("stream_validation", "Q06", "profile_id dt:date rule_name rule_group observed_value:d expected_value:d validation_status severity", "SELECT * FROM validation_rules")
def stream_validation(i):
    return S.stream_validation(layers(i))


@query("stream_validation_summary", "Q06", "profile_id dt:date total_rules:i pass_count:i warn_count:i fail_count:i highest_severity validation_score:d",
       """SELECT profile_id, dt, total_rules, pass_count, warn_count, fail_count, CASE rk WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END AS highest_severity,
  round((fail_count * 2 + warn_count) / greatest(total_rules, 1), 6) AS validation_score FROM (
  SELECT profile_id, dt, count(*) AS total_rules, count(*) FILTER (validation_status = 'pass') AS pass_count, count(*) FILTER (validation_status = 'warn') AS warn_count,
  count(*) FILTER (validation_status = 'fail') AS fail_count, max(CASE severity WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 END) AS rk FROM validation_rules GROUP BY ALL) x""")
def stream_validation_summary(i):
    return S.stream_validation_summary(S.stream_validation(layers(i)))


# --- replay ------------------------------------------------------------------

RELATIONS["canonical_run"] = "SELECT profile_id, dt, run_id, hit_id AS canonical_event_id, ts AS event_time, service_domain FROM source_hits"
RUN = "profile_id, dt, run_id"
RELATIONS["lagged"] = f"""SELECT *, CASE WHEN floor(elapsed) <= 60 THEN 0 ELSE greatest(0, elapsed - replay_sequence / (tpm / 60)) END AS lag_sec,
  CASE WHEN floor(elapsed) <= 60 THEN 0 ELSE greatest(0, elapsed * (tpm / 60) - replay_sequence) END AS backlog_size FROM (
  SELECT {RUN}, c.event_time, date_trunc('minute', c.event_time) AS minute_ts, replay_sequence, (output_us - start_us) / 1000000.0 AS elapsed, tpm, n AS canonical_cnt FROM replay_events r
  JOIN canonical_run c USING ({RUN}, canonical_event_id) JOIN (SELECT {RUN}, min(output_us) AS start_us FROM replay_events GROUP BY ALL) b USING ({RUN})
  JOIN (SELECT {RUN}, count(*) AS n, count(*) / count(DISTINCT date_trunc('minute', event_time)) AS tpm FROM canonical_run GROUP BY ALL) k USING ({RUN})) x"""
RELATIONS["perf_minutes"] = f"""SELECT *, greatest(0, 1 - observed_event_count / baseline_throughput_per_minute) AS throughput_drop_ratio FROM (
  SELECT {RUN}, minute_ts, max(canonical_cnt) AS expected_event_count, count(*) AS observed_event_count, max(tpm) AS baseline_throughput_per_minute, max(lag_sec) AS freshness_delay_sec_max,
  avg(backlog_size) AS backlog_size_avg, max(backlog_size) AS backlog_size_max,
  (max(lag_sec) FILTER (rn = greatest(1, floor(cn * 0.5))) + max(lag_sec) FILTER (rn = greatest(1, ceil(cn * 0.5)))) / 2 AS freshness_delay_sec_p50,
  (max(lag_sec) FILTER (rn = greatest(1, floor(cn * 0.95))) + max(lag_sec) FILTER (rn = greatest(1, ceil(cn * 0.95)))) / 2 AS freshness_delay_sec_p95 FROM (
  SELECT *, count(*) OVER (PARTITION BY {RUN}, minute_ts) AS cn, row_number() OVER (PARTITION BY {RUN}, minute_ts ORDER BY lag_sec, replay_sequence) AS rn FROM lagged) x GROUP BY ALL) y"""
RELATIONS["batch_inputs"] = """SELECT profile_id, dt, run_id, service_domain, count(*) AS event_count, max(epoch_us(ts)) AS created_us FROM collected_hits GROUP BY ALL"""


def perf(i):
    return O.replay_lag_minute(i.replay_events, i.canonical_run, 60)


def run_counts(i):
    return i.canonical_run.groupBy("profile_id", "dt", "run_id").agg(F.count("*").alias("expected_event_count"))


def built(i):
    return i.collected_hits.groupBy("profile_id", "dt", "run_id", "service_domain").agg(F.count("*").alias("event_count"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("created_us"))


@query("replay_sequence", "W07", "profile_id dt:date run_id:i canonical_event_id:i replay_sequence:i",
       f"SELECT {RUN}, canonical_event_id, row_number() OVER (PARTITION BY {RUN} ORDER BY event_time, canonical_event_id) AS replay_sequence FROM canonical_run")
def replay_sequence(i):
    return O.replay_sequence(i.canonical_run, "canonical_event_id", "event_time")


@query("replay_join", "J10", "profile_id dt:date run_id:i event_time:ts replay_sequence:i lag_sec:d backlog_size:d",
       "SELECT * FROM lagged")
def replay_join(i):
    return O.replay_lag(O.replay_join(i.replay_events, i.canonical_run), 60)


PERF_COLS = "expected_event_count:i observed_event_count:i baseline_throughput_per_minute:d throughput_drop_ratio:d freshness_delay_sec_p50:d freshness_delay_sec_p95:d freshness_delay_sec_max:d backlog_size_avg:d backlog_size_max:d"


@query("replay_lag_minute", "W06", f"profile_id dt:date run_id:i minute_ts:ts {PERF_COLS}", "SELECT * FROM perf_minutes")
def replay_lag_minute(i):
    return perf(i)


RELATIONS["batch_minutes"] = f"""SELECT {RUN}, n AS expected_event_count, coalesce(o, 0) AS observed_event_count, greatest(0, 1 - coalesce(o, 0) / n) AS throughput_drop_ratio, greatest(0, n - coalesce(o, 0)) AS backlog_size
  FROM (SELECT {RUN}, count(*) AS n FROM canonical_run GROUP BY ALL) c LEFT JOIN (SELECT {RUN}, sum(event_count) AS o FROM batch_inputs GROUP BY ALL) b USING ({RUN})"""


@query("batch_minute", "W06", "profile_id dt:date run_id:i expected_event_count:i observed_event_count:i throughput_drop_ratio:d backlog_size:i", "SELECT * FROM batch_minutes")
def batch_minute(i):
    return O.batch_minute(run_counts(i), built(i))


RELATIONS["perf_days"] = f"""SELECT {RUN}, count(*) AS minute_window_count, count(*) FILTER (observed_event_count > 0) AS active_minute_count, sum(observed_event_count) AS observed_event_count, avg(observed_event_count) AS throughput_per_minute_avg,
  max(observed_event_count) AS max_throughput_per_minute, avg(throughput_drop_ratio) AS throughput_drop_ratio_avg, max(throughput_drop_ratio) AS throughput_drop_ratio_max, avg(freshness_delay_sec_p50) AS freshness_delay_sec_p50,
  max(freshness_delay_sec_p95) AS max_freshness_delay_sec_p95, max(freshness_delay_sec_max) AS freshness_delay_sec_max, avg(backlog_size_avg) AS backlog_size_avg, max(backlog_size_max) AS backlog_size_max,
  count(*) FILTER (freshness_delay_sec_p95 >= 300 OR throughput_drop_ratio >= 0.3) AS degraded_minute_count, count(*) FILTER (freshness_delay_sec_p95 >= 900 OR throughput_drop_ratio >= 0.6) AS severe_minute_count FROM perf_minutes GROUP BY ALL"""


@query("perf_day", "A23", "profile_id dt:date run_id:i minute_window_count:i active_minute_count:i observed_event_count:i throughput_per_minute_avg:d max_throughput_per_minute:i throughput_drop_ratio_avg:d throughput_drop_ratio_max:d freshness_delay_sec_p50:d max_freshness_delay_sec_p95:d freshness_delay_sec_max:d backlog_size_avg:d backlog_size_max:d degraded_minute_count:i severe_minute_count:i",
       "SELECT * FROM perf_days")
def perf_day(i):
    return O.perf_day(perf(i))


@query("perf_day_batch", "A23", "profile_id dt:date run_id:i minute_window_count:i active_minute_count:i observed_event_count:i throughput_per_minute_avg:d throughput_drop_ratio:d backlog_size:i degraded_minute_count:i severe_minute_count:i",
       f"""SELECT {RUN}, 1 AS minute_window_count, CASE WHEN observed_event_count > 0 THEN 1 ELSE 0 END AS active_minute_count, observed_event_count, observed_event_count / 1440 AS throughput_per_minute_avg, throughput_drop_ratio, backlog_size,
  CASE WHEN observed_event_count < expected_event_count THEN 1 ELSE 0 END AS degraded_minute_count, CASE WHEN observed_event_count = 0 THEN 1 ELSE 0 END AS severe_minute_count FROM batch_minutes""")
def perf_day_batch(i):
    return O.perf_day_batch(O.batch_minute(run_counts(i), built(i)))


def gap_sql(rel, us, order):
    return f"""SELECT {RUN}, coalesce(max(g), 0) AS max_gap_sec, coalesce(sum(CASE WHEN g > 5 THEN g - 5 ELSE 0 END), 0) AS downtime_sec FROM (
  SELECT {RUN}, floor(({us} - lag({us}) OVER (PARTITION BY {RUN} ORDER BY {us}, {order})) / 1000000) AS g FROM {rel}) x GROUP BY ALL"""


def run_sql(rel, count, us, order, empty, part):
    return f"""SELECT *, CASE WHEN output_count = expected_input_count THEN 'success' WHEN output_count = 0 THEN 'failed' ELSE 'partial' END AS run_status, CASE WHEN output_count = expected_input_count THEN 1 ELSE 0 END AS run_success_flag,
  CASE WHEN max_gap_sec > 5 THEN max_gap_sec ELSE 0 END AS no_data_interval_sec, CASE WHEN output_count = 0 THEN '{empty}' WHEN output_count < expected_input_count THEN '{part}' END AS failure_reason_code FROM (
  SELECT {RUN}, n AS expected_input_count, coalesce(o, 0) AS output_count, coalesce(max_gap_sec, 0) AS max_gap_sec, coalesce(downtime_sec, 0) AS downtime_sec FROM (SELECT {RUN}, count(*) AS n FROM canonical_run GROUP BY ALL) c
  LEFT JOIN (SELECT {RUN}, {count} AS o FROM {rel} GROUP BY ALL) r USING ({RUN}) LEFT JOIN ({gap_sql(rel, us, order)}) g USING ({RUN})) y"""


RELATIONS["replay_runs"] = run_sql("replay_events", "count(*)", "output_us", "replay_sequence", "no_replay_output", "partial_replay_output")
RUN_COLS = "profile_id dt:date run_id:i expected_input_count:i output_count:i max_gap_sec:i downtime_sec:i run_status run_success_flag:i no_data_interval_sec:i failure_reason_code"


def runs(i):
    return O.replay_gaps(i.canonical_run, i.replay_events)


@query("replay_gaps", "W05", RUN_COLS, "SELECT * FROM replay_runs")
def replay_gaps(i):
    return runs(i)


@query("batch_gaps", "W05", RUN_COLS, run_sql("batch_inputs", "sum(event_count)", "created_us", "service_domain", "no_batch_output", "partial_batch_output"))
def batch_gaps(i):
    return O.batch_gaps(run_counts(i), built(i))


RELATIONS["availability_days"] = """SELECT profile_id, dt, count(*) AS run_count, count(*) FILTER (run_status = 'success') AS success_run_count, count(*) FILTER (run_status = 'failed') AS failed_run_count, count(*) FILTER (run_status = 'partial') AS partial_run_count,
  0 AS timeout_run_count, avg(run_success_flag) AS success_rate, sum(no_data_interval_sec) AS no_data_interval_sec_sum, max(no_data_interval_sec) AS no_data_interval_sec_max, sum(downtime_sec) AS downtime_sec_sum, max(downtime_sec) AS downtime_sec_max,
  greatest(0, 1 - sum(downtime_sec) / 86400) AS availability_ratio, count(*) FILTER (output_count = 0) AS zero_output_run_count FROM replay_runs GROUP BY ALL"""


@query("availability_day", "A24", "profile_id dt:date run_count:i success_run_count:i failed_run_count:i partial_run_count:i timeout_run_count:i success_rate:d no_data_interval_sec_sum:i no_data_interval_sec_max:i downtime_sec_sum:i downtime_sec_max:i availability_ratio:d zero_output_run_count:i",
       "SELECT * FROM availability_days")
def availability_day(i):
    return O.availability_day(runs(i))


RELATIONS["operational_day"] = """SELECT profile_id, dt, n AS processed_count, tpm AS throughput_per_minute, p50 * 1000 AS lag_p50_ms, p95 * 1000 AS lag_p95_ms, mx * 1000 AS lag_max_ms,
  CASE WHEN availability_ratio = 0 THEN 1 ELSE availability_ratio END AS availability_ratio, no_data_interval_sec_sum / 60.0 AS no_data_gap_minutes FROM (SELECT profile_id, dt, count(*) AS n FROM replay_events GROUP BY ALL) r
  JOIN (SELECT profile_id, dt, max(throughput_per_minute_avg) AS tpm, max(freshness_delay_sec_p50) AS p50, max(max_freshness_delay_sec_p95) AS p95, max(freshness_delay_sec_max) AS mx FROM perf_days GROUP BY ALL) p USING (profile_id, dt)
  JOIN availability_days USING (profile_id, dt)"""


def operational(i):
    counts = i.replay_events.groupBy("profile_id", "dt").agg(F.count("*").alias("processed_count"))
    return O.measurement_operational(counts, O.perf_day(perf(i)), O.availability_day(runs(i)))


@query("measurement_operational", "A25", "profile_id dt:date processed_count:i throughput_per_minute:d lag_p50_ms:d lag_p95_ms:d lag_max_ms:d availability_ratio:d no_data_gap_minutes:d", "SELECT * FROM operational_day")
def measurement_operational(i):
    return operational(i)


RELATIONS["realism_layers"] = """SELECT profile_id, dt, scenario, source_count, canonical_count, stream_count, batch_count, replay_count, baseline_source, baseline_canonical, latency_delta_ms, suppressed_hours, marker_count, no_data_minutes, availability_ratio, schema_flags,
  scenario AS scenario_name FROM (
  SELECT profile_id, dt, CASE WHEN day(dt) = 21 THEN 'source_no_data' WHEN day(dt) = 22 THEN 'source_latency_degradation' WHEN day(dt) = 20 THEN 'source_schema_drift' ELSE 'baseline' END AS scenario,
  count(*) AS source_count, count(*) FILTER (WHERE value >= 2) AS canonical_count, count(*) FILTER (WHERE value >= 3) AS stream_count, count(*) FILTER (WHERE value >= 2) AS batch_count, 0 AS replay_count, 320 AS baseline_source, 310 AS baseline_canonical,
  CASE WHEN day(dt) > 25 THEN 900 ELSE 0 END AS latency_delta_ms, count(*) FILTER (WHERE value > 250) AS suppressed_hours, count(*) FILTER (WHERE value > 240) AS marker_count, count(*) FILTER (WHERE value > 200) AS no_data_minutes,
  CAST(0.97 AS DOUBLE) AS availability_ratio, 0 AS schema_flags FROM source_hits GROUP BY profile_id, dt) x"""
RELATIONS["realism_day"] = """SELECT *, CASE WHEN reason IS NULL THEN 'PASS' ELSE 'WARN' END AS realism_status, concat_ws(',', 'direct_measurement_delta_calculated', reason) AS realism_reasons FROM (
  SELECT *, CASE WHEN scenario_name = 'baseline' AND greatest(completeness_delta, timeliness_delta, availability_delta, integrity_delta) > 0.0001 THEN 'baseline_direct_delta_nonzero'
    WHEN scenario_name = 'source_latency_degradation' AND timeliness_delta <= 0 THEN 'expected_timeliness_delta_missing' WHEN scenario_name = 'source_no_data' AND availability_delta <= 0 THEN 'expected_availability_delta_missing'
    WHEN scenario_name = 'source_schema_drift' AND integrity_delta <= 0 THEN 'expected_integrity_delta_missing' END AS reason FROM (
  SELECT *, CASE WHEN calm THEN 0 ELSE greatest(ds, dc, greatest(0, (canonical_count - batch_count) / canonical_count), greatest(0, (canonical_count - stream_count) / canonical_count)) END AS completeness_delta,
    CASE WHEN calm THEN 0 ELSE least(1, latency_delta_ms / 3000) END AS timeliness_delta,
    CASE WHEN calm THEN 0 ELSE greatest(1 - availability_ratio, least(1, suppressed_hours / 24), least(1, marker_count / 60), least(1, no_data_minutes / 1440), CASE WHEN scenario_name = 'source_no_data' THEN greatest(ds, dc) ELSE 0 END) END AS availability_delta,
    CASE WHEN scenario_name = 'source_schema_drift' THEN 1 ELSE 0 END AS integrity_delta FROM (
  SELECT *, greatest(0, (baseline_source - source_count) / baseline_source) AS ds, greatest(0, (baseline_canonical - canonical_count) / baseline_canonical) AS dc,
    scenario_name = 'baseline' AND batch_count = canonical_count AND stream_count = canonical_count AND suppressed_hours = 0 AND marker_count = 0 AND latency_delta_ms <= 0 AS calm FROM realism_layers) a) b) c"""


@query("measurement_realism", "A26", "profile_id dt:date scenario_name completeness_delta:d timeliness_delta:d availability_delta:d integrity_delta:d realism_status realism_reasons", "SELECT * FROM realism_day")
def measurement_realism(i):
    return O.measurement_realism(i.realism_layers)


@query("no_data_window", "F05", "profile_id kept:i removed:i",
       """SELECT profile_id, count(*) FILTER (NOT inside) AS kept, count(*) FILTER (inside) AS removed FROM (SELECT profile_id, ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 09:30:00' AS inside FROM source_hits) x GROUP BY ALL""")
def no_data_window(i):
    kept, removed = O.no_data_window(i.source_hits, "2024-01-10 06:00:00", "2024-01-12 09:30:00")
    return kept.groupBy("profile_id").agg(F.count("*").alias("kept")).join(removed, "profile_id")
