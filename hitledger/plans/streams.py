"""Streaming queries over the event table, drained once, against their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import streamquality as S
from ..session import scratch_dir
from ..sources import records as R
from ..streaming import quality as Q
from .registry import REGISTRY, query
from .stream import summary

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(i):
    d = i.spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(i.sf_dir)
    return d.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("profile_id", F.lit("p0"))


def messages(i):
    """The stream twin of the stream_events relation."""
    copies = F.array_compact(F.array(F.when(F.col("value") >= 3, 0), F.when(F.col("value") > 120, 1)))
    d = events(i).withColumn("copy_no", F.explode(copies))
    return d.select(
        F.col("event_id").alias("raw_event_id"), "profile_id", "ts", F.col("event_type").alias("service_domain"), (F.col("event_id") % 3).alias("stream_partition"), F.col("event_id").alias("stream_offset"),
        (F.col("event_id") - F.when((F.col("value") > 150) & (F.col("copy_no") == 0), 20).otherwise(0)).alias("sequence_no"), F.floor(F.col("value") * 100).alias("event_delay_ms"))


def in_steps(i, rows, label, drain, steps=3):
    """Rows put into a source in order of time, a part at a time, each part drained before the next one comes."""
    where = scratch_dir(i.spark, label)
    us = F.unix_micros("ts")
    cuts = rows.agg(F.percentile_approx(us, [k / steps for k in range(1, steps)], 1000)).first()[0] or []
    part = F.lit(0)
    for cut in sorted(set(cuts)):
        part = part + (us > cut).cast("int")
    for k in range(len(set(cuts)) + 1):
        rows.where(part == k).write.mode("append").parquet(f"{where}/in")
        out = drain(i.spark.readStream.schema(rows.schema).parquet(f"{where}/in"), f"{where}/out")
    return out


def sent(i):
    """The messages as a table, with the types of the stream."""
    return i.stream_events.withColumn("ts", F.col("ts").cast("timestamp"))


HEAD = "profile_id metric_minute:ts service_domain"
MINUTE = ["profile_id", "metric_minute", "service_domain"]


@query("stream_minute_quality", "R01 R09", f"{HEAD} total_count:i avg_event_delay_ms:d max_event_delay_ms:i sla_breach_count:i status",
       "SELECT l.*, d.total_count FROM latency_minutes l JOIN duplicate_minutes d USING (profile_id, metric_minute, service_domain)")
def stream_minute_quality(i):
    return Q.run_updated(Q.stream_minute_quality(messages(i), "10 minutes", 10000), MINUTE, "minutes")


@query("stream_duplicates", "R02", f"{HEAD} total_count:i duplicate_count:i duplicate_ratio:d", "SELECT * FROM duplicate_minutes")
def stream_duplicates(i):
    return Q.run_updated(Q.stream_duplicates(messages(i)), MINUTE, "duplicates")


@query("stream_ordering", "R03", "profile_id service_domain stream_partition:i raw_event_id:i sequence_no:i prev_seq:i violation:i",
       "SELECT profile_id, service_domain, stream_partition, raw_event_id, curr_seq AS sequence_no, prev_seq, violation FROM order_rows")
def stream_ordering(i):
    return in_steps(i, sent(i), "ordering", lambda stream, path: Q.stream_ordering(stream, path=path))


@query("stream_completeness", "R04", "raw_event_id:i service_domain arrived:i",
       "SELECT raw_event_id, service_domain, CASE WHEN raw_event_id IN (SELECT raw_event_id FROM stream_events) THEN 1 ELSE 0 END AS arrived FROM expected_events")
def stream_completeness(i):
    expected = events(i).select("profile_id", F.col("event_id").alias("raw_event_id"), "ts", F.col("event_type").alias("service_domain"))
    actual = Q.stream_dedup_ingest(messages(i), ["raw_event_id"], "10 minutes")
    rows = i.expected_events.withColumn("ts", F.col("ts").cast("timestamp"))
    found = Q.run_completeness(expected, actual, rows, sent(i).agg(F.max("ts")).first()[0], "completeness")
    return found.select("raw_event_id", "service_domain", F.col("arrived_id").isNotNull().cast("int").alias("arrived"))


@query("stream_sessions", "R05", "profile_id user_id:i session_start:ts last_ts:ts events:i",
       """SELECT 'p0' AS profile_id, user_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events) x) y
  GROUP BY user_id, s""")
def stream_sessions(i):
    return Q.run_sessions(events(i), "user_id")


@query("stream_dedup_ingest", "R06", "raw_event_id:i service_domain", "SELECT DISTINCT raw_event_id, service_domain FROM stream_events")
def stream_dedup_ingest(i):
    return Q.run_bounded(Q.stream_dedup_ingest(messages(i), ["raw_event_id"]), "dedup")


@query("late_events", "R07", "profile_id metric_minute:ts events:i late_events:i max_delay_ms:i",
       "SELECT profile_id, date_trunc('minute', ts) AS metric_minute, count(*) AS events, count(*) FILTER (event_delay_ms > 10000) AS late_events, max(event_delay_ms) AS max_delay_ms FROM stream_events GROUP BY ALL")
def late_events(i):
    return Q.run_updated(Q.late_events(messages(i), 10000), ["profile_id", "metric_minute"], "late")


@query("stream_sink_idempotent", "R08", "service_domain n:i", "SELECT service_domain, count(*) AS n FROM stream_events GROUP BY ALL")
def stream_sink_idempotent(i):
    return Q.idempotent_sink(messages(i), "service_domain", times=2).groupBy("service_domain").agg(F.count("*").alias("n"))


def silences(i, keys):
    return in_steps(i, sent(i), "silence", lambda stream, path: Q.no_data_alert(stream, keys, path=path))


GAPS = """SELECT profile_id, service_domain, since, ts, gap_sec, gap_sec - 5 AS downtime_sec, false AS is_open FROM (SELECT *, floor((epoch_us(ts) - epoch_us(since)) / 1000000) AS gap_sec FROM
  (SELECT profile_id, {0} AS service_domain, ts, lag(ts) OVER (PARTITION BY profile_id, {0} ORDER BY ts, raw_event_id) AS since FROM stream_events) y) x WHERE gap_sec > 5"""


@query("no_data_alert", "R10", "profile_id ts:ts gap_sec:i downtime_sec:i", f"SELECT profile_id, ts, gap_sec, downtime_sec FROM ({GAPS.format("''")}) z")
def no_data_alert(i):
    return silences(i, ["profile_id"]).where("NOT is_open")


# a source that has stopped is silent up to the watermark, which is kept in milliseconds
@query("silent_sources", "R10", "profile_id service_domain since:ts ts:ts gap_sec:i downtime_sec:i is_open",
       GAPS.format("service_domain") + """ UNION ALL SELECT profile_id, service_domain, since, NULL, gap_sec, gap_sec - 5, true FROM (SELECT profile_id, service_domain, since, floor((mark - epoch_us(since)) / 1000000) AS gap_sec FROM
  (SELECT profile_id, service_domain, max(ts) AS since FROM stream_events GROUP BY ALL) s CROSS JOIN (SELECT (epoch_ms(max(ts)) - 600000) * 1000 AS mark FROM stream_events) w) x WHERE gap_sec > 5""")
def silent_sources(i):
    return silences(i, ["profile_id", "service_domain"])


def sliding(i):
    moments = Q.run_updated(Q.minute_moments(messages(i)), ["profile_id", "metric_minute"], "moments")
    return Q.sliding_windows(moments)


WINDOWS = """SELECT profile_id, window_end, count(*) AS events, avg(event_delay_ms) AS avg_delay_ms, avg(event_delay_ms) + 3 * stddev_pop(event_delay_ms) AS upper_limit_ms FROM (SELECT profile_id, event_delay_ms, unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE, date_trunc('minute', ts) + INTERVAL 60 MINUTE, INTERVAL 1 MINUTE)) AS window_end FROM stream_events) x
  GROUP BY ALL"""


@query("sliding_baseline", "R11", "profile_id window_end:ts events:i avg_delay_ms:d upper_limit_ms:d", WINDOWS)
def sliding_baseline(i):
    return sliding(i)


@query("sliding_thresholds", "R11 B21", "profile_id window_end:ts events:i avg_delay_ms:d delay_warn:d delay_fail:d status",
       f"""SELECT *, CASE WHEN avg_delay_ms >= delay_fail THEN 'fail' WHEN avg_delay_ms >= delay_warn THEN 'warn' ELSE 'ok' END AS status FROM ({WINDOWS}) w
  LEFT JOIN ({REGISTRY["auto_threshold_tuner"].sql}) t USING (profile_id)""")
def sliding_thresholds(i):
    return Q.judged_windows(sliding(i), S.auto_threshold_tuner(summary(i)))


@query("message_round_trip", "S08 S09 R09", "canonical_event_id:i event_name service_domain latency_ms:i status:i", "SELECT hit_id AS canonical_event_id, evt AS event_name, service_domain, latency_ms, status FROM source_hits")
def message_round_trip(i):
    path = scratch_dir(i.spark, "messages")
    R.write_event_stream(i.source_hits.withColumnRenamed("hit_id", "canonical_event_id"), "text", {}, path)
    return Q.run_bounded(R.read_event_stream(i.spark, "text", {"maxFilesPerTrigger": "4"}, path), "received")
