"""Parsing, canonical forms, table writes and filters over whole inputs."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..session import scratch_dir
from ..sources import logs as L, records as R
from .fixtures import RELATIONS
from .registry import query

HEAD = "profile_id dt:date scenario_name"


@query("parse_access_log", "S01",
       "hit_id:i dt:date ts:ts ip method path query status:i bytes:i latency_ms:i ref ref_host ua uid pcid evt event_type page_type service_domain funnel_stage is_conversion:i accept_lang affected:i drop_probability:d app_platform",
       """SELECT hit_id, dt, date_trunc('second', ts) AS ts, ip, method, path, CASE WHEN contains(url_raw, '?') THEN split_part(url_raw, '?', 2) END AS query, status, CASE WHEN value >= 10 THEN latency_ms END AS bytes, latency_ms, CASE WHEN value >= 30 THEN 'https://www.example.com/in' END AS ref,
  CASE WHEN value >= 30 THEN 'www.example.com' END AS ref_host, ua, 'again' AS uid, pcid, evt, evt AS event_type, CASE WHEN page_type <> '' THEN page_type WHEN event_type = 'signup' THEN 'login' ELSE 'page' END AS page_type,
  CASE WHEN event_type = 'signup' THEN 'auth' ELSE 'web' END AS service_domain, CASE WHEN page_type <> '' THEN page_type WHEN event_type = 'signup' THEN 'login' ELSE 'page' END AS funnel_stage, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_conversion,
  'ko,en' AS accept_lang, 3 AS affected, 0.25 AS drop_probability, app_platform FROM tails WHERE value >= 3""")
def parse_access_log(i):
    return L.parse_access_log(i.log_lines, keep=("hit_id",))[0]


@query("unparsed_lines", "S01", "hit_id:i line", "SELECT hit_id, line FROM log_lines WHERE line LIKE 'broken%'")
def unparsed_lines(i):
    return L.parse_access_log(i.log_lines, keep=("hit_id",))[1]


@query("parse_access_log_range", "S02", "hit_id:i dt:date ts:ts url_full url_norm host path status:i bytes:i uid pcid device_type evt page_type",
       """SELECT hit_id, dt, date_trunc('second', ts) AS ts, concat('https://shop.example.com', url_raw) AS url_full, concat('https://shop.example.com', path) AS url_norm, 'shop.example.com' AS host, path, status, CASE WHEN value >= 10 THEN latency_ms ELSE 0 END AS bytes, uid, pcid,
  CASE WHEN contains(ua, 'iPhone') OR contains(ua, 'Android') THEN 'mobile' WHEN contains(ua, 'Tablet') THEN 'tablet' ELSE 'desktop' END AS device_type, evt,
  CASE WHEN page_type <> '' THEN page_type WHEN event_type = 'purchase' THEN 'success' ELSE 'page' END AS page_type FROM tails WHERE value >= 3 AND dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def parse_access_log_range(i):
    return L.parse_access_log_range(i.log_lines, "https://shop.example.com/", "2024-01-05", "2024-01-25", keep=("hit_id",))


@query("access_log_dedup", "S02", "dt:date n:i",
       "SELECT dt, count(*) AS n FROM (SELECT DISTINCT dt, date_trunc('second', ts), ip, method, url_raw, status, uid, pcid, sid FROM tails WHERE value >= 3) x GROUP BY dt")
def access_log_dedup(i):
    lines = i.log_lines.unionByName(i.log_lines)
    return L.parse_access_log_range(lines, "https://shop.example.com", "2024-01-01", "2024-12-31", dedup=True).groupBy("dt").agg(F.count("*").alias("n"))


@query("file_manifest", "S05", "file_name checksum record_count:i size_bytes:i")
def file_manifest(i):
    return L.file_manifest(i.spark, f"{i.sf_dir}/*.parquet")


RELATIONS["transaction_lines"] = """SELECT tx_id, concat('{"event_time":"', {ISO_US}, 'Z","journey_id":"j', CAST(journey_id AS STRING), '","transaction_event":"', transaction_event, '","order_id":"', CAST(order_id AS STRING), '","amount":', CAST(CAST(amount AS DECIMAL(18,2)) AS STRING), ',"transaction_delay_ms":', CAST(transaction_delay_ms AS STRING),
  ',"anomaly_flag":', CASE WHEN amount > 300000 THEN 'true' ELSE 'false' END, '}') AS line, event_us FROM transaction_events"""
RELATIONS["state_lines"] = """SELECT state_id, concat('{"event_time":"', {ISO_US}, '+09:00","journey_id":"j', CAST(journey_id AS STRING), '","state_event":"', state_event, '","state_transition_delay_ms":', CAST(state_transition_delay_ms AS STRING), '}') AS line, event_us FROM state_events"""


@query("read_transactions", "S03 P29", "tx_id:i event_time:ts journey_id transaction_event order_id amount:d transaction_delay_ms:i anomaly_flag:i duplicate_key",
       """SELECT tx_id, make_timestamp(event_us) AS event_time, 'j' || journey_id AS journey_id, transaction_event, CAST(order_id AS VARCHAR) AS order_id, amount, transaction_delay_ms, CASE WHEN amount > 300000 THEN 1 ELSE 0 END AS anomaly_flag,
  concat('j', journey_id, '|', order_id, '||', transaction_event) AS duplicate_key FROM transaction_events""")
def read_transactions(i):
    return R.to_transaction_events(R.parse_records(i.transaction_lines, R.TRANSACTION_FIELDS, "line", ("tx_id",)))


@query("read_states", "S04 P28", "state_id:i event_time:ts journey_id state_event state_entity state_transition_delay_ms:i anomaly_flag:i",
       "SELECT state_id, make_timestamp(event_us) AS event_time, 'j' || journey_id AS journey_id, state_event, split_part(state_event, '_', 1) AS state_entity, state_transition_delay_ms, 0 AS anomaly_flag FROM state_events")
def read_states(i):
    return R.to_state_events(R.parse_records(i.state_lines, R.STATE_FIELDS, "line", ("state_id",)))


@query("to_raw_events", "S06", "source_row_id:i event_name source_type log_date:date status_code:i source_file_id:i",
       "SELECT hit_id AS source_row_id, event_type AS event_name, 'wc' AS source_type, dt AS log_date, status AS status_code, 7 AS source_file_id FROM collected_hits")
def to_raw_events(i):
    return L.to_raw_events(i.collected_hits, "hit_id", {"source_file_id": 7, "raw_snapshot_id": 3})


@query("to_canonical", "S07", "run_id:i raw_event_id:i target_date:date event_time:ts event_type session_id channel status_code:i",
       "SELECT 5 AS run_id, hit_id AS raw_event_id, dt AS target_date, ts AS event_time, event_type, sid AS session_id, channel, status AS status_code FROM collected_hits")
def to_canonical(i):
    return L.to_canonical(L.to_raw_events(i.collected_hits, "hit_id", {"source_file_id": 7}), 5)


@query("to_behavior_events", "S07", "hit_id:i journey_id journey_stage", "SELECT hit_id, concat('j', hit_id % 97) AS journey_id, funnel_stage AS journey_stage FROM tails")
def to_behavior_events(i):
    return L.to_behavior_events(i.tails)


@query("event_messages", "S08 S09", "canonical_event_id:i dt:date ts:ts event_name service_domain funnel_stage status:i latency_ms:i is_conversion:i uid sid",
       "SELECT hit_id AS canonical_event_id, dt, ts, evt AS event_name, service_domain, funnel_stage, status, latency_ms, is_conversion, uid, sid FROM source_hits")
def event_messages(i):
    return R.parse_messages(R.to_messages(i.source_hits, "hit_id").select("value"))


@query("overwrite_scope", "S10", "profile_id dt:date n:i", "SELECT profile_id, dt, count(*) AS n FROM collected_hits GROUP BY ALL")
def overwrite_scope(i):
    path = scratch_dir(i.spark, "scope")
    hits = i.source_hits.select("profile_id", "dt", "hit_id").repartition("profile_id", "dt")
    R.overwrite_scope(hits, path, ["profile_id", "dt"])
    again = i.collected_hits.select("profile_id", "dt", "hit_id").repartition("profile_id", "dt")
    R.overwrite_scope(again, path, ["profile_id", "dt"])
    return i.spark.read.parquet(path).groupBy("profile_id", "dt").agg(F.count("*").alias("n"))


@query("upsert", "S11", "hit_id:i status:i", "SELECT s.hit_id, CASE WHEN c.hit_id IS NULL THEN s.status ELSE 1 END AS status FROM source_hits s LEFT JOIN collected_hits c USING (hit_id)")
def upsert(i):
    return R.upsert(i.source_hits.select("hit_id", "status"), i.collected_hits.select("hit_id", F.lit(1).alias("status")), ["hit_id"])


@query("upsert_touched", "S11 J14", "hit_id:i status:i", "SELECT s.hit_id, CASE WHEN c.hit_id IS NULL THEN s.status ELSE 1 END AS status FROM source_hits s LEFT JOIN collected_hits c USING (hit_id)")
def upsert_touched(i):
    path, schema = scratch_dir(i.spark, "keyed"), "hit_id bigint, status int"
    R.write_keyed(i.source_hits.select("hit_id", F.col("status").cast("int")), path, ["hit_id"])
    delta = i.collected_hits.select("hit_id", F.lit(1).alias("status"))
    for _ in range(2):  # the same delta again changes nothing
        R.upsert_keyed(path, delta, ["hit_id"], "collected", schema)
    return R.read_keyed(i.spark, path, schema)


@query("conform", "S12", "hit_id:i uid gap_rate:d event_count:i risk_level detail_json", "SELECT hit_id, uid, 0 AS gap_rate, 0 AS event_count, 'unknown' AS risk_level, '{}' AS detail_json FROM source_hits")
def conform(i):
    schema = T._parse_datatype_string("hit_id bigint, uid string, gap_rate double, event_count bigint, risk_level string, detail_json string")
    return R.conform(i.source_hits, schema)


@query("latest_row", "S13", "profile_id pcid hit_id:i path", "SELECT profile_id, pcid, hit_id, path FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, pcid ORDER BY ts DESC, hit_id DESC) AS rn FROM source_hits) x WHERE rn = 1")
def latest_row(i):
    return R.latest_row(i.source_hits, ["profile_id", "pcid"], ["ts", "hit_id"])


@query("latest_per_scenario", "T09", "profile_id scenario_name dt:date hits:i",
       "SELECT profile_id, scenario_name, max(dt) AS dt, arg_max(n, dt) AS hits FROM (SELECT profile_id, scenario_name, dt, count(*) AS n FROM source_hits GROUP BY ALL) x GROUP BY ALL")
def latest_per_scenario(i):
    days = i.source_hits.groupBy("profile_id", "scenario_name", "dt").agg(F.count("*").alias("hits"))
    return R.latest_row(days, ["profile_id", "scenario_name"], ["dt"])


@query("export_csv", "S14", "app_platform n:i", "SELECT app_platform, count(*) AS n FROM source_hits GROUP BY ALL")
def export_csv(i):
    path = scratch_dir(i.spark, "export")
    R.export_csv(i.source_hits.groupBy("app_platform").agg(F.count("*").alias("n")), path)
    return i.spark.read.schema("app_platform string, n bigint").option("header", True).option("sep", "\t").csv(path)


RELATIONS["asked_scopes"] = """SELECT profile_id, dt, CASE WHEN min(value) < 0.2 THEN 99 ELSE 11 END AS source_gen_run_id, CASE WHEN max(value) > 220 THEN 2 ELSE 1 END AS run_id, CASE WHEN count(*) > 330 THEN 'other' ELSE min(scenario_name) END AS scenario_name FROM source_hits GROUP BY profile_id, dt"""


@query("progressive_count", "S15 Q12", f"{HEAD} source_gen_run_id:i run_id:i row_count:i matched_scope",
       """SELECT a.*, coalesce(n, 0) AS row_count, CASE WHEN n IS NULL THEN 'none' WHEN a.scenario_name = s.scenario_name THEN CASE WHEN a.source_gen_run_id = 11 AND a.run_id = 1 THEN 'strict' WHEN a.source_gen_run_id = 11 THEN 'any_run' WHEN a.run_id = 1 THEN 'any_source' ELSE 'scenario_only' END
  WHEN a.source_gen_run_id = 11 AND a.run_id = 1 THEN 'any_scenario' ELSE 'day_only' END AS matched_scope FROM asked_scopes a LEFT JOIN (SELECT profile_id, dt, scenario_name, count(*) AS n FROM collected_hits GROUP BY ALL) s USING (profile_id, dt)""")
def progressive_count(i):
    return R.progressive_count(i.collected_hits, i.asked_scopes)


@query("scope_filter", "F01 F02 F03 F04", "app_platform n:i",
       "SELECT app_platform, count(*) AS n FROM source_hits WHERE profile_id = 'p0' AND run_id = 1 AND dt BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' AND scenario_name = 'baseline' GROUP BY ALL")
def scope_filter(i):
    d = R.scope_filter(i.source_hits, profile_id="p0", run_id=1, unknown_column="x", source_gen_run_id=None)
    d = R.scenario_or_blank(R.date_range(d, "2024-01-03", "2024-01-28"), "baseline")
    return d.groupBy("app_platform").agg(F.count("*").alias("n"))


@query("time_range", "F02", "n:i", "SELECT count(*) AS n FROM source_hits WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 09:30:00'")
def time_range(i):
    return R.date_range(i.source_hits, "2024-01-10 06:00:00", "2024-01-12 09:30:00", "ts", half_open=True).agg(F.count("*").alias("n"))


@query("marker_filter", "F06", "dt:date n:i", "SELECT dt, count(*) AS n FROM tails WHERE contains(kv_raw, 'evt=error') OR contains(path, '/product/3') GROUP BY dt")
def marker_filter(i):
    return R.marker_filter(i.tails, ["kv_raw", "path", "cookie"], ["evt=error", "/product/3"]).groupBy("dt").agg(F.count("*").alias("n"))
