"""Event relations derived from the supplied tables, in SQL both engines read.

Losses, repeats and delays depend on the measured ``value`` of an event, so the
inputs grow with the tables and no row is left out of a plan's reach.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Engine-specific spellings; everything else in the relations is common SQL.
SPELLING = {
    "spark": {
        "EPOCH_US": "unix_micros(CAST(ts AS TIMESTAMP))",
        "APACHE": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
        "ISO": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
        "ISO_US": "date_format(timestamp_micros(event_us), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
        "TS_US": "CAST(timestamp_micros(event_us) AS TIMESTAMP_NTZ)",
        "DOM": "day(ts)",
    },
    "duckdb": {
        "EPOCH_US": "epoch_us(ts)",
        "APACHE": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
        "ISO": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')",
        "ISO_US": "strftime(make_timestamp(event_us), '%Y-%m-%dT%H:%M:%S.%f')",
        "TS_US": "make_timestamp(event_us)",
        "DOM": "day(ts)",
    },
}

RELATIONS = {
    # web server hits: the truth
    "source_hits": """
SELECT event_id AS hit_id, 'p0' AS profile_id,
  CASE WHEN {DOM} BETWEEN 20 AND 22 THEN 'collection_missing' ELSE 'baseline' END AS scenario_name,
  CAST(ts AS DATE) AS dt, ts, 1 AS run_id, 11 AS source_gen_run_id,
  CASE WHEN value < 20 THEN NULL ELSE concat('u', CAST(user_id AS STRING)) END AS uid,
  concat('c', CAST(user_id AS STRING)) AS pcid,
  concat('s', CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS sid,
  concat('10.0.0.', CAST(user_id % 64 AS STRING)) AS ip,
  CASE user_id % 4 WHEN 0 THEN 'pc_web' WHEN 1 THEN 'mobile_web' WHEN 2 THEN 'ios_app' ELSE 'android_app' END AS app_platform,
  CASE WHEN user_id % 4 < 2 THEN 'web-1' ELSE concat('app-', CAST(user_id % 3 AS STRING)) END AS app_version,
  concat('sdk-', CAST(user_id % 5 AS STRING)) AS sdk_version,
  CASE user_id % 5 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36'
    WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Version/17.0 Mobile Safari/604.1'
    WHEN 2 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 13) Firefox/121.0'
    WHEN 3 THEN 'Mozilla/5.0 (Linux; Android 14; Tablet) Edg/120.0' ELSE '' END AS ua,
  CASE user_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE '' END AS device_type,
  'GET' AS method,
  CASE event_type WHEN 'view' THEN concat('/product/', CAST(event_id % 7 AS STRING)) WHEN 'click' THEN '/search'
    WHEN 'signup' THEN '/auth/signup' WHEN 'purchase' THEN '/order/complete' ELSE '/error.css' END AS path,
  CASE event_type WHEN 'view' THEN 'product' WHEN 'purchase' THEN 'payment' WHEN 'click' THEN 'search' ELSE '' END AS page_type,
  CASE event_type WHEN 'view' THEN 'product' WHEN 'purchase' THEN 'checkout' WHEN 'click' THEN 'search' ELSE 'browse' END AS funnel_stage,
  CASE event_type WHEN 'view' THEN 'commerce' WHEN 'purchase' THEN 'commerce' WHEN 'signup' THEN 'auth' ELSE 'web' END AS service_domain,
  CASE WHEN value < 60 THEN 'web' WHEN value < 120 THEN 'app' ELSE '' END AS channel,
  event_type, CASE WHEN event_type = 'view' THEN 'view' ELSE event_type END AS evt,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_conversion,
  CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status,
  CAST(floor(value) AS BIGINT) * 10 AS latency_ms, value
FROM events""",
    # what the tag collector kept
    "collected_hits": """
SELECT * FROM source_hits
WHERE value >= CASE WHEN scenario_name = 'baseline' THEN 4 ELSE 16 END
  AND NOT (app_platform = 'ios_app' AND app_version = 'app-1' AND value < 60)""",
    # cookie tail of a hit
    "tails": """
SELECT *, concat('schema_version=v05; evt=', evt, '; uid=', coalesce(uid, ''), '; pcid=', pcid, '; sid=', sid,
  '; page_type=', page_type, '; journey_id=j', CAST(hit_id % 97 AS STRING),
  '; latency_ms=', CAST(latency_ms AS STRING), '; uid = again', '; note; drop_probability=0.25; affected=3.9',
  '; app_platform=', app_platform, '; al=ko,en; auth_result=', CASE WHEN value < 40 THEN 'ok' ELSE 'fail' END) AS kv_raw,
  concat(path, CASE WHEN value < 50 THEN concat('?q=', CAST(hit_id AS STRING), '&q=2&ref=x%20y&flag') ELSE '' END) AS url_raw
FROM source_hits""",
    # access log lines of the hits, some of them broken
    "log_lines": """
SELECT hit_id, dt, CASE WHEN value < 3 THEN concat('broken ', CAST(hit_id AS STRING)) ELSE
  concat(ip, ' - - [', {APACHE}, ' +0000] "', method, ' ', url_raw, ' HTTP/1.1" ', CAST(status AS STRING), ' ',
    CASE WHEN value < 10 THEN '-' ELSE CAST(latency_ms AS STRING) END,
    ' "', CASE WHEN value < 30 THEN '-' ELSE 'https://www.example.com/in' END, '" "', ua, '" "', kv_raw, '"') END AS line
FROM tails""",
    "behavior_events": """
SELECT event_id AS behavior_id, 'p0' AS profile_id, user_id AS journey_id,
  CASE WHEN event_type = 'purchase' AND value >= 80 THEN user_id * 10 END AS order_id,
  CASE event_type WHEN 'purchase' THEN 'order_complete' WHEN 'signup' THEN 'checkout' ELSE 'browse' END AS journey_stage,
  CASE WHEN value >= 100 THEN 'cp' END AS coupon_id, {EPOCH_US} AS event_us
FROM events""",
    "transaction_events": """
SELECT o_orderkey AS tx_id, 'p0' AS profile_id, o_custkey AS journey_id, o_orderkey AS order_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS payment_id,
  CASE o_orderstatus WHEN 'F' THEN 'payment_approved' WHEN 'O' THEN 'order_created' ELSE
    CASE WHEN o_totalprice < 100000 THEN 'coupon_applied' ELSE 'refund_completed' END END AS transaction_event,
  (1704067200 + (o_orderkey * 7919) % 2592000) * 1000000 AS event_us, o_totalprice AS amount,
  o_orderkey % 500 AS transaction_delay_ms
FROM orders""",
    "state_events": """
SELECT l_orderkey * 100 + l_linenumber AS state_id, 'p0' AS profile_id, o_custkey AS journey_id, l_orderkey AS order_id,
  CASE min(l_returnflag) WHEN 'N' THEN 'order_status_created' WHEN 'R' THEN 'refund_status_completed' ELSE 'delivery_status_started' END AS state_event,
  (1704067200 + (l_orderkey * 7919) % 2592000 + min(l_partkey) % 7200 - 600) * 1000000 AS event_us,
  min(l_partkey) % 900 AS state_transition_delay_ms
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY l_orderkey, l_linenumber, o_custkey""",
    # messages of the stream: some lost, some repeated, some out of order
    "stream_events": """
SELECT event_id AS raw_event_id, 'p0' AS profile_id, ts, event_type AS service_domain, event_id % 3 AS stream_partition,
  event_id AS stream_offset, event_id - CASE WHEN value > 150 THEN 20 ELSE 0 END AS sequence_no,
  CAST(floor(value * 100) AS BIGINT) AS event_delay_ms
FROM events WHERE value >= 3
UNION ALL
SELECT event_id, 'p0', ts, event_type, event_id % 3, event_id, event_id, CAST(floor(value * 100) AS BIGINT)
FROM events WHERE value > 120""",
    "expected_events": """
SELECT event_id AS raw_event_id, 'p0' AS profile_id, ts, event_type AS service_domain FROM events""",
    "event_mapping": """
SELECT * FROM (VALUES (1, '/product/', 1), (2, '/search', 1), (3, '/order/', 1), (4, '/auth/', 0), (5, '/product/1', 1))
  AS t(id, url_pattern, is_active)""",
    # rows replayed from the canonical events, with their output time
    "replay_events": """
SELECT hit_id AS canonical_event_id, profile_id, dt, run_id, hit_id AS replay_event_id, ts AS event_time,
  row_number() OVER (PARTITION BY profile_id, dt, run_id ORDER BY ts, hit_id) AS replay_sequence,
  {EPOCH_US} + latency_ms * 1000 AS output_us
FROM source_hits WHERE value >= 3""",
}

# Further relations may be registered by plan modules (day facts of a family).
NAME = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_][a-z0-9_]*)\b")


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(NAME.findall(sql)) if n in RELATIONS]


def _closure(sql: str, seen: dict | None = None) -> dict[str, str]:
    seen = {} if seen is None else seen
    for name in _needs(sql):
        if name not in seen:
            body = RELATIONS[name]
            _closure(body, seen)
            seen[name] = body
    return seen


def _render(text: str, engine: str) -> str:
    for token, spelling in SPELLING[engine].items():
        text = text.replace("{" + token + "}", spelling)
    return text


# day facts that several relations read; computed once
WRITTEN = ("gap_features", "gap_profile", "gap_recent")


def with_relations(body: str, final: str) -> str:
    """DuckDB text: the relations ``body`` reads, ``body`` as ``answer``, then ``final``."""
    parts = [f"{n} AS {'MATERIALIZED ' if n in WRITTEN else ''}({s.strip()})" for n, s in _closure(body).items()]
    # written whole, so that what a reader asks of it (a limit) does not change how it is made
    parts.append(f"answer AS MATERIALIZED ({body.strip()})")
    return _render("WITH " + ",\n".join(parts) + "\n" + final, "duckdb")


# lines of orders that one task joins and groups
LINES = 500_000


class Inputs:
    """Tables of one folder and the relations derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, body: str) -> DataFrame:
        """Run common SQL over tables and relations."""
        relations = _closure(body)
        text = " ".join([*relations.values(), body])
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                given = self.table(name)
                if name == "lineitem" and "state_events" in relations:
                    given = self.dealt(given)
                given.createOrReplaceTempView(name)
        parts = [f"{n} AS ({s.strip()})" for n, s in relations.items()]
        head = f"WITH {', '.join(parts)}\n" if parts else ""
        return self.spark.sql(_render(head + body, "spark"))

    def dealt(self, lines: DataFrame) -> DataFrame:
        """Lines by their order, over as many parts as their number asks for.

        States join and group lines by order in one stage. With a fixed number of
        parts, or parts put together by their compressed bytes, its tasks hold
        many times the lines.
        """
        parts = -(-lines.count() // LINES)
        return lines.repartition(parts, "l_orderkey") if parts > self.spark.sparkContext.defaultParallelism else lines

    def __getattr__(self, name: str) -> DataFrame:
        if name in RELATIONS:
            return self.sql(f"SELECT * FROM {name}")
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
