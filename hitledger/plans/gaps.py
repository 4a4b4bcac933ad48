"""Collection gaps between source and collected hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaps as G
from .fixtures import RELATIONS
from .registry import query

SCOPE = "profile_id, dt, scenario_name"
BROWSER = """CASE WHEN contains(lower(ua), 'edg/') THEN 'Edge' WHEN contains(lower(ua), 'chrome/') THEN 'Chrome'
  WHEN contains(lower(ua), 'safari/') THEN 'Safari' WHEN contains(lower(ua), 'firefox/') THEN 'Firefox' WHEN ua = '' THEN 'unknown' ELSE 'Other' END"""
SYSTEM = """CASE WHEN app_platform = 'ios_app' OR contains(ua, 'iPhone') THEN 'iOS'
  WHEN app_platform = 'android_app' OR contains(ua, 'Android') THEN 'Android' WHEN contains(ua, 'Windows') THEN 'Windows'
  WHEN contains(ua, 'Macintosh') THEN 'macOS' ELSE 'unknown' END"""

for side in ("source", "collected"):
    # segment columns, spelled for DuckDB; the Spark side uses segment_columns
    RELATIONS[f"{side}_segments"] = f"""SELECT * REPLACE (CASE WHEN device_type = '' THEN 'unknown' ELSE device_type END AS device_type),
  path AS surface_path, {BROWSER} AS browser_family, {SYSTEM} AS os_family FROM {side}_hits"""


def measures(dims: str, side: str) -> str:
    keys = f"{SCOPE}, {dims}" if dims else SCOPE
    return f"""SELECT {keys}, count(*) AS event_count, count(*) FILTER (event_type = 'view' OR page_type IN ('product', 'search', 'payment')) AS pv,
  count(DISTINCT pcid) AS uv, count(DISTINCT sid) AS visit, CAST(sum(is_conversion) AS BIGINT) AS conversion FROM {side}_segments GROUP BY {keys}"""


MEASURES = ("event_count", "pv", "uv", "visit", "conversion")


def both(dims: str) -> str:
    keys = f"{SCOPE}, {dims}" if dims else SCOPE
    picks = ", ".join(
        f"coalesce(w.{m}, 0) AS web_{m}, coalesce(c.{m}, 0) AS wc_{m}" for m in MEASURES
    )
    return f"SELECT {keys}, {picks} FROM ({measures(dims, 'source')}) w FULL JOIN ({measures(dims, 'collected')}) c USING ({keys})"


def rate(m: str) -> str:
    return f"CASE WHEN web_{m} <= 0 THEN 0 ELSE greatest(0, web_{m} - wc_{m}) / web_{m} END"


def gap_sql(dims: str) -> str:
    rates = ", ".join(f"{rate(m)} AS {m}_missing_rate" for m in ("uv", "visit", "pv", "conversion"))
    return f"""SELECT *, greatest(0, web_event_count - wc_event_count) AS missing_count, {rate('event_count')} AS missing_rate, {rates},
  CASE WHEN web_event_count >= 30 AND {rate('event_count')} >= 0.05 THEN 1 ELSE 0 END AS tagging_missing_flag FROM ({both(dims)}) g"""


COUNTS = " ".join(f"web_{m}:i wc_{m}:i" for m in MEASURES)
GAP = f"{COUNTS} missing_count:i missing_rate:d uv_missing_rate:d visit_missing_rate:d pv_missing_rate:d conversion_missing_rate:d tagging_missing_flag:i"
HEAD = "profile_id dt:date scenario_name"


def sides(i):
    return G.segment_columns(i.source_hits), G.segment_columns(i.collected_hits)


@query("hit_metrics", "A01", f"{HEAD} app_platform app_version sdk_version event_count:i pv:i uv:i visit:i conversion:i",
       measures("app_platform, app_version, sdk_version", "source"))
def hit_metrics(i):
    return G.hit_metrics(sides(i)[0], G.APP)


@query("identity_metrics", "A02", f"{HEAD} app_platform app_version sdk_version event_count:i uid_events:i login_users:i",
       f"""SELECT {SCOPE}, app_platform, app_version, sdk_version, count(*) AS event_count, count(uid) AS uid_events,
  count(DISTINCT uid) AS login_users FROM source_segments GROUP BY ALL""")
def identity_metrics(i):
    return G.identity_metrics(sides(i)[0])


def dims_sql(side: str) -> str:
    levels = [
        ("'all'", "'all'"), ("'app_platform'", "app_platform"), ("'app_version'", "concat(app_platform, '|', app_version)"),
        ("'sdk_version'", "concat(app_platform, '|', sdk_version)"), ("'app_sdk'", "concat(app_platform, '|', app_version, '|', sdk_version)"),
    ]
    return " UNION ALL ".join(measures(f"{t} AS dimension_type, {v} AS dimension_value", side).replace(
        f"GROUP BY {SCOPE}, {t} AS dimension_type, {v} AS dimension_value", "GROUP BY ALL") for t, v in levels)


@query("dim_metrics", "A03", f"{HEAD} dimension_type dimension_value event_count:i pv:i uv:i visit:i conversion:i", dims_sql("source"))
def dim_metrics(i):
    return G.dim_metrics(sides(i)[0])


@query("gap_by_app", "A04 J04 U03", f"{HEAD} app_platform app_version sdk_version {GAP}", gap_sql("app_platform, app_version, sdk_version"))
def gap_by_app(i):
    return G.gap_by_app(*sides(i))


@query("gap_by_sdk", "A04 J04", f"{HEAD} app_platform sdk_version affected_app_versions:i {GAP}",
       f"""SELECT g.*, affected_app_versions FROM ({gap_sql('app_platform, sdk_version')}) g JOIN (
  SELECT {SCOPE}, app_platform, sdk_version, count(DISTINCT app_version) AS affected_app_versions FROM
  (SELECT {SCOPE}, app_platform, app_version, sdk_version FROM source_hits UNION ALL SELECT {SCOPE}, app_platform, app_version, sdk_version FROM collected_hits) u
  GROUP BY ALL) v USING ({SCOPE}, app_platform, sdk_version)""")
def gap_by_sdk(i):
    return G.gap_by_sdk(*sides(i))


@query("gap_by_url", "A04 J04", f"{HEAD} app_platform app_version sdk_version surface_path {GAP}", gap_sql("app_platform, app_version, sdk_version, surface_path"))
def gap_by_url(i):
    return G.gap_by_url(*sides(i))


@query("gap_by_client", "A04 J04", f"{HEAD} app_platform app_version sdk_version device_type browser_family os_family {GAP}",
       gap_sql("app_platform, app_version, sdk_version, device_type, browser_family, os_family"))
def gap_by_client(i):
    return G.gap_by_client(*sides(i))


BOTH_DIMS = f"""SELECT {SCOPE}, dimension_type, dimension_value, m.name AS metric_name, CAST(m.web AS DOUBLE) AS web_value, CAST(m.wc AS DOUBLE) AS wc_value
FROM (SELECT {SCOPE}, dimension_type, dimension_value, unnest([
  {", ".join(f"{{'name': '{m}', 'web': coalesce(w.{m}, 0), 'wc': coalesce(c.{m}, 0)}}" for m in MEASURES)}]) AS m
  FROM ({dims_sql('source')}) w FULL JOIN ({dims_sql('collected')}) c USING ({SCOPE}, dimension_type, dimension_value)) x"""
METRIC_GAP_SQL = f"""SELECT *, CASE WHEN gap_rate >= 0.30 THEN 'critical' WHEN gap_rate >= 0.15 THEN 'high' WHEN gap_rate >= 0.05 THEN 'warning' ELSE 'low' END AS severity,
  CASE WHEN web_value >= 30 AND gap_rate >= 0.05 THEN 1 ELSE 0 END AS tagging_missing_flag FROM (
  SELECT *, greatest(0, web_value - wc_value) AS missing_value, CASE WHEN web_value <= 0 THEN 0 ELSE greatest(0, web_value - wc_value) / web_value END AS gap_rate
  FROM ({BOTH_DIMS}) d) e"""
RELATIONS["metric_gap_day"] = METRIC_GAP_SQL


@query("metric_gap", "A05", f"{HEAD} dimension_type dimension_value metric_name web_value:d wc_value:d missing_value:d gap_rate:d severity tagging_missing_flag:i",
       "SELECT * FROM metric_gap_day")
def metric_gap(i):
    return G.metric_gap(*sides(i))


IDENTITY_SIDE = "SELECT {scope}, app_platform, app_version, sdk_version, count(*) AS event_count, count(uid) AS uid_events, count(DISTINCT uid) AS login_users FROM {side}_hits GROUP BY ALL"
IDENTITY_GAP_SQL = f"""SELECT *, greatest(uid_missing_rate, login_user_gap_rate) AS identity_integrity_gap FROM (
  SELECT *, greatest(0, web_uid_events - wc_uid_events) AS uid_missing_count,
  CASE WHEN web_uid_events <= 0 THEN 0 ELSE greatest(0, web_uid_events - wc_uid_events) / web_uid_events END AS uid_missing_rate,
  CASE WHEN web_login_users <= 0 THEN 0 ELSE greatest(0, web_login_users - wc_login_users) / web_login_users END AS login_user_gap_rate FROM (
  SELECT {SCOPE}, app_platform, app_version, sdk_version, {", ".join(f"coalesce(w.{m}, 0) AS web_{m}, coalesce(c.{m}, 0) AS wc_{m}" for m in ("event_count", "uid_events", "login_users"))}
  FROM ({IDENTITY_SIDE.format(scope=SCOPE, side='source')}) w FULL JOIN ({IDENTITY_SIDE.format(scope=SCOPE, side='collected')}) c USING ({SCOPE}, app_platform, app_version, sdk_version)) a) b"""
RELATIONS["identity_gap_day"] = IDENTITY_GAP_SQL


@query("identity_gap", "A06",
       f"{HEAD} app_platform app_version sdk_version web_event_count:i wc_event_count:i web_uid_events:i wc_uid_events:i web_login_users:i wc_login_users:i uid_missing_count:i uid_missing_rate:d login_user_gap_rate:d identity_integrity_gap:d",
       "SELECT * FROM identity_gap_day")
def identity_gap(i):
    return G.identity_gap(*sides(i))


URL_KEYS = f"{SCOPE}, app_platform, app_version, sdk_version, surface_path"
URL_SHIFT_SQL = f"""SELECT *, CASE WHEN distribution_shift_score >= 0.05 THEN 1 ELSE 0 END AS url_collapse_flag,
  CASE WHEN under_count > 0 THEN 'under' WHEN over_count > 0 THEN 'over' ELSE 'none' END AS shifted_direction FROM (
  SELECT *, greatest(0, web_events - wc_events) AS under_count, greatest(0, wc_events - web_events) AS over_count,
  CASE WHEN web_events <= 0 THEN 0 ELSE least(1, greatest(0, web_events - wc_events) / web_events) END AS under_rate,
  CASE WHEN web_events <= 0 THEN 0 ELSE least(1, greatest(0, wc_events - web_events) / web_events) END AS over_rate,
  least(1, abs(web_events - wc_events) / greatest(web_events, wc_events, 1)) AS distribution_shift_score FROM (
  SELECT {URL_KEYS}, coalesce(w.n, 0) AS web_events, coalesce(c.n, 0) AS wc_events FROM
  (SELECT {URL_KEYS}, count(*) AS n FROM source_segments GROUP BY ALL) w FULL JOIN
  (SELECT {SCOPE}, app_platform, app_version, sdk_version, CASE WHEN value > 200 THEN '/order/pizza' ELSE surface_path END AS surface_path, count(*) AS n FROM collected_segments GROUP BY ALL) c
  USING ({URL_KEYS})) a) b"""
RELATIONS["url_shift_day"] = URL_SHIFT_SQL


@query("url_semantic_gap", "A07",
       f"{HEAD} app_platform app_version sdk_version surface_path web_events:i wc_events:i under_count:i over_count:i under_rate:d over_rate:d distribution_shift_score:d url_collapse_flag:i shifted_direction",
       "SELECT * FROM url_shift_day")
def url_semantic_gap(i):
    web, wc = sides(i)
    collapsed = wc.withColumn("surface_path", F.when(F.col("value") > 200, "/order/pizza").otherwise(F.col("surface_path")))
    return G.url_semantic_gap(web, collapsed)


KPI_SQL = f"""SELECT *, conversion_gap_rate AS purchase_event_gap_rate, conversion_gap_rate * 0.8 AS revenue_proxy_gap_rate,
  least(1, 0.65 * conversion_gap_rate + 0.35 * traffic_preservation_score) AS business_kpi_distortion_score FROM (
  SELECT *, CASE WHEN pv_gap_rate <= 0.02 THEN 1 WHEN pv_gap_rate <= 0.12 THEN 1 - pv_gap_rate / 0.12 * 0.55 ELSE 0 END AS traffic_preservation_score FROM (
  SELECT {SCOPE}, {", ".join(f"{rate(m)} AS {m}_gap_rate" for m in ("pv", "uv", "visit", "conversion"))} FROM ({both('')}) g) a) b"""
RELATIONS["kpi_gap_day"] = KPI_SQL


@query("business_kpi_gap", "A08",
       f"{HEAD} pv_gap_rate:d uv_gap_rate:d visit_gap_rate:d conversion_gap_rate:d purchase_event_gap_rate:d revenue_proxy_gap_rate:d traffic_preservation_score:d business_kpi_distortion_score:d",
       "SELECT * FROM kpi_gap_day")
def business_kpi_gap(i):
    return G.business_kpi_gap(*sides(i))


STAGE_SQL = """SELECT profile_id, dt, scenario_name, count(*) AS hits, count(DISTINCT {visitor}) AS uv, count(*) FILTER (funnel_stage = 'checkout') AS checkout,
  count(*) FILTER (funnel_stage = 'product') AS product, 0 AS payment, count(*) FILTER (funnel_stage = 'browse') AS browse,
  count(*) FILTER (funnel_stage = 'search') AS search, 0 AS other FROM {side}_hits GROUP BY ALL"""
STAGES = ("checkout", "product", "payment", "browse", "search", "other")
OBS_SQL = f"""SELECT {SCOPE}, web_hits, wc_hits, canonical_behavior_events, greatest(0, web_hits - wc_hits) AS collection_gap_count, {rate('hits')} AS collection_gap_rate,
  greatest(0, web_hits - canonical_behavior_events) AS canonical_gap_count, greatest(0, web_hits - canonical_behavior_events) / web_hits AS canonical_gap_rate,
  web_uv AS web_uv_ip, wc_uv AS wc_uv_pcid, {rate('uv')} AS uv_gap_rate, {rate('checkout')} AS checkout_missing_rate, {rate('product')} AS product_missing_rate,
  {rate('payment')} AS payment_missing_rate, CASE WHEN top.g <= 0 THEN 'none' ELSE top.s END AS top_missing_stage,
  CASE WHEN web_hits > wc_hits THEN 'wc_collector_collection_gap' ELSE 'none' END AS suspected_root_cause FROM (
  SELECT *, list_reduce([{", ".join(f"{{'g': greatest(0, web_{s} - wc_{s}), 's': '{s}'}}" for s in STAGES)}], lambda a, b: CASE WHEN b.g > a.g THEN b ELSE a END) AS top FROM (
  SELECT {SCOPE}, {", ".join(f"w.{s} AS web_{s}, coalesce(c.{s}, 0) AS wc_{s}" for s in ("hits", "uv", *STAGES))}, coalesce(k.n, 0) AS canonical_behavior_events
  FROM ({STAGE_SQL.format(visitor='ip', side='source')}) w LEFT JOIN ({STAGE_SQL.format(visitor='pcid', side='collected')}) c USING ({SCOPE})
  LEFT JOIN (SELECT {SCOPE}, count(*) AS n FROM collected_hits WHERE value >= 8 GROUP BY ALL) k USING ({SCOPE})) a) b"""
RELATIONS["observability_day"] = OBS_SQL
OBS_COLS = f"{HEAD} web_hits:i wc_hits:i canonical_behavior_events:i collection_gap_count:i collection_gap_rate:d canonical_gap_count:i canonical_gap_rate:d web_uv_ip:i wc_uv_pcid:i uv_gap_rate:d checkout_missing_rate:d product_missing_rate:d payment_missing_rate:d top_missing_stage suspected_root_cause"


@query("observability_measurement", "A09", OBS_COLS, "SELECT * FROM observability_day")
def observability_measurement(i):
    canonical = i.collected_hits.where("value >= 8")
    return G.observability_measurement(i.source_hits, i.collected_hits, canonical)


SIGNAL_SIDE = """SELECT profile_id, dt, scenario_name, count(*) AS hits, count(DISTINCT {visitor}) AS uv, count(*) FILTER (path LIKE '%order%') AS checkout,
  count(*) FILTER (path LIKE '%product%') AS product FROM {side}_hits WHERE path NOT LIKE '%.css' AND (evt = 'view' OR page_type <> '') GROUP BY ALL"""


@query("observability_signal", "A10",
       f"{HEAD} web_hits:i wc_hits:i collection_gap_count:i hits_gap_rate:d uv_gap_rate:d checkout_gap_rate:d product_gap_rate:d observability_signal_score:d observability_risk_level dominant_observability_signal",
       f"""SELECT *, CASE WHEN s >= 0.2 THEN 'high' WHEN s >= 0.1 THEN 'warning' WHEN s > 0 THEN 'review' ELSE 'low' END AS observability_risk_level, s AS observability_signal_score,
  CASE WHEN s > 0 THEN 'WC Collection Completeness Risk' ELSE 'None' END AS dominant_observability_signal FROM (
  SELECT *, greatest(hits_gap_rate, uv_gap_rate, checkout_gap_rate, product_gap_rate) AS s FROM (
  SELECT {SCOPE}, web_hits, wc_hits, greatest(0, web_hits - wc_hits) AS collection_gap_count,
    {", ".join(f"round({rate(m)}, 6) AS {m}_gap_rate" for m in ("hits", "uv", "checkout", "product"))} FROM (
  SELECT {SCOPE}, {", ".join(f"w.{m} AS web_{m}, coalesce(c.{m}, 0) AS wc_{m}" for m in ("hits", "uv", "checkout", "product"))}
  FROM ({SIGNAL_SIDE.format(visitor='ip', side='source')}) w LEFT JOIN ({SIGNAL_SIDE.format(visitor='pcid', side='collected')}) c USING ({SCOPE})) a) b) d""")
def observability_signal(i):
    return G.observability_signal(i.source_hits, i.collected_hits)


def concentration_sql(dims: str) -> str:
    return f"""SELECT {SCOPE}, max(tm) AS total_missing, least(1, greatest(0, greatest(max(missing_count / nullif(tm, 0) - web_event_count / nullif(tw, 0)) * 1.6, max(missing_rate) * 0.75))) AS concentration
FROM (SELECT *, sum(missing_count) OVER w AS tm, sum(web_event_count) OVER w AS tw FROM ({gap_sql(dims)}) g WINDOW w AS (PARTITION BY {SCOPE})) x GROUP BY {SCOPE}"""


RELATIONS["app_concentration_day"] = concentration_sql("app_platform, app_version, sdk_version")


@query("segment_concentration", "A36", f"{HEAD} total_missing:i concentration:d", "SELECT * FROM app_concentration_day")
def segment_concentration(i):
    return G.segment_concentration(G.gap_by_app(*sides(i)))


TOP_SEGMENTS = f"""SELECT * FROM (SELECT g.*, c.concentration, row_number() OVER (PARTITION BY {SCOPE} ORDER BY missing_count DESC, missing_rate DESC, app_platform, app_version, sdk_version) AS gap_rank
  FROM ({gap_sql('app_platform, app_version, sdk_version')}) g JOIN app_concentration_day c USING ({SCOPE})) x WHERE gap_rank <= 100"""


@query("top_gap_segments", "A04 A36 T02",
       f"{HEAD} gap_rank:i app_platform app_version sdk_version web_event_count:i wc_event_count:i missing_count:i missing_rate:d concentration:d", TOP_SEGMENTS)
def top_gap_segments(i):
    rows = G.gap_by_app(*sides(i))
    found = rows.join(G.segment_concentration(rows), list(G.SCOPE))
    return G.top_gap_urls(found, 100, tie=G.APP)


@query("top_gap_urls", "T02", f"{HEAD} gap_rank:i app_platform app_version sdk_version surface_path missing_count:i missing_rate:d",
       f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {SCOPE} ORDER BY missing_count DESC, missing_rate DESC, app_platform, app_version, sdk_version, surface_path) AS gap_rank
  FROM ({gap_sql('app_platform, app_version, sdk_version, surface_path')}) g) x WHERE gap_rank <= 100""")
def top_gap_urls(i):
    return G.top_gap_urls(G.gap_by_url(*sides(i)), 100, tie=G.URL)
