"""Projections and scalar functions over whole hit, page and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N, text as X
from .registry import query

KV_PAIRS = "list_filter(list_transform(string_split(kv_raw, ';'), lambda p: trim(p)), lambda p: contains(p, '='))"
LAST = "list_last(list_filter({pairs}, lambda p: trim(split_part(p, '=', 1)) = '{key}'))"


def last_value(key):
    return f"trim(substr({LAST.format(pairs='pairs', key=key)}, instr({LAST.format(pairs='pairs', key=key)}, '=') + 1))"


@query(
    "parse_kv", "P01", "hit_id:i uid pcid note drop_probability n_keys:i",
    f"""SELECT hit_id, {last_value('uid')} AS uid, {last_value('pcid')} AS pcid, CAST(NULL AS VARCHAR) AS note,
  {last_value('drop_probability')} AS drop_probability,
  len(list_distinct(list_transform(pairs, lambda p: trim(split_part(p, '=', 1))))) AS n_keys
FROM (SELECT hit_id, {KV_PAIRS} AS pairs FROM tails) x""",
)
def parse_kv(i):
    pick = lambda k: F.try_element_at("kv", F.lit(k)).alias(k)
    parsed = i.tails.select("hit_id", X.parse_kv("kv_raw").alias("kv"))
    return parsed.select("hit_id", *map(pick, ("uid", "pcid", "note", "drop_probability")), F.size("kv").alias("n_keys"))


@query(
    "parse_kv_lower", "P02", "hit_id:i evt sid app_platform",
    r"""SELECT hit_id, regexp_extract(kv_raw, '(?:^|;\s*)evt=([^;]*)', 1) AS evt,
  regexp_extract(kv_raw, '(?:^|;\s*)sid=([^;]*)', 1) AS sid,
  regexp_extract(kv_raw, '(?:^|;\s*)app_platform=([^;]*)', 1) AS app_platform FROM tails""",
)
def parse_kv_lower(i):
    up = i.tails.withColumn("kv_raw", F.regexp_replace("kv_raw", "evt=", "EVT="))
    parsed = up.select("hit_id", X.parse_kv_lower("kv_raw").alias("kv"))
    return parsed.select("hit_id", *[F.try_element_at("kv", F.lit(k)).alias(k) for k in ("evt", "sid", "app_platform")])


@query(
    "extract_kv", "P03", "hit_id:i uid page_type al bare_uid bare_ref q",
    r"""SELECT hit_id, 'again' AS uid, nullif(page_type, '') AS page_type, 'ko,en' AS al,
  uid AS bare_uid, CASE WHEN contains(url_raw, '?') THEN 'x%20y' END AS bare_ref,
  CASE WHEN contains(url_raw, '?') THEN '2' END AS q FROM tails""",
)
def extract_kv(i):
    tail = F.concat(F.lit("t|"), F.substring_index("url_raw", "?", -1))
    return i.tails.select(
        "hit_id",
        X.extract_kv("kv_raw", "uid").alias("uid"),
        X.extract_kv("kv_raw", "page_type").alias("page_type"),
        X.extract_kv("kv_raw", "al").alias("al"),
        X.extract_kv("kv_raw", "uid", bare=True).alias("bare_uid"),
        X.extract_kv(tail, "ref", bare=True).alias("bare_ref"),
        X.extract_kv(tail, "q").alias("q"),
    )


@query(
    "split_path_query", "P04", "page_id:i path query",
    """SELECT page_id, split_part(url, '?', 1) AS path,
  CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?') + 1) END AS query FROM pages""",
)
def split_path_query(i):
    p, q = X.split_path_query("url")
    return i.pages.select("page_id", p.alias("path"), q.alias("query"))


@query(
    "path_only", "P05", "page_id:i path",
    r"""SELECT page_id, CASE WHEN contains(rest, '/') THEN split_part(rest, '?', 1) ELSE '/' END AS path
FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS rest FROM pages) x""",
)
def path_only(i):
    return i.pages.select("page_id", X.path_only("url").alias("path"))


@query(
    "query_params", "P06", "hit_id:i q ref flag n:i",
    """SELECT hit_id, CASE WHEN has THEN CAST(hit_id AS VARCHAR) END AS q, CASE WHEN has THEN 'x y' END AS ref,
  CASE WHEN has THEN '' END AS flag, CASE WHEN has THEN 3 ELSE 0 END AS n
FROM (SELECT hit_id, contains(url_raw, '?') AS has FROM tails) x""",
)
def query_params(i):
    m = i.tails.select("hit_id", X.query_params("url_raw").alias("m"))
    return m.select("hit_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("q", "ref", "flag")], F.size("m").alias("n"))


@query(
    "resolve_url", "P07", "hit_id:i url_full url_norm host path query",
    """SELECT hit_id, concat('https://www.example.com/', ltrim(url_raw, '/')) AS url_full,
  concat('https://www.example.com', split_part(url_raw, '?', 1)) AS url_norm, 'www.example.com' AS host,
  split_part(url_raw, '?', 1) AS path, CASE WHEN contains(url_raw, '?') THEN split_part(url_raw, '?', 2) ELSE '' END AS query
FROM tails""",
)
def resolve_url(i):
    cols = X.resolve_url("https://www.example.com/", "url_raw")
    return i.tails.select("hit_id", *[c.alias(n) for n, c in cols.items()])


@query(
    "ref_host", "P08", "page_id:i host dash",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CAST(NULL AS VARCHAR) AS dash FROM pages""",
)
def ref_host(i):
    return i.pages.select("page_id", X.ref_host("url").alias("host"), X.ref_host(F.lit("-")).alias("dash"))


@query(
    "apache_ts", "P09", "hit_id:i seen:ts dt:date",
    "SELECT hit_id, date_trunc('second', ts) AS seen, CAST(ts AS DATE) AS dt FROM tails",
)
def apache_ts(i):
    text = F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0900"))
    seen = X.apache_ts(text)
    return i.tails.select("hit_id", seen.alias("seen"), seen.cast("date").alias("dt"))


@query(
    "browser_family", "P10", "hit_id:i browser",
    """SELECT hit_id, CASE WHEN contains(lower(ua), 'edg/') THEN 'Edge' WHEN contains(lower(ua), 'chrome/') THEN 'Chrome'
  WHEN contains(lower(ua), 'safari/') THEN 'Safari' WHEN contains(lower(ua), 'firefox/') THEN 'Firefox'
  WHEN ua = '' THEN 'unknown' ELSE 'Other' END AS browser FROM source_hits""",
)
def browser_family(i):
    return i.source_hits.select("hit_id", X.browser_family("ua").alias("browser"))


@query(
    "os_family", "P11", "hit_id:i os",
    """SELECT hit_id, CASE WHEN app_platform = 'ios_app' OR contains(ua, 'iPhone') THEN 'iOS'
  WHEN app_platform = 'android_app' OR contains(ua, 'Android') THEN 'Android' WHEN contains(ua, 'Windows') THEN 'Windows'
  WHEN contains(ua, 'Macintosh') THEN 'macOS' ELSE 'unknown' END AS os FROM source_hits""",
)
def os_family(i):
    return i.source_hits.select("hit_id", X.os_family("ua", "app_platform").alias("os"))


@query(
    "device_type", "P12", "hit_id:i device log_device",
    """SELECT hit_id, CASE WHEN device_type <> '' THEN device_type WHEN ua = '' THEN NULL WHEN contains(ua, 'Tablet') THEN 'tablet'
  WHEN contains(ua, 'iPhone') OR contains(ua, 'Android') THEN 'mobile' ELSE 'desktop' END AS device,
  CASE WHEN contains(ua, 'iPhone') OR contains(ua, 'Android') THEN 'mobile' WHEN contains(ua, 'Tablet') THEN 'tablet'
  ELSE 'desktop' END AS log_device FROM source_hits""",
)
def device_type(i):
    return i.source_hits.select(
        "hit_id", X.device_type("ua", "device_type").alias("device"), X.device_type("ua", tablet_first=False).alias("log_device")
    )


@query(
    "infer_attributes", "P13 P14 P15 P16 P17", "hit_id:i domain kind page stage conversion:i",
    """SELECT hit_id, CASE WHEN event_type = 'signup' THEN 'auth' ELSE 'web' END AS domain, 'view' AS kind,
  CASE WHEN event_type = 'signup' THEN 'login' ELSE 'page' END AS page,
  CASE WHEN event_type = 'view' THEN 'product' ELSE 'browse' END AS stage,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS conversion FROM source_hits""",
)
def infer_attributes(i):
    return i.source_hits.select(
        "hit_id",
        X.service_domain("path").alias("domain"),
        X.event_type("path").alias("kind"),
        X.page_type("path").alias("page"),
        X.funnel_stage("path").alias("stage"),
        X.is_conversion("path").alias("conversion"),
    )


@query(
    "infer_attributes_hinted", "P13 P14 P15 P16 P17", "hit_id:i domain kind page stage conversion:i",
    """SELECT hit_id, service_domain AS domain, event_type AS kind,
  CASE WHEN page_type <> '' THEN page_type WHEN event_type = 'signup' THEN 'login' ELSE 'page' END AS page,
  funnel_stage AS stage, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS conversion FROM source_hits""",
)
def infer_attributes_hinted(i):
    return i.source_hits.select(
        "hit_id",
        X.service_domain("path", "service_domain").alias("domain"),
        X.event_type("path", "evt", "event_type").alias("kind"),
        X.page_type("path", "page_type").alias("page"),
        X.funnel_stage("path", "page_type", "funnel_stage").alias("stage"),
        X.is_conversion("path", "evt", "event_type").alias("conversion"),
    )


def hit_row(*names):
    return {n: F.col(n) for n in names}


@query(
    "semantic_event_name", "P18", "hit_id:i name stream_name",
    """SELECT hit_id, CASE event_type WHEN 'purchase' THEN 'other' WHEN 'signup' THEN
    CASE WHEN value < 40 THEN 'auth_success' ELSE 'auth_fail' END WHEN 'error' THEN 'other' WHEN 'click' THEN 'other'
    ELSE 'page_view' END AS name,
  CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'signup'
    ELSE 'page_view' END AS stream_name FROM source_hits""",
)
def semantic_event_name(i):
    hits = i.tails.select("hit_id", "event_type", "kv_raw", "path", "method", "status", "evt")
    named = X.with_event_name(hits, "name").select("hit_id", "event_type", "path", "evt", "name")
    return X.with_event_name(named, "stream_name", mode="stream")


@query("is_static", "P19", "path static:i n:i",
       "SELECT path, CASE WHEN path LIKE '%.css' THEN 1 ELSE 0 END AS static, count(*) AS n FROM source_hits GROUP BY ALL")
def is_static(i):
    return i.source_hits.groupBy("path", X.is_static("path").cast("int").alias("static")).agg(F.count("*").alias("n"))


@query(
    "is_pageview", "P20", "hit_id:i view_only:i all_hits:i",
    """SELECT hit_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS view_only,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS all_hits FROM source_hits""",
)
def is_pageview(i):
    row = hit_row("method", "status", "path", "evt", "event_type")
    return i.source_hits.select(
        "hit_id", X.is_pageview(row).cast("int").alias("view_only"), X.is_pageview(row, "all_hits").cast("int").alias("all_hits")
    )


@query(
    "identity_key", "P21", "hit_id:i best cookie address",
    """SELECT hit_id, coalesce('UID:' || uid, 'PCID:' || pcid) AS best, 'PCID:' || pcid AS cookie, 'IP:' || ip AS address
FROM source_hits""",
)
def identity_key(i):
    row = hit_row("uid", "pcid", "ip")
    return i.source_hits.select(
        "hit_id", X.identity_key(row).alias("best"), X.identity_key(row, "pcid_ip").alias("cookie"), X.identity_key(row, "ip").alias("address")
    )


@query(
    "contract_cast", "P22", "hit_id:i drop_probability:d affected:i latency:i missing:i",
    """SELECT hit_id, 0.25 AS drop_probability, 3 AS affected, latency_ms AS latency, CAST(NULL AS BIGINT) AS missing FROM tails""",
)
def contract_cast(i):
    get = lambda k: F.try_element_at("kv", F.lit(k))
    return i.tails.select("hit_id", X.parse_kv("kv_raw").alias("kv")).select(
        "hit_id",
        X.contract_cast("drop_probability", get("drop_probability")).alias("drop_probability"),
        X.contract_cast("affected", get("affected")).alias("affected"),
        X.contract_cast("latency_shift_ms", get("latency_ms")).alias("latency"),
        X.contract_cast("bot_flag", F.lit("-")).alias("missing"),
    )


@query("norm_blank", "P23", "page short n:i",
       """SELECT CASE WHEN page_type = '' THEN 'unknown' ELSE page_type END AS page, substr(path, 1, 8) AS short, count(*) AS n
FROM source_hits GROUP BY ALL""")
def norm_blank(i):
    return i.source_hits.groupBy(X.norm_blank("page_type").alias("page"), X.norm_blank("path", 8).alias("short")).agg(F.count("*").alias("n"))


@query("coalesce_first_nonblank", "P24", "hit_id:i who number:d",
       "SELECT hit_id, coalesce(uid, pcid) AS who, CASE WHEN status = 200 THEN 200 ELSE 503 END AS number FROM source_hits")
def coalesce_first_nonblank(i):
    return i.source_hits.select("hit_id", N.first_nonblank("uid", "pcid").alias("who"), N.pick_number("ua", "status").alias("number"))


@query(
    "guarded_ratios", "P25",
    "event_id:i share:d zero:d drop_share:d moved:d up:d down:d lost:d",
    """SELECT event_id, least(1, value / 100) AS share, 0 AS zero, greatest(0, least(1, (50 - value) / 50)) AS drop_share,
  abs(value - 50) / 50 AS moved, greatest(0, (value - 50) / 50) AS up, greatest(0, (50 - value) / 50) AS down,
  greatest(0, (50 - value) / 50) AS lost FROM events""",
)
def guarded_ratios(i):
    return i.events.select(
        "event_id",
        N.safe_div("value", 100).alias("share"),
        N.safe_div("value", 0).alias("zero"),
        N.ratio_drop(50, "value").alias("drop_share"),
        N.abs_delta_ratio("value", 50).alias("moved"),
        N.positive_delta_ratio("value", 50).alias("up"),
        N.negative_delta_ratio("value", 50).alias("down"),
        N.availability_drop("value", 50).alias("lost"),
    )


@query(
    "level_band", "P26", "event_id:i reliability status severity evidence confidence propagation grade",
    """SELECT event_id, CASE WHEN s >= 0.75 THEN 'critical' WHEN s >= 0.55 THEN 'high' WHEN s >= 0.30 THEN 'warning' WHEN s >= 0.08 THEN 'low' ELSE 'stable' END AS reliability,
  CASE WHEN s >= 0.6 THEN 'FAIL' WHEN s >= 0.2 THEN 'WARN' ELSE 'PASS' END AS status,
  CASE WHEN s >= 0.30 THEN 'critical' WHEN s >= 0.15 THEN 'high' WHEN s >= 0.05 THEN 'warning' ELSE 'low' END AS severity,
  CASE WHEN s >= 0.75 THEN 'critical' WHEN s >= 0.5 THEN 'high' WHEN s >= 0.25 THEN 'warning' ELSE 'low' END AS evidence,
  CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.55 THEN 'medium' WHEN s >= 0.3 THEN 'low' ELSE 'weak' END AS confidence,
  CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' WHEN s > 0 THEN 'low' ELSE 'none' END AS propagation,
  CASE WHEN value < 20 THEN 'stable' WHEN value < 40 THEN 'watch' WHEN value < 70 THEN 'degraded' ELSE 'critical' END AS grade
FROM (SELECT event_id, value, value / 128 AS s FROM events) x""",
)
def level_band(i):
    s = F.col("value") / 128
    return i.events.select(
        "event_id",
        N.level_band(s).alias("reliability"),
        N.level_band(s, "status").alias("status"),
        N.level_band(s, "gap_severity").alias("severity"),
        N.level_band(s, "evidence").alias("evidence"),
        N.level_band(s, "confidence").alias("confidence"),
        N.level_band(s, "propagation").alias("propagation"),
        N.level_band("value", "grade").alias("grade"),
    )


@query("minute_and_hour", "P27", "hit_id:i minute:ts hh:i label",
       "SELECT hit_id, date_trunc('minute', ts) AS minute, hour(ts) AS hh, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS label FROM source_hits")
def minute_and_hour(i):
    return i.source_hits.select("hit_id", X.minute_bucket("ts").alias("minute"), F.hour("ts").alias("hh"), X.hour_label("ts").alias("label"))


@query("state_entity", "P28", "state_event entity n:i",
       "SELECT state_event, split_part(state_event, '_', 1) AS entity, count(*) AS n FROM state_events GROUP BY ALL")
def state_entity(i):
    return i.state_events.groupBy("state_event", X.state_entity("state_event").alias("entity")).agg(F.count("*").alias("n"))


@query(
    "joined_and_hashed_keys", "P29", "tx_id:i dup_key hashed",
    """SELECT tx_id, k AS dup_key, md5(k) AS hashed FROM (SELECT tx_id, concat(CAST(journey_id AS VARCHAR), '|', CAST(order_id AS VARCHAR), '|',
  coalesce(CAST(payment_id AS VARCHAR), ''), '|', transaction_event) AS k FROM transaction_events) x""",
)
def joined_and_hashed_keys(i):
    ids = ("journey_id", "order_id", "payment_id", "transaction_event")
    return i.transaction_events.select("tx_id", X.joined_key(*ids).alias("dup_key"), X.hashed_key(*ids).alias("hashed"))


@query("json_payload", "P30", "hit_id:i payload path k",
       """SELECT hit_id, concat('{"path":"', path, '","status":', CAST(status AS VARCHAR), '}') AS payload, path,
  CAST(status AS VARCHAR) AS k FROM source_hits""")
def json_payload(i):
    p = X.json_payload("path", "status")
    return i.source_hits.select("hit_id", p.alias("payload"), X.json_get(p, "$.path").alias("path"), X.json_get(p, "$.status").alias("k"))


@query("truncate_text", "P31", "doc_id:i cut n:i",
       """SELECT doc_id, CASE WHEN length(text) > 900 THEN substr(text, 1, 885) || '... [truncated]' ELSE text END AS cut,
  length(CASE WHEN length(text) > 900 THEN substr(text, 1, 885) || '... [truncated]' ELSE text END) AS n FROM documents""")
def truncate_text(i):
    cut = X.truncate_text("text", 900)
    return i.documents.select("doc_id", cut.alias("cut"), F.length(cut).alias("n"))


@query(
    "mapping_suggestion", "P32",
    "path suggested_pattern suggested_event_name suggested_event_type suggested_funnel_stage suggested_funnel_order:i n:i",
    """SELECT path, CASE WHEN path LIKE '/auth/%' THEN '/auth/' ELSE path END AS suggested_pattern,
  CASE WHEN path LIKE '/auth/%' THEN 'auth' ELSE replace(trim(path, '/'), '/', '_') END AS suggested_event_name,
  CASE WHEN path LIKE '/auth/%' THEN 'action' ELSE 'page' END AS suggested_event_type,
  CASE WHEN path LIKE '/auth/%' THEN 'auth' ELSE 'view' END AS suggested_funnel_stage,
  CASE WHEN path LIKE '/auth/%' THEN 2 ELSE 1 END AS suggested_funnel_order, count(*) AS n FROM source_hits GROUP BY ALL""",
)
def mapping_suggestion(i):
    cols = X.mapping_suggestion("path")
    paths = i.source_hits.groupBy("path").agg(F.count("*").alias("n"))
    return paths.select("path", "n", *[c.alias(n) for n, c in cols.items()])


WORDS = {"short": ["the ", "and "], "french": ["eau", "tion"], "mark": ["%%%", "@"], "none": ["zzqq"]}


@query(
    "keyword_hits", "P33", "doc_id:i labels",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(t, 'the ') OR contains(t, 'and ') THEN 'short' END,
  CASE WHEN contains(t, 'eau') OR contains(t, 'tion') THEN 'french' END, CASE WHEN contains(t, '%%%') OR contains(t, '@') THEN 'mark' END],
  lambda x: x IS NOT NULL), ',') AS labels FROM (SELECT doc_id, lower(text) AS t FROM documents) x""",
)
def keyword_hits(i):
    texts = i.documents.select("doc_id", F.lower("text").alias("t"))
    return texts.select("doc_id", F.array_join(X.keyword_hits("t", WORDS, lowered=True), ",").alias("labels"))


@query("page_event_filter", "P34", "event_type page_hits:i view_hits:i",
       """SELECT event_type, count(*) FILTER (path NOT LIKE '%.css' AND (evt = 'view' OR page_type <> '')) AS page_hits,
  count(*) FILTER (evt = 'view') AS view_hits FROM source_hits GROUP BY event_type""")
def page_event_filter(i):
    return i.source_hits.groupBy("event_type").agg(
        F.count_if(X.page_event_filter("path", "evt", "page_type")).alias("page_hits"),
        F.count_if(X.page_event_filter("path", "evt", "page_type", "evt_only")).alias("view_hits"),
    )


@query("token_match", "P35", "app_platform any_hit:i listed:i",
       """SELECT app_platform, count(*) AS any_hit, count(*) FILTER (app_platform IN ('ios_app', 'android_app')) AS listed
FROM source_hits GROUP BY app_platform""")
def token_match(i):
    return i.source_hits.groupBy("app_platform").agg(
        F.count_if(X.token_match("app_platform", "*")).alias("any_hit"),
        F.count_if(X.token_match("app_platform", "IOS_app, android_app")).alias("listed"),
    )


@query("rewrite_url", "P36", "hit_id:i replaced collapsed",
       """SELECT hit_id, CASE WHEN contains(path, '/product/') THEN replace(path, '/product/', '/order/pizza/') ELSE '/order/pizza/' END AS replaced,
  '/order/pizza' AS collapsed FROM source_hits""")
def rewrite_url(i):
    return i.source_hits.select(
        "hit_id", X.rewrite_url("path", "/product/", "/order/pizza/").alias("replaced"), X.rewrite_url("path", "*", "/order/pizza").alias("collapsed")
    )


@query("null_identity", "P37", "hit_id:i uid kv_raw",
       r"""SELECT hit_id, CAST(NULL AS VARCHAR) AS uid, regexp_replace(regexp_replace(kv_raw, '(^|[;&\s])uid=[^;&\s]*', '\1uid=', 'g'),
  '(^|[;&\s])login_id=[^;&\s]*', '\1login_id=', 'g') AS kv_raw FROM tails""")
def null_identity(i):
    return i.tails.select("hit_id", *X.null_identity("uid", "kv_raw"))


@query("contract_note", "P38", "status level note n:i",
       """SELECT status, level, CASE WHEN status = 'OK' THEN 'PASS' WHEN level = 'review' THEN 'PASS_WITH_REVIEW' ELSE 'CHECK' END AS note,
  count(*) AS n FROM (SELECT CASE WHEN status = 200 THEN 'OK' ELSE 'FAIL' END AS status,
  CASE WHEN value < 50 THEN 'review' ELSE 'blocked' END AS level FROM source_hits) x GROUP BY ALL""")
def contract_note(i):
    got = i.source_hits.select(
        F.when(F.col("status") == 200, "OK").otherwise("FAIL").alias("status"),
        F.when(F.col("value") < 50, "review").otherwise("blocked").alias("level"),
    )
    return got.groupBy("status", "level", X.contract_note("status", "level").alias("note")).agg(F.count("*").alias("n"))


@query("signal_family", "E23", "path event_type family layer n:i",
       """SELECT path, event_type, CASE event_type WHEN 'error' THEN 'latency_performance' WHEN 'signup' THEN 'identity_mapping' WHEN 'click' THEN 'completeness' ELSE 'unknown' END AS family,
  CASE event_type WHEN 'error' THEN 'stream' WHEN 'signup' THEN 'batch' WHEN 'click' THEN 'batch' ELSE '' END AS layer, count(*) AS n
FROM source_hits GROUP BY ALL""")
def signal_family(i):
    signal = (
        F.when(F.col("event_type") == "error", "Replay_LAG").when(F.col("event_type") == "signup", "uid loss")
        .when(F.col("event_type") == "click", "rows missing").otherwise("calm")
    )
    family = X.signal_family(signal)
    return i.source_hits.groupBy("path", "event_type", family.alias("family"), X.family_layer(family).alias("layer")).agg(F.count("*").alias("n"))
