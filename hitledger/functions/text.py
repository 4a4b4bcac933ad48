"""Scalar functions over hits: cookie tails, URLs, agents and inferred attributes.

All are native column expressions, so they stay in whole-stage codegen. Blank
and null are treated alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .numbers import col, first_nonblank

# Fixed values the inputs are written in.
STATIC_PATTERN = r"(?i)\.(css|js|png|jpg|jpeg|gif|ico|map|woff|woff2|ttf|eot|svg|webp|zip|txt)$"
KEYS_WITH_COMMAS = ("al", "accept_lang")
SECTIONS = ("loan", "card", "deposit", "transfer", "auth", "account", "customer", "branch")
PRODUCT_SECTIONS = ("loan", "card", "deposit", "transfer")
MAPPED_SECTIONS = ("account", "auth", "branch", "card", "customer", "deposit", "loan", "transfer")
GENERIC_EVENT_NAMES = ("", "view", "click", "conversion", "submit", "success", "browse", "page", "other")
REAL_KEYS = (
    "volume_multiplier", "conversion_multiplier", "drop_probability", "timeout_multiplier",
    "retry_multiplier", "duplicate_multiplier",
)
WHOLE_KEYS = (
    "affected", "latency_shift_ms", "event_time_skew_ms", "suppress_input", "bot_flag",
    "backlog_flush", "transaction_delay_ms", "event_ingestion_delay_ms", "pii_detected",
    "amount_expected", "amount_actual", "amount_delta", "balance_delta",
)


def lower0(x) -> Column:
    return F.lower(F.coalesce(col(x).cast("string"), F.lit("")))


def has(text: Column, *words: str) -> Column:
    """Whether any of the words occurs in the text."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def blank(x) -> Column:
    return F.nullif(F.trim(col(x).cast("string")), F.lit(""))


# --- cookie tail -----------------------------------------------------------


def _pairs(kv: Column) -> Column:
    return F.filter(F.transform(F.split(kv, ";"), lambda p: F.trim(p)), lambda p: p.contains("="))


def parse_kv(kv) -> Column:
    """``k=v;k=v`` to a map; the last of repeated keys wins."""
    pairs = _pairs(F.coalesce(col(kv), F.lit("")))
    return F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(
                F.trim(F.substring_index(p, "=", 1)).alias("key"),
                F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("value"),
            ),
        )
    )


def parse_kv_lower(kv) -> Column:
    """Map with lower-cased keys; only keys of letters, digits, ``_`` and ``-`` count."""
    parts = F.transform(F.split(F.coalesce(col(kv), F.lit("")), ";"), lambda p: F.trim(p))
    pairs = F.filter(parts, lambda p: p.rlike(r"^[A-Za-z0-9_\-]+="))
    return F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(
                F.lower(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("value")
            ),
        )
    )


def kv_value(kv_map: Column, key: str) -> Column:
    return F.nullif(F.try_element_at(kv_map, F.lit(key)), F.lit(""))


def extract_kv(kv, key: str, bare: bool = False) -> Column:
    """Value of one key, trying one delimiter after the other.

    ``bare`` is the log variant: other delimiter order, commas always tried,
    and a last scan for ``key=`` anywhere.
    """
    text = col(kv)
    if bare:
        order = ["&", ";", "|", ","]
    else:
        order = [";", "&", "|"] + ([] if key in KEYS_WITH_COMMAS else [","])
    tries: list[tuple[Column, Column]] = []
    if not bare:
        kvs = parse_kv(text)
        tries.append((F.map_contains_key(kvs, key), F.try_element_at(kvs, F.lit(key))))
    for d in order:
        parts = F.filter(
            F.transform(F.split(text, r"\Q" + d + r"\E"), lambda p: F.trim(p)), lambda p: p.startswith(f"{key}=")
        )
        tries.append((text.contains(d) & (F.size(parts) > 0), F.trim(F.substr(F.get(parts, F.lit(0)), F.lit(len(key) + 2)))))
    if bare:
        pattern = f"{key}=([^ \\t\\n&;|,]*)"
        tries.append((text.contains(f"{key}="), F.trim(F.regexp_extract(text, pattern, 1))))
    out = None
    for cond, value in tries:
        value = F.nullif(value, F.lit(""))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def contract_cast(key: str, value) -> Column:
    """Typed cookie value: multipliers as double, other numeric keys as whole numbers."""
    v = F.nullif(F.nullif(col(value), F.lit("")), F.lit("-"))
    if key in REAL_KEYS:
        return v.try_cast("double")
    if key in WHOLE_KEYS:
        return v.try_cast("double").try_cast("bigint")
    return col(value)


def null_identity(uid, kv) -> tuple[Column, Column]:
    """Drop the login identity and blank it in the cookie tail."""
    tail = col(kv)
    for key in ("uid", "login_id"):
        tail = F.regexp_replace(tail, rf"(^|[;&\s]){key}=[^;&\s]*", f"$1{key}=")
    return F.lit(None).cast("string").alias("uid"), tail.alias("kv_raw")


# --- URLs ------------------------------------------------------------------


def split_path_query(url) -> tuple[Column, Column]:
    u = F.nullif(col(url), F.lit(""))
    cut = F.instr(u, "?")
    return F.substring_index(u, "?", 1), F.when(cut > 0, F.substr(u, cut + 1))


def path_only(url) -> Column:
    """Path of an absolute or relative URL, without its query."""
    u = col(url)
    rest = F.regexp_replace(u, r"^https?://[^/]*", "")
    absolute = F.when(rest.contains("/"), F.substring_index(rest, "?", 1)).otherwise("/")
    return F.when(u.rlike(r"^https?://"), absolute).otherwise(F.substring_index(u, "?", 1))


def url_host(url) -> Column:
    return F.nullif(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def resolve_url(base: str, raw) -> dict[str, Column]:
    """Full and normalized form of a URL, joined to ``base`` when relative."""
    r = col(raw)
    root = F.lit(base.rstrip("/") + "/")
    full = F.when(r.rlike("^https?://"), r).otherwise(F.concat(root, F.ltrim(r, F.lit("/"))))
    shape = r"^([a-z]+)://([^/?#]*)([^?#]*)\??([^#]*)"
    part = lambda i: F.regexp_extract(full, shape, i)
    return {
        "url_full": full,
        "url_norm": F.concat(part(1), F.lit("://"), part(2), part(3)),
        "host": part(2),
        "path": part(3),
        "query": part(4),
    }


def ref_host(ref) -> Column:
    r = F.nullif(blank(ref), F.lit("-"))
    return url_host(r)


def query_params(url) -> Column:
    """Query string as a map; the first of repeated names wins, blanks are kept."""
    q = F.regexp_extract(col(url), r"\?([^#]*)", 1)
    pairs = F.filter(F.split(q, "&"), lambda p: F.length(p) > 0)
    name = lambda p: F.try_url_decode(F.substring_index(p, "=", 1))
    value = lambda p: F.when(p.contains("="), F.try_url_decode(F.substr(p, F.instr(p, "=") + 1))).otherwise("")
    entries = F.transform(F.reverse(pairs), lambda p: F.struct(name(p).alias("key"), value(p).alias("value")))
    return F.map_from_entries(entries)


def rewrite_url(url, source: str, target: str) -> Column:
    """Replace one path by another, or collapse the whole path where it is absent."""
    u = F.coalesce(col(url), F.lit(""))
    if not source.strip() or source.strip() == "*":
        return F.lit(target)
    return (
        F.when(u.contains(source), F.replace(u, F.lit(source), F.lit(target)))
        .when((u != "") & u.contains(target), u)
        .otherwise(F.lit(target))
    )


def apache_ts(text) -> Column:
    """Wall clock of ``dd/Mon/yyyy:HH:MM:SS +zzzz``; the offset is not applied."""
    return F.to_timestamp_ntz(F.substring(col(text), 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))


def is_static(path) -> Column:
    return F.coalesce(col(path), F.lit("")).rlike(STATIC_PATTERN)


# --- agents and inferred attributes ----------------------------------------


def browser_family(ua) -> Column:
    u = lower0(ua)
    return (
        F.when(has(u, "edg/", "edge/"), "Edge")
        .when(has(u, "chrome/", "crios/"), "Chrome")
        .when(has(u, "safari/"), "Safari")
        .when(has(u, "firefox/"), "Firefox")
        .when(u == "", "unknown")
        .otherwise("Other")
    )


def os_family(ua, platform) -> Column:
    u, p = lower0(ua), lower0(platform)
    return (
        F.when((p == "ios_app") | has(u, "iphone", "ipad"), "iOS")
        .when((p == "android_app") | has(u, "android"), "Android")
        .when(has(u, "windows"), "Windows")
        .when(has(u, "mac os", "macintosh"), "macOS")
        .when(has(u, "linux"), "Linux")
        .otherwise("unknown")
    )


def device_type(ua, hint=None, tablet_first: bool = True) -> Column:
    """Device class; the log variant tests mobile first and never returns null."""
    u = lower0(ua)
    tablet = (has(u, "ipad", "tablet"), "tablet")
    mobile = (has(u, "iphone", "android", "mobile"), "mobile")
    first, second = (tablet, mobile) if tablet_first else (mobile, tablet)
    out = F.when(*first).when(*second).otherwise("desktop")
    if not tablet_first:
        return out
    out = F.when(u != "", out)
    return out if hint is None else F.coalesce(F.nullif(col(hint), F.lit("")), out)


def service_domain(path, hint=None) -> Column:
    p = lower0(path)
    out = reduce(lambda acc, s: acc.when(p.contains(f"/{s}/"), s), SECTIONS[1:], F.when(p.contains(f"/{SECTIONS[0]}/"), SECTIONS[0]))
    out = out.otherwise("web")
    return out if hint is None else F.coalesce(F.nullif(col(hint), F.lit("")), out)


def event_type(path, evt=None, given=None) -> Column:
    p = lower0(path)
    guess = F.when(p.contains("/submit"), "conversion").when(has(p, "/apply", "/step"), "click").otherwise("view")
    hints = [F.nullif(col(x), F.lit("")) for x in (given, evt) if x is not None]
    return F.coalesce(*hints, guess)


def page_type(path, hint=None) -> Column:
    p = lower0(path)
    out = F.when(p.contains("/loan/"), "loan")
    for s in PRODUCT_SECTIONS[1:]:
        out = out.when(p.contains(f"/{s}/"), s)
    out = (
        out.when(has(p, "/auth/", "/login"), "login")
        .when(p.contains("/account/"), "account")
        .when(p.contains("/dashboard"), "dashboard")
        .when(p.contains("/main"), "home")
        .when(p != "", "page")
    )
    return out if hint is None else F.coalesce(F.nullif(col(hint), F.lit("")), out)


def funnel_stage(path, page=None, hint=None) -> Column:
    p = lower0(path)
    out = F.when(p.contains("/submit"), "submit")
    for s in ("apply", "product", "status"):
        out = out.when(p.contains(f"/{s}"), s)
    hints = [F.nullif(col(x), F.lit("")) for x in (hint, page) if x is not None]
    return F.coalesce(*hints, out.otherwise("browse"))


def is_conversion(path, evt=None, given=None) -> Column:
    hints = [F.nullif(col(x), F.lit("")) for x in (given, evt) if x is not None]
    e = F.lower(F.coalesce(*hints, F.lit("")))
    return (e.isin("conversion", "submit", "success") | has(lower0(path), "/submit", "/complete", "/success")).cast("int")


# Keyword rules of event names, first match wins. ``all`` words
# must occur, one of ``any`` must; "batch" and "stream" inputs use two lists.
EVENT_RULES = {
    "batch": [
        ("card_apply_submit", ["card"], ["/card/apply/submit", "/card/application/submit", "/card/complete", "card_apply_submit", "application_result=submitted", "submit", "complete"]),
        ("card_apply_start", ["card"], ["/card/apply", "/card/application/start", "card_apply_start", "start", "step1", "apply"]),
        ("loan_apply_submit", ["loan"], ["/loan/apply/submit", "/loan/application/submit", "/loan/complete", "loan_apply_submit", "application_result=submitted", "submit", "complete"]),
        ("loan_apply_start", ["loan"], ["/loan/apply", "/loan/application/start", "loan_apply_start", "start", "step1", "apply"]),
        ("loan_view", ["loan"], ["/loan", "/loan/product", "/loan/detail", "loan_view", "product=loan", "view"]),
        ("auth_success", [], ["/auth/success", "/auth/complete", "/cert/success", "auth_success", "auth_result=success"]),
        ("auth_fail", [], ["/auth/fail", "/login/fail", "/cert/fail", "auth_fail", "auth_result=fail"]),
        ("otp_request", [], ["/otp", "/auth/otp", "/mfa", "otp_request", "otp=request", "mfa=request"]),
        ("risk_login", [], ["/risk-login", "/auth/risk", "risk_login", "risk_login=1", "fraud_flag=1"]),
        ("login_success", [], ["/login/success", "/auth/login/success", "/signin/success", "login_success"]),
        ("auth_attempt", [], ["/login", "/auth/login", "/signin", "/cert", "auth_attempt", "login_attempt", "auth_step=attempt"]),
    ],
    "stream": [
        ("card_apply_submit", ["card"], ["/card/apply/submit", "/card/complete", "card_apply_submit", "submit", "complete"]),
        ("card_apply_start", ["card"], ["/card/apply", "card_apply_start", "start", "step1", "apply"]),
        ("loan_apply_submit", ["loan"], ["/loan/apply/submit", "/loan/complete", "loan_apply_submit", "submit", "complete"]),
        ("loan_apply_start", ["loan"], ["/loan/apply", "loan_apply_start", "start", "step1", "apply"]),
        ("loan_view", ["loan"], ["/loan", "/loan/product", "/loan/detail", "loan_view", "view"]),
        ("auth_success", [], ["/auth/success", "auth_success", "auth_result=success"]),
        ("auth_fail", [], ["/auth/fail", "auth_fail", "auth_result=fail"]),
        ("otp_request", [], ["/otp", "/mfa", "otp_request", "mfa=request"]),
        ("risk_login", [], ["/risk-login", "/auth/risk", "risk_login", "fraud_flag=1"]),
        ("login_success", [], ["/login/success", "login_success"]),
        ("auth_attempt", [], ["/login", "/auth/login", "/signin", "/cert", "auth_attempt", "login_attempt"]),
    ],
}
# An auth or login text with one of these words also counts.
AUTH_OUTCOMES = {"auth_success": ("success", "ok"), "auth_fail": ("fail", "error", "denied")}


def _tail(row: dict[str, Column]) -> Column | None:
    """Parsed cookie tail of a row: an already parsed ``kv`` map wins over ``kv_raw``."""
    if "kv" in row:
        return row["kv"]
    return parse_kv_lower(row["kv_raw"]) if "kv_raw" in row else None


HIT_FIELDS = (
    "semantic_event_name event_name event_type evt financial_product product_type funnel_stage path url_norm query "
    "method status status_code uid pcid ip"
).split()


def with_hit_row(df):
    """``df`` with the cookie tail parsed once as ``kv``, and its fields as a row of columns."""
    if "kv_raw" in df.columns and "kv" not in df.columns:
        df = df.withColumn("kv", parse_kv_lower("kv_raw"))
    row = {n: F.col(n) for n in HIT_FIELDS if n in df.columns}
    if "kv" in df.columns:
        row["kv"] = F.col("kv")
    return df, row


def with_event_name(df, out: str = "semantic_event", mode: str = "batch", pv_mode: str = "view_only"):
    """Add the event name found by keyword rules over the joined text of a hit.

    The tail, the text and the name are built in steps, so each is computed once per row.
    """
    df, row = with_hit_row(df)
    kv = row.get("kv")

    def pick(names, keys=()):
        found = [F.nullif(row[n].cast("string"), F.lit("")) for n in names if n in row]
        if kv is not None:
            found += [kv_value(kv, k) for k in keys]
        return F.lower(F.trim(F.coalesce(*found, F.lit(""))))

    named = ("semantic_event_name", "event_name") + (("event_type",) if mode == "stream" else ())
    happened = ("evt",) + (("event_type",) if mode == "batch" else ())
    df = df.withColumn("_existing", pick(named)).withColumn(
        "_text",
        F.concat_ws(
            " | ",
            "_existing",
            pick(happened, ("evt", "event", "action")),
            pick((), ("auth_result", "result")),
            pick(("financial_product", "product_type"), ("financial_product", "product_type")),
            pick(("funnel_stage",), ("funnel_stage",)),
            pick(("path",)),
            pick(("url_norm",)),
            pick(("query",)),
        ),
    )
    text, existing, method = F.col("_text"), F.col("_existing"), F.upper(pick(("method",)))
    name = F.when((existing != "") & ~existing.isin(*GENERIC_EVENT_NAMES), existing)
    for label, need, any_of in EVENT_RULES[mode]:
        # required words first: they settle most rows
        cond = has(text, *any_of)
        for word in need:
            cond = text.contains(word) & cond
        if label in AUTH_OUTCOMES:
            cond = cond | (has(text, "auth", "login") & has(text, *AUTH_OUTCOMES[label]))
        if mode == "batch" and label == "loan_view":
            cond = cond & method.isin("", "GET", "POST")
        if mode == "batch" and label == "otp_request":
            cond = cond & has(text, "otp", "mfa", "request", "send")
        name = name.when(cond, label)
    if mode == "stream":
        name = name.otherwise("page_view")
    else:
        name = name.when(is_pageview(row, pv_mode), "page_view").otherwise("other")
    return df.withColumn(out, name).drop("_existing", "_text")


def is_pageview(row: dict[str, Column], mode: str = "view_only") -> Column:
    """A GET or POST with a status of 200-599 that is no static file."""
    kv = _tail(row)
    status = first_nonblank(*[row[n] for n in ("status", "status_code") if n in row] or [F.lit(None)]).try_cast("int")
    method = F.upper(F.coalesce(row.get("method", F.lit("")), F.lit("")))
    ok = status.isNull() | status.between(200, 599)
    ok = ok & method.isin("", "GET", "POST")
    ok = ok & ~((method == "GET") & is_static(row["path"]))
    if mode == "view_only":
        tries = [F.nullif(row["evt"], F.lit(""))] if "evt" in row else []
        if kv is not None:
            tries.append(kv_value(kv, "evt"))
        evt = F.lower(F.trim(F.coalesce(*tries, F.lit(""))))
        kind = lower0(row.get("event_type", F.lit("")))
        ok = ok & (evt.isin("", "view") | kind.isin("", "view"))
    return F.coalesce(ok, F.lit(False))


def identity_key(row: dict[str, Column], mode: str = "uid_pcid_ip") -> Column:
    """Prefixed visitor id: login, else cookie, else address."""
    kv = _tail(row)

    def pick(name):
        found = [F.nullif(row[name].cast("string"), F.lit(""))] if name in row else []
        if kv is not None:
            found += [kv_value(kv, name), kv_value(kv, f"nth_{name}")]
        return F.nullif(F.trim(F.coalesce(*found, F.lit(""))), F.lit(""))

    address = F.concat(F.lit("IP:"), F.trim(F.coalesce(row["ip"], F.lit(""))))
    cookie = F.concat(F.lit("PCID:"), pick("pcid"))
    if mode == "ip":
        return address
    if mode == "pcid_ip":
        return F.coalesce(cookie, address)
    return F.coalesce(F.concat(F.lit("UID:"), pick("uid")), cookie, address)


def page_event_filter(path, evt, page, mode: str = "evt_or_page_type") -> Column:
    seen = lower0(evt) == "view"
    if mode == "evt_or_page_type":
        seen = seen | (F.coalesce(col(page), F.lit("")) != "")
    return ~is_static(path) & seen


def token_match(value, spec: str) -> Column:
    """``*`` matches all; otherwise one of a comma-separated list, any case."""
    want = (spec or "*").strip().lower()
    if want in ("", "*"):
        return F.lit(True)
    return F.trim(lower0(value)).isin(*[t.strip() for t in want.split(",") if t.strip()])


def norm_blank(x, width: int | None = None) -> Column:
    out = F.coalesce(blank(x), F.lit("unknown"))
    return out if width is None else F.substring(out, 1, width)


def minute_bucket(ts) -> Column:
    return F.date_trunc("minute", col(ts))


def hour_label(ts) -> Column:
    return F.lpad(F.hour(col(ts)).cast("string"), 2, "0")


def state_entity(name) -> Column:
    n = F.coalesce(col(name), F.lit(""))
    out = F.when(n.startswith("delivery_"), "delivery")
    for e in ("refund", "order"):
        out = out.when(n.startswith(f"{e}_"), e)
    return out.otherwise("unknown")


def joined_key(*ids) -> Column:
    """Ids joined by ``|``, nulls as blanks."""
    return F.concat_ws("|", *[F.coalesce(col(i).cast("string"), F.lit("")) for i in ids])


def hashed_key(*ids) -> Column:
    return F.md5(joined_key(*ids))


def json_payload(*cols) -> Column:
    return F.to_json(F.struct(*[col(c) for c in cols]))


def json_get(payload, path: str) -> Column:
    return F.get_json_object(col(payload), path)


TRUNCATED = "... [truncated]"


def truncate_text(x, n: int = 900) -> Column:
    t = F.coalesce(col(x), F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - len(TRUNCATED)), F.lit(TRUNCATED))).otherwise(t)


def mapping_suggestion(path) -> dict[str, Column]:
    """Proposed mapping of an unmapped path."""
    p = F.coalesce(F.nullif(col(path), F.lit("")), F.lit("/"))
    section = F.regexp_extract(p, "^(/(?:" + "|".join(MAPPED_SECTIONS) + ")/)", 1)
    pattern = F.coalesce(F.nullif(section, F.lit("")), p)
    name = F.replace(F.replace(F.trim(pattern, F.lit("/")), F.lit("/"), F.lit("_")), F.lit(".do"), F.lit(""))
    kind = (
        F.when(has(pattern, "apply", "submit"), "conversion")
        .when(pattern.startswith("/auth/") | pattern.startswith("/transfer/"), "action")
        .otherwise("page")
    )
    stage = F.when(kind == "conversion", "apply").when(pattern.startswith("/auth/"), "auth").otherwise("view")
    return {
        "suggested_pattern": pattern,
        "suggested_event_name": F.when(name == "", "root_view").otherwise(name),
        "suggested_event_type": kind,
        "suggested_funnel_stage": stage,
        "suggested_funnel_order": F.when(kind == "conversion", 3).when(kind == "action", 2).otherwise(1),
    }


def keyword_hits(text, labels: dict[str, list[str]], lowered: bool = False) -> Column:
    """Labels whose keyword list occurs in the lower-cased text.

    A long text is best lower-cased once, in a column of its own.
    """
    t = col(text) if lowered else lower0(text)
    flags = [F.when(has(t, *[w.lower() for w in words]), F.lit(label)) for label, words in labels.items()]
    return F.array_compact(F.array(*flags))


def contract_note(status, level) -> Column:
    s = F.upper(F.coalesce(col(status), F.lit("")))
    return (
        F.when(s.isin("PASS", "OK"), "PASS")
        .when((s == "FAIL") & (lower0(level) == "review"), "PASS_WITH_REVIEW")
        .otherwise("CHECK")
    )


# Words that place a signal in a family, first match wins.
SIGNAL_FAMILIES = [
    ("completeness", "comple|missing|partial|drop|no_data"),
    ("schema_validation", "schema|validation|contract"),
    ("identity_mapping", "identity|uid|pcid|mapping"),
    ("latency_performance", "latency|lag|delay|freshness|performance"),
    ("availability", "availability|timeout|retry|resource|saturation"),
    ("root_cause_weighted", "root_cause_weighted"),
]
# Layer of each family.
FAMILY_LAYERS = {
    "completeness": "batch",
    "schema_validation": "batch",
    "identity_mapping": "batch",
    "latency_performance": "stream",
    "capacity_volume": "stream",
    "availability": "operational",
    "performance_availability": "operational",
}


def signal_family(signal) -> Column:
    s = lower0(signal)
    out = F.when(s == "", "unknown")
    for family, words in SIGNAL_FAMILIES:
        out = out.when(s.rlike(words), family)
    return out.otherwise("unknown")


def family_layer(family) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FAMILY_LAYERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col(family)), F.lit(""))
