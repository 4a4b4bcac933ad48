"""Source-versus-collected measures by segment, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N, text as X

SCOPE = ("profile_id", "dt", "scenario_name")
METRICS = ("event_count", "pv", "uv", "visit", "conversion")
APP = ("app_platform", "app_version", "sdk_version")
SDK = ("app_platform", "sdk_version")
URL = (*APP, "surface_path")
CLIENT = (*APP, "device_type", "browser_family", "os_family")

# What counts as a page view.
PV_EVENTS = ("view", "page_view", "pv")
PV_PAGES = ("home", "category", "product", "search", "cart", "checkout", "payment")
MISSING_THRESHOLD = 0.05
MIN_WEB_EVENTS = 30


def known(x) -> Column:
    """The value, or null where it is blank or ``unknown``."""
    return F.nullif(X.norm_blank(x), F.lit("unknown"))


def segment_columns(hits: DataFrame) -> DataFrame:
    """Normalize the segment columns of hits; adds path, browser and system."""
    out = hits
    for c in APP:
        out = out.withColumn(c, X.norm_blank(c))
    return (
        out.withColumn("browser_family", X.browser_family("ua"))
        .withColumn("os_family", X.os_family("ua", "app_platform"))
        .withColumn("device_type", X.norm_blank("device_type"))
        .withColumn("surface_path", X.norm_blank("path"))
    )


def visit_counts(hits: DataFrame, keys) -> DataFrame:
    """Hits reduced to one row per key, visitor and session.

    Distinct counts over several grouping levels run on this reduced table, so
    the expansion they need never touches the raw hits.
    """
    kind = F.lower(X.first_nonblank("event_type", "evt"))
    pv = F.coalesce(kind.isin(*PV_EVENTS), F.lit(False)) | X.lower0("page_type").isin(*PV_PAGES)
    visitor = F.coalesce(known("pcid"), known("ip"))
    return hits.groupBy(*keys, visitor.alias("_visitor"), known("sid").alias("_session")).agg(
        F.count("*").alias("event_count"),
        F.count_if(pv).alias("pv"),
        F.count_if(F.col("is_conversion").cast("string").isin("1", "true")).alias("conversion"),
    )


def _metric_aggs():
    return [
        F.sum("event_count").alias("event_count"),
        F.sum("pv").alias("pv"),
        F.count_distinct("_visitor").alias("uv"),
        F.count_distinct("_session").alias("visit"),
        F.sum("conversion").alias("conversion"),
    ]


def hit_metrics(hits: DataFrame, dims, scope=SCOPE) -> DataFrame:
    """Events, page views, visitors, visits and conversions per segment."""
    keys = [*scope, *dims]
    return visit_counts(hits, keys).groupBy(*keys).agg(*_metric_aggs())


def identity_metrics(hits: DataFrame, dims=APP, scope=SCOPE) -> DataFrame:
    """Events, events with a login, and distinct logins per segment."""
    keys = [*scope, *dims]
    reduced = hits.groupBy(*keys, known("uid").alias("_uid")).agg(F.count("*").alias("n"))
    return reduced.groupBy(*keys).agg(
        F.sum("n").alias("event_count"),
        F.sum(F.when(F.col("_uid").isNotNull(), F.col("n")).otherwise(0)).alias("uid_events"),
        F.count("_uid").alias("login_users"),
    )


def dim_metrics(hits: DataFrame, scope=SCOPE) -> DataFrame:
    """The measures for all, platform, app, sdk and app+sdk levels in one pass."""
    reduced = visit_counts(hits, [*scope, *APP])
    base = [F.col(c) for c in scope]
    p, a, s = [F.col(c) for c in APP]
    sets = [[*base], [*base, p], [*base, p, a], [*base, p, s], [*base, p, a, s]]
    # bits of platform, app, sdk: 1 where the column is rolled up
    level = F.grouping("app_platform") * 4 + F.grouping("app_version") * 2 + F.grouping("sdk_version")
    out = reduced.groupingSets(sets, *base, p, a, s).agg(level.alias("_level"), *_metric_aggs())
    kind = (
        F.when(F.col("_level") == 7, "all").when(F.col("_level") == 3, "app_platform").when(F.col("_level") == 1, "app_version")
        .when(F.col("_level") == 2, "sdk_version").otherwise("app_sdk")
    )
    value = F.when(F.col("_level") == 7, "all").otherwise(F.concat_ws("|", *APP))
    return out.select(*scope, kind.alias("dimension_type"), value.alias("dimension_value"), *METRICS)


def gap_join(source: DataFrame, collected: DataFrame, keys) -> DataFrame:
    """Both sides on the union of their keys as ``web_*`` and ``wc_*``, missing counts 0."""
    keys = list(keys)
    measures = [c for c in source.columns if c not in keys]
    left = source.select(*keys, *[F.col(c).alias(f"web_{c}") for c in measures])
    right = collected.select(*keys, *[F.col(c).alias(f"wc_{c}") for c in measures])
    return left.join(right, keys, "full_outer").fillna(0)


def lost(web, wc) -> Column:
    return F.greatest(F.lit(0), F.col(web) - F.col(wc))


def lost_rate(measure: str) -> Column:
    return N.safe_div(lost(f"web_{measure}", f"wc_{measure}"), f"web_{measure}")


def with_gap_rates(joined: DataFrame, threshold: float = MISSING_THRESHOLD, min_web: int = MIN_WEB_EVENTS) -> DataFrame:
    rate = lost_rate("event_count")
    flag = (F.col("web_event_count") >= min_web) & (rate >= threshold)
    return joined.select(
        "*",
        lost("web_event_count", "wc_event_count").alias("missing_count"),
        rate.alias("missing_rate"),
        *[lost_rate(m).alias(f"{m}_missing_rate") for m in ("uv", "visit", "pv", "conversion")],
        flag.cast("int").alias("tagging_missing_flag"),
    )


def segment_gap(source: DataFrame, collected: DataFrame, dims, scope=SCOPE, **limits) -> DataFrame:
    keys = [*scope, *dims]
    return with_gap_rates(gap_join(hit_metrics(source, dims, scope), hit_metrics(collected, dims, scope), keys), **limits)


def gap_by_app(source, collected, scope=SCOPE, **limits) -> DataFrame:
    return segment_gap(source, collected, APP, scope, **limits)


def gap_by_sdk(source, collected, scope=SCOPE, **limits) -> DataFrame:
    """SDK gaps with the number of app versions each SDK version was seen with."""
    rows = segment_gap(source, collected, SDK, scope, **limits)
    pairs = source.select(*scope, *APP).unionByName(collected.select(*scope, *APP)).distinct()
    versions = pairs.groupBy(*scope, *SDK).agg(F.count("*").alias("affected_app_versions"))
    return rows.join(versions, [*scope, *SDK], "left")


def gap_by_url(source, collected, scope=SCOPE, **limits) -> DataFrame:
    return segment_gap(source, collected, URL, scope, **limits)


def gap_by_client(source, collected, scope=SCOPE, **limits) -> DataFrame:
    return segment_gap(source, collected, CLIENT, scope, **limits)


def metric_gap(source: DataFrame, collected: DataFrame, scope=SCOPE, threshold: float = MISSING_THRESHOLD, min_web: int = MIN_WEB_EVENTS) -> DataFrame:
    """One row per dimension value and measure: both values, gap rate, severity, flag."""
    keys = [*scope, "dimension_type", "dimension_value"]
    wide = gap_join(dim_metrics(source, scope), dim_metrics(collected, scope), keys)
    pairs = F.array(*[
        F.struct(
            F.lit(m).alias("metric_name"),
            F.col(f"web_{m}").cast("double").alias("web_value"),
            F.col(f"wc_{m}").cast("double").alias("wc_value"),
        )
        for m in METRICS
    ])
    long = wide.select(*keys, F.inline(pairs))
    rate = N.safe_div(lost("web_value", "wc_value"), "web_value")
    flag = (F.col("web_value") >= min_web) & (rate >= threshold)
    return long.select(
        "*",
        lost("web_value", "wc_value").alias("missing_value"),
        rate.alias("gap_rate"),
        N.level_band(rate, "gap_severity").alias("severity"),
        flag.cast("int").alias("tagging_missing_flag"),
    )


def identity_gap(source: DataFrame, collected: DataFrame, dims=APP, scope=SCOPE) -> DataFrame:
    keys = [*scope, *dims]
    j = gap_join(identity_metrics(source, dims, scope), identity_metrics(collected, dims, scope), keys)
    return j.select(
        "*",
        lost("web_uid_events", "wc_uid_events").alias("uid_missing_count"),
        lost_rate("uid_events").alias("uid_missing_rate"),
        lost_rate("login_users").alias("login_user_gap_rate"),
        F.greatest(lost_rate("uid_events"), lost_rate("login_users")).alias("identity_integrity_gap"),
    )


def url_semantic_gap(source: DataFrame, collected: DataFrame, scope=SCOPE, threshold: float = MISSING_THRESHOLD) -> DataFrame:
    """Shift of hits between paths: lost from one, gained by another."""
    keys = [*scope, *URL]
    count = lambda d: d.groupBy(*keys).agg(F.count("*").alias("events"))
    j = gap_join(count(source), count(collected), keys)
    under, over = lost("web_events", "wc_events"), lost("wc_events", "web_events")
    shift = F.least(
        F.lit(1.0),
        F.abs(F.col("web_events") - F.col("wc_events")) / F.greatest("web_events", "wc_events", F.lit(1)),
    )
    return j.select(
        "*",
        under.alias("under_count"),
        over.alias("over_count"),
        N.safe_div(under, "web_events").alias("under_rate"),
        N.safe_div(over, "web_events").alias("over_rate"),
        shift.alias("distribution_shift_score"),
        ((shift >= threshold) & ((under > 0) | (over > 0))).cast("int").alias("url_collapse_flag"),
        F.when(under > 0, "under").when(over > 0, "over").otherwise("none").alias("shifted_direction"),
    )


def traffic_preservation(pv_gap) -> Column:
    """1 up to a 2 % page view gap, falling to 0 beyond 12 %."""
    g = N.dbl(pv_gap)
    return F.when(g <= 0.02, 1.0).when(g <= 0.12, N.clamp01(1.0 - (g / 0.12) * 0.55)).otherwise(0.0)


def kpi_distortion(conversion_gap, preservation) -> Column:
    return N.clamp01(0.65 * N.dbl(conversion_gap) + 0.35 * N.dbl(preservation))


def business_kpi_gap(source: DataFrame, collected: DataFrame, scope=SCOPE) -> DataFrame:
    j = gap_join(hit_metrics(source, (), scope), hit_metrics(collected, (), scope), scope)
    out = j.select(*scope, *[lost_rate(m).alias(f"{m}_gap_rate") for m in ("pv", "uv", "visit", "conversion")])
    out = out.withColumn("traffic_preservation_score", traffic_preservation("pv_gap_rate"))
    return (
        out.withColumn("purchase_event_gap_rate", F.col("conversion_gap_rate"))
        .withColumn("revenue_proxy_gap_rate", F.col("conversion_gap_rate") * 0.80)
        .withColumn("business_kpi_distortion_score", kpi_distortion("conversion_gap_rate", "traffic_preservation_score"))
    )


STAGES = ("checkout", "product", "payment", "browse", "search", "other")


def _stage_flags() -> dict[str, Column]:
    path, stage = X.lower0("path"), F.lower(F.coalesce("funnel_stage", "page_type", F.lit("")))
    other = ~X.has(stage, "checkout", "payment", "product", "browse", "search")
    return {
        "checkout": X.has(path, "checkout", "payment") | X.has(stage, "checkout", "payment"),
        "product": path.contains("product") | stage.contains("product"),
        "payment": path.contains("payment") | stage.contains("payment"),
        "browse": stage.contains("browse"),
        "search": stage.contains("search"),
        "other": other,
    }


def stage_counts(hits: DataFrame, visitor: Column, scope=SCOPE) -> DataFrame:
    flags = _stage_flags()
    reduced = hits.groupBy(*scope, visitor.alias("_visitor")).agg(
        F.count("*").alias("hits"), *[F.count_if(c).alias(n) for n, c in flags.items()]
    )
    return reduced.groupBy(*scope).agg(
        F.sum("hits").alias("hits"), F.count("_visitor").alias("uv"), *[F.sum(n).alias(n) for n in flags]
    )


def observability_measurement(source: DataFrame, collected: DataFrame, canonical: DataFrame, scope=SCOPE) -> DataFrame:
    """Hits, visitors and stage hits of both sides, their gap rates and the worst stage.

    Source visitors are addresses, collected ones cookies.
    """
    nb = lambda c: F.nullif(F.col(c), F.lit(""))
    web = stage_counts(source, F.col("ip"), scope)
    wc = stage_counts(collected, F.coalesce(nb("pcid"), nb("sid"), F.col("ip")), scope)
    j = gap_join(web, wc, scope).join(
        canonical.groupBy(*scope).agg(F.count("*").alias("canonical_behavior_events")), list(scope), "left"
    ).fillna(0, subset=["canonical_behavior_events"])
    gaps = {s: lost(f"web_{s}", f"wc_{s}") for s in STAGES}
    return j.select(
        *scope,
        F.col("web_hits"),
        F.col("wc_hits"),
        "canonical_behavior_events",
        lost("web_hits", "wc_hits").alias("collection_gap_count"),
        lost_rate("hits").alias("collection_gap_rate"),
        lost("web_hits", "canonical_behavior_events").alias("canonical_gap_count"),
        N.safe_div(lost("web_hits", "canonical_behavior_events"), "web_hits").alias("canonical_gap_rate"),
        F.col("web_uv").alias("web_uv_ip"),
        F.col("wc_uv").alias("wc_uv_pcid"),
        lost_rate("uv").alias("uv_gap_rate"),
        *[lost_rate(s).alias(f"{s}_missing_rate") for s in ("checkout", "product", "payment")],
        N.dominant(gaps).alias("top_missing_stage"),
        F.when(F.col("web_hits") > F.col("wc_hits"), "wc_collector_collection_gap").otherwise("none").alias("suspected_root_cause"),
    )


def observability_signal(source: DataFrame, collected: DataFrame, scope=SCOPE) -> DataFrame:
    """Page events only: the highest of four gap rates, its level and label."""
    nb = lambda c: F.nullif(F.col(c), F.lit(""))

    def side(hits, visitor):
        path = X.lower0("path")
        page = hits.where(X.page_event_filter("path", "evt", "page_type"))
        reduced = page.groupBy(*scope, visitor.alias("_visitor")).agg(
            F.count("*").alias("hits"),
            F.count_if(X.has(path, "checkout", "payment", "order")).alias("checkout"),
            F.count_if(path.contains("product")).alias("product"),
        )
        return reduced.groupBy(*scope).agg(
            F.sum("hits").alias("hits"), F.count("_visitor").alias("uv"), F.sum("checkout").alias("checkout"), F.sum("product").alias("product")
        )

    j = gap_join(side(source, nb("ip")), side(collected, F.coalesce(nb("pcid"), nb("uid"), nb("ip"))), scope)
    rates = {m: F.round(lost_rate(m), 6) for m in ("hits", "uv", "checkout", "product")}
    score = F.greatest(*rates.values())
    return j.select(
        *scope,
        "web_hits",
        "wc_hits",
        lost("web_hits", "wc_hits").alias("collection_gap_count"),
        *[c.alias(f"{n}_gap_rate") for n, c in rates.items()],
        score.alias("observability_signal_score"),
        N.level_band(score, "signal").alias("observability_risk_level"),
        F.when(score > 0, "WC Collection Completeness Risk").otherwise("None").alias("dominant_observability_signal"),
    )


def segment_concentration(rows: DataFrame, scope=SCOPE, web: str = "web_event_count", missing: str = "missing_count", rate: str = "missing_rate") -> DataFrame:
    """How far the loss sits in segments beyond their share of the traffic."""
    totals = rows.groupBy(*scope).agg(F.sum(web).alias("_web"), F.sum(missing).alias("_missing"))
    excess = N.safe_div(missing, "_missing") - N.safe_div(web, "_web")
    return (
        rows.join(totals, list(scope))
        .groupBy(*scope)
        .agg(
            F.max(excess).alias("_excess"),
            F.max(rate).alias("_rate"),
            F.max("_missing").alias("total_missing"),
        )
        .select(
            *scope,
            "total_missing",
            N.clamp01(F.greatest(F.col("_excess") * 1.6, F.col("_rate") * 0.75)).alias("concentration"),
        )
    )


def top_gap_urls(rows: DataFrame, k: int = 100, scope=SCOPE, tie=()) -> DataFrame:
    """The ``k`` rows with most lost hits per scope."""
    order = [F.desc("missing_count"), F.desc("missing_rate"), *[F.asc(c) for c in tie]]
    w = Window.partitionBy(*scope).orderBy(*order)
    return rows.withColumn("gap_rank", F.row_number().over(w)).where(F.col("gap_rank") <= k)
