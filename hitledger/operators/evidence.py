"""From day facts to evidence: behavior, runtime, observability, root causes, propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N, rules as R, text as X
from .gaps import kpi_distortion, segment_concentration, top_gap_urls, traffic_preservation

SCOPE = ("profile_id", "dt", "scenario_name")


def is_reference(name="scenario_name") -> Column:
    """Scenarios that only produce the reference and carry no risk."""
    return F.lower(F.coalesce(F.col(name), F.lit(""))).isin(*R.REFERENCE_SCENARIOS)


def num(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def score_contributions(delta: DataFrame, scope=SCOPE) -> DataFrame:
    """What each metric adds to each score family: its risk score times a weight."""
    mine = []
    for family, metric_scope, metrics, weight in R.CONTRIBUTIONS:
        hit = (F.col("metric_scope") == metric_scope) & F.col("metric_name").isin(*metrics)
        mine.append(F.when(hit, F.struct(F.lit(family).alias("score_family"), F.lit(weight).alias("weight"))))
    rows = delta.where(F.col("scenario_name") != "baseline").select("*", F.inline(F.array_compact(F.array(*mine))))
    return rows.select(
        *scope, "score_family", F.col("metric_scope").alias("input_metric_scope"), F.col("metric_name").alias("input_metric_name"),
        F.col("risk_score").alias("metric_risk_score"), "weight", N.clamp01(F.col("risk_score") * F.col("weight")).alias("contribution_score"),
    )


def _top(score: str, metric_scope: str, metrics) -> Column:
    hit = (F.col("metric_scope") == metric_scope) & F.col("metric_name").isin(*metrics)
    return F.coalesce(F.max(F.when(hit, F.col(score))), F.lit(0.0))


def _joined(parts, scope) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(scope), "full_outer"), parts)


def statistical_top(evidence: DataFrame, scope=SCOPE) -> DataFrame:
    return evidence.groupBy(*scope).agg(
        F.max("statistical_score").alias("statistical_evidence_score"), F.max(F.abs("z_score")).alias("max_z_score"), F.max("historical_percentile").alias("max_historical_percentile"),
        F.sum("control_limit_breach").alias("control_limit_breach_count"),
    )


def _calm(cols, scope=SCOPE):
    """Zero the scores of baseline scenarios: they only make the reference."""
    return [F.when(F.col("scenario_name") == "baseline", 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in cols]


def batch_behavior_score(delta: DataFrame, shift: DataFrame, coverage: DataFrame, evidence: DataFrame, scope=SCOPE) -> DataFrame:
    """Behavior, conversion, session, mapping and quality scores of a day, and the highest one.

    ``coverage`` has mapping_coverage per scope.
    """
    keys = list(scope)
    d = delta.groupBy(*keys).agg(
        _top("risk_score", "behavior_volume", R.VOLUME_METRICS).alias("volume"), _top("risk_score", "observability", R.COLLECTION_METRICS).alias("collection"),
        _top("risk_score", "observability", R.COLLECTOR_COUNTS).alias("collector"), _top("risk_score", "behavior_funnel", R.FUNNEL_METRICS).alias("funnel"),
        _top("risk_score", "behavior_volume", ("visit",)).alias("visits"), _top("risk_score", "batch_quality", R.QUALITY_METRICS).alias("batch_quality_score"),
        F.max((F.col("baseline_status") == "baseline_available").cast("int")).alias("_known_d"),
    )
    s = shift.groupBy(*keys).agg(F.max("distribution_shift_score").alias("shift"), F.max((F.col("baseline_status") == "baseline_available").cast("int")).alias("_known_s"))
    j = d.join(s, keys, "left").join(coverage.select(*keys, "mapping_coverage"), keys, "left").join(statistical_top(evidence, scope).select(*keys, "statistical_evidence_score"), keys, "left")
    j = j.fillna(0)
    c = F.col
    j = j.select(
        *keys, "_known_d", "_known_s", "statistical_evidence_score", "batch_quality_score",
        N.clamp01(F.greatest("volume", "shift", "collection", "collector")).alias("behavior_distortion_score"),
        N.clamp01(F.greatest(c("funnel"), c("collection") * 0.70)).alias("conversion_distortion_score"),
        N.clamp01(F.greatest(c("visits"), c("collection") * 0.45)).alias("session_fragmentation_score"),
        N.clamp01(1 - c("mapping_coverage")).alias("mapping_risk_score"),
    )
    names = ("behavior_distortion_score", "conversion_distortion_score", "session_fragmentation_score", "mapping_risk_score", "batch_quality_score", "statistical_evidence_score")
    j = j.select(*keys, "_known_d", "_known_s", *_calm(names))
    overall = N.clamp01(F.greatest(*names))
    signal = {n.replace("_score", ""): F.col(n) for n in names[:5]}
    status = F.when((c("_known_d") == 1) | (c("_known_s") == 1), "baseline_available").when(c("scenario_name") == "baseline", "BASELINE_SELF_REFERENCE").otherwise("BASELINE_MISSING_REVIEW")
    j = j.withColumn("batch_overall_score", overall).withColumn("baseline_status", status)
    # the highest signal names the day once the overall score is positive
    best = N.dominant(signal, none="behavior_distortion")
    out = j.withColumn("dominant_batch_signal", F.when(c("batch_overall_score") <= 0, "none").otherwise(best))
    state = F.when((c("baseline_status") == "BASELINE_MISSING_REVIEW") & (c("batch_overall_score") <= 0), c("baseline_status")).otherwise(N.level_band("batch_overall_score", "status"))
    return out.withColumn("analysis_status", state).drop("_known_d", "_known_s")


VOLUME_SHIFT = ("event_count", "pv", "uv", "visit", "wc_hits", "canonical_behavior_events", "collection_gap_rate", "canonical_gap_rate")


def _volume_shift() -> Column:
    hit = F.col("metric_scope").isin("behavior_volume", "observability") & F.col("metric_name").isin(*VOLUME_SHIFT)
    return F.coalesce(F.max(F.when(hit, F.col("risk_score"))), F.lit(0.0))


def _missing_any(name: str) -> Column:
    return F.max((F.col("baseline_status") == "BASELINE_MISSING_REVIEW").cast("int")).alias(name)


def distribution_analysis(delta: DataFrame, shift: DataFrame, evidence: DataFrame, scope=SCOPE) -> DataFrame:
    keys = list(scope)
    d = delta.groupBy(*keys).agg(_volume_shift().alias("volume_shift_score"), _missing_any("_md"))
    s = shift.groupBy(*keys).agg(F.max("distribution_shift_score").alias("ratio_shift_score"), _missing_any("_ms"))
    j = _joined([d, s], keys).join(statistical_top(evidence, scope).select(*keys, "statistical_evidence_score"), keys, "left").fillna(0)
    j = j.select(*keys, "_md", "_ms", *_calm(("ratio_shift_score", "volume_shift_score", "statistical_evidence_score")))
    j = j.withColumn("batch_distribution_score", N.clamp01(F.greatest("ratio_shift_score", "volume_shift_score", "statistical_evidence_score")))
    missing = (F.col("_md") == 1) | (F.col("_ms") == 1)
    return j.select(
        *keys, "ratio_shift_score", "volume_shift_score", "batch_distribution_score",
        F.when(F.col("batch_distribution_score") >= 0.20, "batch_distribution_shift").otherwise("none").alias("distribution_signal"),
        F.when(missing, "BASELINE_MISSING_REVIEW").otherwise(N.level_band("batch_distribution_score", "status")).alias("analysis_status"),
    )


def time_pattern(shift: DataFrame, delta: DataFrame, scope=SCOPE) -> DataFrame:
    """Hours that moved: shift of shares, change of counts, and the hour that changed most."""
    keys = list(scope)
    hours = shift.where("dimension_name = 'hour'").withColumn(
        "_rate", F.abs(F.col("current_count") - F.coalesce("baseline_count_avg", F.lit(0.0))) / F.greatest(F.abs(F.coalesce("baseline_count_avg", F.lit(0.0))), F.lit(1.0))
    )
    h = hours.groupBy(*keys).agg(
        F.max("distribution_shift_score").alias("ratio"), N.clamp01(F.max("_rate") / 0.20).alias("count"), F.max("_rate").alias("dominant_hour_delta_rate"),
        F.min_by("dimension_value", F.struct(-F.col("_rate"), F.col("dimension_value"))).alias("dominant_hour"), _missing_any("_ms"),
    )
    d = delta.groupBy(*keys).agg(_volume_shift().alias("volume"), _missing_any("_md"))
    j = _joined([h, d], keys).fillna(0)
    c = F.col
    out = j.select(
        *keys, c("ratio").alias("ratio_shift_score"), c("count").alias("count_delta_score"), c("volume").alias("batch_volume_score"),
        N.clamp01(F.greatest(c("ratio"), c("count") - c("volume") * 0.50)).alias("localized_time_distortion_score"),
        N.clamp01(F.greatest(c("ratio"), c("count"), c("volume") * 0.70)).alias("time_pattern_score"), F.coalesce("dominant_hour", F.lit("none")).alias("dominant_hour"), "dominant_hour_delta_rate", "_ms", "_md",
    )
    missing = ((c("_ms") == 1) | (c("_md") == 1)) & (c("time_pattern_score") <= 0)
    return out.withColumn("analysis_status", F.when(missing, "BASELINE_MISSING_REVIEW").otherwise(N.level_band("time_pattern_score", "status"))).drop("_ms", "_md")


def top_contribution(contributions: DataFrame, scope=SCOPE) -> DataFrame:
    """The strongest contribution per scope; ties by family, metric and name."""
    ranks = F.create_map(*[F.lit(x) for p in R.FAMILY_RANK.items() for x in p])
    order = F.struct(
        -F.col("contribution_score"), F.coalesce(F.try_element_at(ranks, F.col("score_family")), F.lit(9)),
        F.when(F.col("input_metric_name").isin(*R.FIRST_METRICS), 1).otherwise(5), F.col("input_metric_name"), F.col("input_metric_scope"),
    )
    best = F.min_by(F.struct("score_family", "input_metric_name", "contribution_score"), order)
    return contributions.groupBy(*scope).agg(best.alias("t")).select(*scope, "t.*")


def behavior_anomaly(behavior: DataFrame, distribution: DataFrame, observability: DataFrame, contributions: DataFrame, delta: DataFrame, evidence: DataFrame, scope=SCOPE) -> DataFrame:
    """Collection and batch score of a day, the signal they form and its status."""
    keys = list(scope)
    families = F.col("score_family").isin("collection_effect", "behavior_distortion", "conversion_distortion", "session_fragmentation")
    con = contributions.groupBy(*keys).agg(
        F.max("contribution_score").alias("contribution"), F.max(F.when(families & (F.col("input_metric_scope") == "observability"), F.col("contribution_score"))).alias("collected")
    )
    m = delta.groupBy(*keys).agg(F.max("risk_score").alias("metric"))
    parts = [
        behavior.select(*keys, F.greatest("batch_overall_score", "behavior_distortion_score", "conversion_distortion_score", "session_fragmentation_score").alias("behavior")),
        distribution.select(*keys, F.col("batch_distribution_score").alias("distribution")),
        observability.select(*keys, F.greatest(
            *[num(n) * 3 for n in ("collection_gap_rate", "canonical_gap_rate")], *[num(n) * 2 for n in ("checkout_missing_rate", "product_missing_rate", "uv_gap_rate")]).alias("gap")),
        con, m, statistical_top(evidence, scope).select(*keys, F.col("statistical_evidence_score").alias("stat")), top_contribution(contributions, scope),
    ]
    j = _joined(parts, keys).fillna(0).fillna("none", subset=["score_family", "input_metric_name"])
    c = F.col
    j = j.withColumn("collection_score", N.clamp01(F.greatest("gap", "collected"))).withColumn(
        "batch_score", N.clamp01(F.greatest(c("behavior"), c("distribution"), c("contribution"), c("metric") * 0.50, c("stat")))
    )
    overall = N.clamp01(F.greatest("batch_score", "collection_score"))
    signal = (
        F.when((c("collection_score") >= 0.60) & (c("batch_score") >= 0.60), "observed_kpi_distortion_from_collection_loss")
        .when(c("collection_score") >= 0.20, "observability_collection_anomaly").when(c("batch_score") >= 0.20, "batch_behavior_distortion").otherwise("none")
    )
    return j.select(
        *keys, "collection_score", "batch_score", overall.alias("anomaly_score"), signal.alias("anomaly_signal"), N.level_band(overall, "status").alias("anomaly_status"),
        c("score_family").alias("top_score_family"), c("input_metric_name").alias("top_metric_name"), c("contribution_score").alias("top_contribution_score"),
    )


def runtime_evidence(rows: DataFrame) -> DataFrame:
    """Batch, stream, operational and realism scores of a day row, and the strongest.

    ``rows`` joins the day facts. Baselines without a direct delta score 0.
    """
    top = lambda *names: N.clamp01(F.greatest(F.lit(0.0), *[num(n) for n in names if n in rows.columns]))
    one = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(1.0)) if n in rows.columns else F.lit(1.0)
    err = num("error_rate") if "error_rate" in rows.columns else F.lit(0.0)
    deltas = [f"{n}_delta" for n in ("completeness", "timeliness", "availability", "integrity")]
    scores = {
        "batch": top("behavior_distortion_score", "conversion_distortion_score", "session_fragmentation_score", "identity_anomaly_score", "mapping_risk_score", "batch_quality_score", "batch_distribution_score"),
        "stream": top("duplicate_rate", "late_event_rate", "missing_event_rate", "ordering_violation_rate"),
        "operational": N.clamp01(F.greatest(1 - one("availability_score"), 1 - one("performance_score"), err)),
        "realism": top(*deltas),
    }
    calm = is_reference() & (top(*deltas) <= 0.0001)
    out = rows.select("*", *[F.when(calm, 0.0).otherwise(e).alias(f"{n}_evidence_score") for n, e in scores.items()])
    named = {n: F.col(f"{n}_evidence_score") for n in scores}
    best = N.clamp01(F.greatest(*named.values()))
    return out.select("*", best.alias("runtime_evidence_score"), N.dominant(named).alias("dominant_runtime_signal"), N.level_band(best, "evidence").alias("evidence_level"))


def observability_analysis(rows: DataFrame) -> DataFrame:
    """Six components of an observability row, one overall score, level and label."""
    parts = {
        "collection_completeness": N.clamp01(num("collection_gap_rate") * 3),
        "canonical_observability_gap": N.clamp01(num("canonical_gap_rate") * 3),
        "uv_observability_gap": N.clamp01(num("uv_gap_rate") * 2),
        "journey_stage_distortion": N.clamp01(F.greatest(num("checkout_missing_rate"), num("product_missing_rate")) * 2),
        "statistical_signal": num("statistical_evidence_score") if "statistical_evidence_score" in rows.columns else F.lit(0.0),
    }
    parts["kpi_false_degradation"] = F.greatest(*[parts[n] for n in ("collection_completeness", "canonical_observability_gap", "journey_stage_distortion")])
    out = rows.select("*", *[e.alias(n) for n, e in parts.items()])
    cols = {n: F.col(n) for n in parts}
    overall = N.clamp01(F.greatest(*cols.values()) * 0.70 + sum(cols.values()) / len(cols) * 0.30)
    out = out.withColumn("observability_overall_score", overall)
    signal = N.dominant(cols, none="collection_completeness")
    label = (
        F.when(F.col("observability_overall_score") < 0.08, "None").when(signal.isin("collection_completeness", "canonical_observability_gap"), "WC Collection Completeness Risk")
        .when(signal == "kpi_false_degradation", "False KPI Degradation Risk").otherwise("Operational Observability Distortion")
    )
    return out.select(
        "*", N.level_band("observability_overall_score", ([(0.65, "high"), (0.35, "warning")], "low")).alias("risk_level"), signal.alias("dominant_observability_signal"), label.alias("recommended_semantic_risk"),
    )


# --- root causes ---------------------------------------------------------------


def _candidates(rows: DataFrame, dimension: Column, value: Column, source: str, missing: Column, rates: dict[str, Column], evidence_rows: Column, fallback: Column | None = None, scope=SCOPE) -> DataFrame:
    """One candidate per segment row: (dimension, value, missing, total, rates, affected)."""
    items = F.array(*[F.struct(F.lit(n).alias("n"), F.coalesce(c.cast("double"), F.lit(0.0)).alias("r")) for n, c in rates.items()])
    d = rows.select(*scope, dimension.alias("root_cause_dimension"), value.alias("root_cause_value"), F.lit(source).alias("source_table"), missing.cast("double").alias("_missing"),
                    items.alias("_rates"), evidence_rows.alias("evidence_row_count"), *([fallback.cast("double").alias("_fallback")] if fallback is not None else []))
    extra = [F.sum("_fallback").alias("_alt")] if fallback is not None else []
    totals = d.groupBy(*scope).agg(F.sum("_missing").alias("_total"), *extra)
    total = F.when(F.col("_total") > 0, F.col("_total")).otherwise(F.col("_alt")) if fallback is not None else F.col("_total")
    return d.join(totals, list(scope)).select(
        *scope, "root_cause_dimension", "root_cause_value", "source_table", "evidence_row_count", N.safe_div("_missing", total).alias("segment_concentration"),
        F.transform("_rates", lambda x: x["r"]).alias("_r"), F.transform(F.filter("_rates", lambda x: x["r"] > 0.01), lambda x: x["n"]).alias("affected"),
    )


def root_cause_candidates(app=None, sdk=None, url=None, client=None, metric=None, identity=None, shift=None, kpi=None, context: DataFrame | None = None, scope=SCOPE) -> DataFrame:
    """Candidates of all gap tables with their confidence.

    ``context`` may give max_statistical_score and max_co_movement per scope.
    """
    c, parts, one = F.col, [], F.lit(1)
    full = {"event_count": c("missing_rate"), "pv": c("pv_missing_rate"), "uv": c("uv_missing_rate"), "visit": c("visit_missing_rate"), "conversion": c("conversion_missing_rate")}
    short = {"event_count": c("missing_rate"), "uv": c("uv_missing_rate")}
    slash = lambda *n: F.concat_ws("/", *[X.norm_blank(x) for x in n])
    if app is not None:
        parts.append(_candidates(app, F.lit("app_version"), slash("app_platform", "app_version", "sdk_version"), "app_gap", c("missing_count"), full, one, scope=scope))
    if sdk is not None:
        parts.append(_candidates(sdk, F.lit("sdk_version"), slash("app_platform", "sdk_version"), "sdk_gap", c("missing_count"), full, one, scope=scope))
    if url is not None:
        parts.append(_candidates(url, F.lit("url_path"), X.norm_blank("surface_path"), "url_gap", c("missing_count"), short, one, scope=scope))
    if client is not None:
        parts.append(_candidates(client, F.lit("client"), slash("app_platform", "device_type", "browser_family", "os_family"), "client_gap", c("missing_count"), short, one, scope=scope))
    if metric is not None:
        names = ("event_count", "pv", "uv", "visit", "conversion")
        wide = metric.groupBy(*scope, "dimension_type", "dimension_value").agg(
            F.sum("missing_value").alias("missing_count"), F.count("*").alias("n"), *[F.max(F.when(c("metric_name") == m, c("gap_rate"))).alias(m) for m in names])
        parts.append(_candidates(wide, F.concat(F.lit("metric_"), "dimension_type"), X.norm_blank("dimension_value"), "metric_gap", c("missing_count"), {m: c(m) for m in names}, c("n"), scope=scope))
    if identity is not None:
        rates = {"uid": c("uid_missing_rate"), "login_user": c("login_user_gap_rate"), "identity_integrity": c("identity_integrity_gap")}
        parts.append(_candidates(identity, F.lit("app_version"), slash("app_platform", "app_version", "sdk_version"), "identity_gap", c("uid_missing_count"), rates, one, c("identity_integrity_gap"), scope))
    if shift is not None:
        rates = {"url_distribution": c("distribution_shift_score"), "url_undercount": c("under_rate"), "url_overcount": c("over_rate")}
        parts.append(_candidates(shift, F.lit("sdk_version"), slash("app_platform", "sdk_version"), "url_semantic_gap", c("under_count") + c("over_count"), rates, one, c("distribution_shift_score"), scope))
    if kpi is not None:
        rates = {"purchase_event": c("purchase_event_gap_rate"), "conversion": c("conversion_gap_rate"), "revenue_proxy": c("revenue_proxy_gap_rate"), "business_kpi": c("business_kpi_distortion_score")}
        # its concentration is the strongest rate over the summed distortion
        rows = kpi.withColumn("_top", F.greatest(*rates.values()))
        part = _candidates(rows, F.lit("business_kpi"), F.lit("all:all"), "business_kpi_gap", c("_top"), rates, one, scope=scope)
        total = rows.groupBy(*scope).agg(F.sum("business_kpi_distortion_score").alias("_d"), F.sum("_top").alias("_t"))
        share = N.safe_div("_t", F.when(c("_d") > 0, c("_d")).otherwise(c("_t")))
        parts.append(part.drop("segment_concentration").join(total.select(*scope, share.alias("segment_concentration")), list(scope)).select(*part.columns))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    if context is not None:
        out = out.join(context.select(*scope, "max_statistical_score", "max_co_movement"), list(scope), "left").fillna(0, subset=["max_statistical_score", "max_co_movement"])
    else:
        out = out.withColumn("max_statistical_score", F.lit(0.0)).withColumn("max_co_movement", F.lit(0.0))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v, lambda acc: acc / F.size(a))
    # exact duplicates of an affected name cannot occur: names are fixed per table
    out = out.select(
        "*", F.size("affected").alias("affected_metrics"), F.array_max("_r").alias("max_gap"), mean(c("_r")).alias("avg_gap"), N.clamp01(mean(F.transform("_r", lambda v: F.least(v, F.lit(1.0))))).alias("kpi_distortion_score"),
    )
    out = out.select(
        "*", N.clamp01(c("affected_metrics") / 5.0).alias("multi_metric_gap_score"), N.clamp01(F.greatest("max_gap", "avg_gap") * 3).alias("baseline_deviation_score"),
    )
    out = out.select(
        "*", F.greatest(c("max_statistical_score"), c("baseline_deviation_score") * 0.65, c("kpi_distortion_score") * 0.55).alias("statistical_severity_score"),
        N.clamp01(0.55 * c("multi_metric_gap_score") + 0.25 * c("max_co_movement") + 0.20 * F.when(c("affected_metrics") >= 3, 1.0).otherwise(0.0)).alias("propagation_strength"),
    )
    confidence = N.clamp01(0.30 * c("segment_concentration") + 0.25 * c("multi_metric_gap_score") + 0.25 * c("statistical_severity_score") + 0.20 * c("propagation_strength"))
    out = out.withColumn("root_cause_confidence", confidence)
    return out.select(
        *scope, "root_cause_dimension", "root_cause_value", "source_table", "evidence_row_count", "segment_concentration", "affected_metrics", F.concat_ws(",", "affected").alias("affected_metric_list"),
        "propagation_strength", N.level_band("propagation_strength", "propagation").alias("propagation_level"), "statistical_severity_score", N.level_band("statistical_severity_score").alias("statistical_severity_level"),
        "kpi_distortion_score", "root_cause_confidence", N.level_band("root_cause_confidence", "confidence").alias("confidence_level"),
        N.level_band("root_cause_confidence", ([(0.55, "SIGNAL"), (0.30, "WATCH")], "PASS")).alias("analysis_status"),
    )


def merge_candidates(candidates: DataFrame, scope=SCOPE) -> DataFrame:
    """One row per dimension and value: the strongest candidate, its sources joined, evidence rows summed."""
    keys = [*scope, "root_cause_dimension", "root_cause_value"]
    rest = [c for c in candidates.columns if c not in (*keys, "source_table", "evidence_row_count")]
    best = F.max_by(F.struct(*rest), F.struct("root_cause_confidence", "affected_metrics", "source_table"))
    out = candidates.groupBy(*keys).agg(best.alias("b"), F.array_join(F.array_sort(F.collect_set("source_table")), ",").alias("source_table"), F.sum("evidence_row_count").alias("evidence_row_count"))
    return out.select(*keys, "source_table", "evidence_row_count", "b.*")


def top_root_causes(merged: DataFrame, scopes: DataFrame, n: int = 20, scope=SCOPE) -> DataFrame:
    """Ranked root causes, at most ``n`` per scope; a scope without any gets one NO_SIGNAL row."""
    order = [F.desc("root_cause_confidence"), F.asc("root_cause_dimension"), F.asc("root_cause_value")]
    ranked = merged.withColumn("root_cause_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col("root_cause_rank") <= max(1, n))
    none = scopes.select(*scope).distinct().join(merged.select(*scope).distinct(), list(scope), "left_anti")
    blank = none.select(
        *scope, F.lit("none").alias("root_cause_dimension"), F.lit("none").alias("root_cause_value"), F.lit(0.0).alias("root_cause_confidence"), F.lit(0).alias("affected_metrics"),
        F.lit("weak").alias("confidence_level"), F.lit("none").alias("propagation_level"), F.lit("NO_SIGNAL").alias("analysis_status"), F.lit("none").alias("source_table"), F.lit(1).alias("root_cause_rank"),
    )
    return ranked.unionByName(blank, allowMissingColumns=True)


# --- propagation and evidence ----------------------------------------------------

DOMAINS = ("behavior", "transaction", "state", "conversion", "attribution")


def propagation_evidence(rows: DataFrame) -> DataFrame:
    """How far a mismatch reached: five domain impacts, strength, level and confidence.

    ``rows`` has the reconciliation measures and batch_behavior_score,
    batch_conversion_score, obs_gap_score, statistical_score, sample_days,
    baseline_quality_score, evidence_rows and runtime_evidence_score.
    """
    n = num
    bt, ts = N.clamp01(1 - n("behavior_transaction_match_rate")), N.clamp01(1 - n("transaction_state_match_rate"))
    b_total = F.greatest(n("behavior_transaction_total_count"), n("behavior_only_count") + n("behavior_transaction_matched_count") + n("transaction_only_count"), F.lit(1.0))
    s_total = F.greatest(n("transaction_state_total_count"), n("orphan_state_count") + n("transaction_without_state_count") + n("transaction_state_matched_count"), F.lit(1.0))
    b_only, t_only = N.clamp01(n("behavior_only_count") / b_total), N.clamp01(n("transaction_only_count") / b_total)
    orphan, no_state = N.clamp01(n("orphan_state_count") / s_total), N.clamp01(n("transaction_without_state_count") / s_total)
    impacts = {
        "behavior": F.greatest(n("batch_behavior_score"), n("obs_gap_score"), bt * 0.35, b_only * 1.20),
        "transaction": F.greatest(bt * 0.65, t_only * 2.0, n("payment_order_gap"), n("coupon_reconciliation_gap")),
        "state": F.greatest(ts * 0.85, orphan * 1.25, no_state * 1.50, n("refund_transition_gap")),
        "conversion": F.greatest(F.abs(n("conversion_gap")), n("batch_conversion_score"), n("obs_gap_score") * 0.75),
        "attribution": F.greatest(b_only * 1.50, t_only * 2.0, n("coupon_reconciliation_gap"), n("propagation_distortion_count") / b_total),
    }
    out = rows.select("*", *[N.clamp01(e).alias(f"{d}_impact_score") for d, e in impacts.items()], is_reference().alias("_calm"))
    c = F.col
    cols = {d: c(f"{d}_impact_score") for d in DOMAINS}
    hit = F.array_compact(F.array(*[F.when(e >= 0.10, F.lit(d)) for d, e in cols.items()]))
    only = F.array(N.dominant(cols))
    listed = F.when(F.size(hit) > 0, hit).when(F.greatest(*cols.values()) > 0, only).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("_domains", F.when(c("_calm"), F.array().cast("array<string>")).otherwise(listed))
    strength = N.clamp01(
        0.30 * cols["behavior"] + 0.22 * F.greatest(cols["transaction"], cols["attribution"]) + 0.18 * cols["conversion"] + 0.15 * cols["state"]
        + 0.10 * F.size("_domains") / 5.0 + 0.05 * F.greatest(n("statistical_score"), n("runtime_evidence_score"))
    )
    out = out.withColumn("propagation_strength", F.when(c("_calm"), 0.0).otherwise(strength))
    s = c("propagation_strength")
    level = F.when(s >= 0.85, "critical").when(s >= 0.70, "high").otherwise(N.level_band(s))
    size = N.clamp01(F.log10(F.greatest(
        n("behavior_event_count") + n("transaction_event_count") + n("state_event_count"), n("behavior_transaction_total_count") + n("transaction_state_total_count"), F.lit(0.0)) + 1) / 4.0)
    quality = F.when(n("baseline_quality_score") > 0, n("baseline_quality_score")).otherwise(F.when(n("sample_days") >= 3, 0.8).otherwise(0.35))
    present = F.when(n("evidence_rows") > 0, 1.0).otherwise(0.0)
    trust = N.clamp01(0.40 * size + 0.25 * present + 0.20 * N.clamp01(n("sample_days") / 7.0) + 0.15 * N.clamp01(quality))
    return out.select(
        "*", level.alias("propagation_level"), F.size("_domains").alias("affected_domain_count"), F.to_json("_domains").alias("affected_domains"), trust.alias("reconciliation_confidence")
    ).drop("_calm", "_domains")


def gap_inputs(app: DataFrame, sdk: DataFrame, identity: DataFrame, shift: DataFrame, metric: DataFrame, kpi: DataFrame, scope=SCOPE) -> DataFrame:
    """What the evidence layer reads from the gap tables, one row per scope."""
    top = lambda *names: F.greatest(*[F.max(x) for x in names]) if len(names) > 1 else F.max(names[0])
    name = F.lower("metric_name")
    parts = [
        segment_concentration(app, scope).select(*scope, F.col("concentration").alias("_app")), segment_concentration(sdk, scope).select(*scope, F.col("concentration").alias("_sdk")),
        identity.groupBy(*scope).agg(top("identity_integrity_gap", "uid_missing_rate", "login_user_gap_rate").alias("identity_integrity_score")),
        shift.groupBy(*scope).agg(top("distribution_shift_score", "under_rate", "over_rate").alias("semantic_shift_score")),
        metric.groupBy(*scope).agg(
            F.max("gap_rate").alias("max_gap_rate"), F.max(F.when(name.isin("conversion", "purchase", "order_complete", "payment"), F.col("gap_rate"))).alias("_mc"),
            F.max(F.when(name.isin("pv", "page_view", "event_count"), F.col("gap_rate"))).alias("_mp")),
        kpi.groupBy(*scope).agg(top("conversion_gap_rate", "purchase_event_gap_rate").alias("_kc"), F.max("pv_gap_rate").alias("_kp")),
    ]
    j = _joined(parts, scope).fillna(0)
    return j.select(
        *scope, N.clamp01(F.greatest("_app", "_sdk", "identity_integrity_score", "semantic_shift_score")).alias("segment_concentration"),
        N.clamp01("identity_integrity_score").alias("identity_integrity_score"), N.clamp01("semantic_shift_score").alias("semantic_shift_score"), "max_gap_rate",
        F.greatest("_mc", "_kc").alias("conversion_gap_rate"), F.greatest("_mp", "_kp").alias("pv_gap_rate"),
    )


EVIDENCE = (
    "reconciliation_gap_score", "propagation_score", "amplification_score", "distortion_score", "transaction_loss_score", "customer_impact_score", "baseline_evidence", "statistical", "propagation",
    "impact", "concentration", "criticality", "identity_integrity", "semantic_shift",
)


def criticality(c: Column, t: Column, d: Column) -> Column:
    return F.when((c >= 0.50) & (t >= 0.45), F.greatest(F.lit(0.75), d)).when((c >= 0.30) & (t >= 0.30), F.greatest(F.lit(0.45), d * 0.85)).otherwise(c * 0.35)


def reliability_evidence(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Evidence scores of a scope, from reconciliation, gaps, statistics and runtime.

    ``rows`` joins the reconciliation measures, ``gap_inputs``, statistical_score,
    cross_domain_strength and runtime_evidence_score. Reference scenarios score 0.
    ``compat`` leaves matched rows out of the amplification denominator.
    """
    n = num
    b, t = n("behavior_only_count"), n("transaction_only_count")
    no_state, orphan = n("transaction_without_state_count"), n("orphan_state_count")
    one = F.lit(1.0)
    matched = F.lit(0.0) if compat else n("behavior_transaction_matched_count")
    out = rows.select(
        "*", is_reference().alias("_calm"),
        N.clamp01((1 - n("behavior_transaction_match_rate")) * 0.25 + (1 - n("transaction_state_match_rate")) * 0.20).alias("reconciliation_gap_score"),
        N.clamp01(no_state / F.greatest(no_state + orphan, one)).alias("propagation_score"), N.clamp01(b / F.greatest(b + matched, one)).alias("amplification_score"),
        N.clamp01(b / F.greatest(b + 1, one) * 0.22 + t / F.greatest(b + t, one) * 0.10).alias("distortion_score"), N.clamp01(t / F.greatest(b + t, one)).alias("transaction_loss_score"),
        N.clamp01("statistical_score").alias("statistical"), N.clamp01("cross_domain_strength").alias("propagation"), N.clamp01("segment_concentration").alias("concentration"),
        N.clamp01("identity_integrity_score").alias("identity_integrity"), N.clamp01("semantic_shift_score").alias("semantic_shift"),
        traffic_preservation("pv_gap_rate").alias("traffic_preservation"),
    )
    c = F.col
    out = out.select(
        "*", kpi_distortion("conversion_gap_rate", "traffic_preservation").alias("business_kpi_distortion"),
        N.clamp01(0.35 * c("distortion_score") + 0.25 * c("reconciliation_gap_score") + 0.20 * c("propagation_score")).alias("customer_impact_score"),
    )
    core = F.greatest(
        0.40 * c("reconciliation_gap_score") + 0.20 * c("distortion_score") + 0.15 * c("transaction_loss_score") + 0.10 * c("propagation_score") + 0.15 * c("propagation"), c("statistical"), 0.85 * c("propagation")
    )
    out = out.select(
        "*", N.clamp01(0.88 * N.clamp01(core) + 0.12 * n("runtime_evidence_score")).alias("baseline_evidence"),
        N.clamp01(F.greatest("customer_impact_score", "transaction_loss_score", "reconciliation_gap_score")).alias("impact"),
        N.clamp01(criticality(n("conversion_gap_rate"), c("traffic_preservation"), c("business_kpi_distortion"))).alias("criticality"),
    )
    keep = [x for x in out.columns if x not in EVIDENCE and x != "_calm"]
    visible = F.when(c("_calm"), 1.0).otherwise(N.clamp01(1 - n("max_gap_rate") * 0.25))
    return out.select(*keep, *[F.when(c("_calm"), 0.0).otherwise(c(e)).alias(e) for e in EVIDENCE], visible.alias("visibility_score"))
