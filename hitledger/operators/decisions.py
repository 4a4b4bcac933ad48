"""Evidence to decision: pattern, mechanism, risk, class and ranked actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N, rules as R, text as X
from .evidence import is_reference, num

SCOPE = ("profile_id", "dt", "scenario_name")
c = F.col


def pattern(evidence: DataFrame, localized: float = 0.15, silent: float = 0.60, silent_kpi: float = 0.60) -> DataFrame:
    """Failure pattern of each row, first rule wins, with its confidence."""
    hb = F.greatest("baseline_evidence", "statistical")
    im, pr, co, cr = c("impact"), c("propagation"), c("concentration"), c("criticality")
    rec, d, t = c("reconciliation_gap_score"), c("business_kpi_distortion"), c("traffic_preservation")
    hurt = F.greatest(c("transaction_loss_score"), c("customer_impact_score"), im)
    rules = [
        ("stable", is_reference() | (F.greatest(hb, im, pr, co, cr) < 0.08), F.lit(1.0)),
        ("silent_distortion", (cr >= silent) & (d >= silent_kpi) & (t >= 0.30), 0.35 * cr + 0.30 * d + 0.20 * t + 0.15 * hb),
        ("localized_failure", co >= localized, 0.50 * co + 0.30 * hb + 0.20 * F.greatest(im, cr)),
        ("reconciliation_failure", (rec >= 0.15) & (hurt >= 0.08), 0.45 * rec + 0.35 * hurt + 0.20 * hb),
        ("systemic_failure", (pr >= 0.55) & (F.greatest(hb, im) >= 0.20), 0.45 * pr + 0.35 * hb + 0.20 * im),
        ("emerging_reliability_degradation", F.lit(True), 0.40 * hb + 0.25 * im + 0.20 * pr + 0.15 * F.greatest(co, cr)),
    ]
    name, trust = None, None
    for label, cond, confidence in rules:
        name = F.when(cond, label) if name is None else name.when(cond, label)
        trust = F.when(cond, N.clamp01(confidence)) if trust is None else trust.when(cond, N.clamp01(confidence))
    return evidence.select("*", name.alias("risk_pattern"), trust.alias("pattern_confidence"))


def failure_mechanism(rows: DataFrame) -> DataFrame:
    """The concrete way a pattern failed, where that shows, and how sure it is."""
    p, t, g = c("risk_pattern"), c("traffic_preservation"), num("pv_gap_rate")
    ident, shift, co, cr, pc = c("identity_integrity"), c("semantic_shift"), c("concentration"), c("criticality"), c("pattern_confidence")
    local = p == "localized_failure"
    trust = num("reconciliation_confidence") if "reconciliation_confidence" in rows.columns else F.lit(0.0)
    rules = [
        ("none", "none", (p == "stable") | is_reference(), F.lit(1.0)),
        ("critical_event_loss", "purchase_event_criticality", (p == "silent_distortion") & (cr >= 0.60), F.greatest(cr, c("business_kpi_distortion"), pc)),
        ("identity_integrity_breakage", "app_version_concentration", local & (ident >= F.greatest(shift, F.lit(0.10))) & (t >= 0.30), F.greatest(ident, co, pc)),
        ("semantic_attribution_distortion", "sdk_version_concentration", local & (shift >= 0.10) & (t >= 0.30) & (g <= 0.25), F.greatest(shift, co, pc)),
        ("collection_completeness_loss", "broad_collection_gap", local, F.greatest(co, pc, 1 - t)),
        ("cross_domain_mapping_gap", "behavior_transaction_state_reconciliation", p == "reconciliation_failure", F.greatest(trust, pc)),
        ("systemic_observability_degradation", "multi_domain_propagation", p == "systemic_failure", F.greatest(c("propagation"), pc)),
        ("emerging_reliability_degradation", "mixed_evidence_primitives", F.lit(True), pc),
    ]
    picks = [None, None, None]
    for name, source, cond, confidence in rules:
        for k, value in enumerate((F.lit(name), F.lit(source), N.clamp01(confidence))):
            picks[k] = F.when(cond, value) if picks[k] is None else picks[k].when(cond, value)
    return rows.select("*", *[e.alias(n) for e, n in zip(picks, ("failure_mechanism", "mechanism_source", "mechanism_confidence"))])


def _weighted(weights: dict) -> Column:
    """Weighted sum per pattern; patterns without weights of their own use ``other``."""
    total = lambda w: N.clamp01(sum(c(f"_{n}") * x for n, x in w.items()))
    out = F.when(c("risk_pattern") == "stable", 0.0)
    for p, w in weights.items():
        if p != "other":
            out = out.when(c("risk_pattern") == p, total(w))
    return out.otherwise(total(weights["other"]))


def risk(rows: DataFrame) -> DataFrame:
    """Risk as likelihood times impact; confidence is kept beside it, never in it."""
    known = c("risk_pattern").isin(*R.CLASSES)
    rows = rows.withColumn("risk_pattern", F.when(known, c("risk_pattern")).otherwise("emerging_reliability_degradation"))
    weak = N.clamp01(F.greatest("baseline_evidence", "statistical", "propagation", "impact"))
    rows = rows.withColumn("pattern_confidence", F.when((num("pattern_confidence") <= 0) & ~is_reference(), weak).otherwise(N.clamp01("pattern_confidence")))
    opt = lambda n: num(n) if n in rows.columns else F.lit(0.0)
    kpi = F.coalesce(c("kpi_distortion_impact_score"), c("impact")) if "kpi_distortion_impact_score" in rows.columns else c("impact")
    features = {
        "baseline_evidence": c("baseline_evidence"), "statistical": c("statistical"), "propagation": c("propagation"), "impact": c("impact"), "concentration": c("concentration"), "criticality": c("criticality"),
        "pattern_confidence": c("pattern_confidence"), "pattern_or_mechanism": F.greatest(c("pattern_confidence"), num("mechanism_confidence")), "identity_or_shift": F.greatest("identity_integrity", "semantic_shift"),
        "customer_impact": N.clamp01("customer_impact_score"), "transaction_loss": N.clamp01("transaction_loss_score"), "kpi_distortion": N.clamp01(kpi), "affected_domains": N.clamp01(opt("affected_domain_count") / 5.0),
        "runtime_impact": N.clamp01(sum(opt(f"{n}_evidence_score") * w for n, w in R.RUNTIME_IMPACT.items())),
    }
    d = rows.select("*", *[e.alias(f"_{n}") for n, e in features.items()])
    off = is_reference() | (c("risk_pattern") == "stable")
    d = d.withColumn("likelihood_score", F.when(off, 0.0).otherwise(_weighted(R.LIKELIHOOD))).withColumn("impact_score", F.when(off, 0.0).otherwise(_weighted(R.IMPACT)))
    score = N.clamp01(c("likelihood_score") * c("impact_score"))
    trust = N.clamp01(F.greatest(opt("reconciliation_confidence"), c("pattern_confidence"), num("mechanism_confidence")))
    d = d.select(*rows.columns, "likelihood_score", "impact_score", score.alias("overall_risk_score"), trust.alias("confidence_score"))
    return d.select(
        "*", N.level_band("overall_risk_score").alias("final_risk_level"), N.level_band("confidence_score", "risk_confidence").alias("confidence_level"),
        F.when(c("overall_risk_score") > 0, "Reliability Risk").otherwise("None").alias("risk_classification"),
    )


def classify(rows: DataFrame) -> DataFrame:
    """Class, catalog key, template, rule and root-cause label of a risk row.

    ``rows`` may carry root_cause_dimension, root_cause_label and
    root_cause_confidence of the top root cause.
    """
    quiet = (c("risk_pattern") == "stable") | (c("final_risk_level") == "stable")
    key = F.when(quiet, "stable").when(c("risk_pattern").isin(*R.CLASSES), c("risk_pattern")).otherwise("emerging_reliability_degradation")
    table = F.create_map(*[x for p, v in R.CLASSES.items() for x in (F.lit(p), F.struct(*[F.lit(y).alias(n) for y, n in zip(v, ("a", "b", "c", "d"))]))])
    entry = F.try_element_at(table, key)
    dim = X.lower0("root_cause_dimension") if "root_cause_dimension" in rows.columns else F.lit("")
    label = F.nullif(F.nullif(c("root_cause_label"), F.lit("")), F.lit("none")) if "root_cause_label" in rows.columns else F.lit(None).cast("string")
    guess = F.lit("UNKNOWN_ROOT_CAUSE")
    for words, name in reversed(R.DIMENSION_LABELS):
        guess = F.when(dim.rlike(words), name).otherwise(guess)
    by_mechanism = F.create_map(*[F.lit(x) for p in R.ROOT_LABELS.items() for x in p])
    off = (c("risk_pattern") == "stable") | is_reference() | (c("overall_risk_score") < R.ACTION_THRESHOLD)
    cause = F.when(off, "NONE").otherwise(F.coalesce(F.try_element_at(by_mechanism, c("failure_mechanism")), label, guess))
    seen = num("root_cause_confidence") if "root_cause_confidence" in rows.columns else F.lit(0.0)
    trust = F.when(off, 0.0).otherwise(F.greatest(c("confidence_score"), seen, num("mechanism_confidence")))
    keep = [x for x in rows.columns if x not in ("root_cause_confidence",)]
    return rows.select(
        *keep, entry["a"].alias("classification"), entry["b"].alias("catalog_key"), entry["c"].alias("narrative_template_id"), entry["d"].alias("mapping_rule_id"),
        F.when(quiet, 0.0).otherwise(R.CLASS_THRESHOLD).alias("evidence_threshold"), F.when(c("risk_pattern") == "stable", c("overall_risk_score")).otherwise(c("pattern_confidence")).alias("evidence_value"),
        cause.alias("root_cause_candidate"), trust.alias("root_cause_confidence"),
    )


def _catalog(rows) -> Column:
    fields = ("action_type", "recommended_action", "evidence_metric")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, fields)]) for r in rows])


def authority_actions(classified: DataFrame, scope=SCOPE) -> DataFrame:
    """Catalog rows of each decision: none below the action threshold."""
    p, m = c("risk_pattern"), c("failure_mechanism")
    act = ~is_reference() & ~F.lower("classification").isin("none", "") & c("final_risk_level").isin("low", "warning", "high", "critical") & (c("overall_risk_score") >= R.ACTION_THRESHOLD)
    rows = F.when(~act | (p == "stable") | (c("catalog_key") == "none"), _catalog(R.ACTIONS["stable"]))
    local = (p == "localized_failure") | (c("catalog_key") == "localized_reliability")
    for mechanism in ("identity_integrity_breakage", "semantic_attribution_distortion"):
        rows = rows.when(local & (m == mechanism), _catalog(R.ACTIONS[mechanism]))
    rows = rows.when(local, _catalog(R.ACTIONS["localized_failure"]))
    for name in ("systemic_failure", "silent_distortion", "reconciliation_failure", "interpretation_failure"):
        rows = rows.when((p == name) | (c("catalog_key") == R.CLASSES[name][1]), _catalog(R.ACTIONS[name]))
    rows = rows.otherwise(_catalog(R.ACTIONS["other"]))
    out = classified.select(*scope, act.alias("_act"), "risk_pattern", "catalog_key", "classification", "overall_risk_score", F.posexplode(rows).alias("_pos", "a"))
    calm = lambda e, v: F.when(c("_act"), e).otherwise(v)
    value = F.when(c("a.evidence_metric").isin(*R.SCORED_METRICS), c("overall_risk_score")).otherwise(1.0)
    return out.select(
        *scope, (c("_pos") + 1).alias("action_rank"), "a.action_type", "a.recommended_action", "a.evidence_metric", value.alias("evidence_value"), F.lit("authority_action").alias("action_layer"),
        calm(c("risk_pattern"), "stable").alias("risk_pattern"), calm(c("catalog_key"), "none").alias("catalog_key"),
    )


def reference_actions(root_causes: DataFrame, top: int = 5, scope=SCOPE) -> DataFrame:
    """Supporting checks from the ``top`` root causes, each kind once, in rank order."""
    dim, value = X.lower0("root_cause_dimension"), F.coalesce(F.nullif("root_cause_value", F.lit("")), F.lit("UNKNOWN"))
    pick = None
    for words, key, kind, sentence in R.REFERENCE_ACTIONS:
        head, tail = sentence.split("{}")
        row = F.struct(F.lit(key).alias("key"), F.lit(kind).alias("action_type"), F.concat(F.lit(head), value, F.lit(tail)).alias("recommended_action"))
        cond = dim.rlike(words)
        pick = F.when(cond, row) if pick is None else pick.when(cond, row)
    rows = root_causes.where(c("root_cause_rank") <= top).select(*scope, "root_cause_rank", "root_cause_confidence", pick.alias("a")).where("a IS NOT NULL")
    first = rows.groupBy(*scope, c("a.key").alias("key")).agg(F.min_by(F.struct("root_cause_rank", "root_cause_confidence", "a"), "root_cause_rank").alias("f"))
    return first.select(*scope, "key", "f.root_cause_rank", c("f.a.action_type").alias("action_type"), c("f.a.recommended_action").alias("recommended_action"), c("f.root_cause_confidence").alias("evidence_value"))


def recommend_actions(classified: DataFrame, root_causes: DataFrame, scope=SCOPE) -> DataFrame:
    """Authority actions first in catalog order, then reference actions, in one ranking."""
    main = authority_actions(classified, scope)
    head = main.groupBy(*scope).agg(F.count("*").alias("_n"), F.max((c("risk_pattern") == "stable").cast("int")).alias("_stable"))
    extra = reference_actions(root_causes, scope=scope).join(head.where("_stable = 0"), list(scope))
    # at most one row per kind of check, so the array per scope is bounded
    listed = extra.groupBy(*scope, "_n").agg(F.array_sort(F.collect_list(F.struct("root_cause_rank", "key", "action_type", "recommended_action", "evidence_value"))).alias("l"))
    ranked = listed.select(*scope, "_n", F.posexplode("l").alias("_pos", "a")).select(
        *scope, (c("_n") + c("_pos") + 1).alias("action_rank"), "a.action_type", "a.recommended_action", F.lit("root_cause_confidence").alias("evidence_metric"), "a.evidence_value", F.lit("reference_obs_action").alias("action_layer"),
    )
    return main.unionByName(ranked, allowMissingColumns=True)


def observability_actions(analysis: DataFrame, scope=SCOPE) -> DataFrame:
    """Actions for a collection risk whose score is high enough."""
    score = c("observability_overall_score")
    pick = None
    for label, rows in R.OBSERVABILITY_ACTIONS.items():
        items = F.array(*[F.struct(F.lit(a).alias("action_type"), F.lit(b).alias("recommended_action")) for a, b in rows])
        cond = c("recommended_semantic_risk") == label
        pick = F.when(cond, items) if pick is None else pick.when(cond, items)
    return analysis.where(score >= R.OVERRIDE_SCORE).select(*scope, score.alias("score"), F.posexplode(pick).alias("_pos", "a")).select(
        *scope, (c("_pos") + 1).alias("action_rank"), "a.action_type", "a.recommended_action", "score"
    )


def semantic_override(classified: DataFrame, analysis: DataFrame, scope=SCOPE) -> DataFrame:
    """Replace the class by the observability label where its score calls for it; add missing scopes."""
    a = analysis.where((c("observability_overall_score") >= R.OVERRIDE_SCORE) & (c("recommended_semantic_risk") != "None")).select(
        *scope, c("recommended_semantic_risk").alias("_label"), c("observability_overall_score").alias("_score")
    )
    j = classified.select(*scope, "classification", "root_cause_confidence", "overall_risk_score").join(a, list(scope), "full_outer")
    hit = c("_label").isNotNull()
    return j.select(
        *scope, F.coalesce("_label", "classification").alias("dominant_semantic_risk"), F.when(hit, 1.0).otherwise(c("root_cause_confidence")).alias("semantic_confidence"),
        F.when(hit, c("_score")).otherwise(c("overall_risk_score")).alias("max_raw_score"), hit.cast("int").alias("overridden"),
    )


# --- older chain: five dimensions ---------------------------------------------------

DIMENSIONS = ("Completeness", "Timeliness", "Availability", "Integrity", "Consistency")


def _mean_over(scores: dict, cut: float) -> Column:
    kept = F.filter(F.array(*scores.values()), lambda s: s > cut)
    return F.aggregate(kept, F.lit(0.0), lambda a, s: a + s) / F.greatest(F.lit(1), F.size(kept))


def dimension_reliability(rows: DataFrame) -> DataFrame:
    """Five dimension scores, the dominant one, and how it fits the expected family."""
    n = num
    scores = {
        "Completeness": N.clamp01(F.greatest(n("completeness_delta"), n("batch_quality_score"), n("mapping_risk_score") * 0.8)),
        "Timeliness": N.clamp01("timeliness_delta"), "Availability": N.clamp01("availability_delta"),
        "Integrity": N.clamp01(F.greatest(n("integrity_delta"), n("behavior_distortion_score"), n("conversion_distortion_score"))),
        "Consistency": N.clamp01(F.greatest(n("session_fragmentation_score"), n("identity_anomaly_score"), n("channel_imbalance_score"))),
    }
    d = rows.select("*", *[e.alias(f"{k.lower()}_score") for k, e in scores.items()])
    cols = {k: c(f"{k.lower()}_score") for k in DIMENSIONS}
    score_of = F.create_map(*[x for k, e in cols.items() for x in (F.lit(k), e)])
    family = F.create_map(*[F.lit(x) for p in R.EXPECTED_DIMENSION.items() for x in p])
    best = N.dominant(cols, none="Completeness")
    expected = F.coalesce(F.try_element_at(family, c("expected_risk_family")), best)
    d = d.withColumn("expected_dimension", expected)
    own = F.coalesce(F.try_element_at(score_of, c("expected_dimension")), F.lit(0.0)) > 0
    dom = F.when((c("expected_dimension") != "None") & own, c("expected_dimension")).when(F.greatest(*cols.values()) <= 0.0001, "None").otherwise(best)
    d = d.withColumn("dominant_dimension", dom)
    d = d.withColumn("source_delta", F.coalesce(F.try_element_at(score_of, c("dominant_dimension")), F.lit(0.0)))
    delta, overall = c("source_delta"), n("batch_overall_score")
    align = F.when((c("expected_dimension") == "None") & (delta == 0), 1.0).when(c("expected_dimension") == c("dominant_dimension"), 1.0).otherwise(0.0)
    d = d.withColumn("semantic_alignment_score", align)
    broad = F.size(F.filter(F.array(*cols.values()), lambda s: s > 0.2)) >= 2
    several = F.size(F.filter(F.array(*cols.values()), lambda s: s > 0.05)) >= 2
    spread = N.clamp01(F.greatest(delta, _mean_over(cols, 0.05), overall))
    layer = F.create_map(*[F.lit(x) for p in R.DIMENSION_LAYER.items() for x in p])
    return d.select(
        "*", N.clamp01(F.greatest(F.when(delta == 0, 0.0).otherwise(1 - c("semantic_alignment_score")), n("behavior_distortion_score"), n("conversion_distortion_score"))).alias("distortion_score"),
        spread.alias("propagation_score"), N.clamp01(F.greatest(delta, overall)).alias("drift_score"),
        N.clamp01(F.greatest(F.when((delta >= 0.7) | broad, spread).otherwise(0.0), n("channel_imbalance_score"), n("conversion_distortion_score") * 0.7)).alias("amplification_score"),
        F.when(several, N.clamp01(_mean_over(cols, 0.05))).otherwise(delta).alias("correlation_score"),
        F.coalesce(F.try_element_at(layer, c("dominant_dimension")), F.lit("integrated")).alias("dominant_layer"),
    )


SEMANTIC_ORDER = ("Integrity", "Completeness", "Timeliness", "Consistency", "Availability")


def semantic_dimension(rows: DataFrame) -> DataFrame:
    """Dominant and secondary dimension; the expected one wins where it has a score."""
    cols = {k: c(f"{k.lower()}_score") for k in SEMANTIC_ORDER}
    score_of = F.create_map(*[x for k, e in cols.items() for x in (F.lit(k), e)])
    family = F.create_map(*[F.lit(x) for p in R.EXPECTED_DIMENSION.items() for x in p])
    expected = F.coalesce(F.try_element_at(family, c("expected_risk_family")), F.lit("Unknown"))
    own = F.coalesce(F.try_element_at(score_of, expected), F.lit(0.0)) > 0
    dom = F.when(own, expected).when(F.greatest(*cols.values()) <= 0.0001, "None").otherwise(N.dominant(cols))
    d = rows.withColumn("dominant_semantic", dom)
    d = d.withColumn("semantic_confidence", F.coalesce(F.try_element_at(score_of, c("dominant_semantic")), F.lit(0.0)))
    items = F.array(*[F.struct(e.alias("s"), F.lit(-i).alias("k"), F.lit(k).alias("n")) for i, (k, e) in enumerate(cols.items())])
    second = F.get(F.sort_array(F.filter(items, lambda x: x["n"] != c("dominant_semantic")), asc=False), F.lit(0))
    return d.withColumn("secondary_semantic", F.when(second["s"] > 0.05, second["n"]).otherwise("None"))


def unified_score(rows: DataFrame) -> DataFrame:
    parts = N.clamp01("semantic_confidence") + N.clamp01(num("amplification_score") * 0.15) + N.clamp01(num("distortion_score") * 0.10) + N.clamp01(num("drift_score") * 0.10)
    # rounded, so that a score on a limit does not depend on summation order
    return rows.withColumn("overall_score", N.clamp01(parts)).withColumn(
        "overall_level", N.level_band(F.round("overall_score", 9), ([(0.8, "CRITICAL"), (0.5, "HIGH"), (0.2, "WARN")], "STABLE"))
    )


def rule_action(rows: DataFrame) -> DataFrame:
    """Action, cause and priority of a dominant dimension."""
    table = F.create_map(*[x for k, v in R.DIMENSION_ACTIONS.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for y, n in zip(v, ("action", "cause", "priority"))]))])
    calm = (c("dominant_semantic") == "None") | (c("semantic_confidence") <= 0.0001)
    known = c("dominant_semantic").isin(*R.DIMENSION_ACTIONS)
    key = F.when(calm, "None").when(known, c("dominant_semantic")).otherwise("Unknown")
    a = F.try_element_at(table, key)
    return rows.select("*", a["action"].alias("recommended_action"), a["cause"].alias("root_cause_direction"), a["priority"].alias("priority"), F.when(calm, 1.0).otherwise(c("semantic_confidence")).alias("alignment_score"))


# --- cases and traces -----------------------------------------------------------------


def case_evidence(canonical: DataFrame, scope=("profile_id", "dt"), cases: dict | None = None) -> DataFrame:
    """Per scope and case: matching rows, drifted and mismatched ones, users, share of all rows."""
    cases = R.CASES if cases is None else cases
    tests = []
    for name, rule in cases.items():
        cond = F.lit(True)
        for col, want in rule["evidence"].items():
            if col in canonical.columns:
                cond = cond & (F.coalesce(c(col), F.lit("")) == want)
        tests.append(F.when(cond, F.lit(name)))
    total = canonical.groupBy(*scope).agg(F.count("*").alias("total_count"))
    hit = canonical.select("*", F.explode(F.array_compact(F.array(*tests))).alias("case_id"))
    flag = lambda n: c(n) if n in canonical.columns else F.lit("")
    per_user = hit.groupBy(*scope, "case_id", "uid").agg(
        F.count("*").alias("n"), F.count_if(flag("schema_flag") == "drift").alias("d"), F.count_if(~F.coalesce(flag("reconciliation_flag"), F.lit("")).isin("", "none")).alias("r"))
    out = per_user.groupBy(*scope, "case_id").agg(
        F.sum("n").alias("case_count"), F.sum("d").alias("drift_count"), F.sum("r").alias("reconciliation_count"), F.count("uid").alias("affected_uid_count"))
    return out.join(total, list(scope)).withColumn("case_event_ratio", c("case_count") / c("total_count"))


def case_rule_decision(evidence: DataFrame, scores: DataFrame, scope=("profile_id", "dt"), cases: dict | None = None) -> DataFrame:
    """Fixed decision of a case with evidence; dimension scores are raised to its floors."""
    cases = R.CASES if cases is None else cases
    entry = F.create_map(*[
        x for name, rule in cases.items() for x in (F.lit(name), F.struct(
            *[F.lit(v).alias(n) for v, n in zip(rule["decision"], ("dominant_semantic_risk", "secondary_semantic_risk", "final_risk_level", "recommended_action", "priority"))],
            *[F.lit(v).alias(f"f_{n}") for n, v in rule["floors"].items()], F.lit(min(1.0, sum(rule["overall"]))).alias("overall_risk_score")))
    ])
    names = list(next(iter(cases.values()))["floors"])
    j = evidence.where("case_count > 0").join(scores, list(scope), "left").withColumn("_r", F.try_element_at(entry, c("case_id")))
    return j.select(
        *scope, "case_id", "case_count", "case_event_ratio", *[F.greatest(num(f"{n}_score"), c("_r")[f"f_{n}"]).alias(f"{n}_score") for n in names],
        *[c("_r")[n].alias(n) for n in ("dominant_semantic_risk", "secondary_semantic_risk", "final_risk_level", "recommended_action", "priority", "overall_risk_score")],
    )


def source_anomaly_trace(measurement: DataFrame, scope=SCOPE) -> DataFrame:
    """Rows a collection anomaly touched, out of all, per scope."""
    return measurement.where("collection_gap_count > 0").select(
        *scope, F.lit("wc_collection_missing").alias("anomaly_type"), F.lit("wc_collector").alias("source_layer"), c("collection_gap_count").alias("affected_count"), c("web_hits").alias("total_count"),
        c("collection_gap_rate").alias("affected_ratio"), c("web_hits").alias("original_count"), c("wc_hits").alias("final_count"),
    )
