"""Data-quality checks and reports over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N, text as X
from .evidence import is_reference

SCOPE = ("profile_id", "dt", "scenario_name")
c = F.col


def _stack(parts) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- lineage --------------------------------------------------------------------


def scenario_identity_audit(tables: dict[str, DataFrame], expected: DataFrame, keys=("profile_id", "dt")) -> DataFrame:
    """Rows of each table by scenario, and how many belong to another scenario than expected.

    ``expected`` has keys and expected_scenario.
    """
    parts = []
    for name, df in tables.items():
        got = df.groupBy(*keys, "scenario_name").agg(F.count("*").alias("row_count"))
        parts.append(got.select(F.lit(name).alias("table_name"), *keys, "scenario_name", "row_count"))
    j = _stack(parts).join(expected, list(keys), "left")
    wrong = c("scenario_name").isNotNull() & c("expected_scenario").isNotNull() & (c("scenario_name") != c("expected_scenario"))
    return j.select("table_name", *keys, "scenario_name", "row_count", F.when(wrong, c("row_count")).otherwise(0).alias("mismatch_count"))


def single_active_run(df: DataFrame, run: str = "source_gen_run_id", scope=SCOPE) -> DataFrame:
    """Scopes with more than one source run, and the runs."""
    runs = df.select(*scope, run).distinct()
    out = runs.groupBy(*scope).agg(F.count(run).alias("run_count"), F.array_join(F.array_sort(F.collect_set(c(run).cast("string"))), ",").alias("runs"))
    return out.where("run_count > 1")


def superseded_runs(df: DataFrame, active: DataFrame, run: str = "source_gen_run_id", scope=SCOPE) -> DataFrame:
    """Earlier runs of a scope than its active one; later ones are never listed."""
    runs = df.select(*scope, run).distinct()
    return runs.join(active.select(*scope, c("active_run")), list(scope)).where(c(run) < c("active_run")).drop("active_run")


def purge_superseded(df: DataFrame, active: DataFrame, run: str = "source_gen_run_id", scope=SCOPE) -> DataFrame:
    """``df`` without the rows of superseded runs, to be written over the old table."""
    return df.join(superseded_runs(df, active, run, scope), [*scope, run], "left_anti")


def metadata_completeness(df: DataFrame, cols, keys=("profile_id",)) -> DataFrame:
    """Rows, rows with a blank in any of the columns, and PASS or FAIL."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(c(x).cast("string"), F.lit("")) == "" for x in cols])
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(blank).alias("null_or_blank"))
    return out.withColumn("status", F.when((c("total") > 0) & (c("null_or_blank") == 0), "PASS").otherwise("FAIL"))


def expected_minus_seen(df: DataFrame, col: str, required, keys=("profile_id",)) -> DataFrame:
    """Required values that a scope never shows."""
    seen = df.select(*keys, col).distinct()
    want = df.select(*keys).distinct().withColumn(col, F.explode(F.array(*[F.lit(r) for r in required])))
    return want.join(seen, [*keys, col], "left_anti")


# --- contracts -------------------------------------------------------------------

# Which rows a scenario must have, and the match rate it must fall below.
CONTRACTS = {
    "behavior_only_anomaly": dict(transactions="zero", states="zero"),
    "transaction_missing_anomaly": dict(transactions="positive", match="behavior_transaction_match_rate", below=0.80, evidence=("behavior_only_count", "transaction_only_count")),
    "state_missing_anomaly": dict(transactions="positive", match="transaction_state_match_rate", below=0.80, evidence=("transaction_without_state_count",), only_with_states=True),
}


def reconciliation_contract(rows: DataFrame) -> DataFrame:
    """Contract failures of each measured scope, by its scenario."""
    n = lambda x: F.coalesce(c(x).cast("double"), F.lit(0.0))
    s, b, t, st = c("scenario_name"), n("behavior_event_count"), n("transaction_event_count"), n("state_event_count")
    fails = [F.when(b <= 0, "missing behavior rows")]
    for name, rule in CONTRACTS.items():
        mine = s == name
        if rule.get("transactions") == "zero":
            fails += [F.when(mine & (t != 0), f"{name} expected no transactions"), F.when(mine & (st != 0), f"{name} expected no states")]
        else:
            fails.append(F.when(mine & (t <= 0), f"{name} expected transactions"))
        if "match" in rule:
            shown = reduce(lambda a, x: a | x, [n(e) > 0 for e in rule["evidence"]])
            bad = (n(rule["match"]) >= rule["below"]) & ~shown
            if rule.get("only_with_states"):
                bad = bad & (st > 0)
            fails.append(F.when(mine & bad, f"{name} expected a degraded match rate"))
    plain = ~s.isin(*CONTRACTS)
    fails += [F.when(plain & (t <= 0), "missing transaction rows"), F.when(plain & (st <= 0), "missing state rows")]
    found = F.array_compact(F.array(*fails))
    return rows.select("*", found.alias("failures")).withColumn("contract_status", F.when(F.size("failures") == 0, "PASS").otherwise("FAIL"))


# --- evidence checks -----------------------------------------------------------------


def scenario_sensitivity(evidence: DataFrame, domains=("batch_metric_delta", "reconciliation_measurement")) -> DataFrame:
    """Days and highest scores per scenario; an anomaly must exceed the baseline."""
    rows = evidence.where(c("evidence_domain").isin(*domains))
    per = rows.groupBy("profile_id", "scenario_name").agg(
        F.count_distinct("dt").alias("days"), F.count("*").alias("row_count"), F.max(F.coalesce("statistical_score", F.lit(0.0))).alias("max_score"), F.max(F.abs("z_score")).alias("max_abs_z"))
    base = per.where("scenario_name = 'baseline'").select("profile_id", c("max_score").alias("baseline_score"))
    j = per.join(base, "profile_id", "left").fillna(0, subset=["baseline_score"])
    return j.withColumn("sensitivity", F.when(c("scenario_name") == "baseline", "REFERENCE").when(c("max_score") > c("baseline_score"), "PASS").otherwise("FAIL"))


def evidence_meaning(evidence: DataFrame, min_days: int = 3, min_sd_ratio: float = 0.0, reference=("observability_expected",)) -> DataFrame:
    """Per domain: enough history, deviation, percentiles and limits to mean something."""
    out = evidence.groupBy(*SCOPE, "evidence_domain").agg(
        F.count("*").alias("row_count"), F.min("sample_days").alias("min_sample_days"), F.max("sample_days").alias("max_sample_days"), F.count_if(c("sample_days") >= min_days).alias("enough_sample_rows"),
        F.count_if(c("baseline_sd") > 0).alias("nonzero_sd_rows"), F.count_if(c("historical_percentile").isNotNull()).alias("percentile_rows"),
        F.count_if(c("control_limit_lower").isNotNull() | c("control_limit_upper").isNotNull()).alias("control_limit_rows"), F.max("statistical_score").alias("max_score"),
    )
    ratio = c("nonzero_sd_rows") / c("row_count")
    batch = ((c("max_sample_days") >= min_days) | (c("enough_sample_rows") > 0)) & (c("percentile_rows") > 0) & (c("control_limit_rows") > 0)
    other = (c("max_sample_days") >= min_days) & (c("enough_sample_rows") > 0) & (c("percentile_rows") == c("row_count")) & (c("control_limit_rows") == c("row_count")) & (ratio >= min_sd_ratio)
    state = F.when(c("evidence_domain").isin(*reference), "REFERENCE").when(F.when(c("evidence_domain") == "batch_metric_delta", batch).otherwise(other), "MEANINGFUL").otherwise("WEAK")
    return out.select("*", ratio.alias("nonzero_sd_ratio"), state.alias("meaning"))


def baseline_false_positive(decisions: DataFrame, actions: DataFrame, max_score: float = 0.08) -> DataFrame:
    """Baseline scopes must stay stable, unclassified and without a real action."""
    real = actions.where(c("recommended_action") != "no action").groupBy(*SCOPE).agg(F.count("*").alias("false_actions"))
    j = decisions.where(is_reference()).join(real, list(SCOPE), "left").fillna(0, subset=["false_actions"])
    ok = (c("overall_risk_score") <= max_score) & c("final_risk_level").isin("stable", "low") & F.lower(F.coalesce("classification", F.lit("none"))).isin("none", "") & (c("false_actions") == 0)
    return j.select(*SCOPE, "overall_risk_score", "final_risk_level", "classification", "false_actions", F.when(ok, "PASS").otherwise("FAIL").alias("status"))


# Words that stand for an expected family.
ALIASES = {
    "completeness": ("completeness", "missing", "partial", "loss"),
    "consistency": ("consistency", "reconciliation", "mapping", "transaction"),
    "integrity": ("integrity", "state", "transition"),
    "timeliness": ("timeliness", "latency", "delay"),
    "availability": ("availability", "runtime", "operational", "pipeline"),
    "customer": ("customer", "experience"),
    "coupon": ("coupon", "attribution"),
}


def _plain(x) -> Column:
    return F.translate(X.lower0(x), "_-", "  ")


def contains_expected(observed, expected) -> Column:
    """One text holds the other, or the first family named in the expectation shows in the observation."""
    o, e = F.trim(_plain(observed)), F.trim(_plain(expected))
    alias = None
    for key, words in ALIASES.items():
        hit = X.has(o, *words)
        alias = F.when(e.contains(key), hit) if alias is None else alias.when(e.contains(key), hit)
    return F.when(e == "", True).when(o == "", False).when(o.contains(e) | e.contains(o), True).otherwise(F.coalesce(alias, F.lit(False)))


def calibration_review(decisions: DataFrame, expectations: DataFrame) -> DataFrame:
    """Observed class, action and level of each scope against what its scenario should give."""
    j = decisions.join(expectations, "scenario_name", "left")
    calm = is_reference()
    none = lambda x: F.lower(F.coalesce(c(x), F.lit(""))).isin("", "none", "null")
    sem = F.when(calm, none("classification")).otherwise(contains_expected("classification", "expected_semantic_family"))
    act = F.when(calm, X.lower0("recommended_action").contains("no action") | (F.coalesce("recommended_action", F.lit("")) == "")).otherwise(contains_expected("recommended_action", "expected_action"))
    esc = F.when(calm, X.lower0("final_risk_level").isin("stable", "normal", "low")).otherwise(contains_expected("final_risk_level", "escalation_expectation"))
    d = j.select("*", sem.alias("semantic_match"), act.alias("action_match"), esc.alias("escalation_match"))
    result = F.when(c("semantic_match") & c("action_match") & c("escalation_match"), "PASS").when(calm, "MISMATCH").otherwise("REVIEW")
    reasons = F.concat_ws(";", *[F.when(~c(f"{n}_match"), n) for n in ("semantic", "action", "escalation")])
    return d.select(*SCOPE, "classification", "recommended_action", "final_risk_level", *[c(f"{n}_match").cast("int").alias(f"{n}_match") for n in ("semantic", "action", "escalation")], result.alias("calibration_result"), reasons.alias("review_reason"))


def calibration_summary(review: DataFrame) -> DataFrame:
    return review.groupBy("scenario_name", "calibration_result").agg(F.count("*").alias("cnt"))


def source_contract_check(hits: DataFrame, lines_order: Column, keys=("profile_id", "dt"), required=("uid", "pcid", "journey_id"), slice_seconds: int = 600) -> DataFrame:
    """Hits with missing cookie keys or out of time order, and how many carry a login.

    ``lines_order`` is the position of a line in its log.
    """
    from .split import lag_in_slices, micros

    d = hits.withColumn("_kv", X.parse_kv("kv_raw")).withColumn("_us", micros("ts")).withColumn("_pos", lines_order)
    missing = F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.map_contains_key(c("_kv"), r))
    d = d.select(*keys, "_us", "_pos", F.size(missing).alias("_missing"), X.kv_value(c("_kv"), "uid").alias("_uid"), X.kv_value(c("_kv"), "pcid").alias("_pcid"))
    d = lag_in_slices(d, keys, ["_pos"], F.floor(c("_pos") / F.lit(100_000)), "_us", "_prev")
    reduced = d.groupBy(*keys, "_pcid").agg(
        F.count("*").alias("n"), F.count_if(c("_missing") > 0).alias("m"), F.count_if(c("_us") < c("_prev")).alias("o"), F.count("_uid").alias("u"))
    out = reduced.groupBy(*keys).agg(F.sum("n").alias("line_count"), F.sum("m").alias("missing_key_lines"), F.sum("o").alias("unsorted_lines"), F.count("_pcid").alias("unique_pcid"), F.sum("u").alias("uid_lines"))
    ok = (c("missing_key_lines") == 0) & (c("unsorted_lines") == 0)
    return out.select("*", F.round(c("uid_lines") / F.greatest("line_count", F.lit(1)), 5).alias("uid_cookie_rate"), F.when(ok, "PASS").otherwise("FAIL").alias("contract_status"))


def hourly_shape(hits: DataFrame, keys=("profile_id", "dt")) -> DataFrame:
    """Visits and page views per hour, and page views per visit."""
    per = hits.groupBy(*keys, F.hour("ts").alias("hh"), "sid").agg(F.count("*").alias("n"))
    out = per.groupBy(*keys, "hh").agg(F.count("sid").alias("visits"), F.sum("n").alias("page_views"))
    return out.withColumn("pv_per_visit", N.ratio("page_views", "visits"))


def scenario_effect_check(counts: DataFrame, baseline: DataFrame, keys=("profile_id",)) -> DataFrame:
    """Row counts of a scenario day against the baseline's, judged by what the scenario should do.

    ``counts`` has dt, scenario_id, row_count, affected_row_count and created_at;
    the newest row of each day and scenario counts. ``baseline`` has one
    baseline_rows per key.
    """
    latest = counts.groupBy(*keys, "dt", "scenario_id").agg(F.max_by(F.struct("row_count", "affected_row_count"), "created_at").alias("r")).select(*keys, "dt", "scenario_id", "r.*")
    j = latest.join(baseline.select(*keys, "baseline_rows"), list(keys), "left").fillna(0, subset=["baseline_rows"])
    n, a, b, s = c("row_count"), c("affected_row_count"), c("baseline_rows"), c("scenario_id")
    more = "NEEDS_MORE_EVIDENCE"
    yes = lambda cond, other: F.when(cond, "PASS").otherwise(other)
    status = (
        F.when(s == "source_campaign_spike", yes((n > b) & (a > 0), "FAIL")).when(s == "source_weather_drop", yes((a > 0) & (n <= b), more))
        .when(s == "source_system_degraded", yes(a > 0, "FAIL")).when(s == "source_no_data", yes((a > 0) & (n < b), more)).otherwise(yes(n > 0, "FAIL"))
    )
    return j.select("*", (n - b).alias("row_delta"), (n / F.when(b > 0, b)).alias("row_ratio"), (a / F.when(n > 0, n)).alias("affected_ratio"), status.alias("validation_status"))


MARKERS = {"drift_on": "drift=on", "drift_off": "drift=off", "affected": "affected=1", "weather_alias": "weather=", "schema_version": "schema_version=", "scenario_id": "scenario_id="}


def marker_contract(lines: DataFrame, line: str, keys, scenario: str = "scenario_id") -> DataFrame:
    """Counts of marker texts per file, and the reasons a file breaks the contract."""
    out = lines.groupBy(*keys, scenario).agg(F.count("*").alias("row_count"), *[F.count_if(c(line).contains(m)).alias(f"{n}_count") for n, m in MARKERS.items()])
    n = c("row_count")
    base, quiet = c(scenario) == "baseline", c(scenario) == "source_no_data"
    reasons = F.array_compact(F.array(
        F.when(c("weather_alias_count") > 0, "weather_alias_present"), F.when((n > 0) & (c("schema_version_count") != n), "schema_version_missing"), F.when((n > 0) & (c("scenario_id_count") != n), "scenario_id_missing"),
        F.when(base & ((c("drift_on_count") != 0) | (c("drift_off_count") == 0)), "baseline_drift_contract_failed"), F.when(~base & ~quiet & ((c("drift_on_count") == 0) | (c("affected_count") == 0)), "anomaly_not_activated"),
    ))
    return out.select("*", F.concat_ws(",", reasons).alias("reasons"), F.when(F.size(reasons) == 0, "PASS").otherwise("FAIL").alias("status"))


def evidence_calendar_coverage(evidence: DataFrame, calendar: DataFrame) -> DataFrame:
    """Evidence per calendar day and domain; a day without any gets a MISSING row."""
    got = evidence.groupBy(*SCOPE, "evidence_domain").agg(
        F.count("*").alias("row_count"), F.min("sample_days").alias("min_sample_days"), F.max("sample_days").alias("max_sample_days"), F.max("statistical_score").alias("max_score"))
    gone = calendar.select("profile_id", "dt").distinct().join(got.select("profile_id", "dt").distinct(), ["profile_id", "dt"], "left_anti")
    return got.withColumn("coverage", F.lit("FOUND")).unionByName(gone.withColumn("coverage", F.lit("MISSING")), allowMissingColumns=True).fillna(0, subset=["row_count"])


# --- reports -----------------------------------------------------------------------------


def count_chain(layers: dict[str, DataFrame], keys=("profile_id", "dt")) -> DataFrame:
    """Rows per layer in pipeline order, and the change from layer to layer."""
    parts = [df.groupBy(*keys).agg(F.count("*").alias("cnt")).select(*keys, F.lit(i).alias("layer_no"), F.lit(name).alias("layer"), "cnt") for i, (name, df) in enumerate(layers.items())]
    w = Window.partitionBy(*keys).orderBy("layer_no")
    prev = F.lag("cnt").over(w)
    return _stack(parts).select("*", (c("cnt") - prev).alias("delta"), F.round((prev - c("cnt")) / F.when(prev > 0, prev), 6).alias("drop_rate"))


def collector_delta(chain: DataFrame, keys=("profile_id", "dt")) -> DataFrame:
    """The layer counts of a scope side by side with the collector's drop and repeat rate."""
    names = ("stage", "collector", "raw", "canonical")
    wide = chain.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(c("layer") == n, c("cnt"))), F.lit(0)).alias(f"{n}_count") for n in names])
    s, k = c("stage_count"), c("collector_count")
    rate = lambda e: F.round(e / F.when(s > 0, s), 6)
    return wide.select("*", (s - k).alias("stage_to_collector_delta"), rate(s - k).alias("estimated_collector_drop_rate"), rate(k - s).alias("estimated_collector_dup_rate"))


def canonical_coverage(canonical: DataFrame, cols=("uid", "pcid", "session_id", "schema_version"), flags=("schema_flag", "identity_flag"), keys=("profile_id", "dt")) -> DataFrame:
    filled = lambda x: F.coalesce(c(x).cast("string"), F.lit("")) != ""
    return canonical.groupBy(*keys).agg(
        F.count("*").alias("canonical_event_count"), *[F.round(F.avg(filled(x).cast("int")), 6).alias(f"{x}_coverage") for x in cols if x in canonical.columns], *[F.count_if(filled(x)).alias(f"{x}_count") for x in flags if x in canonical.columns])


def anomaly_trace(canonical: DataFrame, cols=("anomaly_type", "schema_flag", "identity_flag"), keys=("profile_id", "dt")) -> DataFrame:
    return canonical.groupBy(*keys, *[F.coalesce(c(x), F.lit("NULL")).alias(x) for x in cols]).agg(F.count("*").alias("canonical_event_count"))


def score_distribution(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("scenario_name", "final_risk_level", "classification").agg(F.count("*").alias("cnt"), F.avg("overall_risk_score").alias("avg_risk_score"))


POLICIES = {"preserve": ("ml", "ai_score"), "full": ("semantic", "risk", "action", "ml", "ai_score"), "informational": ()}


def artifact_coverage(calendar: DataFrame, tables: dict[str, DataFrame], policy: str = "full") -> DataFrame:
    """Rows of each artifact per calendar day and scenario, and whether the policy's ones exist."""
    out = calendar.select(*SCOPE).distinct()
    for name, df in tables.items():
        out = out.join(df.groupBy(*SCOPE).agg(F.count("*").alias(f"{name}_rows")), list(SCOPE), "left")
    out = out.fillna(0)
    need = [c(f"{n}_rows") > 0 for n in POLICIES[policy] if n in tables]
    ok = reduce(lambda a, b: a & b, need) if need else F.lit(True)
    return out.withColumn("artifact_ok", F.when(ok, "PASS").otherwise("FAIL"))


def exogenous_day(timeline: DataFrame, first=("weather_type", "campaign_flag", "system_flag"), mean=("volume_multiplier", "conversion_multiplier", "timeout_multiplier", "retry_multiplier")) -> DataFrame:
    """Day attributes of an hourly timeline: the first known flag, the mean multipliers."""
    return timeline.groupBy("profile_id", "dt").agg(
        *[F.min_by(x, F.when(c(x).isNotNull(), c("hh"))).alias(x) for x in first if x in timeline.columns], *[F.avg(x).alias(x) for x in mean if x in timeline.columns])


def exogenous_lookup(facts: DataFrame, timeline: DataFrame, keys=("profile_id", "dt")) -> DataFrame:
    """Day (or hour) facts with the attributes of the timeline at the same keys."""
    return facts.join(timeline, list(keys), "left")


def timeline_performance(timeline: DataFrame) -> DataFrame:
    """Timeouts, backlog, retries and partial failures a day's system flag implies."""
    d = timeline.select("profile_id", "dt", X.lower0("system_flag").alias("system_flag"), F.coalesce("timeout_multiplier", F.lit(1.0)).alias("t"), F.coalesce("retry_multiplier", F.lit(1.0)).alias("r")).distinct()
    flag = F.when(c("system_flag") == "", "normal").otherwise(c("system_flag"))
    slow, dropped = flag.isin("degraded", "auth_delay"), flag.isin("degraded", "collector_drop")
    part = lambda cond, e: F.when(cond, F.round(e, 6)).otherwise(0.0)
    return d.select(
        "profile_id", "dt", flag.alias("system_flag"), part(slow, 100 * (c("t") - 1)).alias("timeout_count"), part(slow, 80 * (c("t") - 1)).alias("queue_backlog"),
        part(dropped, 120 * (c("r") - 1)).alias("retry_count"), F.when(flag == "submit_partial_loss", 35.0).otherwise(0.0).alias("partial_fail_count"))


def dataset_freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and newest day of each dataset."""
    return _stack([df.agg(F.lit(name).alias("dataset"), F.count("*").alias("row_count"), F.max(F.to_date(day)).alias("max_date")) for name, (df, day) in tables.items()])


def status_mix(df: DataFrame, status: str, day: str = "dt", keys=("profile_id",)) -> DataFrame:
    return df.groupBy(*keys, day, c(status).alias("status")).agg(F.count("*").alias("cnt"))


def trend_union(df: DataFrame, at: str, series, keys=("profile_id",)) -> DataFrame:
    """Several score columns as (time, series, value) rows."""
    items = F.array(*[F.struct(F.lit(s).alias("series"), c(s).cast("double").alias("value")) for s in series])
    return df.select(*keys, c(at).alias("time"), F.inline(items))
