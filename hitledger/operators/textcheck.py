"""Rule checks on generated incident text: what it claims, cites and recommends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N, text as X
from .evidence import num

SCOPE = ("profile_id", "dt", "scenario_name")
c = F.col

# Word lists of the checks.
CLAIMS = {
    "kafka broker outage": ["kafka broker outage", "kafka outage", "broker outage", "카프카 브로커 장애"],
    "database failure": ["db outage", "database outage", "database failure", "db failure", "database corruption", "db 장애", "데이터베이스 장애"],
    "network issue": ["network outage", "network failure", "network issue", "네트워크 장애", "네트워크 문제"],
    "schema corruption": ["schema corruption", "schema corrupted", "스키마 손상"],
    "collector crash": ["collector crash", "collector failure", "collector crashed", "수집기 장애", "collector 장애"],
    "disk failure": ["disk failure", "disk full", "디스크 장애"],
    "memory leak": ["memory leak", "메모리 누수"],
    "third-party api outage": ["third-party api", "external api outage", "외부 api 장애"],
}
ALSO_SUPPORTS = {"schema corruption": ["schema corruption", "스키마 손상"]}
RISK_TERMS = {
    "Completeness": ["completeness", "missing", "누락", "결측", "ingestion", "partial"],
    "Timeliness": ["timeliness", "latency", "delay", "backlog", "지연", "대기열"],
    "Availability": ["availability", "no data", "unavailable", "가용성", "무데이터", "timeout"],
    "Integrity": ["integrity", "schema", "reconciliation", "무결성", "스키마", "정합성"],
    "Consistency": ["consistency", "mapping", "identity", "일관성", "매핑", "식별자"],
    "None": ["stable", "normal", "no action", "정상", "안정"],
}
SIGNAL_TERMS = ["risk", "위험", "signal", "신호", "delta", "score", "증가", "하락"]
EVIDENCE_TERMS = ["delta", "score", "measurement", "direct_", "completeness_delta", "timeliness_delta", "availability_delta", "integrity_delta", "propagation", "측정", "근거", "점수"]
MEASURE_TERMS = ["measurement", "측정", "delta", "direct_"]
ACTION_TERMS = {
    "ingestion validation": ["ingestion validation", "ingestion", "누락", "수집", "검증"],
    "queue/backlog check": ["queue", "backlog", "latency", "delay", "지연", "대기열"],
    "retry/timeout tuning": ["retry", "timeout", "availability", "가용성", "재시도", "타임아웃"],
    "reconciliation": ["reconciliation", "integrity", "schema", "정합", "무결성", "스키마"],
    "mapping validation": ["mapping", "identity", "consistency", "매핑", "식별자", "일관성"],
    "no action": ["no action", "monitor", "stable", "정상", "모니터링"],
}
OVERCONFIDENT = ["guaranteed", "certainly caused", "definitely caused"]
RECONCILIATION_TERMS = ["reconciliation", "match_rate", "transaction", "state", "behavior"]


def incident_context(rows: DataFrame, parts: dict[str, list[str]], scope=SCOPE) -> DataFrame:
    """Evidence bundle per scope: one struct per named part, and how many parts hold anything."""
    have = {n: [x for x in cols if x in rows.columns] for n, cols in parts.items()}
    bundle = [F.struct(*[c(x) for x in cols]).alias(n) for n, cols in have.items() if cols]
    full = [F.when(F.coalesce(*[c(x).cast("string") for x in cols]).isNotNull(), F.lit(n)) for n, cols in have.items() if cols]
    used = F.array_compact(F.array(*full))
    return rows.select(*scope, F.struct(*bundle).alias("context"), used.alias("evidence_parts"), F.size(used).alias("evidence_count"), F.to_json(F.struct(*bundle)).alias("context_json"))


def template_summary(rows: DataFrame, scope=SCOPE) -> DataFrame:
    """Incident text from the measures and the decision alone."""
    s = lambda n: F.coalesce(c(n).cast("string"), F.lit("None"))
    dom = F.coalesce(F.nullif("dominant_semantic_risk", F.lit("")), F.lit("None"))
    text = F.format_string(
        "For %s %s scenario=%s, v0.5 reconciliation evidence shows behavior_transaction_match_rate=%s and transaction_state_match_rate=%s. The rule/semantic layer produced final_risk_level=%s, overall_risk_score=%.6f, dominant_semantic_risk=%s.",
        s("profile_id"), s("dt"), s("scenario_name"), s("behavior_transaction_match_rate"), s("transaction_state_match_rate"), F.coalesce(c("final_risk_level"), F.lit("unknown")), num("overall_risk_score"), dom)
    root = F.when(dom == "None", "Baseline residual mismatch is treated as non-promoted evidence when semantic/action gates suppress it.").otherwise(
        F.concat(F.lit("Primary evidence is "), dom, F.lit(", supported by reconciliation and semantic tables.")))
    act = F.concat(F.lit("Recommended action from governed action layer: "), F.coalesce(c("recommended_action"), F.lit("no action")), F.lit("."))
    return rows.select(*scope, text.alias("incident_explanation"), root.alias("root_cause_summary"), act.alias("recommended_action_summary"))


def prefer_generated(rows: DataFrame, outputs: DataFrame, keys=("profile_id", "dt")) -> DataFrame:
    """The best generated text of a day (accepted and no fallback first, newest next), else the row's own.

    ``outputs`` has api_status, fallback_used, created_at, summary_text and execution_id.
    """
    good = ((c("api_status") == "OK") & (c("fallback_used") == 0)).cast("int")
    best = outputs.groupBy(*keys).agg(F.max_by(F.struct("api_status", "fallback_used", c("summary_text").alias("_text"), "execution_id"), F.struct(good, "created_at")).alias("b"))
    j = rows.join(best.select(*keys, "b.*"), list(keys), "left")
    use = F.coalesce((F.upper("api_status") == "OK") & (F.coalesce("fallback_used", F.lit(0)) == 0) & (F.trim("_text") != ""), F.lit(False))
    keep = [x for x in rows.columns if x != "summary_text"]
    return j.select(*keep, F.when(use, c("_text")).otherwise(c("summary_text")).alias("checked_text"), F.when(use, "LLM").otherwise("FALLBACK").alias("output_source"), F.when(use, c("execution_id")).alias("execution_id"))


def unsupported_claims(text: Column, seen: Column) -> Column:
    """Claims the text makes that the evidence does not name; both are lower-cased already."""
    made = X.keyword_hits(text, CLAIMS, lowered=True)
    backed = F.array_compact(F.array(*[F.when(X.has(seen, *[w.lower() for w in ALSO_SUPPORTS.get(label, [label])]), F.lit(label)) for label in CLAIMS]))
    return F.array_except(made, backed)


def check_unsupported_claims(rows: DataFrame, text: str = "checked_text", evidence: str = "evidence_text") -> DataFrame:
    # lower-cased once per row, however many words are looked for
    d = rows.withColumn("_t", X.lower0(text)).withColumn("_e", X.lower0(evidence)).withColumn("unsupported", unsupported_claims(c("_t"), c("_e")))
    n = F.size("unsupported")
    return d.select(*rows.columns, F.concat_ws(",", "unsupported").alias("unsupported_claims"), n.alias("unsupported_claim_count"), F.least(F.lit(1.0), n / 3.0).alias("hallucination_score"), (n > 0).cast("int").alias("hallucination_flag"))


def _named(table: dict[str, list[str]], key: Column, text: Column, other: Column) -> Column:
    out = None
    for name, words in table.items():
        hit = X.has(text, *[w.lower() for w in words])
        out = F.when(key == name, hit) if out is None else out.when(key == name, hit)
    return out.otherwise(other)


def check_interpretation(rows: DataFrame, text: str = "checked_text") -> DataFrame:
    """Whether a text names a signal, its risk, its evidence and a measurement.

    ``rows`` has dominant_semantic_risk and has_evidence (0/1).
    """
    rows = rows.withColumn("_t", X.lower0(text))
    t, dom = c("_t"), F.coalesce(c("dominant_semantic_risk"), F.lit("None"))
    semantic = (dom == "None") | _named(RISK_TERMS, dom, t, t.contains(F.lower(dom)))
    parts = {
        "signal_match_score": X.has(t, *SIGNAL_TERMS), "semantic_match_score": semantic,
        "evidence_match_score": (c("has_evidence") == 1) & X.has(t, *EVIDENCE_TERMS), "measurement_reference_score": X.has(t, *MEASURE_TERMS),
    }
    d = rows.select("*", *[e.cast("double").alias(n) for n, e in parts.items()]).drop("_t")
    mean = sum(c(n) for n in parts) / 4.0
    return d.withColumn("interpretation_score", mean).withColumn("interpretation_status", N.level_band("interpretation_score", ([(0.75, "PASS"), (0.5, "WARN")], "FAIL")))


def check_action_alignment(rows: DataFrame, text: str = "action_text", rule: str = "rule_action") -> DataFrame:
    """Whether the text holds the action of the rules, or words that stand for it."""
    rows = rows.withColumn("_t", X.lower0(text))
    t, r = c("_t"), F.lower(F.trim(F.coalesce(c(rule), F.lit(""))))
    ok = (r != "") & (t.contains(r) | _named(ACTION_TERMS, r, t, F.lit(False)))
    return rows.select("*", ok.cast("double").alias("action_match_score"), F.when(ok, "ALIGNED").otherwise("MISMATCH").alias("action_status")).drop("_t")


def check_generated(rows: DataFrame) -> DataFrame:
    """Missing evidence, overconfident wording, unbacked outage or reconciliation claims, wrong action for calm levels.

    ``rows`` has evidence_count, summary_text, final_risk_level, overall_risk_score and recommended_action.
    """
    rows = rows.withColumn("_t", X.lower0("summary_text"))
    t, act = c("_t"), X.lower0("recommended_action")
    missing = num("evidence_count") <= 0
    outage = t.contains("outage") & ~X.has(t, "runtime", "availability")
    invented = missing & X.has(t, *RECONCILIATION_TERMS)
    calm = X.lower0("final_risk_level").isin("stable", "normal", "low") & (num("overall_risk_score") < 0.20)
    wrong = calm & ~act.contains("no action") & (act != "")
    flags = {"missing_evidence_flag": missing, "unsupported_explanation_flag": X.has(t, *OVERCONFIDENT), "hallucination_flag": outage | invented, "wrong_action_flag": wrong}
    d = rows.select("*", *[e.cast("int").alias(n) for n, e in flags.items()]).drop("_t")
    n = sum(c(x) for x in flags)
    return d.withColumn("issue_count", n).withColumn("validation_status", F.when(n == 0, "PASS").otherwise("FAIL"))


def ai_reliability_score(rows: DataFrame) -> DataFrame:
    """Risk of trusting a checked text, from its four flags."""
    w = {"missing_evidence_flag": 0.30, "unsupported_explanation_flag": 0.25, "hallucination_flag": 0.30, "wrong_action_flag": 0.15}
    total = F.least(F.lit(1.0), sum(num(n) * x for n, x in w.items()))
    d = rows.withColumn("overall_ai_risk_score", total)
    s = c("overall_ai_risk_score")
    return d.withColumn("ai_reliability_level", F.when(s == 0, "trusted").when(s < 0.5, "review").otherwise("blocked"))


def interpretation_reliability(rows: DataFrame) -> DataFrame:
    """The older score, from the match scores of interpretation, evidence and action."""
    v = lambda n: N.clamp01(n)
    interp = 1 - (v("signal_match_score") + v("semantic_match_score")) / 2
    evid = 1 - (v("evidence_match_score") + v("measurement_reference_score")) / 2
    total = F.round(0.30 * interp + 0.30 * evid + 0.25 * (1 - v("action_match_score")) + 0.15 * v("hallucination_score"), 6)
    d = rows.withColumn("overall_ai_risk_score", total)
    s = c("overall_ai_risk_score")
    return d.withColumn("validation_status", F.when(s <= 0.15, "PASS").when(s <= 0.35, "WARN").otherwise("FAIL"))


def usage_governance(log: DataFrame, keys=("profile_id", "dt")) -> DataFrame:
    """Calls, fallbacks, tokens and cost per day."""
    fallback = (X.lower0("provider").isin("", "none") | X.lower0("output_source").contains("fallback")).cast("int")
    d = log.select("*", fallback.alias("_fb"))
    out = d.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("_fb").alias("fallback_calls"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost").alias("total_cost"))
    return out.withColumn("governance_status", F.when(c("fallback_calls") == c("calls"), "NOT_CALLED").otherwise("COMPLETED"))
