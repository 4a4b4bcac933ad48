"""Fixed values of the decision rules: weights, labels and catalogs.

They state what each pattern, mechanism or signal means, so that results agree
with the published rules; the code that applies them is in ``operators``.
"""

REFERENCE_SCENARIOS = ("baseline", "normal", "stable")

# --- weights of likelihood and impact per pattern ---------------------------
LIKELIHOOD = {
    "localized_failure": {"baseline_evidence": 0.25, "concentration": 0.25, "statistical": 0.15, "identity_or_shift": 0.15, "pattern_or_mechanism": 0.20},
    "systemic_failure": {"baseline_evidence": 0.25, "propagation": 0.30, "statistical": 0.25, "pattern_confidence": 0.20},
    "silent_distortion": {"criticality": 0.35, "impact": 0.25, "concentration": 0.15, "pattern_or_mechanism": 0.25},
    "reconciliation_failure": {"baseline_evidence": 0.25, "statistical": 0.25, "propagation": 0.30, "pattern_confidence": 0.20},
    "interpretation_failure": {"statistical": 0.35, "criticality": 0.35, "pattern_confidence": 0.30},
    "other": {"baseline_evidence": 0.30, "statistical": 0.25, "propagation": 0.20, "concentration": 0.15, "pattern_confidence": 0.10},
}
IMPACT = {
    "localized_failure": {"customer_impact": 0.30, "kpi_distortion": 0.20, "criticality": 0.20, "identity_or_shift": 0.15, "affected_domains": 0.15},
    "systemic_failure": {"customer_impact": 0.30, "transaction_loss": 0.25, "affected_domains": 0.20, "runtime_impact": 0.15, "criticality": 0.10},
    "silent_distortion": {"criticality": 0.30, "kpi_distortion": 0.30, "customer_impact": 0.20, "transaction_loss": 0.20},
    "reconciliation_failure": {"customer_impact": 0.30, "transaction_loss": 0.30, "affected_domains": 0.25, "kpi_distortion": 0.15},
    "interpretation_failure": {"criticality": 0.35, "customer_impact": 0.35, "kpi_distortion": 0.30},
    "other": {"customer_impact": 0.35, "transaction_loss": 0.25, "kpi_distortion": 0.20, "affected_domains": 0.10, "runtime_impact": 0.10},
}
RUNTIME_IMPACT = {"runtime": 0.35, "stream": 0.20, "operational": 0.25, "batch": 0.10, "realism": 0.10}

# --- classification of a pattern --------------------------------------------
# pattern: (classification, catalog key, template, rule)
CLASSES = {
    "stable": ("None", "none", "NO_RISK", "PATTERN_STABLE_TO_NO_CLASSIFICATION_V1"),
    "localized_failure": ("Operational Observability Reliability", "localized_reliability", "PATTERN_LOCALIZED_FAILURE", "PATTERN_LOCALIZED_FAILURE_TO_OBSERVABILITY_RELIABILITY_V1"),
    "systemic_failure": ("Operational Observability Reliability", "systemic_reliability", "PATTERN_SYSTEMIC_FAILURE", "PATTERN_SYSTEMIC_FAILURE_TO_OBSERVABILITY_RELIABILITY_V1"),
    "silent_distortion": ("Business Semantic Distortion", "critical_kpi_distortion", "PATTERN_SILENT_DISTORTION", "PATTERN_SILENT_DISTORTION_TO_BUSINESS_SEMANTIC_DISTORTION_V1"),
    "reconciliation_failure": ("Cross-Domain Reconciliation Reliability", "reconciliation_reliability", "PATTERN_RECONCILIATION_FAILURE", "PATTERN_RECONCILIATION_FAILURE_TO_RECONCILIATION_RELIABILITY_V1"),
    "interpretation_failure": ("AI Reliability", "interpretation_reliability", "PATTERN_INTERPRETATION_FAILURE", "PATTERN_INTERPRETATION_FAILURE_TO_AI_RELIABILITY_V1"),
    "emerging_reliability_degradation": ("Operational Decision Reliability", "reliability_investigation", "PATTERN_EMERGING_RELIABILITY_DEGRADATION", "PATTERN_EMERGING_DEGRADATION_TO_OPERATIONAL_DECISION_RELIABILITY_V1"),
}
CLASS_THRESHOLD = 0.20
ROOT_LABELS = {
    "identity_integrity_breakage": "IDENTITY_INTEGRITY_BREAKAGE",
    "semantic_attribution_distortion": "SEMANTIC_ATTRIBUTION_DISTORTION",
    "critical_event_loss": "CRITICAL_EVENT_LOSS",
    "collection_completeness_loss": "COLLECTION_COMPLETENESS_LOSS",
}
# word in the dimension of a root cause and the label it stands for, first match wins
DIMENSION_LABELS = [
    ("app_version", "APP_VERSION_TAGGING_BREAKAGE"),
    ("sdk", "SDK_COMPATIBILITY_OR_COLLECTION_BREAKAGE"),
    ("url", "URL_TAGGING_BREAKAGE"),
    ("client|browser|os", "CLIENT_COVERAGE_GAP"),
]

# --- action catalog ------------------------------------------------------------
# pattern or mechanism: rows of (type, text, evidence metric); the evidence value
# is 1 but for overall_risk_score and authority_risk_level, which take the score
ACTIONS = {
    "stable": [("no action", "no action", "overall_risk_score")],
    "identity_integrity_breakage": [
        ("identity propagation audit", "Validate uid/login_id propagation for the concentrated app-version segment before using login-user or UV KPIs.", "failure_mechanism"),
        ("app version tagging audit", "Inspect app release tagging initialization and login cookie handling for the affected app version.", "mechanism_source"),
        ("localized KPI annotation", "Annotate UV/login-based dashboards for the affected segment and avoid extrapolating to total traffic.", "overall_risk_score"),
    ],
    "semantic_attribution_distortion": [
        ("url mapping validation", "Validate SDK URL/category attribution mapping and confirm whether order URLs collapsed into a single category.", "failure_mechanism"),
        ("sdk compatibility review", "Review SDK version tagging contract, route mapping, and payload serialization for the concentrated SDK segment.", "mechanism_source"),
        ("category KPI annotation", "Annotate product/category attribution KPIs until URL semantic distribution is recovered.", "overall_risk_score"),
    ],
    "localized_failure": [
        ("segment isolation audit", "Identify the concentrated segment and isolate the affected version/client/user cohort before broad operational action.", "risk_pattern"),
        ("collection completeness audit", "Audit collector delivery, beacon acceptance, retry, and payload contract for the localized root-cause candidate.", "root_cause_candidate"),
        ("localized KPI annotation", "Annotate dashboards for the affected segment and avoid extrapolating the issue to total business performance.", "overall_risk_score"),
    ],
    "systemic_failure": [
        ("collector health check", "Validate collector ingest, queue, retry, and beacon delivery health across platforms.", "risk_pattern"),
        ("pipeline validation", "Run source-to-canonical and Web-to-WC reconciliation checks before using affected KPIs.", "overall_risk_score"),
        ("decision freeze", "Freeze campaign/product decisions that depend on the affected telemetry until systemic recovery is confirmed.", "authority_risk_level"),
    ],
    "silent_distortion": [
        ("critical KPI validation", "Validate purchase/conversion/payment events separately from PV/UV volume before business interpretation.", "risk_pattern"),
        ("dashboard KPI annotation", "Annotate conversion and revenue-proxy dashboards with reliability risk and confidence context.", "overall_risk_score"),
        ("business decision hold", "Hold marketing or funnel decisions that rely on critical events until event-level collection is recovered.", "authority_risk_level"),
    ],
    "reconciliation_failure": [
        ("cross-domain reconciliation", "Compare Web/WC behavior, transaction, and state records to locate where operational facts diverge.", "risk_pattern"),
        ("mapping validation", "Validate behavior-to-transaction and transaction-to-state mapping completeness and replay mapping if needed.", "overall_risk_score"),
        ("orphan/missing audit", "Audit behavior-only, transaction-only, orphan state, and transaction-without-state records.", "root_cause_candidate"),
    ],
    "interpretation_failure": [
        ("evidence-bound review", "Review whether the explanation and recommended action are fully supported by measurement evidence.", "risk_pattern"),
        ("human review required", "Require human validation before operational execution because interpretation confidence is uncertain.", "overall_risk_score"),
    ],
    "other": [
        ("reliability investigation", "Collect additional evidence and classify the emerging reliability degradation pattern before taking broad action.", "risk_pattern"),
        ("monitoring annotation", "Annotate dashboards with emerging reliability degradation and monitor recurrence.", "overall_risk_score"),
    ],
}
SCORED_METRICS = ("overall_risk_score", "authority_risk_level")
ACTION_THRESHOLD = 0.08
# words in the dimension of a root cause: (key, type, text around the value)
REFERENCE_ACTIONS = [
    ("app_version", "app_version_audit", "OBS reference: app version tagging audit", "Reference check: inspect release/tagging initialization for app version segment {}."),
    ("sdk_version|^app_sdk$", "sdk_compatibility_review", "OBS reference: SDK compatibility review", "Reference check: validate SDK beacon dispatch, initialization, and payload contract for {}."),
    ("url|surface|path", "url_tagging_audit", "OBS reference: URL / journey tagging audit", "Reference check: inspect tagging coverage and event mapping for surface path {}."),
    ("client|browser|os|platform", "client_coverage_review", "OBS reference: client/platform coverage review", "Reference check: inspect client, platform, browser, or OS-specific collection coverage for {}."),
]

# --- collection-risk actions ----------------------------------------------------
OBSERVABILITY_ACTIONS = {
    "WC Collection Completeness Risk": [
        ("wc collector validation", "Validate WC collector ingest path, beacon delivery, and collector-side drop/retry behavior."),
        ("web-wc reconciliation check", "Compare WebServer source hits with WC telemetry by run_id/source_gen_run_id and segment the collection gap."),
        ("observability KPI annotation", "Annotate or suppress KPI dashboard decisions until collection completeness is recovered."),
    ],
    "Operational Observability Distortion": [
        ("observability evidence audit", "Audit reality-vs-observability evidence before treating KPI degradation as business degradation."),
        ("dashboard freshness annotation", "Annotate dashboard with observability degradation and decision-freeze guidance."),
        ("collector recovery validation", "Validate collector recovery and backfill/replay completeness."),
    ],
}
OVERRIDE_SCORE = 0.15

# --- older chain ------------------------------------------------------------------
EXPECTED_DIMENSION = {
    "completeness": "Completeness", "latency_performance": "Timeliness", "availability": "Availability",
    "schema_validation": "Integrity", "identity_mapping": "Consistency", "low": "None",
}
DIMENSION_LAYER = {"Completeness": "batch_stream", "Timeliness": "stream_operational", "Availability": "operational", "Integrity": "batch", "Consistency": "batch_cross_metric"}
DIMENSION_ACTIONS = {
    "Completeness": ("ingestion validation", "source/batch/stream completeness degradation", "P2"),
    "Timeliness": ("queue/backlog check", "stream or operational timeliness degradation", "P2"),
    "Integrity": ("reconciliation", "schema/contract/integrity drift", "P1"),
    "Consistency": ("mapping validation", "cross-layer consistency mismatch", "P2"),
    "Availability": ("retry/timeout tuning", "no-data or availability degradation", "P1"),
    "None": ("no action", "stable baseline", "P4"),
    "Unknown": ("manual investigation", "unknown reliability risk", "P3"),
}
# family, scope, metrics and weight of a score contribution
COLLECTION_METRICS = ("collection_gap_rate", "canonical_gap_rate", "web_to_canonical_gap_rate", "checkout_missing_rate", "product_missing_rate", "uv_gap_rate")
COLLECTOR_COUNTS = ("wc_hits", "canonical_behavior_events")
VOLUME_METRICS = ("event_count", "pv", "uv", "visit")
FUNNEL_METRICS = ("conversion_rate", "collector_capture_rate", "estimated_missing_rate")
QUALITY_METRICS = ("validation_fail_rate", "quality_issue_rate")
CONTRIBUTIONS = [
    ("behavior_distortion", "behavior_volume", VOLUME_METRICS, 1.00),
    ("behavior_distortion", "observability", COLLECTION_METRICS + COLLECTOR_COUNTS, 1.00),
    ("conversion_distortion", "behavior_funnel", FUNNEL_METRICS, 1.00),
    ("conversion_distortion", "observability", COLLECTION_METRICS + COLLECTOR_COUNTS, 0.70),
    ("session_fragmentation", "behavior_volume", ("visit", "uv", "pv"), 1.00),
    ("session_fragmentation", "observability", COLLECTION_METRICS + COLLECTOR_COUNTS, 0.45),
    ("batch_quality", "batch_quality", QUALITY_METRICS, 1.00),
]
FAMILY_RANK = {"behavior_distortion": 1, "collection_effect": 2, "conversion_distortion": 3, "session_fragmentation": 4}
FIRST_METRICS = ("event_count", "pv", "pv_count", "pageview_count")

# --- case rules ---------------------------------------------------------------------
CASES = {
    "CASE-OFFER-001": {
        "evidence": {"scenario_id": "CASE-OFFER-001", "schema_flag": "drift", "reconciliation_flag": "offer_delivery_missing", "funnel_stage": "offer", "financial_product": "loan"},
        "decision": ("Integrity", "Completeness", "HIGH", "offer event schema reconciliation", "P1"),
        "floors": {"integrity": 0.65, "completeness": 0.30, "timeliness": 0.10, "consistency": 0.55, "availability": 0.00},
        "overall": (0.55, 0.15, 0.20, 0.10),
    },
    "CASE-REC-002": {
        "evidence": {"scenario_id": "CASE-REC-002", "schema_flag": "drift", "reconciliation_flag": "kpi_semantic_mismatch", "funnel_stage": "recommendation"},
        "decision": ("Integrity", "Consistency", "HIGH", "recommendation KPI semantic mapping validation", "P1"),
        "floors": {"integrity": 0.65, "completeness": 0.00, "timeliness": 0.00, "consistency": 0.65, "availability": 0.00},
        "overall": (0.55, 0.10, 0.25, 0.10),
    },
}
