"""Feature snapshots, models, formulas and generated-text checks."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import decisions as D, ml as M, textcheck as T
from ..session import materialize, scratch_dir
from . import decisions
from .fixtures import RELATIONS
from .registry import query

S = "profile_id, dt, scenario_name"
HEAD = "profile_id dt:date scenario_name"


def decided(i):
    return D.classify(decisions.risked(i))


RELATIONS["user_events"] = "SELECT concat('p', CAST(user_id AS STRING)) AS profile_id, CAST(ts AS DATE) AS dt, CASE WHEN day(CAST(ts AS DATE)) % 4 = 0 THEN 'baseline' ELSE 'source_wc_collection_missing' END AS scenario_name, event_type FROM events"
SNAP_NUM = ("overall_risk_score", "behavior_transaction_match_rate", "transaction_state_match_rate", "drift_score", "not_measured_score")
RELATIONS["snapshot_day"] = f"""SELECT {S}, overall_risk_score, behavior_transaction_match_rate, transaction_state_match_rate, drift_score, 0.0 AS not_measured_score, final_risk_level, classification AS dominant_semantic_risk, 'no action' AS recommended_action, views AS view_count, coalesce(buys, 0) AS purchase_count
  FROM classified JOIN (SELECT {S}, drift_score FROM dimensioned) d USING ({S}) JOIN (SELECT {S}, count(*) AS views FROM user_events GROUP BY ALL) v USING ({S}) LEFT JOIN (SELECT {S}, count(*) AS buys FROM user_events WHERE event_type = 'purchase' GROUP BY ALL) p USING ({S})"""
SNAP_COLS = f"{HEAD} " + " ".join(f"{n}:d" for n in SNAP_NUM) + " final_risk_level dominant_semantic_risk recommended_action view_count:i purchase_count:i"


def snapshot(i):
    d = decided(i).withColumn("dominant_semantic_risk", F.col("classification"))
    old = D.dimension_reliability(i.dimension_rows).select(*M.SCOPE, "drift_score")
    ev = i.user_events
    return M.ml_feature_snapshot(
        d, {"decision": d, "older": old}, {"view": ev, "purchase": ev.where("event_type = 'purchase'")}, SNAP_NUM,
        {"final_risk_level": "unknown", "dominant_semantic_risk": "None", "recommended_action": "no action"})


@query("ml_feature_snapshot", "M01", SNAP_COLS, "SELECT * FROM snapshot_day")
def ml_feature_snapshot(i):
    return snapshot(i)


RELATIONS["labelled_days"] = f"""SELECT u.*, CASE WHEN overall_score <= 0 OR lower(overall_level) IN ('stable', 'low') THEN 'stable' WHEN dominant_semantic = 'Completeness' THEN 'completeness_risk' WHEN dominant_semantic = 'Timeliness' THEN 'timeliness_risk' WHEN dominant_semantic = 'Integrity' THEN 'integrity_risk'
  WHEN dominant_semantic = 'Consistency' THEN 'consistency_risk' WHEN dominant_semantic = 'Availability' THEN 'availability_risk' ELSE 'none_risk' END AS label_risk_family FROM unified_day u"""


def labelled(i):
    u = D.unified_score(decisions.semantic(i))
    named = u.select(*M.SCOPE, F.col("dominant_semantic").alias("dominant_semantic_risk"), F.col("overall_level").alias("final_risk_level"), F.col("overall_score").alias("overall_risk_score"), F.lit("review").alias("recommended_action"),
                     "completeness_score", "timeliness_score", "availability_score", "integrity_score", "consistency_score", "drift_score", "propagation_score", "expected_risk_family")
    return M.feature_snapshot_v4(named)


@query("feature_snapshot_labelled", "M02", f"{HEAD} overall_risk_score:d label_risk_family label_action", f"SELECT {S}, overall_score AS overall_risk_score, label_risk_family, 'review' AS label_action FROM labelled_days")
def feature_snapshot_labelled(i):
    return labelled(i)


RELATIONS["score_days"] = "SELECT profile_id, dt, scenario_name, CASE WHEN k4 < 20 THEN 'late_events' ELSE '' END AS root_cause_code, CASE WHEN k3 < 40 THEN 0.0 ELSE a * 60 END AS final_risk_score, b * 70 AS stream_risk_score, c * 50 AS performance_risk_score, d * 40 AS availability_risk_score, e * 30 AS operational_risk_score FROM score_rows"
RELATIONS["training_days"] = """SELECT *, CASE WHEN final_risk_score >= 70 THEN 'critical' WHEN final_risk_score >= 40 THEN 'degraded' WHEN final_risk_score >= 20 THEN 'watch' ELSE 'stable' END AS final_risk_grade, CASE WHEN final_risk_score < 20 AND root <> 'late_events' THEN 0 ELSE 1 END AS binary_label, isodow(dt) - 1 AS dayofweek, month(dt) AS month_no,
  CASE WHEN isodow(dt) >= 6 THEN 1 ELSE 0 END AS is_weekend, lag(final_risk_score, 1, 0.0) OVER w AS final_risk_score_prev, avg(final_risk_score) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS final_risk_score_ma7, avg(stream_risk_score) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS stream_risk_score_ma7 FROM (
  SELECT * REPLACE (CASE WHEN final_risk_score > 0 THEN final_risk_score ELSE greatest(stream_risk_score, performance_risk_score, availability_risk_score, operational_risk_score) END AS final_risk_score), CASE WHEN root_cause_code <> '' THEN root_cause_code WHEN scenario_name = 'baseline' THEN 'baseline_ok' ELSE 'scenario_applied' END AS root FROM score_days) x WINDOW w AS (PARTITION BY profile_id ORDER BY dt)"""


@query("training_dataset", "M03 W09", f"{HEAD} final_risk_score:d final_risk_grade ml_label binary_label:i dayofweek:i month_no:i is_weekend:i final_risk_score_prev:d final_risk_score_ma7:d stream_risk_score_ma7:d", "SELECT *, root AS ml_label FROM training_days")
def training_dataset(i):
    return M.training_dataset(i.score_days)


@query("feature_rows", "M03", "profile_id dt:date feature_group feature_name feature_value:d feature_text",
       """SELECT profile_id, dt, 'numeric' AS feature_group, n AS feature_name, v AS feature_value, CAST(NULL AS VARCHAR) AS feature_text FROM (SELECT profile_id, dt, CAST(final_risk_score AS DOUBLE) AS final_risk_score, CAST(stream_risk_score AS DOUBLE) AS stream_risk_score FROM training_days) t UNPIVOT (v FOR n IN (final_risk_score, stream_risk_score))
  UNION ALL SELECT profile_id, dt, 'categorical', 'root_cause_code', NULL, root FROM training_days""")
def feature_rows(i):
    return M.feature_rows(M.training_dataset(i.score_days), ["final_risk_score", "stream_risk_score"], ["root_cause_code"])


NUMBERS = ("completeness_score", "timeliness_score", "availability_score", "integrity_score", "consistency_score", "drift_score", "propagation_score")
TEXTS = ("expected_risk_family",)


# where the models of an application and its tables are, once a query has fitted them
_fitted: dict[tuple[str, str], str] = {}


def models(i, rows):
    """Both models with the trees and depth that are the operators' defaults: fitted once, stored, and loaded by every query."""
    key = (i.spark.sparkContext.applicationId, i.sf_dir)
    if key not in _fitted:
        where = scratch_dir(i.spark, "models")
        train, _ = M.split_by_hash(rows, ["profile_id", "dt"])
        train = materialize(train, "train")
        M.save_models(where, "v1", classifier=M.train_classifier(train, "label_risk_family", NUMBERS, TEXTS), regressor=M.train_regressor(train, "overall_risk_score", NUMBERS, TEXTS))
        _fitted[key] = where
    return tuple(M.load_model(_fitted[key], "v1", name) for name in ("classifier", "regressor"))


def predicted(i):
    # dealt over many files, so that 600 trees are not walked for all rows by the few tasks of a small table
    rows = materialize(labelled(i).repartition(M.PARTS, *M.SCOPE), "labelled")
    return M.predict(*models(i, rows), rows, NUMBERS, TEXTS)


@query("predict_risk", "M04 M05 M06", f"{HEAD} predicted_label ml_risk_grade overall_risk_score:d")
def predict_risk(i):
    return predicted(i)


# what holds of predictions whatever the trees: every row once, labels that occur, grades of their bands, the gap to the rule score
@query("prediction_contract", "M04 M05 M06", "label_risk_family rows:i keys:i risk:d unknown_labels:i wrong_grades:i wrong_gaps:i wrong_confidence:i",
       "SELECT label_risk_family, count(*) AS rows, count(DISTINCT (profile_id, dt, scenario_name)) AS keys, sum(overall_score) AS risk, 0 AS unknown_labels, 0 AS wrong_grades, 0 AS wrong_gaps, 0 AS wrong_confidence FROM labelled_days GROUP BY ALL")
def prediction_contract(i):
    p = predicted(i)
    known = materialize(labelled(i).select("label_risk_family").distinct(), "families").withColumnRenamed("label_risk_family", "predicted_label").withColumn("known", F.lit(1))
    score = F.col("ml_risk_score")
    band = F.when(score >= 0.75, "CRITICAL").when(score >= 0.45, "HIGH").when(score >= 0.2, "WARN").otherwise("STABLE")
    right = (score >= 0) & (score <= 1) & (F.col("ml_risk_grade") == band)
    gap = F.abs(score - F.col("overall_risk_score") - F.col("score_gap")) < 1e-9
    sure = (F.col("prediction_confidence") > 0) & (F.col("prediction_confidence") <= 1 + 1e-9)
    wrong = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
    return p.join(known, "predicted_label", "left").groupBy("label_risk_family").agg(
        F.count("*").alias("rows"), F.count_distinct(*M.SCOPE).alias("keys"), F.sum("overall_risk_score").alias("risk"), F.count_if(F.col("known").isNull()).alias("unknown_labels"),
        wrong(right).alias("wrong_grades"), wrong(gap).alias("wrong_gaps"), wrong(sure).alias("wrong_confidence"))


@query("classification_report", "M04 M10", "label support:i precision:d recall:d f1:d")
def classification_report(i):
    _, test = M.split_by_hash(predicted(i), ["profile_id", "dt"])
    return M.classification_report(test, "label_risk_family")


@query("confusion_matrix", "M10", "label predicted cnt:i",
       "SELECT label_risk_family AS label, CASE WHEN overall_score < 0.3 THEN 'stable' ELSE label_risk_family END AS predicted, count(*) AS cnt FROM labelled_days GROUP BY ALL")
def confusion_matrix(i):
    guess = F.when(F.col("overall_risk_score") < 0.3, "stable").otherwise(F.col("label_risk_family"))
    return M.confusion_matrix(labelled(i).withColumn("predicted_label", guess), "label_risk_family")


@query("report_from_labels", "M10", "label support:i precision:d recall:d f1:d",
       """SELECT label, support, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT label, support, CASE WHEN made > 0 THEN tp / made ELSE 0 END AS p, tp / support AS r FROM (
  SELECT k.label, support, coalesce(made, 0) AS made, coalesce(tp, 0) AS tp FROM (SELECT label_risk_family AS label, count(*) AS support, count(*) FILTER (label_risk_family = 'stable' OR overall_score >= 0.3) AS tp FROM labelled_days GROUP BY ALL) k
  LEFT JOIN (SELECT CASE WHEN overall_score < 0.3 THEN 'stable' ELSE label_risk_family END AS label, count(*) AS made FROM labelled_days GROUP BY ALL) m USING (label)) x) y""")
def report_from_labels(i):
    guess = F.when(F.col("overall_risk_score") < 0.3, "stable").otherwise(F.col("label_risk_family"))
    return M.classification_report(labelled(i).withColumn("predicted_label", guess), "label_risk_family")


@query("top_features", "T07", f"{HEAD} names best:d",
       f"""SELECT {S}, array_to_string(list_transform(list_slice(l, 1, 3), lambda x: x.n), ',') AS names, l[1].v AS best FROM (SELECT {S}, list_sort([{{'s': abs(a), 'k': 0, 'n': 'a', 'v': a}}, {{'s': abs(b), 'k': -1, 'n': 'b', 'v': b}}, {{'s': abs(c), 'k': -2, 'n': 'c', 'v': c}}, {{'s': abs(d), 'k': -3, 'n': 'd', 'v': d}}, {{'s': abs(e), 'k': -4, 'n': 'e', 'v': e}}], 'DESC') AS l FROM score_rows) x""")
def top_features(i):
    t = M.top_features(["a", "b", "c", "d", "e"], 3)
    return i.score_rows.select(*M.SCOPE, t.alias("t")).select(*M.SCOPE, F.array_join(F.transform("t", lambda x: x["name"]), ",").alias("names"), F.col("t")[0]["value"].alias("best"))


RELATIONS["formula_rows"] = """SELECT profile_id, dt, scenario_name, e AS behavior_transaction_match_rate, f AS transaction_state_match_rate, k1 + 1 AS canonical_behavior_count, k2 AS canonical_transaction_count, k3 AS canonical_state_count, k4 AS orphan_state_count, k4 % 7 AS duplicate_order_count, k1 % 5 AS transaction_without_state_count, k2 % 9 AS behavior_only_count, k3 % 4 AS transaction_only_count,
  g AS conversion_distortion_score, d AS runtime_evidence_score, b AS overall_risk_score, CASE k4 % 6 WHEN 0 THEN 'stable' WHEN 1 THEN 'low' WHEN 2 THEN 'warning' WHEN 3 THEN 'high' WHEN 4 THEN 'critical' ELSE 'other' END AS final_risk_level FROM score_rows"""
RELATIONS["ratio_rows"] = """SELECT *, least(1, (1 - behavior_transaction_match_rate) * 0.5 + (1 - transaction_state_match_rate) * 0.5) AS reconciliation_gap, least(1, orphan_state_count / greatest(1, canonical_state_count)) AS orphan_ratio, least(1, duplicate_order_count / greatest(1, canonical_transaction_count)) AS duplicate_ratio, 1 - transaction_state_match_rate AS payment_state_gap, conversion_distortion_score AS conversion_distortion,
  least(1, transaction_without_state_count / greatest(1, canonical_transaction_count)) AS transaction_without_state_ratio, least(1, behavior_only_count / greatest(1, canonical_behavior_count)) AS behavior_only_ratio, least(1, transaction_only_count / greatest(1, canonical_transaction_count)) AS transaction_only_ratio FROM formula_rows"""


@query("derived_features", "M07", f"{HEAD} " + " ".join(f"{n}:d" for n in M.DERIVED), "SELECT * FROM ratio_rows")
def derived_features(i):
    return M.derived_features(i.formula_rows)


def logit(w):
    return "1 / (1 + exp(-(" + " + ".join(f"{n} * {x}" for n, x in w.items()) + " - 1.6)))"


@query("logistic_score", "M07", f"{HEAD} reconciliation_failure_probability:d predicted_score:d predicted_risk_class predicted_risk_level",
       f"""SELECT *, CASE WHEN predicted_score >= 0.75 THEN 'critical_reconciliation_failure' WHEN predicted_score >= 0.55 THEN 'high_reconciliation_risk' WHEN predicted_score >= 0.3 THEN 'warning_reconciliation_risk' WHEN predicted_score >= 0.08 THEN 'low_reconciliation_residual' ELSE 'normal_reconciliation_variation' END AS predicted_risk_class, {decisions.band('predicted_score')} AS predicted_risk_level FROM (
  SELECT *, 0.65 * overall_risk_score + 0.35 * reconciliation_failure_probability AS predicted_score FROM (SELECT *, {logit(M.LOGIT)} AS reconciliation_failure_probability FROM ratio_rows) x) y""")
def logistic_score(i):
    return M.logistic_score(M.derived_features(i.formula_rows))


RELATIONS["calibration_day"] = f"""SELECT *, CASE WHEN score_gap <= 0.35 THEN 'PASS' ELSE 'REVIEW' END AS calibration_status FROM (SELECT *, CASE WHEN final_risk_level = 'stable' OR (final_risk_level = 'low' AND severity < 0.25) THEN 'normal_reconciliation_variation' WHEN severity >= 0.75 THEN 'critical_reconciliation_failure' WHEN severity >= 0.55 THEN 'high_reconciliation_risk' WHEN severity >= 0.3 THEN 'warning_reconciliation_risk'
  ELSE 'low_reconciliation_residual' END AS calibrated_class, abs(severity - CASE final_risk_level WHEN 'stable' THEN 0.02 WHEN 'low' THEN 0.15 WHEN 'warning' THEN 0.45 WHEN 'high' THEN 0.72 WHEN 'critical' THEN 0.92 ELSE overall_risk_score END) AS score_gap FROM (
  SELECT *, 0.65 * overall_risk_score + 0.35 * probability AS severity FROM (SELECT *, {logit(M.CALIBRATION_LOGIT)} AS probability FROM ratio_rows) x) y) z"""


def calibrated(i):
    return M.calibrate(M.derived_features(i.formula_rows))


@query("calibrate", "M08", f"{HEAD} probability:d severity:d calibrated_class score_gap:d calibration_status", "SELECT * FROM calibration_day")
def calibrate(i):
    return calibrated(i)


@query("verify_ml", "M09", f"{HEAD} feature_snapshot_flag:i calibration_flag:i prediction_flag:i baseline_ok_flag:i score_gap_review_flag:i verification_status",
       f"""SELECT *, CASE WHEN feature_snapshot_flag = 0 THEN 'FAIL' WHEN calibration_flag = 1 AND prediction_flag = 1 AND baseline_ok_flag = 1 AND score_gap_review_flag = 0 THEN 'PASS' ELSE 'REVIEW' END AS verification_status FROM (
  SELECT {S}, CASE WHEN r.k1 < 350 THEN 1 ELSE 0 END AS feature_snapshot_flag, CASE WHEN r.k2 < 250 THEN 1 ELSE 0 END AS calibration_flag, CASE WHEN r.k3 < 100 THEN 1 ELSE 0 END AS prediction_flag, CASE WHEN scenario_name <> 'baseline' OR (classification = 'None' AND c.final_risk_level IN ('stable', 'low')) THEN 1 ELSE 0 END AS baseline_ok_flag,
  CASE WHEN r.k2 < 250 AND g.score_gap > 0.35 THEN 1 ELSE 0 END AS score_gap_review_flag FROM score_rows r JOIN (SELECT {S}, classification, final_risk_level FROM classified) c USING ({S}) JOIN (SELECT {S}, score_gap FROM calibration_day) g USING ({S})) x""")
def verify_ml(i):
    rows = i.score_rows
    keys = list(M.SCOPE)
    cal = calibrated(i).join(rows.where("k2 < 250").select(*keys), keys)
    dec = decided(i).withColumn("recommended_action", F.lit("no action"))
    return M.verify_ml(rows, rows.where("k1 < 350"), cal, rows.where("k3 < 100"), dec)


@query("feature_dataset", "J16 J11", f"{HEAD} overall_risk_score:d severity:d issue_count:i",
       f"SELECT {S}, f.overall_risk_score, c.severity, v.issue_count FROM formula_rows f LEFT JOIN (SELECT {S}, severity FROM calibration_day WHERE severity > 0.2) c USING ({S}) LEFT JOIN (SELECT {S}, k4 % 3 AS issue_count FROM score_rows WHERE k1 < 300) v USING ({S})")
def feature_dataset(i):
    keys = (*M.SCOPE, "source_gen_run_id")
    run = lambda d: d.withColumn("source_gen_run_id", F.lit(None).cast("bigint"))
    cal = run(calibrated(i).where("severity > 0.2").select(*M.SCOPE, "severity"))
    val = run(i.score_rows.where("k1 < 300").select(*M.SCOPE, (F.col("k4") % 3).alias("issue_count")))
    score = run(i.score_rows.where("k2 < 300").select(*M.SCOPE, F.col("a").alias("ai_score")))
    return M.feature_dataset(run(i.formula_rows), cal, val, score, keys)


@query("decision_context", "J17", f"{HEAD} overall_risk_score:d classification dominant_dimension severity:d",
       f"SELECT {S}, c.overall_risk_score, classification, dominant_dimension, severity FROM (SELECT {S}, overall_risk_score, classification FROM classified) c LEFT JOIN (SELECT {S}, dominant_dimension FROM dimensioned) d USING ({S}) LEFT JOIN (SELECT {S}, severity FROM calibration_day) k USING ({S})")
def decision_context(i):
    risk = decided(i).select(*M.SCOPE, "overall_risk_score", "classification")
    return M.decision_context(risk, D.dimension_reliability(i.dimension_rows).select(*M.SCOPE, "dominant_dimension"), calibrated(i).select(*M.SCOPE, "severity"))


# --- generated text ---------------------------------------------------------------------

CTX = {"measurement": ["behavior_transaction_match_rate", "transaction_state_match_rate"], "risk": ["overall_risk_score", "final_risk_level"], "forecast": ["not_there"], "note": ["late_note"]}
RELATIONS["context_rows"] = "SELECT *, CASE WHEN overall_risk_score < 0.3 THEN 'late' END AS late_note FROM formula_rows"


@query("incident_context", "G01", f"{HEAD} parts evidence_count:i", f"SELECT {S}, CASE WHEN late_note IS NULL THEN 'measurement,risk' ELSE 'measurement,risk,note' END AS parts, CASE WHEN late_note IS NULL THEN 2 ELSE 3 END AS evidence_count FROM context_rows")
def incident_context(i):
    return T.incident_context(i.context_rows, CTX).withColumn("parts", F.array_join("evidence_parts", ","))


@query("template_summary", "G02", f"{HEAD} root_cause_summary recommended_action_summary has_level:i",
       f"SELECT {S}, CASE WHEN classification = 'None' THEN 'Baseline residual mismatch is treated as non-promoted evidence when semantic/action gates suppress it.' ELSE 'Primary evidence is ' || classification || ', supported by reconciliation and semantic tables.' END AS root_cause_summary, 'Recommended action from governed action layer: no action.' AS recommended_action_summary, 1 AS has_level FROM classified")
def template_summary(i):
    d = decided(i).withColumn("dominant_semantic_risk", F.col("classification")).withColumn("recommended_action", F.lit("no action"))
    out = T.template_summary(d)
    return out.withColumn("has_level", F.col("incident_explanation").rlike("final_risk_level=(stable|low|warning|high|critical), overall_risk_score=[01]\\.[0-9]{6}").cast("int"))


# texts of the document table, some with claims and some with evidence for them
RELATIONS["checked_texts"] = """SELECT doc_id, CASE WHEN n_chars < 300 THEN concat(text, ' The Collector crash and a network outage certainly caused the delta.') WHEN n_chars < 900 THEN concat(text, ' Memory leak, disk full, broker outage and DB failure; score and measurement of completeness; monitor.') ELSE text END AS checked_text,
  CASE WHEN n_chars < 150 THEN concat(lang, ' collector crash seen') WHEN n_chars < 600 THEN 'memory leak' ELSE source END AS evidence_text, CASE WHEN n_chars < 400 THEN 'Completeness' WHEN n_chars < 1500 THEN 'None' ELSE 'Integrity' END AS dominant_semantic_risk, CASE WHEN n_chars < 700 THEN 1 ELSE 0 END AS has_evidence,
  CASE WHEN n_chars < 700 THEN 'No Action' WHEN n_chars < 2000 THEN '' ELSE 'mapping validation' END AS rule_action, n_chars FROM documents"""
_L = "lower(checked_text)"


def any_of(t, words):
    return "(" + " OR ".join(f"contains({t}, '{w.lower()}')" for w in words) + ")"


_CL = ", ".join(f"CASE WHEN {any_of(_L, w)} AND NOT {any_of('lower(evidence_text)', T.ALSO_SUPPORTS.get(k, [k]))} THEN '{k}' END" for k, w in T.CLAIMS.items())
RELATIONS["claimed_texts"] = f"SELECT *, array_to_string(u, ',') AS unsupported_claims, len(u) AS unsupported_claim_count, least(1, len(u) / 3) AS hallucination_score, CASE WHEN len(u) > 0 THEN 1 ELSE 0 END AS hallucination_flag FROM (SELECT *, list_filter([{_CL}], lambda x: x IS NOT NULL) AS u FROM checked_texts) c"


@query("check_unsupported_claims", "G03 P33", "doc_id:i unsupported_claims unsupported_claim_count:i hallucination_score:d hallucination_flag:i", "SELECT * FROM claimed_texts")
def check_unsupported_claims(i):
    return T.check_unsupported_claims(i.checked_texts)


_SEM = "CASE dominant_semantic_risk WHEN 'None' THEN true " + " ".join(f"WHEN '{k}' THEN {any_of(_L, v)}" for k, v in T.RISK_TERMS.items() if k != "None") + " END"
RELATIONS["interpreted_texts"] = f"""SELECT *, CASE WHEN m >= 0.75 THEN 'PASS' WHEN m >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS interpretation_status, m AS interpretation_score FROM (SELECT *, (signal_match_score + semantic_match_score + evidence_match_score + measurement_reference_score) / 4 AS m FROM (
  SELECT doc_id, CASE WHEN {any_of(_L, T.SIGNAL_TERMS)} THEN 1 ELSE 0 END AS signal_match_score, CASE WHEN {_SEM} THEN 1 ELSE 0 END AS semantic_match_score, CASE WHEN has_evidence = 1 AND {any_of(_L, T.EVIDENCE_TERMS)} THEN 1 ELSE 0 END AS evidence_match_score, CASE WHEN {any_of(_L, T.MEASURE_TERMS)} THEN 1 ELSE 0 END AS measurement_reference_score FROM checked_texts) x) y"""
IN_COLS = "doc_id:i signal_match_score:d semantic_match_score:d evidence_match_score:d measurement_reference_score:d interpretation_score:d interpretation_status"


@query("check_interpretation", "G04", IN_COLS, "SELECT * FROM interpreted_texts")
def check_interpretation(i):
    return T.check_interpretation(i.checked_texts)


RELATIONS["aligned_texts"] = f"SELECT doc_id, CASE WHEN ok THEN 1 ELSE 0 END AS action_match_score, CASE WHEN ok THEN 'ALIGNED' ELSE 'MISMATCH' END AS action_status FROM (SELECT doc_id, CASE lower(rule_action) WHEN 'no action' THEN {any_of(_L, T.ACTION_TERMS['no action'])} WHEN 'mapping validation' THEN {any_of(_L, T.ACTION_TERMS['mapping validation'])} ELSE false END AS ok FROM checked_texts) x"


@query("check_action_alignment", "G05", "doc_id:i action_match_score:d action_status", "SELECT * FROM aligned_texts")
def check_action_alignment(i):
    return T.check_action_alignment(i.checked_texts, "checked_text")


RELATIONS["generated_texts"] = "SELECT doc_id, checked_text AS summary_text, has_evidence AS evidence_count, CASE WHEN n_chars < 500 THEN 'low' ELSE 'high' END AS final_risk_level, CASE WHEN n_chars < 250 THEN 0.1 ELSE 0.4 END AS overall_risk_score, CASE WHEN n_chars < 200 THEN 'pipeline validation' ELSE 'no action' END AS recommended_action, n_chars FROM checked_texts"
_G = "lower(summary_text)"
RELATIONS["flagged_texts"] = f"""SELECT *, missing_evidence_flag + unsupported_explanation_flag + hallucination_flag + wrong_action_flag AS issue_count, CASE WHEN missing_evidence_flag + unsupported_explanation_flag + hallucination_flag + wrong_action_flag = 0 THEN 'PASS' ELSE 'FAIL' END AS validation_status FROM (
  SELECT doc_id, CASE WHEN evidence_count <= 0 THEN 1 ELSE 0 END AS missing_evidence_flag, CASE WHEN {any_of(_G, T.OVERCONFIDENT)} THEN 1 ELSE 0 END AS unsupported_explanation_flag, CASE WHEN (contains({_G}, 'outage') AND NOT {any_of(_G, ['runtime', 'availability'])}) OR (evidence_count <= 0 AND {any_of(_G, T.RECONCILIATION_TERMS)}) THEN 1 ELSE 0 END AS hallucination_flag,
  CASE WHEN final_risk_level = 'low' AND overall_risk_score < 0.2 AND recommended_action <> 'no action' THEN 1 ELSE 0 END AS wrong_action_flag FROM generated_texts) x"""
FLAGS = "doc_id:i missing_evidence_flag:i unsupported_explanation_flag:i hallucination_flag:i wrong_action_flag:i"


@query("check_generated", "G06", f"{FLAGS} issue_count:i validation_status", "SELECT * FROM flagged_texts")
def check_generated(i):
    return T.check_generated(i.generated_texts)


@query("ai_reliability_score", "G07", "doc_id:i overall_ai_risk_score:d ai_reliability_level",
       "SELECT doc_id, s AS overall_ai_risk_score, CASE WHEN s = 0 THEN 'trusted' WHEN s < 0.5 THEN 'review' ELSE 'blocked' END AS ai_reliability_level FROM (SELECT doc_id, CAST(least(1, missing_evidence_flag * 0.3 + unsupported_explanation_flag * 0.25 + hallucination_flag * 0.3 + wrong_action_flag * 0.15) AS DOUBLE) AS s FROM flagged_texts) x")
def ai_reliability_score(i):
    return T.ai_reliability_score(T.check_generated(i.generated_texts))


@query("interpretation_reliability", "G07", "doc_id:i overall_ai_risk_score:d validation_status",
       """SELECT doc_id, s AS overall_ai_risk_score, CASE WHEN s <= 0.15 THEN 'PASS' WHEN s <= 0.35 THEN 'WARN' ELSE 'FAIL' END AS validation_status FROM (SELECT doc_id, round(0.3 * (1 - (signal_match_score + semantic_match_score) / 2) + 0.3 * (1 - (evidence_match_score + measurement_reference_score) / 2) + 0.25 * (1 - action_match_score) + 0.15 * hallucination_score, 6) AS s
  FROM interpreted_texts JOIN aligned_texts USING (doc_id) JOIN (SELECT doc_id, hallucination_score FROM claimed_texts) h USING (doc_id)) x""")
def interpretation_reliability(i):
    d = T.check_unsupported_claims(i.checked_texts)
    return T.interpretation_reliability(T.check_action_alignment(T.check_interpretation(d), "checked_text"))


RELATIONS["generated_log"] = """SELECT concat('p', CAST(conv_id % 40 AS STRING)) AS profile_id, CAST('2024-01-01' AS DATE) AS dt, turn AS created_at, conv_id * 100 + turn AS execution_id, CASE role WHEN 'assistant' THEN 'OK' ELSE 'ERROR' END AS api_status, CASE WHEN length(text) < 60 THEN 1 ELSE 0 END AS fallback_used, text AS summary_text,
  CASE role WHEN 'assistant' THEN 'vendor' ELSE 'none' END AS provider, 'model' AS output_source, length(text) AS total_tokens, length(text) * 0.5 AS cost FROM conversations"""
RELATIONS["own_texts"] = "SELECT DISTINCT profile_id, dt, 'own text' AS summary_text FROM generated_log"
_BEST = "row_number() OVER (PARTITION BY profile_id, dt ORDER BY CASE WHEN api_status = 'OK' AND fallback_used = 0 THEN 0 ELSE 1 END, created_at DESC, execution_id DESC)"


@query("prefer_generated", "J13", "profile_id dt:date output_source",
       f"SELECT profile_id, dt, CASE WHEN api_status = 'OK' AND fallback_used = 0 THEN 'LLM' ELSE 'FALLBACK' END AS output_source FROM (SELECT *, {_BEST} AS rn FROM generated_log) x WHERE rn = 1")
def prefer_generated(i):
    return T.prefer_generated(i.own_texts, i.generated_log)


@query("usage_governance", "G08", "profile_id dt:date calls:i fallback_calls:i total_tokens:i total_cost:d governance_status",
       "SELECT *, CASE WHEN fallback_calls = calls THEN 'NOT_CALLED' ELSE 'COMPLETED' END AS governance_status FROM (SELECT profile_id, dt, count(*) AS calls, count(*) FILTER (provider = 'none') AS fallback_calls, sum(total_tokens) AS total_tokens, sum(cost) AS total_cost FROM generated_log GROUP BY ALL) x")
def usage_governance(i):
    return T.usage_governance(i.generated_log)
