"""Formulas of the models against numbers worked out by hand, with no constant of the package."""

import math

import pytest

from hitledger.operators import ml as M

COLUMNS = (
    "behavior_transaction_match_rate double, transaction_state_match_rate double, canonical_behavior_count int, canonical_transaction_count int, canonical_state_count int, "
    "orphan_state_count int, duplicate_order_count int, transaction_without_state_count int, behavior_only_count int, transaction_only_count int, "
    "conversion_distortion_score double, runtime_evidence_score double, overall_risk_score double, final_risk_level string"
)
ROW = (0.8, 0.6, 10, 20, 5, 1, 2, 4, 3, 5, 0.25, 0.4)


@pytest.fixture(scope="module")
def features(spark):
    return M.derived_features(spark.createDataFrame([(*ROW, 0.5, "warning"), (*ROW, 0.1, "critical"), (*ROW, 0.1, "stable"), (*ROW, 0.1, "low")], COLUMNS))


def near(got, want):
    assert {k: got[k] for k in want if isinstance(want[k], str)} == {k: v for k, v in want.items() if isinstance(v, str)}
    assert all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items() if not isinstance(v, str)), (got, want)


def test_derived_features(features):
    # half of 0.2 and half of 0.4; 1 of 5, 2 of 20, 1 - 0.6, 4 of 20, 3 of 10, 5 of 20
    near(features.first().asDict(), {"reconciliation_gap": 0.3, "orphan_ratio": 0.2, "duplicate_ratio": 0.1, "payment_state_gap": 0.4, "conversion_distortion": 0.25, "transaction_without_state_ratio": 0.2, "behavior_only_ratio": 0.3, "transaction_only_ratio": 0.25})


def test_logistic_score(features):
    # 0.36 + 0.48 + 0.18 + 0.16 + 0.20 + 0.16 + 0.10 - 1.6 = 0.04; its odds give 0.5099986668799655
    got = M.logistic_score(features).where("overall_risk_score = 0.5").first().asDict()
    near(got, {"reconciliation_failure_probability": 0.5099986668799655, "predicted_score": 0.325 + 0.35 * 0.5099986668799655, "predicted_risk_class": "warning_reconciliation_risk"})


def test_calibration(features):
    # 0.375 + 0.56 + 0.2 + 0.2 + 0.275 + 0.16 - 1.6 = 0.17; its odds give 0.542397940774351
    p = 0.542397940774351
    got = {r.final_risk_level: r.asDict() for r in M.calibrate(features).collect()}
    near(got["warning"], {"probability": p, "severity": 0.325 + 0.35 * p, "score_gap": 0.325 + 0.35 * p - 0.45, "calibrated_class": "warning_reconciliation_risk", "calibration_status": "PASS"})
    low = 0.065 + 0.35 * p  # 0.2548
    near(got["critical"], {"severity": low, "score_gap": 0.92 - low, "calibrated_class": "low_reconciliation_residual", "calibration_status": "REVIEW"})
    near(got["stable"], {"score_gap": low - 0.02, "calibrated_class": "normal_reconciliation_variation", "calibration_status": "PASS"})
    near(got["low"], {"score_gap": low - 0.15, "calibrated_class": "low_reconciliation_residual", "calibration_status": "PASS"})
