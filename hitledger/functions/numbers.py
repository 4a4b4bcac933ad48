"""Guarded ratios, clamps and level bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(x) -> Column:
    """Column from a name, a number or a column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def dbl(x) -> Column:
    return col(x).cast("double")


def clamp01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dbl(x), F.lit(0.0))))


def safe_div(num, den) -> Column:
    """``num / den`` clamped to [0, 1]; 0 where the denominator is not positive."""
    n, d = F.coalesce(dbl(num), F.lit(0.0)), F.coalesce(dbl(den), F.lit(0.0))
    return F.when(d <= 0, 0.0).otherwise(clamp01(n / F.when(d > 0, d)))


def ratio(num, den, digits: int | None = None) -> Column:
    """``num / den``, 0 where the denominator is 0 or null."""
    d = dbl(den)
    out = F.when(d.isNull() | (d == 0), 0.0).otherwise(dbl(num) / F.when(d != 0, d))
    return out if digits is None else F.round(out, digits)


def ratio_drop(base, current) -> Column:
    """Share of ``base`` that ``current`` lost."""
    return safe_div(dbl(base) - F.coalesce(dbl(current), F.lit(0.0)), base)


def _delta_base(base) -> Column:
    return F.greatest(F.lit(1.0), F.abs(F.coalesce(dbl(base), F.lit(0.0))))


def _signed_delta(current, base) -> Column:
    return (F.coalesce(dbl(current), F.lit(0.0)) - F.coalesce(dbl(base), F.lit(0.0))) / _delta_base(base)


def abs_delta_ratio(current, base) -> Column:
    return F.abs(_signed_delta(current, base))


def positive_delta_ratio(current, base) -> Column:
    return F.greatest(F.lit(0.0), _signed_delta(current, base))


def negative_delta_ratio(current, base) -> Column:
    return F.greatest(F.lit(0.0), -_signed_delta(current, base))


def availability_drop(current, base) -> Column:
    """Relative loss of an availability ratio; 0 without a positive base."""
    b = F.coalesce(dbl(base), F.lit(0.0))
    lost = (b - F.coalesce(dbl(current), F.lit(0.0))) / F.when(b > 0, b)
    return F.when(b <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), lost))


# Cut lists, highest first; the last label is the floor.
RELIABILITY = ([(0.75, "critical"), (0.55, "high"), (0.30, "warning"), (0.08, "low")], "stable")
STATUS = ([(0.6, "FAIL"), (0.2, "WARN")], "PASS")
GAP_SEVERITY = ([(0.30, "critical"), (0.15, "high"), (0.05, "warning")], "low")
EVIDENCE = ([(0.75, "critical"), (0.5, "high"), (0.25, "warning")], "low")
CONFIDENCE = ([(0.80, "high"), (0.55, "medium"), (0.30, "low")], "weak")
RISK_CONFIDENCE = ([(0.80, "high"), (0.50, "medium"), (0.0, "low")], "unknown")
PROPAGATION = ([(0.70, "high"), (0.40, "medium"), (0.0, "low")], "none")
SIGNAL = ([(0.20, "high"), (0.10, "warning"), (0.0, "review")], "low")
GRADE = ([(70.0, "critical"), (40.0, "degraded"), (20.0, "watch")], "stable")
BANDS = {
    "reliability": RELIABILITY,
    "status": STATUS,
    "gap_severity": GAP_SEVERITY,
    "evidence": EVIDENCE,
    "confidence": CONFIDENCE,
    "risk_confidence": RISK_CONFIDENCE,
    "propagation": PROPAGATION,
    "signal": SIGNAL,
    "grade": GRADE,
}


def level_band(score, cuts=RELIABILITY, strict: bool = False) -> Column:
    """First label whose cut the score reaches (exceeds when ``strict``)."""
    steps, floor = BANDS[cuts] if isinstance(cuts, str) else cuts
    s = F.coalesce(dbl(score), F.lit(0.0))
    out = None
    for cut, label in steps:
        hit = (s > cut) if (strict or cut == 0.0) else (s >= cut)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(floor)


def dominant(scores: dict, none: str = "none", floor: float = 0.0) -> Column:
    """Name of the highest score; ties go to the first listed; ``none`` at or below floor."""
    return ranked_names(scores, 1, none, floor)


def ranked_names(scores: dict, position: int, none: str = "none", floor: float = 0.0) -> Column:
    """Name of the ``position``-th best score when it exceeds ``floor``."""
    items = [
        F.struct(F.coalesce(dbl(c), F.lit(0.0)).alias("score"), F.lit(-i).alias("turn"), F.lit(name).alias("name"))
        for i, (name, c) in enumerate(scores.items())
    ]
    best = F.sort_array(F.array(*items), asc=False)[position - 1]
    return F.when(best["score"] > floor, best["name"]).otherwise(F.lit(none))


def first_nonblank(*cols) -> Column:
    return F.coalesce(*[F.nullif(F.trim(col(c).cast("string")), F.lit("")) for c in cols])


def pick_number(*cols, default: float | None = None) -> Column:
    """First candidate that reads as a number."""
    tries = [col(c).cast("string").try_cast("double") for c in cols]
    return F.coalesce(*tries, *([] if default is None else [F.lit(float(default))]))
