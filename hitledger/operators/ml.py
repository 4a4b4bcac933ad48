"""Feature snapshots, risk models on ``pyspark.ml``, and checks of their output."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N, text as X
from . import forest as FO
from .baseline import previous_and_moving
from .evidence import is_reference, num
from .joins import null_safe_join

SCOPE = ("profile_id", "dt", "scenario_name")
c = F.col


def ml_feature_snapshot(scopes: DataFrame, tables: dict[str, DataFrame], counts: dict[str, DataFrame], numbers=(), texts: dict | None = None, scope=SCOPE) -> DataFrame:
    """One wide row per scope from day tables and row counts, with defaults where nothing was found."""
    out = scopes.select(*scope).distinct()
    for df in tables.values():
        out = out.join(df.drop(*[x for x in df.columns if x in out.columns and x not in scope]), list(scope), "left")
    for name, df in counts.items():
        out = out.join(df.groupBy(*scope).agg(F.count("*").alias(f"{name}_count")), list(scope), "left")
    zero = {n: F.coalesce(c(n).cast("double"), F.lit(0.0)) if n in out.columns else F.lit(0.0) for n in numbers}
    said = {n: F.coalesce(F.nullif(c(n).cast("string"), F.lit("")), F.lit(d)) if n in out.columns else F.lit(d) for n, d in (texts or {}).items()}
    return out.select(*scope, *[e.alias(n) for n, e in zero.items()], *[e.alias(n) for n, e in said.items()], *[F.coalesce(c(f"{n}_count"), F.lit(0)).alias(f"{n}_count") for n in counts])


# Word in a dominant risk and its label.
LABELS = [("complete", "completeness_risk"), ("time", "timeliness_risk"), ("integr", "integrity_risk"), ("consisten", "consistency_risk"), ("avail", "availability_risk")]


def label_family(dominant, level, score) -> Column:
    d = X.lower0(dominant)
    out = F.when((N.dbl(score) <= 0) | X.lower0(level).isin("stable", "low"), "stable")
    for word, label in LABELS:
        out = out.when(d.contains(word), label)
    return out.otherwise(F.concat(F.when(d == "", "unknown").otherwise(d), F.lit("_risk")))


def feature_snapshot_v4(snapshot: DataFrame) -> DataFrame:
    """A snapshot with its label of risk family and action."""
    return snapshot.select("*", label_family("dominant_semantic_risk", "final_risk_level", "overall_risk_score").alias("label_risk_family"), c("recommended_action").alias("label_action"))


TRAINING_SERIES = ("final_risk_score", "stream_risk_score", "performance_risk_score", "availability_risk_score", "operational_risk_score")


def training_dataset(days: DataFrame) -> DataFrame:
    """Daily scores with grade, label, calendar parts and trailing means.

    ``days`` has profile_id, dt, scenario_name, root_cause_code and the five
    scores on a 0-100 scale; a missing final score is the highest of the others.
    """
    parts = [num(s) for s in TRAINING_SERIES[1:]] + ([num("data_risk_score")] if "data_risk_score" in days.columns else [])
    final = F.when(num("final_risk_score") > 0, num("final_risk_score")).otherwise(F.greatest(*parts))
    d = days.select(*[x for x in days.columns if x != "final_risk_score"], final.alias("final_risk_score"))
    root = F.coalesce(F.nullif("root_cause_code", F.lit("")), F.when(c("scenario_name") == "baseline", "baseline_ok").otherwise("scenario_applied"))
    d = d.withColumn("root_cause_code", root)
    calm = (c("final_risk_score") < 20) & c("root_cause_code").isin("baseline_ok", "scenario_applied")
    weekday = F.weekday("dt")
    d = d.select(
        "*", N.level_band("final_risk_score", "grade").alias("final_risk_grade"), c("root_cause_code").alias("ml_label"), F.when(calm, 0).otherwise(1).alias("binary_label"),
        (c("final_risk_score") >= 20).cast("int").alias("risk_signal_count"), weekday.alias("dayofweek"), F.month("dt").alias("month_no"), (weekday >= 5).cast("int").alias("is_weekend"))
    return previous_and_moving(d, TRAINING_SERIES)


def feature_rows(dataset: DataFrame, numbers, texts, keys=("profile_id", "dt")) -> DataFrame:
    """A wide dataset as long numeric and categorical feature rows."""
    row = lambda g, n, v, t: F.struct(F.lit(g).alias("feature_group"), F.lit(n).alias("feature_name"), v.cast("double").alias("feature_value"), t.cast("string").alias("feature_text"))
    items = [row("numeric", n, c(n), F.lit(None)) for n in numbers] + [row("categorical", t, F.lit(None), F.coalesce(c(t).cast("string"), F.lit(""))) for t in texts]
    return dataset.select(*keys, F.inline(F.array(*items)))


# --- models ------------------------------------------------------------------------


def _prepare(df: DataFrame, numbers, texts) -> DataFrame:
    return df.select("*", *[F.coalesce(c(n).cast("double"), F.lit(float("nan"))).alias(f"_n_{n}") for n in numbers], *[F.coalesce(F.nullif(c(t).cast("string"), F.lit("")), F.lit("none")).alias(f"_t_{t}") for t in texts])


def _stages(numbers, texts):
    """Missing numbers become 0, categories one-hot; unseen categories are ignored."""
    stages = []
    if texts:
        stages.append(StringIndexer(inputCols=[f"_t_{t}" for t in texts], outputCols=[f"_i_{t}" for t in texts], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"_i_{t}" for t in texts], outputCols=[f"_o_{t}" for t in texts], handleInvalid="keep"))
    return stages + [VectorAssembler(inputCols=[f"_f_{n}" for n in numbers] + [f"_o_{t}" for t in texts], outputCol="_features")]


def _filled(df: DataFrame, numbers, texts) -> DataFrame:
    d = _prepare(df, numbers, texts)
    return d.select("*", *[F.nanvl(c(f"_n_{n}"), F.lit(0.0)).alias(f"_f_{n}") for n in numbers])


def median_imputer(numbers) -> Imputer:
    """Alternative to zero filling where the median suits a feature better."""
    return Imputer(inputCols=list(numbers), outputCols=[f"{n}_imputed" for n in numbers], strategy="median")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight of each row: rows over classes times rows of its class."""
    counts = df.groupBy(label).agg(F.count("*").alias("_k"))
    whole = counts.agg(F.sum("_k").alias("_n"), F.count("*").alias("_m"))
    # one row of totals, attached to the handful of classes by a constant key
    per = counts.withColumn("_one", F.lit(1)).join(whole.withColumn("_one", F.lit(1)), "_one")
    # sent to the rows: a shuffle by class would put each class into one task
    return df.join(F.broadcast(per.select(label, (c("_n") / (c("_m") * c("_k"))).alias("class_weight"))), label)


def split_by_hash(df: DataFrame, row_key, share: float = 0.30, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the row key: the same split on any cluster."""
    at = F.pmod(F.xxhash64(*[c(k) for k in row_key], F.lit(seed)), F.lit(10_000)) / 10_000.0
    return df.where(at >= share), df.where(at < share)


# rows of a part of a training set, and its parts at most: each part sends its statistics of every node
PART_ROWS, PARTS = 2000, 48


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Rows dealt evenly over ``parts`` parts, in an order of their own; the count is given, so adaptive execution leaves the parts as they are."""
    whole = F.xxhash64(*[c(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant")])
    return df.withColumn("_dealt", whole).repartition(parts, "_dealt").sortWithinPartitions("_dealt").drop("_dealt")


def in_parts(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over as many parts as their number asks for, in an order of their own.

    The trees are fitted part by part. Small rows would all be read, or joined
    and coalesced, into one or a few tasks, which then walk every tree for all
    rows.
    """
    return dealt(df, max(1, min(PARTS, -(-df.count() // PART_ROWS))))


def _many(df: DataFrame) -> int:
    """Parts of training rows that are too many for ``pyspark.ml``, which holds two numbers for each of them and each tree; 0 for fewer rows."""
    n = df.count()
    return min(FO.PARTS, -(-n // FO.ROWS)) if n > PART_ROWS * PARTS else 0


def _trained(df: DataFrame, ready, stages, forest, y: Column, w: Column, weights=None) -> list:
    """The fitted stages before a forest and its model; ``ready`` makes the columns they read, ``weights`` the classes' weights from the fitted stages."""
    parts = _many(df)
    if not parts:
        return Pipeline(stages=[*stages, forest]).fit(ready(in_parts(df))).stages
    before = Pipeline(stages=stages).fit(ready(df))
    # dealt after the join of the weights: the order of rows below a join is dropped, and a row's draws follow from its place
    rows = before.transform(dealt(ready(df), parts)).select(vector_to_array("_features").alias("x"), y.alias("y"), w.alias("w"))
    return [*before.stages, FO.fit_forest(forest, rows, parts, weights and weights(before))]


def train_classifier(df: DataFrame, label: str, numbers, texts=(), trees: int = 300, depth: int = 8, seed: int = 42):
    """Balanced random forest; predictions carry the label as ``predicted_label``."""
    known = df.where(c(label).isNotNull())
    ready = lambda d: balanced_weights(_filled(d, numbers, texts), label)
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="class_weight", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True)

    def weights(before):
        # one more class stands for labels that were not there
        of = {r[0]: r[1] for r in balanced_weights(known, label).groupBy(c(label).cast("string")).agg(F.max("class_weight")).collect()}
        return FO.np.array([*[of[x] for x in before.stages[0].labels], 0.0])

    fitted = _trained(known, ready, [index, *_stages(numbers, texts)], forest, c("_label").cast("int"), c("class_weight"), weights)
    return PipelineModel([*fitted, IndexToString(inputCol="prediction", outputCol="predicted_label", labels=fitted[0].labels)])


def train_regressor(df: DataFrame, target: str, numbers, texts=(), trees: int = 300, depth: int = 8, seed: int = 42):
    ready = lambda d: _filled(d, numbers, texts).withColumn("_target", num(target))
    forest = RandomForestRegressor(featuresCol="_features", labelCol="_target", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True)
    return PipelineModel(_trained(df, ready, _stages(numbers, texts), forest, c("_target"), F.lit(1.0)))


def save_models(path: str, version: str, **models) -> None:
    """Fitted pipelines under ``path/version``, each in a folder of its name; a version is written once and then only read."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{version}/{name}")


def load_model(path: str, version: str, name: str):
    """A pipeline that ``save_models`` has written, fitted, with its indexes and label names."""
    return PipelineModel.load(f"{path}/{version}/{name}")


def regression_metrics(model, df: DataFrame, target: str, numbers, texts=()) -> dict:
    scored = model.transform(_filled(df, numbers, texts).withColumn("_target", num(target)))
    ev = RegressionEvaluator(labelCol="_target", predictionCol="prediction")
    return {"mae": ev.evaluate(scored, {ev.metricName: "mae"}), "r2": ev.evaluate(scored, {ev.metricName: "r2"})}


def top_features(numbers, k: int = 10) -> Column:
    """The ``k`` features of a row with the largest absolute value."""
    items = F.array(*[F.struct(F.abs(num(n)).alias("abs_value"), F.lit(-i).alias("turn"), F.lit(n).alias("name"), num(n).alias("value")) for i, n in enumerate(numbers)])
    best = F.slice(F.sort_array(items, asc=False), 1, k)
    return F.transform(best, lambda x: F.struct(x["name"].alias("name"), x["abs_value"].alias("abs_value"), x["value"].alias("value")))


# Grades of a model score.
ML_GRADES = ([(0.75, "CRITICAL"), (0.45, "HIGH"), (0.20, "WARN")], "STABLE")


def predict(classifier, regressor, df: DataFrame, numbers, texts=(), rule_score: str = "overall_risk_score") -> DataFrame:
    """Label, confidence, clamped score, grade and gap to the rule score."""
    d = _filled(df.select("*", top_features(numbers).alias("top_features")), numbers, texts)
    labelled = _said(classifier if "_label" in d.columns else _without_label(classifier), d)
    kept = [*df.columns, "top_features"]
    labelled = labelled.select(*kept, *[x for x in d.columns if x.startswith("_")], "predicted_label", c("_said.confidence").alias("prediction_confidence"))
    scored = _said(regressor, labelled)
    score = N.clamp01("prediction")
    return scored.select(*kept, "predicted_label", "prediction_confidence", score.alias("ml_risk_score"), N.level_band(score, ML_GRADES).alias("ml_risk_grade"), (score - num(rule_score)).alias("score_gap"))


def _said(model, df: DataFrame) -> DataFrame:
    """Rows through a fitted pipeline; its forest is walked for many rows at once and leaves ``prediction`` and ``_said``."""
    for stage in model.stages:
        if isinstance(stage, (RandomForestClassificationModel, RandomForestRegressionModel)):
            df = df.withColumn("_said", FO.walked(stage)).withColumn("prediction", c("_said.prediction"))
        else:
            df = stage.transform(df)
    return df


def _without_label(model):
    """The fitted pipeline without its label index, for rows that have no label."""
    return PipelineModel(model.stages[1:])


def confusion_matrix(predicted: DataFrame, label: str, guess: str = "predicted_label") -> DataFrame:
    return predicted.groupBy(c(label).alias("label"), c(guess).alias("predicted")).agg(F.count("*").alias("cnt"))


def classification_report(predicted: DataFrame, label: str, guess: str = "predicted_label") -> DataFrame:
    """Precision, recall and f1 per class, from one pass over the matrix."""
    hit = c("label") == c("predicted")
    sides = F.array(
        F.struct(c("label").alias("k"), c("cnt").alias("support"), F.lit(0).cast("bigint").alias("made"), F.when(hit, c("cnt")).otherwise(0).alias("tp")),
        F.struct(c("predicted").alias("k"), F.lit(0).cast("bigint").alias("support"), c("cnt").alias("made"), F.lit(0).cast("bigint").alias("tp")),
    )
    j = confusion_matrix(predicted, label, guess).select(F.inline(sides)).groupBy(c("k").alias("label")).agg(*[F.sum(x).alias(x) for x in ("support", "made", "tp")])
    p, r = N.ratio("tp", "made"), N.ratio("tp", "support")
    return j.select("label", "support", p.alias("precision"), r.alias("recall"), N.ratio(2 * p * r, p + r).alias("f1"))


# --- formulas -------------------------------------------------------------------------

DERIVED = ("reconciliation_gap", "orphan_ratio", "duplicate_ratio", "payment_state_gap", "conversion_distortion", "transaction_without_state_ratio", "behavior_only_ratio", "transaction_only_ratio")
# Weights of the two logits.
LOGIT = {"reconciliation_gap": 1.2, "payment_state_gap": 1.2, "orphan_ratio": 0.9, "duplicate_ratio": 1.6, "conversion_distortion": 0.8, "transaction_without_state_ratio": 0.8, "runtime_evidence_score": 0.25}
CALIBRATION_LOGIT = {"reconciliation_gap": 1.25, "payment_state_gap": 1.4, "orphan_ratio": 1.0, "duplicate_ratio": 2.0, "conversion_distortion": 1.1, "transaction_without_state_ratio": 0.8}
CLASS_BANDS = ([(0.75, "critical_reconciliation_failure"), (0.55, "high_reconciliation_risk"), (0.30, "warning_reconciliation_risk"), (0.08, "low_reconciliation_residual")], "normal_reconciliation_variation")
LEVEL_SCORES = {"stable": 0.02, "normal": 0.02, "low": 0.15, "warning": 0.45, "high": 0.72, "critical": 0.92}


def derived_features(rows: DataFrame) -> DataFrame:
    """Ratios from counts; a ratio the row already has is kept."""
    bt, ts = num("behavior_transaction_match_rate"), num("transaction_state_match_rate")
    n = lambda x: F.greatest(F.lit(1.0), num(x))
    b, t, s = n("canonical_behavior_count"), n("canonical_transaction_count"), n("canonical_state_count")
    made = {
        "reconciliation_gap": N.clamp01((1 - bt) * 0.5 + (1 - ts) * 0.5), "orphan_ratio": N.clamp01(num("orphan_state_count") / s), "duplicate_ratio": N.clamp01(num("duplicate_order_count") / t),
        "payment_state_gap": N.clamp01(1 - ts), "conversion_distortion": F.coalesce(c("conversion_distortion_score").cast("double"), F.lit(0.0)),
        "transaction_without_state_ratio": N.clamp01(num("transaction_without_state_count") / t), "behavior_only_ratio": N.clamp01(num("behavior_only_count") / b), "transaction_only_ratio": N.clamp01(num("transaction_only_count") / t),
    }
    keep = [x for x in rows.columns if x not in made]
    return rows.select(*keep, *[(F.coalesce(c(k).cast("double"), e) if k in rows.columns else e).alias(k) for k, e in made.items()])


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(weights: dict) -> Column:
    return sum(num(n) * w for n, w in weights.items())


def logistic_score(features: DataFrame) -> DataFrame:
    """Failure probability and a score that leans on the rule score."""
    d = features.withColumn("reconciliation_failure_probability", N.clamp01(_sigmoid(_logit(LOGIT) - 1.6)))
    d = d.withColumn("predicted_score", N.clamp01(0.65 * num("overall_risk_score") + 0.35 * c("reconciliation_failure_probability")))
    return d.select("*", N.level_band("predicted_score", CLASS_BANDS).alias("predicted_risk_class"), N.level_band("predicted_score").alias("predicted_risk_level"))


def calibrate(features: DataFrame) -> DataFrame:
    """A second logit against the level the rules gave; a gap over 0.35 asks for review."""
    d = features.withColumn("probability", N.clamp01(_sigmoid(_logit(CALIBRATION_LOGIT) - 1.6)))
    d = d.withColumn("severity", N.clamp01(0.65 * num("overall_risk_score") + 0.35 * c("probability")))
    level, s = X.lower0("final_risk_level"), c("severity")
    label = (
        F.when(level.isin("stable", "normal") | ((level == "low") & (s < 0.25)), "normal_reconciliation_variation").when(s >= 0.75, "critical_reconciliation_failure")
        .when(s >= 0.55, "high_reconciliation_risk").when(s >= 0.30, "warning_reconciliation_risk").otherwise("low_reconciliation_residual"))
    table = F.create_map(*[F.lit(x) for p in LEVEL_SCORES.items() for x in p])
    gap = F.abs(s - F.coalesce(F.try_element_at(table, level), num("overall_risk_score")))
    return d.select("*", label.alias("calibrated_class"), gap.alias("score_gap"), F.when(gap <= 0.35, "PASS").otherwise("REVIEW").alias("calibration_status"))


def verify_ml(scopes: DataFrame, snapshot: DataFrame, calibration: DataFrame, prediction: DataFrame, decisions: DataFrame, scope=SCOPE) -> DataFrame:
    """Which outputs a scope has, and whether a baseline was escalated or a gap is wide."""
    keys = list(scope)
    one = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(1))
    j = scopes.select(*keys).distinct()
    for df, n in ((snapshot, "feature_snapshot_flag"), (calibration, "calibration_flag"), (prediction, "prediction_flag")):
        j = j.join(one(df, n), keys, "left")
    j = j.join(calibration.select(*keys, "score_gap"), keys, "left").join(decisions.select(*keys, "classification", "final_risk_level", "recommended_action"), keys, "left")
    j = j.fillna(0, subset=["feature_snapshot_flag", "calibration_flag", "prediction_flag", "score_gap"])
    calm = F.lower(F.coalesce("classification", F.lit("none"))).isin("", "none") & X.lower0("final_risk_level").isin("stable", "normal", "low") & (X.lower0("recommended_action").contains("no action") | (F.coalesce("recommended_action", F.lit("")) == ""))
    ok = (~is_reference() | calm).cast("int")
    wide = (c("score_gap") > 0.35).cast("int")
    f = c("feature_snapshot_flag") == 1
    fine = (c("calibration_flag") == 1) & (c("prediction_flag") == 1) & (ok == 1) & (wide == 0)
    return j.select(*keys, "feature_snapshot_flag", "calibration_flag", "prediction_flag", ok.alias("baseline_ok_flag"), wide.alias("score_gap_review_flag"), F.when(~f, "FAIL").when(fine, "PASS").otherwise("REVIEW").alias("verification_status"))


def feature_dataset(features: DataFrame, calibration: DataFrame, validation: DataFrame, score: DataFrame, keys=("profile_id", "dt", "scenario_name", "source_gen_run_id")) -> DataFrame:
    """Features with calibration, validation and reliability score of the same scope; null equals null."""
    out = features
    for part in (calibration, validation, score):
        out = null_safe_join(out, part, keys)
    return out


def decision_context(risk: DataFrame, *others: DataFrame, keys=("profile_id", "dt", "scenario_name")) -> DataFrame:
    """The decision of a scope with everything known beside it."""
    out = risk
    for other in others:
        fresh = [x for x in other.columns if x not in out.columns or x in keys]
        out = null_safe_join(out, other.select(*fresh), keys)
    return out
