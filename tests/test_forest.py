"""Forests over many rows: draws, cuts and splits against plain loops, and what a model of pyspark.ml says."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from hitledger.operators import forest as FO, ml as M
from hitledger.session import scratch_dir

NUMBERS, TEXTS = ("a", "b"), ("t",)


def table(spark, n=3000):
    """Two numbers and a text that decide a label, a score, and noise, in rows of their own."""
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000
    d = spark.range(n).select("id", at(1).alias("a"), F.round(at(2), 1).alias("b"), F.when(at(3) < 0.3, "x").when(at(3) < 0.9, "y").otherwise("z").alias("t"))
    label = F.when(at(4) < 0.05, "low").when((F.col("a") > 0.6) & (F.col("t") == "x"), "rare").when(F.col("a") + F.col("b") > 1, "high").otherwise("low")
    return d.withColumn("label", label).withColumn("overall_risk_score", F.col("a") * F.col("b") * 0.6 + F.when(F.col("t") == "z", 0.3).otherwise(0.0))


@pytest.fixture
def many(monkeypatch):
    """A few hundred rows count as too many for pyspark.ml; each part has some of them, each task some of the trees."""
    monkeypatch.setattr(M, "PART_ROWS", 2)
    monkeypatch.setattr(FO, "ROWS", 700)
    monkeypatch.setattr(FO, "CHUNK", 100)
    monkeypatch.setattr(FO, "BATCH_BYTES", 50_000)
    monkeypatch.setattr(FO, "TASKS", 8)


def test_draws_are_poisson():
    d = np.concatenate([FO.draws(7, t, p, 50_000) for t in range(4) for p in range(3)])
    assert abs(d.mean() - 1) < 0.01 and abs(d.var() - 1) < 0.02
    assert np.allclose(np.bincount(d, minlength=8)[:5] / len(d), [0.3679, 0.3679, 0.1839, 0.0613, 0.0153], atol=0.003)
    assert (FO.draws(7, 1, 2, 1000) == FO.draws(7, 1, 2, 1000)).all() and (FO.draws(7, 1, 2, 1000) != FO.draws(7, 1, 3, 1000)).any()


def test_cuts():
    assert FO.cuts_of(np.array([3.0, 1.0, 3.0, 0.0]), np.ones(4)).tolist() == [0.5, 2.0]
    assert len(FO.cuts_of(np.array([5.0, 5.0]), np.ones(2))) == 0
    r = np.random.default_rng(1)
    v, w = r.random(20_000), r.random(20_000) * 3
    # the values of several parts, put together
    points = [FO._points(v[i::4], w[i::4]) for i in range(4)]
    assert all(len(a) <= FO.POINTS for a, _ in points) and np.isclose(sum(b.sum() for _, b in points), w.sum())
    cuts = FO.cuts_of(np.concatenate([a for a, _ in points]), np.concatenate([b for _, b in points]))
    shares = np.diff([w[v <= c].sum() / w.sum() for c in (-1, *cuts, 2)])
    assert len(cuts) == 31 and abs(shares - 1 / 32).max() < 0.003


@pytest.mark.parametrize("kind", ["classes", "numbers"])
def test_splits_are_the_best(spark, many, kind):
    """Every split of every tree against all thresholds of all features, over the rows the tree drew."""
    df = table(spark, 900)
    y = F.when(F.col("label") == "low", 0).when(F.col("label") == "high", 1).otherwise(2) if kind == "classes" else F.col("overall_risk_score")
    x = F.array("a", "b", (F.col("t") == "x").cast("double"))
    rows = df.select(x.alias("x"), y.alias("y"), F.lit(1.0).alias("w")).repartition(3, "x").sortWithinPartitions("x").persist()
    weights = np.array([0.5, 1.0, 4.0]) if kind == "classes" else None
    cuts = FO.feature_cuts(rows)
    g = FO.grow(rows, 3, 3, weights, 4, 3, 42, cuts)
    by = rows.withColumn("p", F.spark_partition_id()).toPandas()
    xs, ys = np.array(by["x"].tolist()), by["y"].to_numpy()

    def spread(d, at):  # rows times impurity
        if weights is None:
            n, s = d[at].sum(), (d * ys)[at].sum()
            return n, (d * ys * ys)[at].sum() - s * s / max(n, 1)
        k = np.array([d[at & (ys == c)].sum() * weights[c] for c in range(3)])
        return k.sum(), k.sum() - (k**2).sum() / max(k.sum(), 1e-9)

    for t in range(4):
        d = np.concatenate([FO.draws(42, t, p, int((by["p"] == p).sum())) for p in range(3)]).astype(float)
        node = {1: np.ones(len(ys), bool)}
        splits = 0
        for n in range(1, 8):
            if n not in node:
                continue
            at = node[n]
            whole, impure = spread(d, at)
            assert g["there"][t, n] and g["count"][t, n] == d[at].sum()
            gains = {(f, i): (impure - spread(d, at & (xs[:, f] <= c))[1] - spread(d, at & (xs[:, f] > c))[1]) / whole
                     for f in range(3) for i, c in enumerate(cuts[f]) if d[at & (xs[:, f] <= c)].sum() and d[at & (xs[:, f] > c)].sum()}
            f, i = int(g["feature"][t, n]), int(g["cut"][t, n])
            if f < 0:
                assert max(gains.values(), default=0) < 1e-9
                continue
            splits += 1
            assert abs(g["gain"][t, n] - max(gains.values())) < 1e-9 and abs(gains[f, i] - g["gain"][t, n]) < 1e-9
            node[2 * n], node[2 * n + 1] = at & (xs[:, f] <= cuts[f][i]), at & (xs[:, f] > cuts[f][i])
        assert splits > 3
    rows.unpersist()


def test_many_rows_are_grown_in_parts(spark, many, monkeypatch):
    """The trainer that keeps numbers for each row and tree does not get the rows; the model is a whole one and as good."""
    df = table(spark)
    seen = []
    for kind in (RandomForestClassifier, RandomForestRegressor):
        fit = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, d, *a, fit=fit: (seen.append(d.count()), fit(self, d, *a))[1])
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    cls, reg = M.train_classifier(train, "label", NUMBERS, TEXTS, trees=20), M.train_regressor(train, "overall_risk_score", NUMBERS, TEXTS, trees=20)
    assert seen and max(seen) < 10
    forest = cls.stages[-2]
    assert isinstance(forest, RandomForestClassificationModel) and len(forest.trees) == 20 and max(t.depth for t in forest.trees) == 8
    path = scratch_dir(spark, "models")
    M.save_models(path, "v1", classifier=cls, regressor=reg)
    p = M.predict(M.load_model(path, "v1", "classifier"), M.load_model(path, "v1", "regressor"), test, NUMBERS, TEXTS).toPandas()
    monkeypatch.setattr(M, "PART_ROWS", 2000)
    q = M.predict(M.train_classifier(train, "label", NUMBERS, TEXTS, trees=20), M.train_regressor(train, "overall_risk_score", NUMBERS, TEXTS, trees=20), test, NUMBERS, TEXTS).toPandas()
    monkeypatch.setattr(M, "PART_ROWS", 2)
    assert max(seen) == 2000 and set(p["predicted_label"]) == {"low", "high", "rare"}
    right, gap = [(x["predicted_label"] == x["label"]).mean() for x in (p, q)], [x["score_gap"].abs().mean() for x in (p, q)]
    assert right[0] > max(0.9, right[1] - 0.02) and gap[0] < gap[1] * 1.2
    # the same rows lying otherwise give the same trees
    again = M.train_classifier(train.repartition(5), "label", NUMBERS, TEXTS, trees=20).stages[-2]
    assert [t.toDebugString.split("\n", 1)[1] for t in again.trees] == [t.toDebugString.split("\n", 1)[1] for t in forest.trees]


def test_few_rows_are_left_to_pyspark(spark):
    """A small table gets the very trees it always got."""
    df = table(spark, 400)
    ready = M.balanced_weights(M._filled(M.in_parts(df), NUMBERS, TEXTS), "label")
    whole = M.Pipeline(stages=[M.StringIndexer(inputCol="label", outputCol="_label", handleInvalid="keep"), *M._stages(NUMBERS, TEXTS), RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="class_weight", numTrees=5, maxDepth=4, seed=42, cacheNodeIds=True)]).fit(ready)
    got = M.train_classifier(df, "label", NUMBERS, TEXTS, trees=5, depth=4)
    assert [t.toDebugString.split("\n", 1)[1] for t in got.stages[-2].trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.stages[-1].trees]


def test_walk_says_what_the_model_says(spark):
    """Thresholds, categories and rows between them: bit by bit what ``transform`` gives."""
    df = table(spark, 600)
    cls, reg = M.train_classifier(df, "label", NUMBERS, TEXTS, trees=12), M.train_regressor(df, "overall_risk_score", NUMBERS, TEXTS, trees=12)
    other = df.unionByName(df.limit(5).withColumn("t", F.lit("unseen")).withColumn("a", F.lit(None).cast("double")))
    filled = M._filled(other, NUMBERS, TEXTS)
    r = reg.transform(filled).withColumn("w", FO.walked(reg.stages[-1])).select("prediction", "w.prediction").toPandas().to_numpy()
    assert len(r) == 605 and (r[:, 0] == r[:, 1]).all()
    c = cls.transform(filled).withColumn("w", FO.walked(cls.stages[-2])).select("prediction", F.array_max(vector_to_array("probability")), "w.prediction", "w.confidence").toPandas().to_numpy()
    assert (c[:, :2] == c[:, 2:]).all()
