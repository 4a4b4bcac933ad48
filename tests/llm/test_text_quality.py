"""Quality scores: held-out labels, the estimated prior, and rows of every kind."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from hitledger.llm import text_quality as T
from hitledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_labels(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_quality_classifier"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(y, got[i]) for i, y in labels.items() if held(i) and i in got and y is not None]
    assert all(r["held_out"] and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for _, r in known)
    right = [y == r["predicted"] for y, r in known]
    bad = [1 - r["predicted"] for y, r in known if y == 0]
    print(len(known), np.mean(right), len(bad), np.mean(bad))
    assert np.mean(right) > 0.98 and np.mean(bad) > 0.95


def model_of(spark, docs, labels):
    return T.fit(docs, labels, max_docs=400)


def test_only_good_labels_that_are_not_held_out_are_read(spark):
    """Other labels may be anything, and repeated or null labels change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    one = T.fit(docs, labels)
    flipped = labels.select("doc_id", F.when(T.held_out(F.col("doc_id")), 1 - F.col("quality")).when(F.col("quality") == 1, 1).alias("quality"))
    odd = spark.createDataFrame([(None, 1), (None, 0), (10**9, 1)], "doc_id long, quality int")
    two = T.fit(docs, flipped.unionByName(labels.where("quality = 1")).unionByName(odd))
    assert one.weights and one == two


def test_prior_is_estimated():
    """Feature rows of two kinds, mixed in known shares."""
    r = random.Random(3)

    def row(good):
        return {f"f{k}": 1.0 for k in range(12) if r.random() < (0.7 if good == (k < 6) else 0.2)}

    for share in (0.3, 0.6, 0.9):
        model = T.fit_rows([row(True) for _ in range(2500)], [row(r.random() < share) for _ in range(2500)])
        assert abs(model.prior - share) < 0.12, (share, model.prior)
        fresh = [(good, model.score(row(good))) for _ in range(600) for good in (True, False)]
        assert np.mean([g == (s >= 0.5) for g, s in fresh]) > 0.85


def test_risk_of_bad_texts_stays_above_zero():
    """Few rows, many features: the plain unbiased risk runs below zero, the fit does not follow it."""
    g = np.random.default_rng(5)
    rows = [{f"f{k}": 1.0 for k in g.choice(200, 20, replace=False)} for _ in range(120)]
    good, unlabelled = rows[:40], rows[40:]
    model = T.fit_rows(good, unlabelled, prior=0.7)
    z = lambda rs: np.array([np.log(s / (1 - s)) for s in map(model.score, rs)])
    bad = np.logaddexp(0, z(unlabelled)).mean() - 0.7 * np.logaddexp(0, z(good)).mean()
    assert bad > -0.05


def test_odd_rows(spark):
    good = "The quiet river, as it was, reached the harbour. It had been there before them all, and the boats went out."
    bad = "THE!! RIVER!! WAS!! QUIET!! AND!! REACHED!! THE!! HARBOUR!! AS!! IT!! HAD!! BEEN!!"
    rows = [(i, f"{(good if i % 3 else bad)} {i}", "q", 1) for i in range(60)]
    rows += [(None, None, "q", 1), (60, None, "q", 1), (61, "", "q", 1), (62, "x" * 100_000, "q", 1), (63, good * 2000, "q", 1), (1, good, "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, `a.b` int")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(60)] + [(None, None), (2, 1)], "doc_id long, quality int")
    model = T.fit(docs, labels)
    got = T.score(docs, model)
    assert got.columns == ["doc_id", "text", "a.b", "quality", "is_good"]
    scores = {(r["doc_id"], r["text"]): r["quality"] for r in got.collect()}
    assert got.count() == len(rows) and all(0 <= s <= 1 for s in scores.values())
    assert scores[(60, None)] == scores[(61, "")] == scores[(None, None)]
    assert scores[(1, good)] > scores[(0, rows[0][1])]
    none = T.fit(docs, labels.limit(0))
    assert none.weights == {} and {r["quality"] for r in T.score(docs, none).collect()} == {0.5}
    assert T.score(docs.limit(0), model).count() == 0 and T.fit(docs.limit(0), labels).weights == {}
