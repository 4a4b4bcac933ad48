"""Slices cut where the data ask for it: equal to plain windows whatever the block, and no slice far over it."""

import random

import pytest
from pyspark.sql import Window, functions as F

from hitledger.operators import kpi, split as S
from hitledger.operators.joins import nearest_in_time
from hitledger.operators.quantiles import exact_quantiles, rank_index


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    hot = [("hot", rnd.randrange(1_000_000), i, rnd.randrange(100)) for i in range(3000)]  # all in one second
    rest = [(f"k{rnd.randrange(40)}", rnd.randrange(10**9), 5000 + i, rnd.randrange(100)) for i in range(600)]
    same = [("same", 7, 9000 + i, 1) for i in range(300)]
    return spark.createDataFrame(hot + rest + same, "k string, us bigint, id bigint, v bigint").repartition(5).cache()


@pytest.mark.parametrize("block", [50, 700, 10_000])
def test_equal_to_plain_windows(rows, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", block)
    w = Window.partitionBy("k").orderBy("us", "id")
    want = rows.select("id", F.lag("v").over(w).alias("lag"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.row_number().over(w).alias("no"))
    got = S.lag_in_slices(rows, ["k"], ["us", "id"], None, "v", "lag")
    got = S.sum_in_slices(got, ["k"], ["us", "id"], None, "v", "sum")
    got = S.number_in_slices(got, ["k"], ["us", "id"], None, "no")
    assert sorted(map(tuple, got.select("id", "lag", "sum", "no").collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


def test_a_key_within_one_second_is_spread(rows):
    sizes = {(r[0], r[1]): r[2] for r in S.in_slices(rows, ["k"], "us", 100).groupBy("k", S.BUCKET).count().collect()}
    hot = [n for (k, b), n in sizes.items() if k == "hot"]
    assert len(hot) >= 25 and max(hot) <= 200
    assert all(b is None for k, b in sizes if k not in ("hot", "same"))


@pytest.mark.parametrize("block", [7, 60, None])
def test_nearest_for_any_block(spark, block):
    rnd = random.Random(6)
    points = [(rnd.choice("abc"), rnd.randrange(3000)) for _ in range(500)]
    cands = [(rnd.choice("abd"), rnd.randrange(3000), i) for i in range(400)] + [("c", 1500, 900)]
    left = spark.createDataFrame(points, "k string, t bigint")
    right = spark.createDataFrame(cands, "k string, t bigint, id bigint").select("k", "t", F.struct("id").alias("row"))
    got = {(r.k, r.t): r.best for r in nearest_in_time(left, right, block).collect()}
    assert set(got) == set(points)
    for (k, t), best in got.items():
        assert (best.gap, best.row.id) == min((abs(c[1] - t), c[2]) for c in cands if c[0] == k)


@pytest.mark.parametrize("block", [20, 10_000])
def test_sessions_for_any_block(spark, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", block)
    rnd = random.Random(7)
    views = [(rnd.choice(["hot"] * 6 + ["a", "b"]), rnd.randrange(86_400), i) for i in range(500)]
    df = spark.createDataFrame(views, "identity string, sec bigint, event_id bigint").select("identity", "event_id", F.timestamp_seconds("sec").alias("ts"), F.lit("p").alias("profile_id"), F.lit("d").alias("dt"))
    got = {r.event_id: (r.session_seq, r.session_start_us // 1_000_000) for r in kpi.sessionize(df, gap=300).collect()}
    for who in ("hot", "a", "b"):
        seq, start, before = 0, None, None
        for _, sec, i in sorted((v for v in views if v[0] == who), key=lambda v: (v[1], v[2])):
            if before is None or sec - before > 300:
                seq, start = seq + 1, sec
            before = sec
            assert got[i] == (seq, start)


def test_ranks_of_a_hot_value_are_spread(spark):
    """A value that most rows have is split over the partitions they come from; quantiles of any group are exact."""
    rnd = random.Random(8)
    data = [("a", 0.0, i) for i in range(4000)] + [("a", rnd.random(), i) for i in range(1000)] + [(None, rnd.random(), 1) for _ in range(9)] + [("b", None, 1)]
    df = spark.createDataFrame(data, "k string, v double, x bigint").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index, spans = rank_index(df, ["k"], "v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = [r["count"] for r in index.groupBy(F.shiftright("_id", 33)).count().collect()]
    assert len(parts) > 1 and max(parts) < 3000
    got = {r.k: (r.q, r.m) for r in exact_quantiles(df, ["k"], "v", {"q": 0.9, "m": 0.5}).collect()}
    values = sorted(v for k, v, _ in data if k == "a")
    assert set(got) == {"a", None} and got["a"] == (values[4499], 0.0)


def test_few_shuffles(spark):
    """Quantiles: of what follows the written index, no exchange moves rows but by key and partition."""
    df = spark.createDataFrame([("a", float(i)) for i in range(50)], "k string, v double")
    plan = exact_quantiles(df, ["k"], "v", {"q": 0.9})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6 and "CartesianProduct" not in plan
