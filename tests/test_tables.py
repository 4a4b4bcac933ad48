"""Keyed tables that change in place, stored models, run facts without a hot key, patterns by their lengths."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from hitledger.operators import joins as J, ml as M, operations as O
from hitledger.session import scratch_dir
from hitledger.sources import records as R

SCHEMA = "k bigint, v string, at int"


def files(path, version):
    return {p.name: p.stat().st_mtime_ns for p in Path(path, "data", str(version)).rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark):
    path = scratch_dir(spark, "keyed")
    rows = {k: ("old", 1) for k in range(500)}
    R.write_keyed(spark.createDataFrame([(k, *r) for k, r in rows.items()], SCHEMA), path, ["k"], 16)
    before = files(path, 0)
    delta = [(3, "new", 2), (777, "new", 2), (3, "newer", 3), (4, "late", 0)]
    for k, v, at in delta:
        if at >= rows.get(k, ("", -1))[1]:
            rows[k] = (v, at)
    df = spark.createDataFrame(delta, SCHEMA)
    touched = R.upsert_keyed(path, df, ["k"], "d1", SCHEMA, "at", 16)
    read = lambda: {r.k: (r.v, r.at) for r in R.read_keyed(spark, path, SCHEMA).collect()}
    assert 1 <= len(touched) <= 3 and read() == rows
    assert files(path, 0) == before  # nothing of the version before is moved or written again
    new = files(path, 1)
    assert {p.parent.name for p in Path(path, "data", "1").rglob("*.parquet")} == {f"bucket={b}" for b in touched}
    # the same delta again, also under a restart, changes nothing
    assert R.upsert_keyed(path, df, ["k"], "d1", SCHEMA, "at", 16) == [] and files(path, 1) == new and read() == rows


def test_a_failed_upsert_leaves_the_table(spark):
    """Files that no listed version names do not count, and the next run replaces them."""
    path = scratch_dir(spark, "keyed")
    R.write_keyed(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), path, ["k"], 4)
    spark.createDataFrame([(1, "broken", 9, 0)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(f"{path}/data/1")
    assert sorted(R.read_keyed(spark, path, SCHEMA).select("v").toPandas()["v"]) == ["a", "b"]
    R.upsert_keyed(path, spark.createDataFrame([(2, "c", 2), (None, "n", 1)], SCHEMA), ["k"], "x", SCHEMA, None, 4)
    assert sorted(R.read_keyed(spark, path, SCHEMA).select("v").toPandas()["v"]) == ["a", "c", "n"]


def test_stored_models_score_alike(spark):
    r = random.Random(4)
    rows = [(i, float(r.random()), float(r.random()), "x" if i % 3 else "y") for i in range(200)]
    df = spark.createDataFrame([(i, a, b, t, "high" if a + b > 1 else "low", a) for i, a, b, t in rows], "i int, a double, b double, t string, label string, overall_risk_score double")
    path = scratch_dir(spark, "models")
    cls, reg = M.train_classifier(df, "label", ("a", "b"), ("t",), trees=15), M.train_regressor(df, "overall_risk_score", ("a", "b"), ("t",), trees=15)
    M.save_models(path, "v1", classifier=cls, regressor=reg)

    def scored(c, g):
        return sorted(map(tuple, M.predict(c, g, df, ("a", "b"), ("t",)).drop("top_features").collect()))

    one, two = (scored(M.load_model(path, "v1", "classifier"), M.load_model(path, "v1", "regressor")) for _ in range(2))
    assert one == two == scored(cls, reg)


def test_one_run_is_spread(spark):
    """All rows in one run: no exchange by the run, and the same rows as a plain join."""
    can = spark.range(3000).select(F.lit("p").alias("profile_id"), F.lit("d").alias("dt"), F.lit(1).alias("run_id"), F.col("id").alias("canonical_event_id"), F.timestamp_seconds(F.col("id")).alias("event_time"))
    rep = can.select("profile_id", "dt", "run_id", "canonical_event_id", (F.col("canonical_event_id") * 1_000_000).alias("output_us"), F.lit(None).cast("timestamp").alias("event_time"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = O.replay_join(rep, can)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan
        parts = out.groupBy(F.spark_partition_id()).count().collect()
        assert out.count() == 3000 and {r.replay_event_count for r in out.select("replay_event_count").distinct().collect()} == {3000}
        assert len(parts) > 4 and max(r["count"] for r in parts) < 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_patterns_by_length(spark, monkeypatch):
    r = random.Random(5)
    word = lambda n: "/" + "".join(r.choice("ab/") for _ in range(n))
    paths = sorted({word(r.randint(0, 12)) for _ in range(300)} | {""})
    patterns = [(i, p, 1) for i, p in enumerate(sorted({word(r.choice([0, 2, 5])) for _ in range(30)}))] + [(98, "/a", 0), (99, None, 1)]
    df, mapping = spark.createDataFrame([(p,) for p in [*paths, None]], "path string"), spark.createDataFrame(patterns, "id int, url_pattern string, is_active int")
    active = [(i, p) for i, p, on in patterns if on and p is not None]
    every = sorted((p, i) for p in paths for i, x in active if p.startswith(x))
    for most in (J.SENT_BYTES, 0):  # sent to the paths, and met by a shuffle
        monkeypatch.setattr(J, "SENT_BYTES", most)
        assert sorted((x.path, x.mapping_id) for x in J.path_mapping(df, mapping, longest=False).collect()) == every
        best = {x.path: x.prefix for x in J.path_mapping(df, mapping).collect()}
        assert best == {p: max((x for _, x in active if p.startswith(x)), key=len) for p in paths if any(p.startswith(x) for _, x in active)}
    assert J.path_mapping(df, mapping.limit(0)).count() == 0
