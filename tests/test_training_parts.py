"""Training rows are dealt over many tasks."""

from pyspark.sql import functions as F

from hitledger.operators import ml as M


def test_training_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 500)
    df = spark.range(4000).select("id", F.when(F.col("id") % 9 == 0, "a").otherwise("b").alias("label")).coalesce(1)
    ready = M.balanced_weights(M.in_parts(df), "label")
    sizes = [r["n"] for r in ready.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and sum(sizes) == 4000 and max(sizes) < 1000
    assert abs(ready.agg(F.sum("class_weight")).first()[0] - 4000) < 1e-6
    assert M.in_parts(df.limit(0)).count() == 0
