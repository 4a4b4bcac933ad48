"""Nearest rows walked in one shuffle where no key is large."""

from pyspark.sql import functions as F

from hitledger.operators import joins as J


def test_nearest_rows_are_the_same_walked_whole_and_in_slices(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 10), (2, "a", 10), (3, "a", 16), (4, "b", None), (5, "b", 3), (6, "c", 1), (7, "n", 4)], "i int, g string, u bigint")
    right = spark.createDataFrame([(9, "a", 8), (8, "a", 12), (7, "a", 8), (6, "a", 20), (5, "b", None), (4, "b", None), (3, "c", 1), (2, "c", 1), (1, None, 4)], "id int, h string, v bigint")

    def found(block):
        m = J.match_nearest(left, right, J.key_text("g"), [F.when(F.col("h").isNotNull(), J.key_text("h"))], "u", "v", F.struct("id"), block)
        return sorted(m.select("i", "best.row.id", "best.gap", "best.t").collect(), key=lambda r: r["i"])

    whole = found(None)
    assert [(r["i"], r["id"], r["gap"]) for r in whole] == [(1, 7, 2), (2, 7, 2), (2, 7, 2), (3, 6, 4), (4, 4, None), (5, 4, None), (6, 2, 0), (7, None, None)]
    assert found(2) == whole


def test_nearest_of_small_keys_takes_one_shuffle(spark):
    left = spark.createDataFrame([(1, "a", 10)], "i int, g string, u bigint")
    right = spark.createDataFrame([(9, "a", 8)], "id int, h string, v bigint")
    m = J.match_nearest(left, right, J.key_text("g"), [J.key_text("h")], "u", "v", F.struct("id"))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
