"""Lines dealt by order give the same states."""

from hitledger.plans import fixtures


def test_lines_are_dealt_by_order_without_changing_states(spark, tmp_path, monkeypatch):
    lines = [(k % 40, k % 3, "NRA"[k % 3], k) for k in range(200)] + [(None, 1, "N", 5), (7, None, "R", 6), (7, None, "N", 4)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_returnflag string, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, k % 5) for k in range(35)] + [(3, 77), (3, 77), (4, None), (None, 1)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    i = fixtures.Inputs(spark, str(tmp_path))
    plain = i.state_events.collect()
    monkeypatch.setattr(fixtures, "LINES", 10)
    dealt = i.state_events
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain))
    # parts of so many lines, and one shuffle of them for join and groups
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.rdd.getNumPartitions() >= 21
