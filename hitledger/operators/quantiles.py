"""Exact quantiles of groups of any size, from one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize

# a row's number is its partition in the high bits and its place in it in the low ones
PLACE_BITS = 33


def ranks_of(q: float, kind: str):
    """Wanted ranks (1-based) of quantile ``q`` in a group of ``_n`` values."""
    n = F.col("_n")
    if kind == "nearest":  # smallest value whose share of the group reaches q
        return [F.greatest(F.lit(1), F.ceil(n * F.lit(q)))]
    if kind == "two_ranks":  # mean of the floor and the ceiling rank
        return [F.greatest(F.lit(1), F.floor(n * F.lit(q))), F.greatest(F.lit(1), F.ceil(n * F.lit(q)))]
    if kind == "linear":  # the two ranks around (n - 1) q
        low = F.floor((n - 1) * F.lit(q)) + 1
        return [low, F.least(low + 1, n)]
    raise ValueError(kind)


def rank_index(rows: DataFrame, keys, value: str) -> tuple[DataFrame, DataFrame]:
    """Values numbered along one global sort, and for each key its size and the stretches of numbers it has.

    Rows are range-partitioned and sorted by key, value and the partition they
    come from, so neither a key nor a value that most rows have stays in one
    task. A key's rows then are consecutive numbers within each partition it
    reaches into; the stretches are a row per key and partition.
    """
    keys = list(keys)
    d = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).withColumn("_tie", F.spark_partition_id())
    order = [*keys, "_v", "_tie"]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    # written down: the bounds of a range partitioning are sampled anew by every job
    index = materialize(d.select(*keys, "_v", F.monotonically_increasing_id().alias("_id")), "ranks")
    part = F.shiftright("_id", PLACE_BITS).alias("_p")
    parts = index.groupBy(*keys, part).agg(F.min("_id").alias("first"), F.count("*").alias("n"))
    spans = parts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.array_sort(F.collect_list(F.struct("first", "n"))).alias("_spans"))
    return index.select("_id", "_v"), spans


def number_of(rank):
    """Number of the row of a rank: the stretch that holds it, found from the sizes of those before."""
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("id"))

    def step(a, s):
        here = a["id"].isNull() & (rank <= a["before"] + s["n"])
        return F.struct((a["before"] + s["n"]).alias("before"), F.when(here, s["first"] + rank - a["before"] - 1).otherwise(a["id"]).alias("id"))

    return F.aggregate("_spans", start, step, lambda a: a["id"])


def exact_quantiles(df: DataFrame, keys, value: str, wanted: dict[str, float], kind: str = "nearest") -> DataFrame:
    """Quantiles by rank: one sort of the rows, a row per key and partition, and a lookup by row number."""
    keys = list(keys)
    index, spans = rank_index(df, keys, value)
    asks = F.array(*[
        F.struct(F.lit(name).alias("_q"), r.cast("bigint").alias("_rank"))
        for name, q in wanted.items() for r in ranks_of(q, kind)
    ])
    asked = spans.select(*keys, "_n", "_spans", F.inline(asks)).select(*keys, "_n", "_q", number_of(F.col("_rank")).alias("_id"))
    found = asked.join(index, "_id")
    of = lambda name, pick: pick(F.when(F.col("_q") == name, F.col("_v").cast("double")))
    if kind != "linear":
        return found.groupBy(*keys).agg(*[of(name, F.avg).alias(name) for name in wanted])
    ends = found.groupBy(*keys).agg(F.first("_n").alias("_n"), *[F.struct(of(n, F.min).alias("lo"), of(n, F.max).alias("hi")).alias(n) for n in wanted])
    part = lambda q: (F.col("_n") - 1) * F.lit(q) - F.floor((F.col("_n") - 1) * F.lit(q))
    return ends.select(*keys, *[(F.col(n)["lo"] + part(q) * (F.col(n)["hi"] - F.col(n)["lo"])).alias(n) for n, q in wanted.items()])
