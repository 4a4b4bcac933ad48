"""Window functions over groups too large for one task.

A plain window puts a whole group into one task. Here a group of more than a
block of rows is cut into slices of about a block each along its own order, each
slice is windowed by itself, and one small row per slice carries the state from
slice to slice. Where to cut comes from the data: the sizes of the groups, and
approximate percentiles of the few large ones. Results do not depend on the
cuts. Groups of a block or less stay whole and carry nothing.

Keys must not be null (callers coalesce them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# rows of a slice, and slices of a group at most
BLOCK, MOST = 1_000_000, 1000
BUCKET = "_slice"


def time_slice(us: Column, seconds: int) -> Column:
    """Number of the time slice a microsecond time falls into."""
    return F.floor(us / F.lit(seconds * 1_000_000)).cast("bigint")


def micros(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def _order_key(order) -> Column:
    return F.struct(*[F.col(o) for o in order])


def large_groups(df: DataFrame, keys, block: int | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > (block or BLOCK))


def hot_cuts(df: DataFrame, keys, by: str, block: int | None = None) -> DataFrame:
    """For each group of more than ``block`` rows the values of ``by`` that cut it into slices of about a block.

    There are at most rows / block such groups, and about as many cuts in all.
    """
    keys, block = list(keys), block or BLOCK
    sizes = large_groups(df, keys, block)
    # as text: a literal for each share would cost a call each
    all_cuts = f"percentile_approx(_by, array({', '.join(f'{k / MOST}D' for k in range(1, MOST))}), {10 * MOST})"
    cuts = df.select(*keys, F.col(by).alias("_by")).join(F.broadcast(sizes), keys).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.expr(all_cuts).alias("_all")
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(MOST) / F.ceil(F.col("_n") / F.lit(block))))
    return cuts.select(*keys, F.array_distinct(F.filter("_all", lambda _, i: (i + 1) % step == 0)).alias("_cuts"))


def in_slices(df: DataFrame, keys, by: str, block: int | None = None) -> DataFrame:
    """Rows with the number of their slice; null for those of groups that stay whole.

    The groups are counted at once, in a first pass over the keys; where none is
    large the plan that follows is that of a plain window.
    """
    keys = list(keys)
    if large_groups(df, keys, block).isEmpty():
        return df.withColumn(BUCKET, F.lit(None).cast("bigint"))
    d = df.join(F.broadcast(hot_cuts(df, keys, by, block)), keys, "left")
    place = F.size(F.filter("_cuts", lambda c: c < F.col(by))).cast("bigint")
    return d.withColumn(BUCKET, F.when(F.col("_cuts").isNotNull(), place)).drop("_cuts")


def _sliced(df: DataFrame, keys, order, slice_of: Column | None) -> DataFrame:
    return in_slices(df, keys, order[0]) if slice_of is None else df.withColumn(BUCKET, slice_of)


def _carried(d: DataFrame, keys, carry: DataFrame, slice_of: Column | None) -> DataFrame:
    """Join what a slice takes over; cuts from the data bound the number of slices, so these are sent to the rows."""
    return d.join(F.broadcast(carry) if slice_of is None else carry, [*keys, BUCKET], "left")


def lag_in_slices(df: DataFrame, keys, order, slice_of: Column | None, value: str, out: str) -> DataFrame:
    """``lag(value)`` over ``keys`` by ``order``, whose first column is a number.

    ``slice_of`` gives slices of the caller's own, which must not fall along the
    order; None cuts where the data ask for it.
    """
    keys = list(keys)
    d = _sliced(df, keys, order, slice_of)
    last = d.where(F.col(BUCKET).isNotNull()).groupBy(*keys, BUCKET).agg(F.max_by(F.struct(F.col(value).alias("v")), _order_key(order)).alias("_last"))
    carry = last.select(
        *keys, BUCKET, F.lag("_last").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("_carry")
    )
    near = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    d = _carried(d.withColumn("_near", F.lag(F.struct(F.col(value).alias("v"))).over(near)), keys, carry, slice_of)
    return d.withColumn(out, F.coalesce("_near", "_carry")["v"]).drop("_near", "_carry", BUCKET)


def _running(df: DataFrame, keys, order, slice_of: Column | None, total: Column, step: Column, out: str) -> DataFrame:
    """A running total: ``total`` of the slices before plus ``step`` over the rows so far."""
    keys = list(keys)
    d = _sliced(df, keys, order, slice_of)
    totals = d.where(F.col(BUCKET).isNotNull()).groupBy(*keys, BUCKET).agg(total.alias("_total"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, BUCKET, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    near = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = _carried(d.withColumn("_near", step.over(near)), keys, carry, slice_of)
    return d.withColumn(out, F.col("_near") + F.coalesce(F.col("_carry"), F.lit(0))).drop("_near", "_carry", BUCKET)


def sum_in_slices(df: DataFrame, keys, order, slice_of: Column | None, value: str, out: str) -> DataFrame:
    """Running sum of ``value`` over ``keys`` by ``order``; slices as in ``lag_in_slices``."""
    return _running(df, keys, order, slice_of, F.sum(value), F.sum(value), out)


def number_in_slices(df: DataFrame, keys, order, slice_of: Column | None, out: str) -> DataFrame:
    """``row_number`` over ``keys`` by ``order``; slices as in ``lag_in_slices``."""
    return _running(df, keys, order, slice_of, F.count("*"), F.row_number(), out)
