"""Joins Spark has no single operator for: nearest in time, by position, by prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .split import BUCKET, in_slices, large_groups, number_in_slices

ANY = "*"
# a mapping of up to so many bytes is sent to the paths
SENT_BYTES = 8 << 20


def key_text(*cols) -> Column:
    """One non-null key of several columns; null equals null and nothing else."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("?")) for c in cols]
    return F.concat_ws("\u0001", *parts)


def nearest_in_time(points: DataFrame, candidates: DataFrame, block: int | None = None, reduced: bool = False) -> DataFrame:
    """For each distinct (k, t) of ``points`` the nearest candidate of the same ``k``.

    ``candidates`` has k, t and ``row``, a struct whose first field is the id. The
    smaller gap wins, then the smaller id. Both sides are reduced to distinct
    (k, t) (``reduced`` says that the candidates are), laid over each other and
    walked once in each direction. A key of more
    than ``block`` rows is walked in slices of about that many, and the last and
    first candidate of a slice is carried to the others. No pair is built, and
    no key ends up in one task.
    """
    cand = candidates if reduced else candidates.groupBy("k", "t").agg(F.min("row").alias("row"))
    cand = cand.select("k", "t", F.struct("t", "row").alias("_c"), F.lit(0).alias("_asks"))
    none = F.lit(None).cast(cand.schema["_c"].dataType)
    both = cand.unionByName(points.select("k", "t").distinct().select("k", "t", none.alias("_c"), F.lit(1).alias("_asks")))
    both = in_slices(both, ["k"], "t", block)

    held = F.when(F.col("_c").isNotNull(), F.col("t"))
    edges = both.where(F.col(BUCKET).isNotNull()).groupBy("k", BUCKET).agg(F.min_by("_c", held).alias("head"), F.max_by("_c", held).alias("tail"))
    row = Window.partitionBy("k").orderBy(BUCKET)
    back = Window.partitionBy("k").orderBy(F.desc(BUCKET))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(
        "k", BUCKET, F.last("tail", ignorenulls=True).over(earlier(row)).alias("before"), F.last("head", ignorenulls=True).over(earlier(back)).alias("after")
    )
    walked = _walked(both, "k", BUCKET).join(F.broadcast(carry), ["k", BUCKET], "left")
    return walked.select("k", "t", _nearer(F.coalesce("_lo", "before"), F.coalesce("_hi", "after")).alias("best"))


def _walked(both: DataFrame, *keys) -> DataFrame:
    """Rows that ask, with the last candidate up to them and the first from them on within ``keys``."""
    # a frame that ends at its row is walked in one pass, so the other direction is walked backwards;
    # of candidates of one time the smallest comes last
    near, far = (Window.partitionBy(*keys).orderBy(t, "_asks", F.desc("_c")).rowsBetween(Window.unboundedPreceding, 0) for t in (F.asc("t"), F.desc("t")))
    return both.withColumn("_lo", F.last("_c", ignorenulls=True).over(near)).withColumn("_hi", F.last("_c", ignorenulls=True).over(far)).where("_asks = 1")


def _nearer(lo: Column, hi: Column) -> Column:
    def option(c):
        return F.when(c.isNotNull(), F.struct(F.abs(c["t"] - F.col("t")).alias("gap"), c["row"].alias("row"), c["t"].alias("t")))

    return F.array_min(F.array_compact(F.array(option(lo), option(hi))))


def match_nearest(left: DataFrame, right: DataFrame, left_key, right_keys, left_time: str, right_time: str, row: Column, block: int | None = None) -> DataFrame:
    """Attach to each left row the nearest right row as ``best`` (gap, row, t), or null.

    ``left_key`` is the key of a left row; ``right_keys`` lists the keys a right
    row answers to, null for one it does not. Rows without time match the
    smallest id of their key. Where no key has more rows than ``block``, all
    rows are laid over each other and walked, in one shuffle. Else what the
    right side offers is reduced to one row per key and time and written, and
    distinct points of the left are walked in slices and joined back to it.
    """
    anchors = left.withColumn("k", left_key).withColumn("t", F.col(left_time))
    keys = F.explode(F.array_compact(F.array(*right_keys)))
    offered = right.select(keys.alias("k"), F.col(right_time).alias("t"), row.alias("row"))
    asking = anchors.where("t IS NOT NULL")
    direct = large_groups(offered.select("k").unionAll(asking.select("k")), ["k"], block).isEmpty()
    if direct:
        cand = offered.where("t IS NOT NULL").select("k", "t", F.struct("t", "row").alias("_c"), F.lit(0).alias("_asks"))
        both = cand.unionByName(asking.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
        near = _walked(both, "k").withColumn("best", _nearer(F.col("_lo"), F.col("_hi"))).drop("_c", "_asks", "_lo", "_hi")
    else:
        offered = materialize(offered.groupBy("k", "t").agg(F.min("row").alias("row")), "offered")
        near = nearest_in_time(asking, offered.where("t IS NOT NULL"), block, reduced=True)
    blank = F.struct(F.lit(None).cast("bigint").alias("gap"), F.col("lowest").alias("row"), F.lit(None).cast("bigint").alias("t"))
    missing = offered.where("t IS NULL")
    if not missing.isEmpty():
        # keys whose candidates all lack a time: settled on the reduced points where a key is large, not on the anchors
        untimed = missing.groupBy("k").agg(F.min("row").alias("lowest"))
        near = near.join(untimed, "k", "left").withColumn("best", F.coalesce("best", F.when(F.col("lowest").isNotNull(), blank))).drop("lowest")
    timed = near if direct else asking.join(near, ["k", "t"], "left")
    # anchors without a time, usually none
    lost = anchors.where("t IS NULL")
    if lost.isEmpty():
        return timed.drop("k", "t")
    asked = lost.select("k").distinct()
    lowest = offered.join(asked, "k", "left_semi").groupBy("k").agg(F.min("row").alias("lowest"))
    rest = lost.join(lowest, "k", "left").withColumn("best", F.when(F.col("lowest").isNotNull(), blank)).drop("lowest")
    return timed.unionByName(rest).drop("k", "t")


def positional_pair(a: DataFrame, b: DataFrame, keys, a_order, b_order, a_slice: Column | None = None, b_slice: Column | None = None) -> DataFrame:
    """The i-th row of ``a`` with the i-th row of ``b`` within ``keys``."""
    left = number_in_slices(a, keys, a_order, a_slice, "pair_no")
    right = number_in_slices(b, keys, b_order, b_slice, "pair_no")
    return left.join(right, [*keys, "pair_no"]).withColumn("match_score", F.lit(1.0))


def path_mapping(paths: DataFrame, mapping: DataFrame, path: str = "path", longest: bool = True) -> DataFrame:
    """Active patterns that are a prefix of each distinct path.

    Only lengths that patterns have are cut off a path and looked up by
    equality, so a path makes at most as many rows as it has such lengths, and
    nothing is compared pair by pair. The lengths, no more than the longest
    pattern has characters, are read first, with the size of the mapping: one of
    up to 8 MB is sent to the paths, a larger one is met by a shuffle of the
    prefixes. ``longest`` keeps one pattern per path; otherwise every matching
    pattern yields a row.
    """
    active = mapping.where("is_active = 1").select(F.col("id").alias("mapping_id"), F.col("url_pattern").alias("prefix"))
    p = F.col(path)
    known = active.groupBy(F.length("prefix").alias("n")).agg(F.sum(F.octet_length("prefix") + 16).alias("bytes")).where("n IS NOT NULL").collect()
    lengths = F.array(*[F.lit(n) for n in sorted(r["n"] for r in known)]).cast("array<int>")
    if sum(r["bytes"] for r in known) <= SENT_BYTES:
        active = F.broadcast(active)
    cuts = F.transform(F.filter(lengths, lambda n: n <= F.length(p)), lambda n: F.substring(p, F.lit(1), n))
    found = paths.select(path).distinct().select(path, F.explode(cuts).alias("prefix")).join(active, "prefix")
    if not longest:
        return found
    return found.groupBy(path).agg(
        F.max_by(F.struct("prefix", "mapping_id"), F.struct(F.length("prefix"), -F.col("mapping_id"))).alias("m")
    ).select(path, "m.*")


def unmapped_paths(hits: DataFrame, mapping: DataFrame, path: str = "path", keys=()) -> DataFrame:
    """Hits per path that no active mapping other than ``/`` covers."""
    counts = hits.groupBy(*keys, path).agg(F.count("*").alias("hit_count"))
    mapped = path_mapping(counts, mapping.where("url_pattern <> '/'"), path)
    return counts.join(mapped, path, "left_anti")


def enrich(left: DataFrame, right: DataFrame, on: str, fallback) -> DataFrame:
    """Left join that fills ``fallback`` columns of the left from the right where null."""
    extra = right.select(on, *[F.col(c).alias(f"_r_{c}") for c in fallback if c in right.columns])
    out = left.join(extra, on, "left")
    for c in fallback:
        if f"_r_{c}" in out.columns:
            kept = F.coalesce(F.col(c), F.col(f"_r_{c}")) if c in left.columns else F.col(f"_r_{c}")
            out = out.withColumn(c, kept).drop(f"_r_{c}")
    return out


def union_keys_left_join(tables: dict[str, DataFrame], keys, zeros) -> DataFrame:
    """Tables joined on the union of their keys, missing measures as 0."""
    out = None
    for t in tables.values():
        out = t if out is None else out.join(t, list(keys), "full_outer")
    return out.fillna(0, subset=[z for z in zeros if z in out.columns])


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join on scope keys where null equals null; keys of the left are kept."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_k_{k}")
    cond = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"_k_{k}"])
        cond = same if cond is None else cond & same
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def new_entities(hits: DataFrame, entity: str, day: str = "dt", keys=(), lookback_days: int = 30) -> DataFrame:
    """Entities of each day not seen in the ``lookback_days`` before it.

    One row per entity and day first, then the previous day it was seen.
    """
    days = hits.select(*keys, entity, day).distinct()
    w = Window.partitionBy(*keys, entity).orderBy(day)
    gap = F.datediff(F.col(day), F.lag(day).over(w))
    return days.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > lookback_days)).drop("_gap")


def first_seen(hits: DataFrame, entity: str, day: str = "dt", keys=()) -> DataFrame:
    return hits.groupBy(*keys, entity).agg(F.min(day).alias("first_seen"))


def mapping_coverage(hits: DataFrame, mapping: DataFrame, keys, path: str = "path", longest: bool = True) -> DataFrame:
    """Mapped and unmapped hits per scope; coverage 1 for an empty scope, PASS from 0.98.

    With ``longest=False`` a hit counts once per matching pattern.
    """
    counts = hits.groupBy(*keys, path).agg(F.count("*").alias("n"))
    per_path = path_mapping(counts, mapping, path, longest=False).groupBy(path).agg(F.count("*").alias("k"))
    weight = F.lit(1) if longest else F.col("k")
    j = counts.join(per_path, path, "left")
    out = j.groupBy(*keys).agg(
        F.sum("n").alias("total_events"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n") * weight)), F.lit(0)).alias("mapped_events"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("unmapped_events"),
    )
    seen = F.col("mapped_events") + F.col("unmapped_events")
    rate = F.when(seen <= 0, 1.0).otherwise(F.col("mapped_events") / F.when(seen > 0, seen))
    return out.withColumn("mapping_coverage", rate).withColumn("status", F.when(rate >= 0.98, "PASS").otherwise("WARN"))
