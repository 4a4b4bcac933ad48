"""Clusters of vectors: exact integer k-means whose centroids are searched in a vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import common as C

# components up to this size keep every squared distance of some hundred dimensions within 63 bits
SMALL = 1 << 27
LONG = (1 << 63) - 1
# sums travel in digits of this base, so that no count of tasks makes one overflow
DIGIT = 40
# no pruning within rounding of a square root
SLACK = 1e-12


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly: as 64-bit integers, or as Python's where one is too large."""
    whole = np.floor(values * float(scale))
    if not whole.size or np.abs(whole).max() <= SMALL:
        return whole.astype(np.int64)
    out = np.empty(whole.shape, dtype=object)
    out.ravel()[:] = [int(x) for x in whole.ravel()]
    return out


@dataclass(frozen=True)
class Tree:
    """Nodes of one vantage point each; of each child, the least and greatest distance from the parent's point.

    ``points`` are the centroids by number; node 0 is the root.
    """

    points: np.ndarray
    number: np.ndarray
    children: list[list[tuple[int, float, float]]]

    @classmethod
    def of(cls, points: list[list[int]]) -> Tree:
        big = any(abs(x) > SMALL for p in points for x in p)
        at = np.array(points, dtype=object if big else np.int64).reshape(len(points), len(points[0]) if points else 0)
        number: list[int] = []
        children: list[list[tuple[int, float, float]]] = []

        def add(members: list[int]) -> int:
            node = len(number)
            # the vantage point from which the others' distances differ most splits them best
            apart = {v: [0.0 if big else float(np.sqrt(((at[c] - at[v]) ** 2).sum())) for c in members if c != v] for v in members}
            best = max(members, key=lambda v: (float(np.var(apart[v])) if apart[v] else 0.0, -v))
            number.append(best)
            children.append([])
            rest = sorted(zip(apart[best], [c for c in members if c != best]))
            half = (len(rest) + 1) // 2
            for part in (rest[:half], rest[half:]):
                if part:
                    children[node].append((add([c for _, c in part]), part[0][0], part[-1][0]))
            return node

        if points:
            add(list(range(len(points))))
        return cls(at, np.array(number, dtype=np.int64), children)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; of equals, the smallest number.

        Every vector walks the tree best-first on its own: it opens the node of
        its least lower bound until that is over its best distance. A bound that
        equals it is still opened, for a tie may hold a smaller number. The
        steps of a batch's vectors run side by side.
        """
        n, exact = len(x), x.dtype != object and self.points.dtype != object
        best = np.full(n, -1, dtype=np.int64)
        far = np.full(n, LONG if exact else None, dtype=np.int64 if exact else object)
        radius = np.full(n, np.inf)
        bound = np.full((n, len(self.number)), np.inf)
        bound[:, 0] = 0.0
        rows = np.arange(n)
        while len(rows):
            node = bound[rows].argmin(axis=1)
            least = bound[rows, node]
            going = np.isfinite(least) & (least <= radius[rows])
            rows, node, least = rows[going], node[going], least[going]
            bound[rows, node] = np.inf
            own = self.number[node]
            d = ((x[rows] - self.points[own]) ** 2).sum(axis=1)
            nearer = (best[rows] < 0) | (d < far[rows]) if exact else np.array([b < 0 or a < f for a, b, f in zip(d, best[rows], far[rows])], dtype=bool)
            tie = np.array(d == far[rows], dtype=bool) & (own < best[rows])
            take = nearer | tie
            best[rows[take]], far[rows[take]] = own[take], d[take]
            if exact:
                root = np.sqrt(d.astype(np.float64))
                radius[rows[take]] = root[take] * (1 + SLACK)
            else:
                root = None  # roots of such integers are not kept exactly enough: every node is opened
            for k in np.unique(node):
                here = node == k
                for child, low, high in self.children[k]:
                    if root is None:
                        bound[rows[here], child] = 0.0
                    else:
                        r = root[here]
                        gap = np.maximum(r - high, low - r) - SLACK * (r + high)
                        bound[rows[here], child] = np.maximum(np.maximum(gap, least[here]), 0.0)
        return best, far


def digits(value: int) -> Iterator[tuple[int, int]]:
    """Place and value of each non-zero digit of an integer, all of its sign."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if low := rest & ((1 << DIGIT) - 1):
            yield place, sign * low
        rest, place = rest >> DIGIT, place + 1


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), dims)


def usable(vector: Column, dims: int, scale: int) -> Column:
    """Vectors of ``dims`` components, none null, NaN or infinite, before and after scaling."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def first(kept: DataFrame, k: int) -> list[list[float]]:
    """The ``k`` vectors of the smallest sha256 of ``1:<id>``, in its order; equal ids by their components, null ids last."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("_id").cast("string")).cast("binary"), 256)
    return [list(r["_x"]) for r in kept.select(name.alias("_h"), "_x").orderBy(F.col("_h").asc_nulls_last(), "_x").limit(k).collect()]


def moved(kept: DataFrame, points: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """Each centroid at the floor of its vectors' mean; one without vectors stays.

    A task adds up its own vectors and gives at most a row per centroid,
    component and digit, so the shuffle does not grow with the vectors and a
    centroid of most of them is no hot key.
    """
    shared = kept.sparkSession.sparkContext.broadcast(Tree.of(points))
    names = ["_c", "_i", "_place", "_value"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        total = np.zeros((len(tree.points), dims + 1), dtype=object)
        for b in batches:
            x = integers(matrix(b.column(0), dims), scale)
            if not len(x):
                continue
            cluster, _ = tree.nearest(x)
            for c in np.unique(cluster):
                of = x[cluster == c]
                total[c, :dims] += [int(v) for v in of.sum(axis=0)]
                total[c, dims] += len(of)
        rows = [(c, i, place, v) for c in range(len(total)) for i in range(dims + 1) for place, v in digits(total[c, i])]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], type=pa.int64()) for j in range(4)], names=names)

    parts = kept.select("_x").mapInArrow(add, ", ".join(f"{n} bigint" for n in names))
    sums = [[0] * (dims + 1) for _ in points]
    # at most centroids x components x digits rows
    for r in parts.groupBy(*names[:3]).agg(F.sum("_value").alias("_value")).collect():
        sums[r["_c"]][r["_i"]] += r["_value"] << (DIGIT * r["_place"])
    shared.unpersist()
    return [[s // own[dims] for s in own[:dims]] if own[dims] else p for p, own in zip(points, sums)]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """Every usable row with cluster, distance (squared), cluster_inertia, inertia, centroid (its components as text, comma-joined).

    Components become floor(scale * x); all distances and means are exact
    integers. Rows whose vector is null, of another length, or holds a null or
    non-finite component are left out. Repeated rows are clustered each; of
    equal distances the smaller centroid number wins; with fewer rows than ``k``
    there are as many centroids as rows, and an empty table gives an empty
    result. A distance over 63 bits, which only components over 2**27 can have,
    is null, as are the sums that hold it. Input columns of the output names are
    replaced, others kept. The table is read ``rounds + 2`` times; what reaches
    the driver and is broadcast are ``k`` centroids.
    """
    spark = C.session(vectors)
    rows = C.rows(vectors, _id=C.quoted(id_col), _x=C.quoted(vector_col)).where(usable(F.col("_x"), dims, scale))
    kept = rows.select("_id", F.col("_x").cast("array<double>").alias("_x"))
    points = [integers(np.array([p]), scale)[0].tolist() for p in first(kept, k)]
    for _ in range(rounds if points else 0):
        points = moved(kept, points, dims, scale)
    shared = spark.sparkContext.broadcast(Tree.of(points))

    @F.arrow_udf("struct<cluster:int,distance:bigint>")
    def assign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = integers(matrix(b, dims), scale)
            number, d = shared.value.nearest(x) if len(x) else (np.zeros(0, dtype=np.int64), [])
            far = pa.array([v if v <= LONG else None for v in map(int, d)], type=pa.int64())
            yield pa.StructArray.from_arrays([pa.array(number, type=pa.int32()), far], names=["cluster", "distance"])

    found = rows.select("_row", assign.asNondeterministic()(F.col("_x").cast("array<double>")).alias("_at"))
    found = materialize(found.select("_row", "_at.cluster", "_at.distance"), "clusters")
    whole = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")).cast("string"))
    sums = {r["cluster"]: r["_s"] for r in found.groupBy("cluster").agg(whole.alias("_s")).collect()}
    parts = {c: None if s is None else int(s) for c, s in sums.items()}
    total = None if None in parts.values() else sum(parts.values())
    fits = lambda v: F.lit(v if v is not None and v <= LONG else None).cast("bigint")
    of = F.col("cluster")
    by_number = lambda values, kind: F.element_at(F.array(*values), of + 1) if values else F.lit(None).cast(kind)
    return C.unpack(
        found,
        cluster=of,
        distance=F.col("distance"),
        cluster_inertia=by_number([fits(parts.get(c)) for c in range(len(points))], "bigint"),
        inertia=fits(total),
        centroid=by_number([F.lit(",".join(map(str, p))) for p in points], "string"),
    )
