"""Random forests over many rows: grown level by level from counts of the parts, walked in numpy.

The trainer of ``pyspark.ml`` holds two numbers for every row and tree, and its
models walk node objects, one row after the other. Here a row is its features'
bins, one byte each. How often a tree drew a row follows from the seed, the tree
and the part, so nothing is kept for a row and a tree. Each level is one pass: a
task counts its rows by node, feature and bin, tree by tree, and the counts of
all parts meet by tree, where the best splits are found. Splits, gains, leaves
and the pruning of equal leaves follow ``pyspark.ml``, and the outcome is one of
its models.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_dir

# bins of a feature at most, the default of pyspark.ml, and values that stand for a part of a feature when they are cut
BINS, POINTS = 32, 1024
# rows of a part, parts at most, tasks at least: few parts are met by several tasks, each with some of the trees
ROWS, PARTS, TASKS = 50_000, 48, 48
# drawn rows that are counted at once, so that what is kept of them stays in the processor's cache, and bytes of counts sent at once
CHUNK, BATCH_BYTES = 32_768, 4_000_000
EPSILON = np.finfo(float).eps
# rows of a batch that walks the trees: enough for numpy, few enough for the processor's cache
BATCH_ROWS = 10_000

# the functions go to the workers with what calls them, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# how often a row is drawn: Poisson of mean 1, from sixteen bits where they decide, marked with 255 where they do not
_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
_EDGES = np.searchsorted(_CDF, np.arange(65537) / 65536, side="right")
_DRAWN = np.where(_EDGES[:-1] == _EDGES[1:], _EDGES[:-1], 255).astype(np.uint8)


def draws(seed: int, tree: int, part: int, n: int) -> np.ndarray:
    """How often ``tree`` drew each of the ``n`` rows of ``part``."""
    rng = np.random.Generator(np.random.SFC64([seed, tree, part]))
    bits = np.frombuffer(rng.bytes(2 * n), "<u2")
    out = _DRAWN.take(bits)
    open_ = np.flatnonzero(out == 255)
    if open_.size:
        out[open_] = np.searchsorted(_CDF, (bits[open_] + rng.random(open_.size)) / 65536, side="right")
    return out


# --- bins ----------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column, of equal lengths, as rows of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cuts_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Candidate thresholds of a feature: between any two values, or, of too many, at equal steps of weight."""
    values, at = np.unique(values, return_inverse=True)
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < BINS:
        return middles
    under = np.cumsum(np.bincount(at, weights))
    wanted = under[-1] / BINS * np.arange(1, BINS)
    # the nearest of the places just before and after the step
    after = np.clip(np.searchsorted(under, wanted), 1, len(middles) - 1)
    near = np.where(np.abs(under[after - 1] - wanted) <= np.abs(under[after] - wanted), after - 1, after)
    return middles[np.unique(near)]


def _points(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and weights of a part; more than ``POINTS`` values are put together at equal steps of weight."""
    values, at = np.unique(values, return_inverse=True)
    weight = np.bincount(at, weights)
    if len(values) <= POINTS:
        return values, weight
    step = np.minimum(np.cumsum(weight) / weight.sum() * POINTS, POINTS - 1).astype(np.int64)
    last = np.flatnonzero(np.append(step[1:] != step[:-1], True))
    return values[last], np.diff(np.append(0, np.cumsum(weight)[last]))


def feature_cuts(rows: DataFrame) -> list[np.ndarray]:
    """Thresholds of every feature, from all rows (``x`` list of numbers, ``w`` weight)."""

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(_matrix(b.column("x")), b.column("w").to_numpy()) for b in batches if b.num_rows]
        if found:
            x, w = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
            of = [_points(x[:, f], w) for f in range(x.shape[1])]
            yield pa.RecordBatch.from_pydict({"feature": pa.array(range(len(of)), pa.int32()), "v": [v for v, _ in of], "w": [w for _, w in of]})

    found = rows.select("x", "w").mapInArrow(points, "feature int, v array<double>, w array<double>").orderBy("feature").toArrow()
    feature = found.column("feature").to_numpy()
    values, weights = ([v.values.to_numpy() for v in found.column(n)] for n in ("v", "w"))
    of = [np.flatnonzero(feature == f) for f in range(feature.max() + 1)]
    return [cuts_of(np.concatenate([values[i] for i in at]), np.concatenate([weights[i] for i in at])) for at in of]


def _coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each feature: how many thresholds are below the value."""
    out = np.empty(x.shape, np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16)
    for f, cut in enumerate(cuts):
        out[:, f] = np.searchsorted(cut, x[:, f], side="left")
    return out


def blocks(rows: DataFrame, cuts: list[np.ndarray], parts: int, trees: int) -> DataFrame:
    """One row per task: the coded rows of a part and the trees it counts them for."""
    groups = min(trees, -(-TASKS // parts))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, y, part = [], [], 0
        for b in batches:
            if b.num_rows:
                codes.append(_coded(_matrix(b.column("x")), cuts))
                y.append(b.column("y").to_numpy())
                part = b.column("part")[0].as_py()
        if codes:
            codes, y = np.concatenate(codes).tobytes(), np.concatenate(y).tobytes()
            for g in range(groups):
                yield pa.RecordBatch.from_pydict({"task": pa.array([part * groups + g], pa.int32()), "part": pa.array([part], pa.int32()), "first": pa.array([g], pa.int32()), "step": pa.array([groups], pa.int32()), "codes": [codes], "y": [y]})

    made = rows.select("x", "y", F.spark_partition_id().alias("part")).mapInArrow(coded, "task int, part int, first int, step int, codes binary, y binary")
    return made.repartitionById(parts * groups, F.col("task"))


# --- growing -------------------------------------------------------------------


def _next(feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Node after a node and a bin; a node without split leads to itself."""
    node = np.arange(len(feature))
    after = 2 * node[:, None] + (np.arange(BINS)[None, :] > cut[:, None])
    return np.where(feature[:, None] >= 0, after, node[:, None]).ravel()


def _counts(codes: np.ndarray, y: np.ndarray, drawn: np.ndarray, tree, level: int, width: int, classes: int) -> np.ndarray:
    """Counts of one tree's open nodes in one part: by pick of a feature, node, bin, and class or power of the target."""
    feature, cut, slot, picks = tree
    after, of, slot = _next(feature, cut), np.maximum(feature, 0).astype(np.int64), slot.astype(np.int64)
    picked = [picks[:, j].astype(np.int64) for j in range(width)]
    features, open_ = len(codes) // len(y), len(picks)
    out = np.zeros((width, open_, BINS, classes or 3))
    rows = np.flatnonzero(drawn)
    for at in (rows[i : i + CHUNK] for i in range(0, len(rows), CHUNK)):
        first, node = at * features, np.ones(len(at), np.int64)
        for _ in range(level):
            node = after.take(node * BINS + codes.take(first + of.take(node)))
        place = slot.take(node)
        if (place < 0).any():
            keep = np.flatnonzero(place >= 0)
            at, first, place = at.take(keep), first.take(keep), place.take(keep)
        times, said = drawn.take(at).astype(float), y.take(at)
        powers = () if classes else (times, times * said, times * said * said)
        for j in range(width):
            cell = place * BINS + codes.take(first + picked[j].take(place))
            if classes:
                out[j] += np.bincount(cell * classes + said, times, open_ * BINS * classes).reshape(open_, BINS, classes)
            else:
                for k, w in enumerate(powers):
                    out[j, :, :, k] += np.bincount(cell, w, open_ * BINS).reshape(open_, BINS)
    return out


def _impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Gini of weights by class, or variance from number, sum and sum of squares."""
    if classes:
        whole = stats.sum(-1)
        return np.where(whole > 0, 1 - ((stats / np.where(whole > 0, whole, 1)[..., None]) ** 2).sum(-1), 0.0)
    n = np.where(stats[..., 0] > 0, stats[..., 0], 1)
    return (stats[..., 2] - stats[..., 1] ** 2 / n) / n


def best_splits(counts: np.ndarray, weights: np.ndarray | None) -> dict[str, np.ndarray]:
    """Best pick and bin of every open node, with the statistics of both sides; a gain of 0 or less is no split."""
    classes = 0 if weights is None else len(weights)
    n = counts.sum(-1) if classes else counts[..., 0]
    stats = counts * weights if classes else counts
    left, under = np.cumsum(stats, 2), np.cumsum(n, 2)
    whole, rows = left[:, :, -1:], under[:, :, -1:]
    right, over = whole - left, rows - under
    size = lambda s: s.sum(-1) if classes else s[..., 0]
    total = np.where(size(whole) > 0, size(whole), 1)
    gain = _impurity(whole, classes) - size(left) / total * _impurity(left, classes) - size(right) / total * _impurity(right, classes)
    gain = np.where((under > 0) & (over > 0), gain, -np.inf)
    width, open_ = gain.shape[:2]
    flat = gain.transpose(1, 0, 2).reshape(open_, -1)
    best = flat.argmax(1)
    pick, cut, node = best // BINS, best % BINS, np.arange(open_)
    return {"pick": pick, "cut": cut, "gain": flat[node, best], "whole": whole[0, :, 0], "rows": rows[0, :, 0], "left": left[pick, node, cut], "right": right[pick, node, cut], "under": under[pick, node, cut], "over": over[pick, node, cut]}


def grow(rows: DataFrame, parts: int, numbers: int, weights: np.ndarray | None, trees: int, depth: int, seed: int, cuts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Nodes of all trees by their place in a full tree (root 1, children 2n and 2n + 1).

    ``rows`` has ``x``, ``y`` (a class, if classes have ``weights``, or the target)
    and lies in ``parts`` partitions; ``numbers`` features are picked for a node.
    """
    classes = 0 if weights is None else len(weights)
    kind = np.int32 if classes else np.float64
    nodes, features = 1 << (depth + 1), len(cuts)
    feature, cut = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes), np.int16)
    there = np.zeros((trees, nodes), bool)
    there[:, 1] = True
    stats, count = np.zeros((trees, nodes, classes or 3)), np.zeros((trees, nodes), np.int64)
    gains = np.zeros((trees, nodes))
    open_ = [np.array([1]) for _ in range(trees)]
    kept = blocks(rows, cuts, parts, trees).persist()
    try:
        for level in range(depth):
            # features a node may split by: as many of all, in their order, as pyspark.ml takes
            rng = np.random.default_rng([seed, level])
            picks = [np.sort(np.argsort(rng.random((len(o), features)), 1)[:, :numbers], 1).astype(np.int16) for o in open_]
            slot = np.full((trees, nodes), -1, np.int16)
            for t, o in enumerate(open_):
                slot[t, o] = np.arange(len(o))

            def counted(batches: Iterator[pa.RecordBatch], level=level, slot=slot, picks=picks) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for r in b.to_pylist():
                        codes, y = np.frombuffer(r["codes"], np.uint8), np.frombuffer(r["y"], kind)
                        grown = [t for t in range(r["first"], trees, r["step"]) if len(picks[t])]
                        # some trees a batch: one at a time costs more than counting, all of them would fill a worker
                        some = max(1, BATCH_BYTES // (numbers * BINS * (classes * 4 or 24) * max((len(picks[t]) for t in grown), default=1)))
                        for ts in (grown[i : i + some] for i in range(0, len(grown), some)):
                            found = []
                            for t in ts:
                                c = _counts(codes, y, draws(seed, t, r["part"], len(y)), (feature[t], cut[t], slot[t], picks[t]), level, numbers, classes)
                                # draws by class are whole numbers
                                found.append((c.astype(np.int32) if classes else c).tobytes())
                            yield pa.RecordBatch.from_pydict({"tree": pa.array(ts, pa.int32()), "part": pa.array([r["part"]] * len(ts), pa.int32()), "counts": found})

            def split(found: pa.Table) -> pa.Table:
                t = found.column("tree")[0].as_py()
                shape, one = (numbers, len(picks[t]), BINS, classes or 3), np.int32 if classes else np.float64
                whole = np.zeros(shape)
                # in the order of the parts, so that sums come out the same in every run
                for _, i in sorted((p.as_py(), i) for i, p in enumerate(found.column("part"))):
                    whole += np.frombuffer(found.column("counts")[i].as_buffer(), one).reshape(shape)
                return pa.table({"tree": pa.array([t], pa.int32()), "best": [pickle.dumps(best_splits(whole, weights))]})

            answers = kept.mapInArrow(counted, "tree int, part int, counts binary").groupBy("tree").applyInArrow(split, "tree int, best binary").collect()
            following = [np.array([], np.int64) for _ in range(trees)]
            for a in answers:
                t, b = a["tree"], pickle.loads(a["best"])
                if level == 0:
                    stats[t, 1], count[t, 1] = b["whole"][0], b["rows"][0]
                good = np.flatnonzero(b["gain"] > 0)
                at = open_[t][good]
                feature[t, at], cut[t, at], gains[t, at] = picks[t][good, b["pick"][good]], b["cut"][good], b["gain"][good]
                for side, s, n in ((0, "left", "under"), (1, "right", "over")):
                    child = 2 * at + side
                    there[t, child], stats[t, child], count[t, child] = True, b[s][good], b[n][good]
                children = np.sort(np.concatenate([2 * at, 2 * at + 1]))
                following[t] = children[np.abs(_impurity(stats[t, children], classes)) >= EPSILON]
            open_ = following
            if not any(len(o) for o in open_):
                break
    finally:
        kept.unpersist()
    return {"feature": feature, "cut": cut, "there": there, "stats": stats, "count": count, "gain": gains}


# --- models of pyspark.ml ----------------------------------------------------------

NODES = "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"


def node_rows(grown: dict[str, np.ndarray], cuts: list[np.ndarray], classes: int) -> list[tuple]:
    """Nodes of the trees as a model stores them; two leaves of one prediction become one."""
    feature, cut, stats, count, gain = (grown[k] for k in ("feature", "cut", "stats", "count", "gain"))
    impurity = _impurity(stats, classes)
    says = stats.argmax(-1).astype(float) if classes else stats[..., 1] / np.maximum(stats[..., 0], 1)
    out = []
    for t in range(len(feature)):
        inner = feature[t] >= 0
        for n in range(len(inner) // 2 - 1, 0, -1):
            if inner[n] and not inner[2 * n] and not inner[2 * n + 1] and says[t, 2 * n] == says[t, 2 * n + 1]:
                inner[n] = False
        order, stack = [], [1]
        while stack:
            n = stack.pop()
            order.append(n)
            if inner[n]:
                stack += [2 * n + 1, 2 * n]
        place = {n: i for i, n in enumerate(order)}
        for i, n in enumerate(order):
            of = (i, float(says[t, n]), float(impurity[t, n]), stats[t, n].tolist(), int(count[t, n]))
            if inner[n]:
                f = int(feature[t, n])
                out.append((t, (*of, float(gain[t, n]), place[2 * n], place[2 * n + 1], (f, [float(cuts[f][cut[t, n]])], -1))))
            else:
                out.append((t, (*of, -1.0, -1, -1, (-1, [], -1))))
    return out


def fit_forest(estimator, rows: DataFrame, parts: int, weights: np.ndarray | None = None):
    """The model of a forest estimator of ``pyspark.ml``, grown from ``rows``: ``x`` features, ``y``, ``w`` weight, in ``parts`` partitions."""
    spark = rows.sparkSession
    cuts = feature_cuts(rows)
    features, classes = len(cuts), 0 if weights is None else len(weights)
    # what "auto" stands for: the root of the features for classes, a third for numbers
    numbers = math.ceil(math.sqrt(features)) if classes else math.ceil(features / 3)
    grown = grow(rows, parts, numbers, weights, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed(), cuts)
    # a model of the same parameters and sizes, in which the nodes are then put
    few = [(Vectors.dense([0.0] * features), float(k), 1.0) for k in range(max(classes, 2))]
    weight = [estimator.getWeightCol()] if estimator.isDefined("weightCol") else []
    frame = estimator.fit(spark.createDataFrame(few, [estimator.getFeaturesCol(), estimator.getLabelCol(), *(weight or ["_w"])]))
    where = scratch_dir(spark, "forest")
    frame.write().save(where)
    spark.createDataFrame(node_rows(grown, cuts, classes), NODES).coalesce(1).write.mode("overwrite").parquet(f"{where}/data")
    return type(frame).load(where)


# --- walking -------------------------------------------------------------------------


def _trees(model) -> tuple[list[np.ndarray], list[tuple]]:
    """Thresholds of every feature, and of every tree: its levels, features of its nodes, nodes after a node and a bin, what a node says."""
    spark = SparkSession.active()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    where = scratch_dir(spark, "nodes")
    model.write().save(where)
    d = F.col("nodeData")
    names = {"id": d["id"], "says": d["prediction"], "stats": d["impurityStats"], "left": d["leftChild"], "right": d["rightChild"], "feature": d["split"]["featureIndex"], "at": d["split"]["leftCategoriesOrThreshold"], "kinds": d["split"]["numCategories"]}
    found = spark.read.parquet(f"{where}/data").select("treeID", *[e.alias(n) for n, e in names.items()]).toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    tree, left, right, feature, kinds, says = (found.column(n).to_numpy() for n in ("treeID", "left", "right", "feature", "kinds", "says"))
    stats, at = _matrix(found.column("stats").combine_chunks()), found.column("at").to_pylist()
    # a split by categories lists those that go left; a category is then its own bin
    first = np.array([x[0] if x else 0.0 for x in at])
    uses = [np.flatnonzero((left >= 0) & (feature == f)) for f in range(model.numFeatures)]
    cuts = [np.arange(kinds[i].max() - 1) + 0.5 if i.size and kinds[i].max() >= 0 else np.unique(first[i]) for i in uses]
    width, classes = max(map(len, cuts)) + 1, getattr(model, "numClasses", 0)
    if classes:
        # added class by class, as the model does
        whole = sum(stats[:, k] for k in range(classes))
        says = stats / np.where(whole != 0, whole, 1)[:, None]
    bins, cut = np.arange(width), np.full(len(tree), -1)
    for f, i in enumerate(uses):
        cut[i] = np.searchsorted(cuts[f], first[i])
    goes_left = bins <= cut[:, None]
    for i in np.flatnonzero((left >= 0) & (kinds >= 0)):
        goes_left[i] = np.isin(bins, at[i])
    trees = []
    for own in (slice(*np.searchsorted(tree, [t, t + 1])) for t in np.unique(tree)):
        a, b = left[own], right[own]
        level = [0] * len(a)
        # nodes are numbered from the root, a child after its parent
        for n in np.flatnonzero(a >= 0).tolist():
            level[a[n]] = level[b[n]] = level[n] + 1
        after = np.where(goes_left[own], a[:, None], b[:, None])
        after = np.where(a[:, None] >= 0, after, np.arange(len(a))[:, None])
        trees.append((max(level), np.maximum(feature[own], 0).astype(np.int64), after.astype(np.int32).ravel(), says[own]))
    return cuts, trees


def walked(model, features: str = "_features") -> Column:
    """What a forest says of a vector, as the model itself does: ``prediction``, and of classes the highest probability as ``confidence``."""
    (cuts, trees), classes = _trees(model), getattr(model, "numClasses", 0)
    width = max(map(len, cuts)) + 1

    @F.arrow_udf("struct<prediction:double,confidence:double>")
    def walk(vectors: pa.Array) -> pa.Array:
        x = _matrix(vectors) if len(vectors) else np.zeros((0, len(cuts)))
        codes, start = _coded(x, cuts).ravel(), np.arange(len(x)) * len(cuts)
        said = np.zeros((len(x), classes) if classes else len(x))
        for levels, feature, after, says in trees:
            after, node = after.astype(np.int64), np.zeros(len(x), np.int64)
            for _ in range(levels):
                node = after.take(node * width + codes.take(start + feature.take(node)))
            said += says.take(node, 0)
        if not classes:
            return pa.StructArray.from_arrays([said / len(trees), pa.nulls(len(x), pa.float64())], ["prediction", "confidence"])
        whole = sum(said[:, k] for k in range(classes))
        sure = said / np.where(whole != 0, whole, 1)[:, None]
        return pa.StructArray.from_arrays([said.argmax(1).astype(float), sure.max(1)], ["prediction", "confidence"])

    return walk(vector_to_array(features))
