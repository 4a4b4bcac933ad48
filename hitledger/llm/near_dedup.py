"""Near duplicates by SetSketch registers: band, estimate jointly, verify on full sets, connect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import common as C

WORDS = 5
# registers per sketch, base and rate of their exponential spacing, largest value
REGISTERS, BASE, RATE, TOP = 128, 1.001, 20.0, (1 << 16) - 1
# a band is 4 registers: 32 bands of neighbours, 16 of registers 32 apart
ROWS = 4
BANDS = [tuple(range(ROWS * k, ROWS * (k + 1))) for k in range(REGISTERS // ROWS)] + [tuple(k + 32 * j for j in range(ROWS)) for k in range(16)]
ORDERS = 4
# pairs whose estimate is this far below the limit (four standard errors) are not verified
MARGIN = 0.15
# members of a bucket compared at a time, and shingles of a block when components are compared whole
PART, BLOCK = 512, 400_000
FACTORS = np.random.default_rng(11).integers(1, 2**63, size=REGISTERS, dtype=np.uint64) | np.uint64(1)
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GRID = np.linspace(0.0, 1.0, 81)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; all words as one run where fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(h))
    runs = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        runs = mix(runs * GOLD + h[k : k + len(runs)])
    return np.unique(runs)


def sketch(h: np.ndarray) -> np.ndarray:
    """SetSketch registers: the least of exponential numbers of the elements, on a scale of powers of BASE, truncated.

    A register of a union is the greater of the two, so sketches merge.
    """
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(h), 1024):
        least = np.minimum(least, (h[k : k + 1024, None] * FACTORS).min(axis=0))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of most likelihood given how many registers are above, below and equal, and the sets' sizes."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = GRID * np.minimum(u / v, v / u)

    def chance(x):
        return -np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(u - v * j), chance(v - u * j)
    log = lambda p: np.log(np.maximum(p, 1e-12))
    best = (above * log(up) + below * log(down) + equal * log(1 - up - down)).argmax(axis=1)
    return np.take_along_axis(j, best[:, None], axis=1)[:, 0]


def signed(x: np.uint64) -> int:
    return int(np.int64(x))


def summary(text: str) -> dict:
    h = shingles(text)
    return {
        "n": len(h),
        "f1": signed(mix(h + GOLD).sum(dtype=np.uint64).astype(np.int64)),
        "f2": signed(mix(h * GOLD + MIX1).sum(dtype=np.uint64).astype(np.int64)),
        "regs": sketch(h).tobytes() if len(h) else b"",
    }


def node(n, f1, f2):
    """A set's name; equal sets have the same."""
    return F.xxhash64(n, f1, f2)


def pairs_map(df: DataFrame, fn, schema: str, names: list[str]) -> DataFrame:
    """``fn`` of a batch's columns gives a mask and a column to add."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask, value = fn({n: b.column(i) for i, n in enumerate(b.schema.names)})
            kept = [b.column(b.schema.get_field_index(n)).filter(pa.array(mask)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(value[mask])], schema=target)

    return df.mapInArrow(run, schema)


def crowded(nodes: DataFrame) -> DataFrame:
    """``node``, ``key`` and ``centres`` of every bucket that holds more than one node.

    Centres are the smallest set, the node of least hash, and the first node in
    one of ORDERS orders, which bands take in turn.
    """
    at = lambda i: F.substring("regs", 2 * i + 1, 2)
    keys = [F.xxhash64(F.lit(k), *[at(i) for i in band]) for k, band in enumerate(BANDS)]
    banded = nodes.select("node", "n", F.posexplode(F.array(*keys)).alias("band", "key"))
    turn = f"pmod(band, {ORDERS})"
    centres = banded.groupBy("key").agg(
        F.count("*").alias("members"),
        F.expr("min_by(node, shiftleft(n, 36) + pmod(node, 68719476736L))").alias("c0"),
        F.expr("min_by(node, xxhash64(node))").alias("c1"),
        F.expr(f"min_by(node, xxhash64(node, {turn}))").alias("c2"),
    )
    centres = centres.where("members > 1").select("key", F.array_distinct(F.array("c0", "c1", "c2")).alias("centres"))
    return banded.join(centres, "key").select("node", "key", "centres")


def likely(pairs: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """The pairs that may reach the limit by the sets' sizes and the registers, with the estimate ``j``."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * limit)

    def near(cols):
        a, b = (np.frombuffer(b"".join(cols[c].to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
        j = estimate(a, b, cols["n_a"].to_numpy().astype(float), cols["n_b"].to_numpy().astype(float)) if len(a) else np.zeros(0)
        return j >= limit - MARGIN, j

    return pairs_map(both, near, "a long, b long, j double", ["a", "b"])


def candidates(buckets: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """Likely pairs of a node and a centre of one of its buckets.

    A bucket of any size gives at most three pairs for each member, and members
    of a large group meet the same few centres in many buckets.
    """
    met = buckets.select("node", F.explode("centres").alias("centre")).where("node != centre")
    return likely(met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), nodes, limit)


def meeting(buckets: DataFrame, owned: DataFrame, limit: float) -> DataFrame:
    """Pairs of components ``x`` and ``y`` with likely pairs in a bucket besides those of its centres, y the larger.

    A large group of copies is one component by now and meets nobody in its own
    buckets. Of a bucket that holds several components, members of the largest
    one meet the others only, PART against PART, and the others meet each other:
    a few strays in a bucket of any size cost a copy of its members and as many
    copies of the strays as it has parts. Members are compared by their
    registers and give one row for each two components.
    """
    placed = buckets.where("NOT array_contains(centres, node)").join(owned, "node").select("key", "node", "root", "n", "regs")
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("members"), F.count("*").alias("roots")
    )
    parts = lambda c: F.ceil(c / PART).cast("bigint")
    mixed = counts.where("roots > 1").select("key", "main", "roots", parts(F.col("most")).alias("main_parts"), parts(F.col("members") - F.col("most")).alias("stray_parts"))
    held = F.col("root") == F.col("main")
    placed = placed.join(mixed, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.when(held, F.col("main_parts")).otherwise(F.col("stray_parts"))))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    cell = lambda kind, first, second, side: F.struct(F.lit(kind).alias("kind"), first.alias("first"), second.alias("second"), side.alias("side"))
    own = F.col("part")
    # kind 0: a part of the largest component (side 0) and one of the others (side 1); kind 1: two parts of the others, or one with itself (side 2)
    of_main = F.transform(every("stray_parts"), lambda j: cell(0, own, j, F.lit(0)))
    to_main = F.transform(every("main_parts"), lambda i: cell(0, i, own, F.lit(1)))
    among = F.transform(every("stray_parts"), lambda j: cell(1, F.least(own, j), F.greatest(own, j), F.when(own == j, 2).when(own < j, 0).otherwise(1)))
    cells = F.when(held, of_main).when(F.col("roots") > 2, F.concat(to_main, among)).otherwise(to_main)
    placed = placed.select("key", "root", "n", "regs", F.inline(cells))

    def compare(t: pa.Table) -> pa.Table:
        side, root, n = (t.column(c).to_numpy() for c in ("side", "root", "n"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        equal = np.zeros((len(first), len(second)), dtype=np.int16)
        for r in range(REGISTERS):
            equal += regs[first, r][:, None] == regs[second, r]
        small, large = np.minimum(n[first][:, None], n[second]), np.maximum(n[first][:, None], n[second])
        i, k = np.nonzero((equal >= REGISTERS * (limit - MARGIN)) & (root[first][:, None] != root[second]) & (small >= large * limit))
        ends = np.sort(np.stack([root[first[i]], root[second[k]]], axis=1), axis=1)
        ends = np.unique(ends, axis=0)
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

    pairs = placed.groupBy("key", "kind", "first", "second").applyInArrow(compare, "a long, b long").distinct()
    sizes = owned.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("nodes"))
    side = lambda x: sizes.select(F.col("root").alias(x), F.col("total").alias(f"total_{x}"), F.col("nodes").alias(f"nodes_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    pick = lambda low, high: F.when(F.col("total_a") > F.col("total_b"), F.col(high)).otherwise(F.col(low))
    single = (F.col("nodes_a") == 1) & (F.col("nodes_b") == 1)
    return both.select(pick("a", "b").alias("x"), pick("b", "a").alias("y"), F.greatest("total_a", "total_b").alias("total"), single.alias("single"))


def in_blocks(meets: DataFrame, owned: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked pairs of components, found by comparing all nodes of x with all of y, block against block.

    A block holds about BLOCK shingles, so a component of any size is spread
    over many tasks, and no pair of nodes becomes a row.
    """
    held = owned.join(sets, "node").select("root", "node", "n", "set")
    asked = meets.select("x", "y").join(held.withColumnRenamed("root", "x"), "x")
    per = asked.groupBy("y").agg(F.sum("n").alias("_asked")).join(meets.select("y", "total").distinct(), "y")
    per = per.select("y", F.ceil(F.col("_asked") / BLOCK).alias("askers"), F.ceil(F.col("total") / BLOCK).alias("parts"))
    place = lambda count: F.pmod(F.xxhash64("node"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    asked = asked.join(per, "y").withColumn("asker", place("askers")).withColumn("part", every("parts")).select("y", "asker", "part", "x", "set")
    told = held.withColumnRenamed("root", "y").join(per, "y").withColumn("part", place("parts")).withColumn("asker", every("askers"))
    told = told.select(F.col("y").alias("owner"), "part", "asker", F.col("set").alias("member"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        read = lambda sets: [np.frombuffer(s, dtype="<u8") for s in sets.to_pylist()]
        members = read(right.column("member"))
        links = []
        if members:
            words, at = np.unique(np.concatenate(members), return_inverse=True)
            whose, n = np.repeat(np.arange(len(members)), [len(m) for m in members]), np.array([len(m) for m in members])
            for x, y, q in zip(left.column("x").to_pylist(), left.column("y").to_pylist(), read(left.column("set"))):
                spot = np.minimum(np.searchsorted(words, q), len(words) - 1)
                held = np.zeros(len(words))
                held[spot[words[spot] == q]] = 1
                common = np.bincount(whose, weights=held[at], minlength=len(members)).astype(np.int64)
                if (100 * common >= percent * (len(q) + n - common)).any():
                    links.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    both = asked.groupBy("y", "asker", "part").cogroup(told.groupBy("owner", "asker", "part"))
    return both.applyInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the limit."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def confirm(cols):
        common, union = [], []
        for x, y in zip(cols["set_a"], cols["set_b"]):
            x, y = (np.frombuffer(s.as_buffer(), dtype="<u8") for s in (x, y))
            common.append(len(np.intersect1d(x, y, assume_unique=True)))
            union.append(len(x) + len(y) - common[-1])
        common, union = np.array(common, dtype=np.int64), np.array(union, dtype=np.int64)
        return 100 * common >= percent * union, common

    return pairs_map(both, confirm, "a long, b long, shared long", ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node reachable, by least labels of neighbours and pointer jumps.

    Each round is written to the shared folder, so lineage does not grow.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
    labels = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"), "labels")
    while True:
        told = both.join(labels.withColumnRenamed("node", "x"), "x").groupBy("y").agg(F.min("root").alias("told"))
        next_ = labels.join(told, labels["node"] == told["y"]).select("node", "root", F.least("root", "told").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("root").alias("far"))
        next_ = next_.join(jump, "least").select("node", F.least("least", "far").alias("new"), "root")
        next_ = materialize(next_, "labels")
        if next_.where("new != root").isEmpty():
            return labels
        labels = next_.select("node", F.col("new").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row: id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and split at ASCII white space; a document is
    its set of five-word runs, or all its words where fewer; rows without words
    have no set and link with nothing. Rows are linked when their sets share
    ``percent`` in a hundred of their union. component_id is the least id
    reachable, kept says that it is the row's own; repeated rows share it. Rows
    without an id belong to the component of their text; where no row of an
    equal set has an id they link with nothing and component_id is null. Other columns are not read; an empty table
    gives no rows.

    Rows of equal sets become one node at once. Sketches (256 bytes) are banded;
    in each bucket every node first meets at most three centres. Likely pairs
    are verified on full sets: the best partner of each node, then those that
    still join two components. Components that then still meet in a bucket are
    compared whole, in blocks, so no pair that shares a bucket is left out.
    """
    spark = C.session(docs)
    given = docs.select(C.quoted(id_col).alias("id"), C.quoted(text_col).alias("text"))
    read = C.per_text(lambda: summary, "struct<n:bigint,f1:bigint,f2:bigint,regs:binary>")
    rows = given.select("id", read(F.col("text")).alias("s")).select("id", "s.n", node(F.col("s.n"), F.col("s.f1"), F.col("s.f2")).alias("node"), "s.regs")
    rows = materialize(rows, "sketches")
    named = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"))
    nodes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = materialize(nodes, "nodes")
    buckets = materialize(crowded(nodes), "buckets")
    pairs = materialize(candidates(buckets, nodes, percent / 100), "pairs")

    def full_sets(met: DataFrame) -> DataFrame:
        """The sets of nodes, each from one of its rows."""
        wanted = rows.select("id", "node").join(met, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
        maybe, _ = C.split_by_ids(given, F.col("id"), wanted, "id")
        full = C.per_text(lambda: lambda t: {**(s := summary(t)), "set": shingles(t).tobytes()}, "struct<n:bigint,f1:bigint,f2:bigint,set:binary>")
        sets = maybe.join(wanted.select("id"), "id", "left_semi").select(full(F.col("text")).alias("s"))
        sets = sets.select(node(F.col("s.n"), F.col("s.f1"), F.col("s.f2")).alias("node"), "s.set").groupBy("node").agg(F.first("set").alias("set"))
        return materialize(sets, "sets")

    def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
        """The components after links between some of them."""
        over = components(materialize(links.distinct(), "links")).select(F.col("node").alias("root"), F.col("root").alias("over"))
        touched = roots.select("node", "root").union(over.select("root", "root")).distinct()
        return materialize(touched.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")), "roots")

    ends = lambda d: d.select(F.col("a").alias("node")).union(d.select(F.col("b").alias("node"))).distinct()
    sets = full_sets(ends(pairs))
    # likely partners: the one that most others have too, so that trees are flat; else the likeliest
    turned = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "a", "b", "j").union(pairs.select(F.col("b"), F.col("a"), "a", "b", "j"))
    order = F.when(F.col("j") >= percent / 100 + 0.03, F.col("other") / 2.0**63).otherwise(3 - F.col("j"))
    best = turned.groupBy("node").agg(F.min_by(F.struct("a", "b"), order).alias("pair")).select("pair.*").distinct()
    best = materialize(best, "best")
    edges = materialize(verified(best, sets, percent).select("a", "b"), "links")
    roots = components(edges)
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = rest.withColumns({f"root_{x}": F.coalesce(f"root_{x}", x) for x in "ab"}).where("root_a != root_b")
    rest = materialize(rest, "rest")
    more = verified(rest, sets, percent).select("a", "b").join(rest, ["a", "b"])
    roots = merged(roots, more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))

    # what no centre reached: components that still meet in a bucket are compared whole
    owned = nodes.join(roots, "node", "left").select("node", "n", "regs", F.coalesce("root", "node").alias("root"))
    meets = materialize(meeting(buckets, owned, percent / 100), "meets")
    single = materialize(likely(meets.where("single").select(F.col("x").alias("a"), F.col("y").alias("b")), nodes, percent / 100), "single")
    groups = meets.where("NOT single")
    members = owned.join(groups.select(F.col("x").alias("root")).union(groups.select("y")).distinct(), "root", "left_semi")
    sets = full_sets(ends(single).union(members.select("node")).distinct())
    last = verified(single, sets, percent).select("a", "b").union(in_blocks(groups, members, sets, percent))
    roots = merged(roots, last)

    reached = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = reached.groupBy("root").agg(F.min("rep").alias("component"))
    owner = reached.join(least, "root").select("node", "component")
    out = rows.select("id", "n", "node").join(owner, "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows that are kept, with the input's columns; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col, percent)
    dropped = materialize(found.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_dropped")).distinct(), "dropped")
    maybe, kept = C.split_by_ids(C.rows(docs, _id=C.quoted(id_col)), F.col("_id"), dropped, "_dropped")
    return C.unpack(kept.unionByName(maybe.join(dropped, F.col("_id") == F.col("_dropped"), "left_anti")))
