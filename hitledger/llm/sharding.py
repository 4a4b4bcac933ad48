"""Shards of equal bytes, tokens and rows by vector bin packing of groups of equal texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import common as C

# groups are packed in tiers, heaviest first: those over a 64th of a shard's share, over a 64th of that, and so on
TIER, TIERS = 64, 5
# a group that outweighs a shard's share is split into lots of an eighth of it
LOTS = 8
# so many groups are packed together, and so many rows numbered together
CHUNK = 8000
# bytes are the law, tokens and rows follow as far as that allows
WEIGHTS = (4.0, 1.0, 1.0)


def place(loads: np.ndarray, left: np.ndarray, turn: int) -> np.ndarray:
    """Shard of each lot: largest first, to the highest dot product with the residual capacity.

    Both are in shares of a shard; ``left`` is the residual capacity the lots
    find. Equal products go to the shards in turn from ``turn`` on.
    """
    left = np.roll(left, -turn, axis=0)
    weighted = loads * np.array(WEIGHTS)
    at = np.zeros(len(loads), dtype=np.int64)
    for i in np.lexsort((np.arange(len(loads)), -loads.max(axis=1))):
        best = int((left @ weighted[i]).argmax())
        at[i] = best
        left[best] -= loads[i]
    return (at + turn) % len(left)


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """Shard and slot of every row, so that shards have nearly equal bytes, tokens and rows.

    A row weighs its text's UTF-8 bytes (null: none) plus 8, its tokens (words,
    or the given column) and one row. Rows of equal text (null and empty texts
    are equal) form a group that stays in one shard; only a group that outweighs
    a shard's share of bytes or rows, of which there are at most twice as many
    as shards, is split, into lots of an eighth of a share. Groups are placed by
    their sums, tier by tier of falling weight, in chunks of about 8,000 groups;
    each tier finds the residual capacity the one before has left, each of its
    chunks an equal part of it. Ties go to the shards in turn. Slots are counted
    in blocks of at most 8,000 rows. Repeated rows get a slot each; other columns
    are not read, whatever their names; an empty table gives no rows. Returns
    doc_id, size, tokens, text_crc32, law (``bytes``), shard, slot and
    grown_shard (null under this law).
    """
    spark = C.session(docs)
    text = F.coalesce(C.quoted(text_col), F.lit(""))
    words = F.regexp_count(text, F.lit(r"\S+")) if tokens is None else tokens
    base = docs.select(
        C.quoted(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.coalesce(words, F.lit(0)).cast("bigint").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
    )
    base = materialize(base, "sizes")
    total = base.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    share = [max(float(x or 0) / shards, 1e-9) for x in total]
    loads = [F.sum("size").alias("_b"), F.sum("tokens").alias("_t"), F.count("*").alias("_n")]
    weight = F.greatest(F.col("_b") / share[0], F.col("_n") / share[2])
    groups = materialize(base.groupBy("_key").agg(*loads).withColumn("_w", weight), "groups")
    # at most twice as many as shards; rows of one are dealt to its lots in turn
    split = groups.where("_w > 1").select("_key", F.ceil(F.col("_w") * LOTS).cast("bigint").alias("_lots"))
    lots = F.coalesce(F.col("_lots"), F.lit(1))
    row = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    rows = base.select("*", row.alias("_row")).join(F.broadcast(split), "_key", "left").withColumn("_lot", F.pmod("_row", lots)).drop("_lots", "_row")
    whole = groups.join(F.broadcast(split.select("_key")), "_key", "left_anti").select("_key", F.lit(0).cast("bigint").alias("_lot"), "_b", "_t", "_n")
    parts = rows.join(F.broadcast(split.select("_key")), "_key", "left_semi").groupBy("_key", "_lot").agg(*loads)
    tier = F.floor(F.log(F.greatest(1 / weight, F.lit(1.0))) / np.log(TIER)).cast("int")
    lots = materialize(whole.unionByName(parts).withColumn("_tier", F.least(tier, F.lit(TIERS - 1))), "lots")
    sizes = {r["_tier"]: r["count"] for r in lots.groupBy("_tier").count().collect()}

    left, placed = np.ones((shards, 3)), []
    for number in sorted(sizes):
        chunks = -(-sizes[number] // CHUNK)
        own = spark.sparkContext.broadcast(left / chunks)

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_key", "_lot"]).reset_index(drop=True)
            weights = pdf[["_b", "_t", "_n"]].to_numpy(dtype=np.float64) / np.array(share)
            pdf["shard"] = place(weights, own.value.copy(), int(pdf["_chunk"].iloc[0]) * 7 % shards).astype(np.int32)
            return pdf[["_key", "_lot", "_b", "_t", "_n", "shard"]]

        chunk = F.pmod(F.xxhash64("_key", "_lot"), F.lit(chunks)).cast("int")
        done = lots.where(F.col("_tier") == number).withColumn("_chunk", chunk).groupBy("_chunk").applyInPandas(pack, "_key long, _lot long, _b long, _t long, _n long, shard int")
        done = materialize(done, f"tier-{number}")
        used = {r["shard"]: r for r in done.groupBy("shard").agg(F.sum("_b"), F.sum("_t"), F.sum("_n")).collect()}
        left = left - np.array([[float(used[s][k + 1]) / share[k] if s in used else 0.0 for k in range(3)] for s in range(shards)])
        placed.append(done.select("_key", "_lot", "shard"))

    none = spark.createDataFrame([], "_key long, _lot long, shard int")
    # the heaviest tier, at most some thousand lots, holds every key of many rows
    heavy = placed.pop(0) if min(sizes, default=1) == 0 else none
    light = none
    for part in placed:
        light = light.unionByName(part)
    found = rows.join(F.broadcast(heavy), ["_key", "_lot"], "left")
    cols = ["doc_id", "size", "tokens", "text_crc32", "shard"]
    rest = found.where("shard IS NULL").drop("shard").join(light, ["_key", "_lot"])
    all_rows = found.where("shard IS NOT NULL").select(*cols).unionByName(rest.select(*cols))
    done = materialize(all_rows, "shards")
    done = done.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.floor(F.col("_metadata.row_index") / CHUNK).alias("_block"), F.col("_metadata.row_index").alias("_at"))
    cell = ["shard", "_file", "_block"]
    done = done.withColumn("_nth", F.row_number().over(Window.partitionBy(*cell).orderBy("_at")) - 1)
    before = Window.partitionBy("shard").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    cells = done.groupBy(*cell).agg(F.count("*").alias("_n"))
    cells = cells.select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return done.join(cells, cell).select(
        "doc_id",
        "size",
        "tokens",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + F.col("_nth")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
