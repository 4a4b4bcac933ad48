"""Exact duplicates by content sort, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import common as C

# of the normalised bytes, this many lead the sort key; the digest orders the rest
LEAD = 64
# a group of more rows than this share of the table, and than LEAST, is dealt out in cells
SHARE, LEAST = 1000, 1000


def _found(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> tuple[DataFrame, dict]:
    """Rows with their group's results, and the output columns."""
    C.session(docs)
    text, norm = C.quoted(text_col), C.ascii_lower(C.quoted(text_col))
    if not keep_text:
        docs = docs.select(C.quoted(id_col), text)
    keyed = C.rows(docs, _id=C.quoted(id_col), _lead=F.substring(norm, 1, LEAD), _sha=F.sha2(norm, 256))
    cell = max(docs.count() // SHARE, LEAST)
    hot = keyed.groupBy("_sha").agg(F.count("*").alias("_n")).where(F.col("_n") > cell)
    hot = hot.select("_sha", F.ceil(F.col("_n") / cell).alias("_cells"))
    deal = F.when(F.col("_cells").isNull(), -1).otherwise(F.pmod(F.xxhash64("_id"), F.col("_cells")))
    dealt = keyed.join(F.broadcast(hot), "_sha", "left").withColumn("_cell", deal)
    placed = dealt.repartitionByRange("_lead", "_sha", "_cell").withColumn("_norm", C.ascii_lower(F.col("_row").getField(text_col)))
    run = Window.partitionBy("_lead", "_sha", "_cell", "_norm").orderBy(F.col("_id").desc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = placed.select(
        *["_row"] * keep_text,
        "_id",
        "_sha",
        "_cell",
        F.first("_id").over(whole).alias("_keep"),
        F.count("*").over(whole).alias("_size"),
        F.row_number().over(run).alias("_nth"),
    )
    found = materialize(found, "exact")
    cells = found.where((F.col("_cell") >= 0) & (F.col("_nth") == 1)).groupBy("_sha").agg(F.max("_keep").alias("_all_keep"), F.sum("_size").alias("_all_size"))
    found = found.join(F.broadcast(cells), "_sha", "left")
    keep = F.when(F.col("_all_size").isNotNull(), F.col("_all_keep")).otherwise(F.col("_keep"))
    return found, {
        "keep_id": keep,
        "group_size": F.coalesce("_all_size", "_size"),
        "kept": (F.col("_nth") == 1) & F.col("_keep").eqNullSafe(keep),
        "text_sha256": F.col("_sha"),
    }


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Mark, for every row, the row that stays among those of equal text.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id stays, nulls last; of repeated rows with the
    same id one stays. Adds keep_id, group_size, kept and text_sha256 (an
    input column of such a name is replaced; without ``keep_text`` only the id
    comes with them); an empty table gives no rows.

    Rows are range-partitioned by sampled splitters on the lead of the
    normalised bytes and their digest, sorted outside memory where needed, so
    equal texts are adjacent, and neighbours are compared in full. A group that
    holds more than a thousandth of the rows is sorted in cells, each with its
    own part of the ids; at most a thousand such groups can exist, so their
    merged cells are small enough to broadcast.
    """
    found, out = _found(docs, id_col, text_col, keep_text)
    if keep_text:
        return C.unpack(found, **out)
    return found.select(F.col("_id").alias(id_col), *[c.alias(n) for n, c in out.items()])


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of each group of equal texts, with the input's columns."""
    found, out = _found(docs, id_col, text_col, True)
    return C.unpack(found.where(out["kept"]))
