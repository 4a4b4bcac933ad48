"""What the operators share: whole rows under one name, output columns, id filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import configure

# rows of one Arrow batch; a batch of very long texts then still fits a worker
BATCH_ROWS = 500
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def session(df_or_spark) -> SparkSession:
    """The session with the settings the operators rely on."""
    spark = df_or_spark if isinstance(df_or_spark, SparkSession) else df_or_spark.sparkSession
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row as the struct ``_row`` beside working columns, so no name of the input can clash."""
    return docs.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in columns.items()])


def unpack(df: DataFrame, **outputs: Column) -> DataFrame:
    """The input's columns again, with ``outputs`` added; an input column of an output's name is replaced."""
    taken = {n.lower() for n in outputs}
    names = [f.name for f in df.schema["_row"].dataType if f.name.lower() not in taken]
    return df.select(*[F.col("_row").getField(n).alias(n) for n in names], *[c.alias(n) for n, c in outputs.items()])


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` maps a dict of column lists to a dict of column lists, batch by batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for b in batches:
            out = work({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def per_text(make, kind: str):
    """Column function that maps each text (null: empty) by ``make()``, one call of ``make`` per task.

    It counts as not deterministic, so a filter on its result does not run it twice.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    target = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for b in batches:
            yield pa.array([work(t or "") for t in b.to_pylist()], type=target)

    return run.asNondeterministic()


# a bitmap of this many bits is the most that is ever broadcast for an id filter
BITMAP_WORDS = 1 << 17


def split_by_ids(df: DataFrame, key: Column, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``df`` as rows whose key may be in ``ids`` and rows whose key is surely not.

    The ids are folded into a bitmap of fixed size (8 million bits in 131,072
    words), which bounds what is broadcast whatever the number of ids; an exact
    join on the first part then moves few other rows.
    """
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(BITMAP_WORDS * 63))
    words = (
        ids.select((place / 63).cast("bigint").alias("_word"), F.expr("1").alias("_one"), F.pmod(place, F.lit(63)).cast("int").alias("_bit"))
        .groupBy("_word")
        .agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    )
    at = F.pmod(F.xxhash64(key), F.lit(BITMAP_WORDS * 63))
    marked = df.withColumn("_at", at).withColumn("_word", (F.col("_at") / 63).cast("bigint"))
    marked = marked.join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.expr("(shiftright(_bits, CAST(pmod(_at, 63) AS INT)) & 1L) = 1L"), F.lit(False))
    drop = ("_at", "_word", "_bits")
    return marked.where(hit).drop(*drop), marked.where(~hit).drop(*drop)
