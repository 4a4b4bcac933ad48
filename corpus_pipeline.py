"""From raw documents to packed sequences: each stage reads what its predecessor kept.

Toxic documents go first, then all but one of equal texts, then all but one of
each group of near duplicates, then documents that hold a benchmark item; the
rest is packed. A stage's result is written to the folder of
spark.checkpoint.dir and read again, so a lost executor costs one stage's tasks.

Null and empty texts are no toxic documents, are equal to one another (one of
all of them stays), are near nothing and hold no benchmark item; what stays of
them is packed as a document of the end token alone. Texts of any length are
read whole. Repeated rows are equal texts: one stays. Of ties in exact copies
the largest id stays, null ids last; of near copies the smallest. Extra columns
go through all stages but the last, whatever their names. An empty table gives
an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hitledger.llm import common, decontaminate, exact_dedup, near_dedup, packing, toxicity
from hitledger.llm.queries import tokenizer
from hitledger.session import materialize


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7 by a model fitted on labels that are not held out."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(common.rows(docs, _text=common.quoted("text")), model, "_text")
    return common.unpack(scored.where("NOT is_toxic"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the largest id of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2,048 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("packing", packed)]
# neither the trained model nor the token ids can be stated in SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
