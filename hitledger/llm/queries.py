"""One query per operator over the whole of its table, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C
from . import centroids, decontaminate, exact_dedup, licenses, near_dedup, packing, periodic, pii, secret_scan, sharding, spans, text_quality, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, C.table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("is_toxic").cast("int").alias("predicted"),
        "toxic_sentences",
    )


EXACT_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{C.UPPER}', '{C.UPPER.lower()}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


@query("op4_exact_dedup", EXACT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(C.table(spark, sf_dir, "documents"), keep_text=False)


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id",
        F.col("leak.item").alias("item_id"),
        F.col("leak.score").alias("score"),
        F.col("leak.question").alias("question_overlap"),
        F.col("leak.answer").alias("answer_overlap"),
        F.col("leak.word").alias("passage_start"),
    )


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs).select("doc_id", "secrets")
    base, added = F.col("secrets.base"), F.col("secrets.added")
    order = F.array_sort(F.concat(base, added), lambda a, b: spans.by_place(a, b, secret_scan.KINDS))
    return found.select(
        "doc_id",
        *[spans.count_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        spans.digest(base).alias("base_sha256"),
        spans.text_of(order).alias("spans"),
        spans.count_of(added, "entropy").alias("n_entropy"),
    )


@query("op9_vector_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(C.table(spark, sf_dir, "documents"))


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(C.table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model")).select("doc_id", "n_tokens", "token_score")


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(C.table(spark, sf_dir, "documents"))
    base = F.col("base")
    order = F.array_sort(F.concat("base", "added"), lambda a, b: spans.by_place(a, b, pii.KINDS))
    return found.select(
        "doc_id",
        *[spans.count_of(base, k).alias(f"n_{k}") for k in pii.KINDS],
        spans.digest(base).alias("base_sha256"),
        spans.text_of(order).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "license", "license_paragraphs")


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(docs, plant=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    best = F.col("longest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[best[n].alias(n) for n in ("start", "length", "period")],
        F.expr("(1000 * longest.length) div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def moved_sql(n: int) -> str:
    """Vectors assigned to the centroids c<n-1>, and the centroids c<n> they give."""
    near = f"SELECT r, min(struct_pack(d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p, m)]), c := c)) AS b FROM v CROSS JOIN c{n - 1} GROUP BY r"
    sums = f"SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(p) AS x, unnest(range(64)) AS i FROM a{n} JOIN v USING (r)) GROUP BY c, i"
    mean = f"SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM ({sums}) GROUP BY c"
    return f"a{n} AS MATERIALIZED ({near}),\nc{n} AS MATERIALIZED (SELECT o.c, coalesce(t.m, o.m) AS m FROM c{n - 1} o LEFT JOIN ({mean}) t USING (c))"


CLUSTER_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS p
  FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), p) - 1 AS c, p AS m FROM v ORDER BY 1 LIMIT 16),
{", ".join(moved_sql(n) for n in (1, 2, 3, 4))},
z AS (SELECT vec_id, b.c AS c, b.d AS d FROM a4 JOIN v USING (r))
SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM z JOIN c3 USING (c)
"""


@query("op12_centroid_clusters", CLUSTER_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


@query("op11_quality_classifier")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = text_quality.score(docs, text_quality.fit(docs, C.table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality").alias("score"),
        F.col("is_good").cast("int").alias("predicted"),
    )
