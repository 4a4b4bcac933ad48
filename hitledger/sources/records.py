"""Transaction and state logs, event messages, and the tables results are written to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X
from ..operators.joins import key_text
from ..operators.split import number_in_slices

_S, _L, _M = "string", "bigint", "decimal(18,2)"
# Fields of the two logs.
TRANSACTION_FIELDS = {
    "event_time": _S, "journey_id": _S, "transaction_event": _S, "customer_id": _S, "product_id": _S, "cart_id": _S, "coupon_id": _S, "order_id": _S, "payment_id": _S, "delivery_id": _S,
    "amount": _M, "currency": _S, "source_system": _S, "behavior_anchor_stage": _S, "behavior_anchor_offset_sec": _L, "transaction_delay_ms": _L, "anomaly_flag": "boolean",
}
STATE_FIELDS = {
    "event_time": _S, "journey_id": _S, "state_event": _S, "customer_id": _S, "order_id": _S, "payment_id": _S, "delivery_id": _S, "coupon_id": _S, "order_amount": _M, "expected_amount": _M, "state_status": _S,
    "source_system": _S, "behavior_anchor_stage": _S, "behavior_anchor_offset_sec": _L, "state_transition_delay_ms": _L, "anomaly_flag": "boolean",
}


def iso_wall_clock(text: Column) -> Column:
    """ISO time as wall clock; a zone is dropped, not applied."""
    local = F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", ""), "T", " ")
    return local.try_cast("timestamp_ntz")


def parse_records(lines: DataFrame, fields: dict[str, str], line: str = "value", keep=()) -> DataFrame:
    """JSON lines as typed rows, with the original line as payload."""
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    d = lines.where(F.trim(line) != "").select(*keep, F.col(line).alias("payload_json"), F.from_json(F.col(line), schema).alias("r"))
    out = d.select(*keep, "r.*", "payload_json")
    out = out.withColumn("event_time", iso_wall_clock(F.col("event_time")))
    return out.withColumn("anomaly_flag", F.coalesce(F.col("anomaly_flag").cast("int"), F.lit(0)))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and line number; a file may be split over many tasks."""
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_pos"))
    # rows of one block are read in order by one task
    return number_in_slices(d, ["source_file_path"], ["_pos"], F.col("_block"), "source_row_number").drop("_block", "_pos")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(_numbered_lines(spark, path), TRANSACTION_FIELDS, keep=("source_file_path", "source_row_number"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(_numbered_lines(spark, path), STATE_FIELDS, keep=("source_file_path", "source_row_number"))


def to_transaction_events(raw: DataFrame) -> DataFrame:
    return raw.withColumn("transaction_type", F.col("transaction_event")).withColumn("duplicate_key", X.joined_key("journey_id", "order_id", "payment_id", "transaction_event"))


def to_state_events(raw: DataFrame) -> DataFrame:
    return raw.withColumn("state_entity", X.state_entity("state_event")).withColumn("duplicate_key", X.joined_key("journey_id", "order_id", "payment_id", "delivery_id", "state_event"))


# --- event messages --------------------------------------------------------------

MESSAGE_FIELDS = {
    "profile_id": _S, "canonical_event_id": _L, "raw_event_id": _L, "run_id": _S, "source_gen_run_id": _L, "dt": _S, "ts": _S, "producer_ts": _S, "event_name": _S, "semantic_event_name": _S, "event_type": _S, "service_domain": _S,
    "funnel_stage": _S, "is_conversion": _L, "uid": _S, "pcid": _S, "sid": _S, "device_type": _S, "page_type": _S, "status": _L, "status_code": _L, "latency_ms": _L, "bytes": _L, "path": _S, "query": _S, "url_norm": _S, "method": _S,
    "ip": _S, "ref": _S, "ua": _S, "kv_raw": _S, "evt": _S, "source_type": _S, "schema_version": _S, "scenario_name": _S, "anomaly_type": _S, "sequence_no": _L,
}


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages with the fallbacks of each field; works on streams and tables alike.

    topic, partition, offset and timestamp of the source are kept where it has them.
    """
    schema = ", ".join(f"{n} {t}" for n, t in MESSAGE_FIELDS.items())
    meta = {"topic": "stream_topic", "partition": "stream_partition", "offset": "stream_offset", "timestamp": "ingest_ts"}
    kept = [F.col(c).alias(n) for c, n in meta.items() if c in messages.columns]
    d = messages.select(*kept, F.from_json(F.col(value).cast("string"), schema).alias("m"))
    f = lambda n: F.nullif(F.col(f"m.{n}"), F.lit(""))
    n = lambda name: F.nullif(F.col(f"m.{name}"), F.lit(0))
    seen = F.coalesce(f("producer_ts"), f("ts"))
    name = F.coalesce(f("event_name"), f("semantic_event_name"), f("evt"), F.lit("unknown"))
    status = F.coalesce(n("status"), n("status_code"), F.lit(200))
    late = F.coalesce(F.col("m.latency_ms"), F.lit(0))
    replaced = {"dt", "ts", "producer_ts", "event_name", "semantic_event_name", "event_type", "service_domain", "funnel_stage", "is_conversion", "status", "status_code", "latency_ms", "bytes", "source_type"}
    return d.select(
        *[F.col(a) for a in meta.values() if a in d.columns], *[F.col(f"m.{x}").alias(x) for x in MESSAGE_FIELDS if x not in replaced],
        F.coalesce(f("dt").try_cast("date"), iso_wall_clock(seen).cast("date")).alias("dt"), iso_wall_clock(F.coalesce(f("ts"), f("producer_ts"))).alias("ts"), iso_wall_clock(seen).alias("producer_ts"),
        name.alias("event_name"), F.coalesce(f("semantic_event_name"), f("event_name"), f("evt"), F.lit("unknown")).alias("semantic_event_name"), F.coalesce(f("event_type"), f("event_name")).alias("event_type"),
        F.coalesce(f("service_domain"), F.lit("other")).alias("service_domain"), F.coalesce(f("funnel_stage"), F.lit("browse")).alias("funnel_stage"), F.coalesce("m.is_conversion", F.lit(0)).alias("is_conversion"),
        status.alias("status"), late.alias("latency_ms"), late.alias("event_delay_ms"), F.coalesce("m.bytes", F.lit(0)).alias("bytes"), F.coalesce(f("source_type"), F.lit("canonical_events")).alias("source_type"),
    )


def read_event_stream(spark: SparkSession, fmt: str, options: dict, path: str | None = None) -> DataFrame:
    """Event messages from a topic (``kafka``) or from folders of JSON lines (``text``)."""
    reader = spark.readStream.format(fmt).options(**options)
    return parse_messages(reader.load(path) if path else reader.load())


def to_messages(events: DataFrame, key: str = "canonical_event_id") -> DataFrame:
    """Rows as keyed JSON messages with the defaults a consumer expects."""
    col = lambda n: F.col(n) if n in events.columns else F.lit(None).cast("string")
    at = next(c for c in ("event_time", "ts", "producer_ts") if c in events.columns)
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    num = lambda *n: F.coalesce(*[F.nullif(F.col(x).cast("bigint"), F.lit(0)) for x in n if x in events.columns], F.lit(0))
    status = F.coalesce(*[F.nullif(F.col(x).cast("bigint"), F.lit(0)) for x in ("status_code", "status") if x in events.columns], F.lit(200))
    fields = {
        "profile_id": col("profile_id"), "canonical_event_id": F.col(key), "raw_event_id": F.coalesce(F.col("raw_event_id"), F.col(key)) if "raw_event_id" in events.columns else F.col(key),
        "dt": F.date_format(at, "yyyy-MM-dd"), "ts": iso, "producer_ts": iso, "event_name": col("semantic_event"), "semantic_event_name": col("semantic_event"), "event_type": F.coalesce(col("event_type"), col("semantic_event")),
        "service_domain": F.coalesce(F.nullif(col("service_domain"), F.lit("")), F.lit("other")), "funnel_stage": F.coalesce(F.nullif(col("funnel_stage"), F.lit("")), F.lit("browse")), "is_conversion": num("is_conversion"),
        "uid": col("uid"), "pcid": col("pcid"), "sid": F.coalesce(col("session_id"), col("sid")), "status": status, "status_code": status, "latency_ms": num("latency_ms"), "path": col("path"), "evt": F.coalesce(col("evt"), col("event_type")),
    }
    return events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))


def write_event_stream(events: DataFrame, fmt: str, options: dict, path: str | None = None, key: str = "canonical_event_id"):
    """Write keyed messages, in time order within a partition; a stream returns its query."""
    at = next(c for c in ("event_time", "ts", "producer_ts") if c in events.columns)
    if events.isStreaming:
        writer = to_messages(events, key).writeStream.format(fmt).options(**options)
        return writer.start(path) if path else writer.start()
    out = to_messages(events.sortWithinPartitions(at, key), key)
    writer = (out if fmt == "kafka" else out.select("value")).write.format(fmt).options(**options)
    return writer.save(path) if path else writer.save()


# --- tables -----------------------------------------------------------------------


def overwrite_scope(df: DataFrame, path: str, keys) -> None:
    """Replace the partitions ``df`` touches and no others; a rerun changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def upsert(base: DataFrame, delta: DataFrame, keys, version: str | None = None) -> DataFrame:
    """Rows of ``base`` with those of ``delta`` put in by key; the highest version wins, else the delta."""
    both = base.withColumn("_from", F.lit(0)).unionByName(delta.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_from")]
    order = F.struct(*([F.col(version)] if version else []), "_from")
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def _bucket(keys, buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> tuple[int, dict[int, int], set[str]]:
    """Newest version of a keyed table, the version of each bucket's folder, and the deltas that are in it."""
    rows = spark.read.schema("n int, bucket int, version int, delta string").parquet(f"{path}/versions/*")
    deltas = {r["delta"] for r in rows.select("delta").distinct().collect()}
    last = rows.groupBy("bucket").agg(F.max_by(F.struct("n", "version"), "n").alias("r")).select("bucket", "r.*").collect()
    return max(r["n"] for r in last), {r["bucket"]: r["version"] for r in last if r["bucket"] >= 0}, deltas


def _write_version(df: DataFrame, path: str, keys, buckets: int, n: int, delta: str) -> None:
    """The buckets of ``df`` in a folder of their own, then the list that makes them count."""
    spark = df.sparkSession
    out = df.withColumn("bucket", _bucket(keys, buckets))
    # four files a bucket, so that none is one task's work
    out = out.repartition("bucket", F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(4)))
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{n}")
    # a line of bucket -1 stands for the version itself
    made = [r[0] for r in out.select("bucket").distinct().collect()]
    listed = spark.createDataFrame([(n, b, n, delta) for b in [-1, *sorted(made)]], "n int, bucket int, version int, delta string")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{n}")


def write_keyed(df: DataFrame, path: str, keys, buckets: int = 64) -> None:
    """A table of one row per key, in buckets of the key's hash, that ``upsert_keyed`` can change."""
    _write_version(df, path, keys, buckets, 0, "")


def read_keyed(spark: SparkSession, path: str, schema, only=None) -> DataFrame:
    """The newest folder of each bucket (of those in ``only``)."""
    _, folders, _ = _versions(spark, path)
    paths = [f"{path}/data/{v}/bucket={b}" for b, v in sorted(folders.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_keyed(path: str, delta: DataFrame, keys, delta_id: str, schema, version: str | None = None, buckets: int = 64) -> list[int]:
    """Put ``delta`` into a keyed table and rewrite only the buckets it touches; gives their numbers.

    A delta whose id the table has is not put in again. The rewritten buckets go
    to a folder of the new version and count once the version is listed, so a
    failed run leaves the table as it was and a repeated one replaces its own
    files. Readers of the version before keep their files.
    """
    spark = delta.sparkSession
    n, _, deltas = _versions(spark, path)
    if delta_id in deltas:
        return []
    touched = sorted(r[0] for r in delta.select(_bucket(keys, buckets)).distinct().collect())
    merged = upsert(read_keyed(spark, path, schema, set(touched)), delta, keys, version)
    _write_version(merged.select(*[f.name for f in spark.createDataFrame([], schema).schema]), path, keys, buckets, n + 1, delta_id)
    return touched


def latest_row(df: DataFrame, keys, order) -> DataFrame:
    """The newest row per key, by the listed columns, all descending."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


DEFAULTS = {"rate": 0.0, "score": 0.0, "ratio": 0.0, "count": 0, "level": "unknown", "json": "{}"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``; missing ones and nulls get the default of their kind."""
    out = []
    for f in schema.fields:
        kind = f.name.rsplit("_", 1)[-1]
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(value, F.lit(DEFAULTS[kind]).cast(f.dataType)) if kind in DEFAULTS else value).alias(f.name))
    return df.select(*out)


def first_col(df: DataFrame, candidates) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def export_csv(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def scope_filter(df: DataFrame, **scope) -> DataFrame:
    """Only the scope predicates whose column exists; None asks for nothing."""
    tests = [F.col(k) == F.lit(v) for k, v in scope.items() if v is not None and k in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def date_range(df: DataFrame, first: str, last: str, col: str = "dt", half_open: bool = False) -> DataFrame:
    kind = dict(df.dtypes)[col]
    lo, hi = F.lit(first).cast(kind), F.lit(last).cast(kind)
    return df.where((F.col(col) >= lo) & (F.col(col) < hi)) if half_open else df.where(F.col(col).between(lo, hi))


def scenario_or_blank(df: DataFrame, name: str, col: str = "scenario_name") -> DataFrame:
    return df.where(F.coalesce(F.col(col), F.lit("")).isin(name, ""))


def marker_filter(df: DataFrame, cols, patterns) -> DataFrame:
    """Rows with any marker in any of the text columns that exist."""
    tests = [F.coalesce(F.col(c), F.lit("")).contains(p) for c in cols if c in df.columns for p in patterns]
    return df.where(reduce(lambda a, b: a | b, tests))


ATTEMPTS = {"strict": (True, True, True), "any_run": (True, False, True), "any_source": (False, True, True), "scenario_only": (False, False, True), "any_scenario": (True, True, False), "day_only": (False, False, False)}


def progressive_count(df: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows of each asked scope, loosened step by step until some are found.

    ``scopes`` has profile_id, dt, source_gen_run_id, run_id and scenario_name
    (its rows are one count each; null equals null but for profile and day).
    The table is counted once by its own scope; both sides then give one key per
    step, and the steps are looked up by equality.
    """
    parts = ("source_gen_run_id", "run_id", "scenario_name")
    counts = df.groupBy("profile_id", "dt", *parts).agg(F.count("*").alias("n"))
    keys = F.array(*[F.struct(F.lit(k).alias("_step"), key_text(*[p for p, n in zip(parts, need) if n]).alias("_key")) for k, need in enumerate(ATTEMPTS.values())])
    on = ["profile_id", "dt", "_step", "_key"]
    have = counts.select("profile_id", "dt", "n", F.inline(keys)).groupBy(*on).agg(F.sum("n").alias("n"))
    found = scopes.distinct().select("*", F.inline(keys)).join(have, on, "left")
    best = F.min_by(F.struct("_step", "n"), F.when(F.col("n") > 0, F.col("_step")))
    out = found.groupBy(*scopes.columns).agg(best.alias("_best"))
    names = F.array(*[F.lit(a) for a in ATTEMPTS])
    level = F.when(F.col("_best").isNotNull(), F.element_at(names, F.col("_best._step") + 1)).otherwise("none")
    return out.select(*scopes.columns, F.coalesce("_best.n", F.lit(0)).alias("row_count"), level.alias("matched_scope"))
