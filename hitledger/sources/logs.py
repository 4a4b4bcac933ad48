"""Access logs: text lines to typed hits, raw events and canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X

# The line format, ``%h - - [%t] "request" status bytes "ref" "agent" "k=v; k=v"``.
LINE = (
    r'^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) (\S+) ([^"]+)" (\d{3}) (\d+|-)\s+"([^"]*)"\s+"([^"]*)"\s+"([^"]*)"\s*$'
)
LOOSE_LINE = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+HTTP/[^"]+"\s+(\d{3})\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"(?:\s+"(.*)")?$'
COOKIE_COLUMNS = (
    "schema_version scenario_id scenario_name source_layer anomaly_type drift affected run_id drop_probability latency_shift_ms "
    "volume_multiplier schema_flag identity_flag reconciliation_flag journey_id order_id payment_id app_platform app_version sdk_version"
).split()


# stands between the fields of a matched line; log writers escape control characters
MARK = "\u0001"


def _fields(text: Column, pattern: str, n: int) -> Column:
    """All groups of a line from one match; a line that does not match stays one field."""
    return F.split(F.regexp_replace(text, pattern, MARK.join(f"${i + 1}" for i in range(n))), MARK)


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """A column that is computed once a row: filters and projections above a generator are not merged into it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_access_log(lines: DataFrame, line: str = "line", keep=()) -> tuple[DataFrame, DataFrame]:
    """Typed hits of well-formed lines, and the lines that could not be read.

    Blank lines belong to neither. The tail is parsed once per line.
    """
    text = F.trim(F.col(line))
    filled = lines.where(text != "")
    names = ("ip", "_ts", "method", "url_raw", "protocol", "status", "bytes", "_ref", "ua", "kv_raw")
    fields = _fields(text, LINE, len(names))
    good = (F.size(fields) == len(names)) & X.apache_ts(fields[1]).isNotNull()
    d = _once(filled.select(*keep, line), fields, "_f").where(F.size("_f") == len(names))
    d = _once(d, X.apache_ts(F.col("_f")[1]), "ts").where("ts IS NOT NULL")
    d = d.select(*keep, "ts", *[F.col("_f")[i].alias(n) for i, n in enumerate(names)])
    d = _once(d, X.parse_kv("kv_raw"), "kv")
    kv = lambda k: F.try_element_at("kv", F.lit(k))
    path, query = X.split_path_query("url_raw")
    d = d.withColumn("path", path).withColumn("query", query)
    page = X.page_type("path", kv("page_type"))
    hits = d.select(
        *keep, F.to_date("ts").alias("dt"), "ts", "ip", "method", "protocol", "url_raw", "path", "query", F.col("status").cast("int").alias("status"),
        F.col("bytes").try_cast("bigint").alias("bytes"), X.contract_cast("latency_shift_ms", kv("latency_ms")).alias("latency_ms"), F.nullif("_ref", F.lit("-")).alias("ref"), X.ref_host("_ref").alias("ref_host"),
        "ua", "kv_raw", *[kv(k).alias(k) for k in ("uid", "pcid", "sid", "evt", "product_type", "cc")], X.device_type("ua", kv("device")).alias("device_type"),
        X.event_type("path", kv("evt"), kv("event_type")).alias("event_type"), page.alias("page_type"), X.service_domain("path", kv("domain")).alias("service_domain"),
        X.funnel_stage("path", page, kv("funnel_stage")).alias("funnel_stage"), X.is_conversion("path", kv("evt"), kv("event_type")).alias("is_conversion"),
        F.coalesce(X.kv_value(F.col("kv"), "al"), kv("accept_lang")).alias("accept_lang"), *[X.contract_cast(k, kv(k)).alias("run_id_cookie" if k == "run_id" else k) for k in COOKIE_COLUMNS],
    )
    return hits, filled.where(~good)


def read_access_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_access_log(spark.read.text(path).withColumnRenamed("value", "line"))


DEDUP = ("dt", "ts", "ip", "method", "url_raw", "status", "uid", "pcid", "sid")


def parse_access_log_range(lines: DataFrame, base_url: str, first: str, last: str, dedup: bool = False, line: str = "line", keep=()) -> DataFrame:
    """Looser variant: optional tail, URLs joined to a base, a date range, exact repeats dropped on request."""
    text = F.col(line)
    names = ("ip", "_ts", "method", "url_raw", "_status", "_bytes", "ref", "ua", "kv_raw")
    d = _once(lines.select(*keep, line), _fields(text, LOOSE_LINE, len(names)), "_f").where(F.size("_f") == len(names))
    d = _once(d, X.apache_ts(F.col("_f")[1]), "ts")
    d = d.select(*keep, "ts", *[F.col("_f")[i].alias(n) for i, n in enumerate(names)])
    d = d.withColumn("dt", F.to_date("ts")).where(F.col("dt").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    url = X.resolve_url(base_url, "url_raw")
    d = d.select("*", *[c.alias(n) for n, c in url.items()])
    one = lambda *keys: F.coalesce(*[X.extract_kv("kv_raw", k, bare=True) for k in keys])
    p = F.lower("path")
    evt = F.when(p.contains("/submit"), "submit").when(X.has(p, "/success", "/complete"), "success").otherwise("view")
    page = (
        F.when(p.contains("/apply"), "apply").when(p.contains("/submit"), "submit").when(X.has(p, "/success", "/complete"), "success")
        .when(X.has(p, "/detail", "/view"), "detail").when(p.contains("/list"), "list").when(p != "", "page")
    )
    out = d.select(
        *keep, "dt", "ts", "ip", "method", "url_raw", "url_full", "url_norm", "host", "path", "query", F.col("_status").cast("int").alias("status"),
        F.when(F.col("_bytes") == "-", 0).otherwise(F.col("_bytes").try_cast("bigint")).alias("bytes"), one("latency_ms").alias("latency_ms"), "ref", F.coalesce(X.url_host("ref"), F.lit("")).alias("ref_host"),
        "ua", "kv_raw", one("uid", "nth_uid").alias("uid"), one("pcid", "nth_pcid").alias("pcid"), one("sid", "nth_sid").alias("sid"), X.device_type("ua", tablet_first=False).alias("device_type"),
        F.coalesce(one("evt"), evt).alias("evt"), one("accept_lang").alias("accept_lang"), one("cc").alias("cc"), F.coalesce(one("page_type"), page).alias("page_type"),
    )
    return out.dropDuplicates(list(DEDUP)) if dedup else out


def read_access_log_range(spark: SparkSession, path: str, base_url: str, first: str, last: str, dedup: bool = False) -> DataFrame:
    return parse_access_log_range(spark.read.text(path).withColumnRenamed("value", "line"), base_url, first, last, dedup)


def _hash_files(batches):
    """Streaming hash of files: a chunk at a time, so a file of any size fits."""
    import hashlib

    import pandas as pd
    from pyarrow import fs

    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            system, name = fs.FileSystem.from_uri(path)
            digest, lines, last = hashlib.sha256(), 0, b"\n"
            with system.open_input_stream(name) as stream:
                while chunk := stream.read(1 << 20):
                    digest.update(chunk)
                    lines += chunk.count(b"\n")
                    last = chunk[-1:]
            # an unterminated last line counts too
            rows.append((path, path.rsplit("/", 1)[-1], digest.hexdigest(), lines + (last != b"\n")))
        yield pd.DataFrame(rows, columns=["file_path", "file_name", "checksum", "record_count"])


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, sha256 and line count of each file; a file is one unit of work, read in chunks."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"))
    spread = files.select("path").repartition("path")
    hashed = spread.mapInPandas(_hash_files, "file_path string, file_name string, checksum string, record_count long")
    return hashed.join(files, F.col("file_path") == F.col("path")).drop("path").withColumn("collected_at", F.current_timestamp())


def to_raw_events(collected: DataFrame, row_id: str, lineage: dict) -> DataFrame:
    """Collected hits as raw events; lineage ids are constants of the load."""
    name = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("event_type", "evt", "page_type") if c in collected.columns], F.lit("view"))
    return collected.select(
        F.col(row_id).alias("source_row_id"), *[c for c in collected.columns if c not in (row_id, *lineage)], F.lit("wc").alias("source_type"), F.col("dt").alias("log_date"), F.col("ts").alias("event_time"),
        F.col("status").alias("status_code"), name.alias("event_name"), *[F.lit(v).alias(k) for k, v in lineage.items()],
    )


def to_canonical(raw: DataFrame, run_id: int) -> DataFrame:
    """Raw events under their canonical names."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in raw.columns])
    channel = F.col("cc") if "cc" in raw.columns else (F.col("channel") if "channel" in raw.columns else F.lit(None).cast("string"))
    return raw.select(
        F.lit(run_id).alias("run_id"), F.col("source_row_id").alias("raw_event_id"), "profile_id", F.col("dt").alias("target_date"), F.col("ts").alias("event_time"), "service_domain",
        F.coalesce(pick("event_type", "event_name"), F.lit("view")).alias("event_type"), "uid", "pcid", F.col("sid").alias("session_id"), "device_type", "page_type", "funnel_stage", channel.alias("channel"),
        pick("status_code", "status").try_cast("int").alias("status_code"), "latency_ms", "is_conversion",
    )


def to_behavior_events(canonical: DataFrame, kv_raw: str = "kv_raw") -> DataFrame:
    """Canonical events of a journey with the commerce ids of their tail."""
    d = canonical.withColumn("kv", X.parse_kv(kv_raw))
    ids = ("journey_id", "product_id", "cart_id", "coupon_id", "order_id", "payment_id", "delivery_id", "customer_segment")
    stage = F.coalesce(X.kv_value(F.col("kv"), "journey_stage"), F.col("funnel_stage"))
    out = d.select("*", *[X.kv_value(F.col("kv"), i).alias(i) for i in ids if i not in canonical.columns], stage.alias("journey_stage"))
    return out.where("journey_id IS NOT NULL").drop("kv")
