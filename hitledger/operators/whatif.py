"""Known damage to an event table, to test a detector.

Chance is a hash of the row id and a seed, so the same rows are hit however the
table is partitioned or ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .split import micros, number_in_slices

c = F.col
CONVERSION_WORDS = ("conversion", "purchase", "purchase_success", "payment_success", "order_complete")


def chance(row_id, seed: int = 42, salt: str = "") -> Column:
    """A number in [0, 1) that depends on the row id, the seed and the salt only."""
    i = c(row_id) if isinstance(row_id, str) else row_id
    return F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(1 << 32)) / float(1 << 32)


def is_conversion_row(cols) -> Column:
    """A flagged conversion or an event that names one; checkout pages alone are none."""
    flag = X.lower0("is_conversion").isin("1", "true", "t", "yes", "y")
    text = F.concat_ws(" ", *[X.lower0(x) for x in ("evt", "event_type") if x in cols])
    return flag | X.has(text, *CONVERSION_WORDS)


def target_match(cols, platform="*", app_version="*", sdk_version="*", conversion_only=False, stages="", events="") -> Column:
    """Whether a hit belongs to the targeted segment."""
    out = X.token_match("app_platform", platform) & X.token_match("app_version", app_version) & X.token_match("sdk_version", sdk_version)
    conversion = is_conversion_row(cols)
    if conversion_only:
        out = out & conversion
    text = F.concat_ws(" ", *[X.lower0(x) for x in ("evt", "event_type", "page_type", "funnel_stage", "path", "url_norm", "url_raw", "url_full") if x in cols])
    words = lambda s: [w.strip().lower() for w in s.split(",") if w.strip() and w.strip() != "*"]
    if words(stages):
        out = out & X.has(text, *words(stages))
    if words(events):
        named = X.has(text, *words(events))
        out = out & ((conversion | named) if conversion_only else named)
    return out


def missing_rate(base=0.0, checkout=0.0, product=0.0, ios_safari=0.0) -> Column:
    """Loss rate of a hit: the highest of the tiers it belongs to."""
    p, page, stage, ua = X.lower0("path"), X.lower0("page_type"), X.lower0("funnel_stage"), X.lower0("ua")
    in_any = lambda w: X.has(p, w) | X.has(page, w) | X.has(stage, w)
    buying = reduce(lambda a, b: a | b, [in_any(w) for w in ("checkout", "payment", "order")])
    tier = F.when(buying, F.lit(max(base, checkout))).when(in_any("product"), F.lit(max(base, product))).otherwise(F.lit(float(base)))
    safari = X.has(ua, "iphone", "ipad", "ios") & ua.contains("safari") & ~ua.contains("chrome")
    rate = F.when(safari, F.greatest(tier, F.lit(float(ios_safari)))).otherwise(tier)
    return F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0))


def drop_rows(df: DataFrame, rate, row_id: str, seed: int = 42) -> DataFrame:
    """Rows left after losing each with its rate."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return df.where(chance(row_id, seed, "drop") >= r)


def duplicate_rows(df: DataFrame, rate, row_id: str, seed: int = 42, tag: str = "duplicate") -> DataFrame:
    """Some rows twice; both copies of a repeated row keep its id, the copy carries a group id."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    copies = F.when(chance(row_id, seed, "dup") < r, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = df.withColumn("copy_no", F.explode(copies))
    return out.withColumn("dup_group_id", F.when(c("copy_no") > 0, F.concat_ws("_", F.lit(tag), c(row_id).cast("string"))))


def volume_spike(df: DataFrame, factor: float, row_id: str, seed: int = 42, ts: str = "ts") -> DataFrame:
    """Each row ``factor`` times on average; a copy is one more millisecond late."""
    extra = max(factor, 1.0) - 1.0
    whole = int(extra)
    n = F.lit(whole) + F.when(chance(row_id, seed, "spike") < extra - whole, 1).otherwise(0)
    out = df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), n)))
    return out.withColumn(ts, c(ts) + F.make_dt_interval(secs=c("copy_no") / F.lit(1000.0)))


def delay_rows(df: DataFrame, ms: int, where: Column | None = None, ts: str = "ts", latency: str = "latency_ms") -> DataFrame:
    """Targeted rows later by ``ms``, in time and latency."""
    hit = F.lit(True) if where is None else where
    d = df.withColumn("_hit", hit)
    return d.withColumn(ts, F.when(c("_hit"), c(ts) + F.expr(f"INTERVAL {ms} MILLISECOND")).otherwise(c(ts))).withColumn(
        latency, F.when(c("_hit"), F.coalesce(c(latency), F.lit(0)) + ms).otherwise(c(latency))).drop("_hit")


def skew_time(df: DataFrame, seconds: int, rate: float, row_id: str, seed: int = 42, ts: str = "ts") -> DataFrame:
    """Some rows moved back or forth, never out of their day."""
    sign = F.when(chance(row_id, seed, "sign") < 0.5, -1).otherwise(1)
    moved = c(ts) + F.make_dt_interval(secs=sign * F.lit(float(seconds)))
    day = F.date_trunc("day", c(ts)).cast("timestamp_ntz")
    inside = F.greatest(day, F.least(moved, day + F.expr("INTERVAL 86399 SECONDS")))
    return df.withColumn(ts, F.when(chance(row_id, seed, "skew") < rate, inside).otherwise(c(ts)))


def reorder_blocks(df: DataFrame, n: int, row_id: str, keys=("profile_id", "dt"), ts: str = "ts") -> DataFrame:
    """Reverse the order of every block of ``n`` rows: arrival_no is the new position."""
    d = number_in_slices(df.withColumn("_us", micros(ts)), keys, ["_us", row_id], None, "_no")
    block = F.floor((c("_no") - 1) / n)
    size = d.groupBy(*keys).agg(F.count("*").alias("_total"))
    d = d.join(size, list(keys))
    last = F.least((block + 1) * n, c("_total"))
    return d.withColumn("arrival_no", block * n + 1 + last - c("_no")).withColumn("ordering_group_id", block).drop("_us", "_no", "_total")


def flip_conversion(df: DataFrame, keep: float, row_id: str, seed: int = 42) -> DataFrame:
    lost = (c("is_conversion") == 1) & (chance(row_id, seed, "conversion") > keep)
    return df.withColumn("is_conversion", F.when(lost, 0).otherwise(c("is_conversion")))


def corrupt_identity(df: DataFrame, rate: float, where: Column, row_id: str, seed: int = 42) -> DataFrame:
    """Targeted hits without their login, still visible by cookie."""
    hit = where & (chance(row_id, seed, "identity") < rate)
    d = df.withColumn("uid", F.when(hit, F.lit(None)).otherwise(c("uid")))
    return d.withColumn("kv_raw", F.when(hit, X.null_identity("uid", "kv_raw")[1]).otherwise(c("kv_raw"))) if "kv_raw" in df.columns else d


def collapse_url(df: DataFrame, source: str, target: str, rate: float, where: Column, row_id: str, seed: int = 42) -> DataFrame:
    hit = where & (chance(row_id, seed, "url") < rate)
    return df.withColumn("path", F.when(hit, X.rewrite_url("path", source, target)).otherwise(c("path")))


def inject_errors(df: DataFrame, error_rate: float, latency_rate: float, latency_ms: int, burst_rate: float, burst_minute: int, row_id: str, seed: int = 42, where: Column | None = None, ts: str = "ts") -> DataFrame:
    """Targeted hits fail with 503, turn slow, or fall into one minute of their day."""
    hit = F.lit(True) if where is None else where
    p = lambda salt, r: hit & (chance(row_id, seed, salt) < r)
    second = F.floor(chance(row_id, seed, "second") * 60)
    burst = F.date_trunc("day", c(ts)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(burst_minute), secs=second.cast("double"))
    d = df.withColumn("_e", p("error", error_rate)).withColumn("_l", p("latency", latency_rate)).withColumn("_b", p("burst", burst_rate))
    return d.withColumn("status", F.when(c("_e"), 503).otherwise(c("status"))).withColumn("latency_ms", F.when(c("_l"), latency_ms).otherwise(c("latency_ms"))).withColumn(
        ts, F.when(c("_b"), burst).otherwise(c(ts))).drop("_e", "_l", "_b")


def perturbation_trace(before: DataFrame, after: DataFrame, row_id: str, compare=("ts", "status", "path", "uid", "is_conversion"), keys=("profile_id",)) -> DataFrame:
    """What was done: rows lost and repeated, and rows changed per column."""
    b = before.select(*keys, row_id, *[c(x).alias(f"_b_{x}") for x in compare])
    # a row has few copies: reduced first, so a hot id stays one row
    a = after.groupBy(*keys, row_id).agg(F.count("*").alias("_n"), *[F.min(x).alias(f"_a_{x}") for x in compare])
    j = b.join(a, [*keys, row_id], "left").fillna(0, subset=["_n"])
    seen = c("_n") > 0
    return j.groupBy(*keys).agg(
        F.count("*").alias("source_rows"), F.count_if(~seen).alias("dropped_rows"), F.coalesce(F.sum(F.when(c("_n") > 1, c("_n") - 1)), F.lit(0)).alias("duplicate_rows"),
        *[F.count_if(seen & ~c(f"_b_{x}").eqNullSafe(c(f"_a_{x}"))).alias(f"{x}_changed_rows") for x in compare])


# What an intensity means.
INTENSITY = {
    "mild": dict(missing_rate=0.03, duplicate_rate=0.02, delay_ms=1500, shuffle_window=5, volume_multiplier=0.98, conversion_multiplier=0.90, timeout_multiplier=1.10),
    "medium": dict(missing_rate=0.08, duplicate_rate=0.05, delay_ms=5000, shuffle_window=10, volume_multiplier=0.92, conversion_multiplier=0.75, timeout_multiplier=1.50),
    "high": dict(missing_rate=0.15, duplicate_rate=0.10, delay_ms=15000, shuffle_window=20, volume_multiplier=0.80, conversion_multiplier=0.55, timeout_multiplier=2.00),
}
# Which settings a scenario kind takes from its intensity.
KINDS = {
    "weather_drop": ("missing_rate", "delay_ms", "volume_multiplier", "conversion_multiplier", "timeout_multiplier"),
    "campaign_spike": ("duplicate_rate",),
    "partial_missing": ("missing_rate", "volume_multiplier"),
    "duplicate": ("duplicate_rate",),
    "delay": ("delay_ms", "timeout_multiplier"),
    "ordering": ("shuffle_window",),
    "mixed": ("missing_rate", "duplicate_rate", "delay_ms", "shuffle_window", "volume_multiplier", "conversion_multiplier", "timeout_multiplier"),
}
NEUTRAL = dict(missing_rate=0.0, duplicate_rate=0.0, delay_ms=0, shuffle_window=0, volume_multiplier=1.0, conversion_multiplier=1.0, timeout_multiplier=1.0)
SPIKE = {"mild": (1.25, 1.05), "medium": (1.5, 1.10), "high": (2.0, 1.10)}


def scenario_timeline(registry: DataFrame) -> DataFrame:
    """Registered scenario runs as one row per day with their settings.

    ``registry`` has profile_id, scenario_name, intensity, dt_from and dt_to; a
    name may end in the domain it targets (``delay_auth``).
    """
    name, level = F.lower("scenario_name"), F.lower(F.coalesce("intensity", F.lit("medium")))
    level = F.when(level.isin(*INTENSITY), level).otherwise("medium")
    kind, domain = F.when(name.isin("weather_drop", "campaign_spike", "partial_missing"), name), F.lit(None).cast("string")
    for k in ("partial_missing", "duplicate", "delay", "ordering", "mixed"):
        kind = kind.when(name.startswith(f"{k}_"), k)
    kind = kind.otherwise("baseline")
    d = registry.select("*", kind.alias("mode"), level.alias("state_level")).withColumn("dt", F.explode(F.sequence("dt_from", "dt_to")))
    targeted = c("mode").isin("partial_missing", "duplicate", "delay", "ordering", "mixed") & (name != c("mode"))
    domain = F.when(targeted, F.substr(name, F.length("mode") + 2))
    out = []
    for setting, neutral in NEUTRAL.items():
        table = F.create_map(*[F.lit(x) for lv, s in INTENSITY.items() for x in (lv, s[setting])])
        users = [k for k, uses in KINDS.items() if setting in uses]
        value = F.when(c("mode").isin(*users), F.try_element_at(table, c("state_level")))
        if setting in ("volume_multiplier", "conversion_multiplier"):
            spike = F.create_map(*[F.lit(x) for lv, s in SPIKE.items() for x in (lv, s[0 if setting == "volume_multiplier" else 1])])
            value = F.when(c("mode") == "campaign_spike", F.try_element_at(spike, c("state_level"))).otherwise(value)
        if setting == "conversion_multiplier":
            value = F.when(c("mode") == "partial_missing", F.lit(1.0)).otherwise(value)
        out.append(F.coalesce(value, F.lit(neutral)).alias(setting))
    return d.select("profile_id", "dt", "scenario_name", "mode", "state_level", domain.alias("target_service_domain"), *out)
