"""Behavior, transaction and state reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N
from ..session import materialize
from .joins import ANY, key_text, match_nearest
from .quantiles import exact_quantiles

# Stages that anchor a match, and the state a transaction should reach.
ANCHOR_STAGES = ("checkout", "payment", "order_complete", "refund")
EXPECTED_STATES = {
    "order_created": "order_status_created",
    "payment_approved": "order_status_created",
    "refund_completed": "refund_status_completed",
}
PAYMENT_EVENTS = ("payment_approved", "payment_requested")


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _filled(df: DataFrame, name: str) -> Column:
    return F.nullif(F.trim(_optional(df, name).cast("string")), F.lit(""))


def with_duplicate_flag(df: DataFrame, ids) -> DataFrame:
    """Flag rows whose joined key occurs more than once."""
    keyed = df.withColumn("_dup", key_text(*[_filled(df, c) for c in ids]))
    repeated = keyed.groupBy("_dup").agg(F.count("*").alias("_n")).where("_n > 1").select("_dup", F.lit(1).alias("duplicate_flag"))
    return keyed.join(repeated, "_dup", "left").fillna(0, subset=["duplicate_flag"]).drop("_dup")


def _gap_ms(a: Column, b: Column) -> Column:
    return ((b - a) / 1000).cast("bigint")


def match_behavior_transaction(behavior: DataFrame, transactions: DataFrame, scope=("profile_id",)) -> DataFrame:
    """Each anchoring behavior row with its nearest transaction, plus unmatched transactions."""
    scope = list(scope)
    anchors = behavior.where(
        F.col("journey_stage").isin(*ANCHOR_STAGES) | _filled(behavior, "order_id").isNotNull() | _filled(behavior, "payment_id").isNotNull()
    )
    t = with_duplicate_flag(transactions, [*scope, "journey_id", "order_id", "payment_id", "transaction_event"])
    # read for the match and for the rest; the flag takes a join
    t = materialize(t.select(*scope, "journey_id", "order_id", "tx_id", "transaction_event", "event_us", "duplicate_flag"), "flagged")
    order = F.coalesce(F.concat(F.lit("="), _filled(anchors, "order_id")), F.lit(ANY))
    offered = F.concat(F.lit("="), _filled(t, "order_id"))
    base = [*scope, "journey_id"]
    best = match_nearest(
        anchors, t, key_text(*base, order), [key_text(*base, F.lit(ANY)), F.when(offered.isNotNull(), key_text(*base, offered))], "event_us", "event_us",
        F.struct(F.col("tx_id").alias("id"), F.col("transaction_event"), F.col("duplicate_flag")),
    )
    got = F.col("best").isNotNull()
    per_anchor = best.select(
        *scope, "journey_id", _optional(anchors, "order_id").alias("order_id"), "behavior_id",
        F.col("best.row.id").alias("tx_id"), F.col("journey_stage").alias("behavior_stage"),
        F.col("best.row.transaction_event").alias("transaction_event"),
        F.when(got, "matched").otherwise("behavior_only").alias("mapping_status"),
        F.when(got, 0).otherwise(1).alias("orphan_flag"),
        F.coalesce(F.col("best.row.duplicate_flag"), F.lit(0)).alias("duplicate_flag"),
        _gap_ms(F.col("event_us"), F.col("best.t")).alias("time_gap_ms"),
    )
    per_anchor = materialize(per_anchor, "anchors")  # read twice below
    used = per_anchor.where("tx_id IS NOT NULL").select(F.col("tx_id").alias("_used")).distinct()
    rest = t.join(used, t["tx_id"] == F.col("_used"), "left_anti").select(
        *scope, "journey_id", "order_id", "tx_id", "transaction_event", F.lit("transaction_only").alias("mapping_status"),
        F.lit(1).alias("orphan_flag"), "duplicate_flag",
    )
    return per_anchor.unionByName(rest, allowMissingColumns=True)


def match_transaction_state(transactions: DataFrame, states: DataFrame, scope=("profile_id",), expected: dict | None = None) -> DataFrame:
    """Each transaction with the nearest state it should have reached, plus orphan states.

    Transactions without an expectation may match any state; unmatched ones of
    these are not reported.
    """
    scope = list(scope)
    expected = EXPECTED_STATES if expected is None else expected
    table = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    want = F.try_element_at(table, F.coalesce(F.col("transaction_event"), F.lit("")))
    t = transactions.withColumn("expected_state", want)
    s = with_duplicate_flag(states, [*scope, "journey_id", "order_id", "payment_id", "delivery_id", "state_event"])
    # read for the match and for the rest; the flag takes a join
    s = materialize(s.select(*scope, "journey_id", "order_id", "state_id", "state_event", "event_us", "duplicate_flag"), "flagged")
    base = [*scope, "journey_id"]
    state = F.concat(F.lit("="), F.col("state_event"))
    best = match_nearest(
        t, s, key_text(*base, F.coalesce(F.concat(F.lit("="), F.col("expected_state")), F.lit(ANY))),
        [key_text(*base, F.lit(ANY)), F.when(state.isNotNull(), key_text(*base, state))], "event_us", "event_us",
        F.struct(F.col("state_id").alias("id"), F.col("state_event"), F.col("duplicate_flag")),
    )
    got = F.col("best").isNotNull()
    per_tx = best.where(got | F.col("expected_state").isNotNull()).select(
        *scope, "journey_id", "order_id", "tx_id", F.col("best.row.id").alias("state_id"), "transaction_event",
        F.col("best.row.state_event").alias("state_event"),
        F.when(got, "matched").otherwise("transaction_without_state").alias("mapping_status"),
        F.when(got, 0).otherwise(1).alias("orphan_flag"),
        F.coalesce(F.col("best.row.duplicate_flag"), F.lit(0)).alias("duplicate_flag"),
        F.when(got, "observed").otherwise("missing").alias("state_transition_flag"),
        _gap_ms(F.col("event_us"), F.col("best.t")).alias("time_gap_ms"),
    )
    per_tx = materialize(per_tx, "matched")  # read twice below
    used = per_tx.where("state_id IS NOT NULL").select(F.col("state_id").alias("_used")).distinct()
    rest = s.join(used, s["state_id"] == F.col("_used"), "left_anti").select(
        *scope, "journey_id", "order_id", "state_id", "state_event", F.lit("orphan_state").alias("mapping_status"),
        F.lit(1).alias("orphan_flag"), "duplicate_flag", F.lit("orphan").alias("state_transition_flag"),
    )
    return per_tx.unionByName(rest, allowMissingColumns=True)


def untracked_transactions(transactions: DataFrame, mapping: DataFrame, scope=("profile_id",)) -> DataFrame:
    """Transactions the state mapping is silent about (no expectation, no state), per scope."""
    seen = mapping.where("tx_id IS NOT NULL").select("tx_id").distinct()
    return transactions.join(seen, "tx_id", "left_anti").groupBy(*scope).agg(F.count("*").alias("untracked"))


def _mapping_counts(m: DataFrame, scope, prefix: str, statuses: dict[str, str]) -> DataFrame:
    return m.groupBy(*scope).agg(
        F.count("*").alias(f"{prefix}_total_count"),
        *[F.count_if(F.col("mapping_status") == s).alias(name) for s, name in statuses.items()],
        F.sum("duplicate_flag").alias(f"_{prefix}_dup"),
        F.avg(F.when(F.col("mapping_status") == "matched", F.col("time_gap_ms"))).cast("bigint").alias(f"avg_{prefix}_gap_ms"),
    )


def _p95(m: DataFrame, scope, name: str) -> DataFrame:
    return exact_quantiles(m.where("mapping_status = 'matched'"), scope, "time_gap_ms", {name: 0.95})


def reconciliation_measurement(behavior, transactions, states, btm, tsm, scope=("profile_id",)) -> DataFrame:
    """Counts, match rates, gaps and delays of the three logs per scope."""
    scope = list(scope)
    event, state = F.col("transaction_event"), F.col("state_event")
    coupon = F.nullif(_optional(behavior, "coupon_id"), F.lit("")).isNotNull()
    b = behavior.groupBy(*scope).agg(F.count("*").alias("behavior_event_count"), F.count_if(coupon).alias("_coupon_behavior"))
    t = transactions.groupBy(*scope).agg(
        F.count("*").alias("transaction_event_count"),
        F.count_if(event.isin(*PAYMENT_EVENTS)).alias("_payments"),
        F.count_if(event == "order_created").alias("_orders"),
        F.count_if(event == "refund_completed").alias("_refunds"),
        F.count_if(event == "coupon_applied").alias("_coupon_tx"),
        F.avg(F.when(event.isin(*PAYMENT_EVENTS), F.col("transaction_delay_ms"))).alias("_payment_delay"),
    )
    s = states.groupBy(*scope).agg(
        F.count("*").alias("state_event_count"),
        F.count_if(state == "refund_status_completed").alias("_refund_states"),
        F.avg(F.when(state.startswith("delivery_"), F.col("state_transition_delay_ms"))).alias("_delivery_delay"),
        F.avg(F.when(state.startswith("refund_"), F.col("state_transition_delay_ms"))).alias("_refund_delay"),
    )
    per_order = transactions.where(_filled(transactions, "order_id").isNotNull()).groupBy(*scope, "order_id").agg(F.count("*").alias("c"))
    orders = per_order.groupBy(*scope).agg(F.count_if(F.col("c") > 3).alias("duplicate_order_count"))
    per_pay = transactions.where(_filled(transactions, "payment_id").isNotNull()).groupBy(*scope, "payment_id", "transaction_event").agg(F.count("*").alias("c"))
    payments = per_pay.groupBy(*scope).agg(F.count_if(F.col("c") > 1).alias("duplicate_payment_count"))
    bt = _mapping_counts(btm, scope, "behavior_transaction", {
        "matched": "behavior_transaction_matched_count", "behavior_only": "behavior_only_count", "transaction_only": "transaction_only_count"})
    ts = _mapping_counts(tsm, scope, "transaction_state", {
        "matched": "transaction_state_matched_count", "orphan_state": "orphan_state_count", "transaction_without_state": "transaction_without_state_count"})
    out = b
    for part in (t, s, bt, ts, orders, payments):
        out = out.join(part, scope, "full_outer")
    counts = [f.name for f in out.schema.fields if f.name not in scope and f.dataType.typeName() == "long" and not f.name.startswith("avg_")]
    out = out.fillna(0, subset=counts)
    out = out.join(_p95(btm, scope, "p95_behavior_transaction_gap_ms"), scope, "left")
    out = out.join(_p95(tsm, scope, "p95_transaction_state_gap_ms"), scope, "left")
    c = F.col

    def gap(a, b, den):
        return F.round(F.abs(c(a) - c(b)) / den, 6)

    m = "behavior_transaction_matched_count"
    return out.select(
        *scope, "behavior_event_count", "transaction_event_count", "state_event_count",
        "behavior_transaction_total_count", m, "behavior_only_count", "transaction_only_count",
        N.ratio(m, "behavior_transaction_total_count", 6).alias("behavior_transaction_match_rate"),
        gap(m, "_orders", F.greatest(c(m), c("_orders"), F.lit(1))).alias("conversion_gap"),
        "transaction_state_total_count", "transaction_state_matched_count", "orphan_state_count", "transaction_without_state_count",
        N.ratio("transaction_state_matched_count", "transaction_state_total_count", 6).alias("transaction_state_match_rate"),
        gap("_payments", "_orders", F.greatest(c("_payments"), F.lit(1))).alias("payment_order_gap"),
        gap("_refunds", "_refund_states", F.greatest(c("_refunds"), F.lit(1))).alias("refund_transition_gap"),
        "avg_behavior_transaction_gap_ms", c("p95_behavior_transaction_gap_ms").cast("bigint").alias("p95_behavior_transaction_gap_ms"),
        "avg_transaction_state_gap_ms", c("p95_transaction_state_gap_ms").cast("bigint").alias("p95_transaction_state_gap_ms"),
        *[F.coalesce(c(f"_{d}").cast("bigint"), F.lit(0)).alias(n) for d, n in (
            ("payment_delay", "payment_processing_delay_ms"), ("delivery_delay", "delivery_state_delay_ms"), ("refund_delay", "refund_delay_ms"))],
        "duplicate_order_count", "duplicate_payment_count",
        gap("_coupon_behavior", "_coupon_tx", F.greatest(c("_coupon_behavior"), F.lit(1))).alias("coupon_reconciliation_gap"),
        (c("behavior_only_count") + c("transaction_only_count") + c("orphan_state_count") + c("transaction_without_state_count")
         + c("_behavior_transaction_dup") + c("_transaction_state_dup")).alias("propagation_distortion_count"),
    )
