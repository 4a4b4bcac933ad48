"""Nearest matches of behavior, transaction and state, and their measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J, reconcile as R
from ..session import materialize
from .fixtures import RELATIONS
from .registry import query

RELATIONS["transactions_flagged"] = """SELECT *, CASE WHEN count(*) OVER (PARTITION BY profile_id, journey_id, order_id, payment_id, transaction_event) > 1 THEN 1 ELSE 0 END AS duplicate_flag FROM transaction_events"""
RELATIONS["states_flagged"] = """SELECT *, CASE WHEN count(*) OVER (PARTITION BY profile_id, journey_id, order_id, state_event) > 1 THEN 1 ELSE 0 END AS duplicate_flag FROM state_events"""
RELATIONS["bt_matched"] = """SELECT * FROM (
  SELECT b.profile_id, b.journey_id, b.order_id, b.behavior_id, t.tx_id, b.journey_stage AS behavior_stage, t.transaction_event,
    CASE WHEN t.tx_id IS NULL THEN 'behavior_only' ELSE 'matched' END AS mapping_status, CASE WHEN t.tx_id IS NULL THEN 1 ELSE 0 END AS orphan_flag,
    coalesce(t.duplicate_flag, 0) AS duplicate_flag, CAST(trunc((t.event_us - b.event_us) / 1000.0) AS BIGINT) AS time_gap_ms,
    row_number() OVER (PARTITION BY b.behavior_id ORDER BY abs(t.event_us - b.event_us), t.tx_id) AS rn
  FROM behavior_events b LEFT JOIN transactions_flagged t ON b.profile_id = t.profile_id AND b.journey_id = t.journey_id AND (b.order_id IS NULL OR b.order_id = t.order_id)
  WHERE b.journey_stage IN ('checkout', 'payment', 'order_complete', 'refund') OR b.order_id IS NOT NULL) x WHERE rn = 1"""
RELATIONS["bt_mapping"] = """SELECT profile_id, journey_id, order_id, behavior_id, tx_id, behavior_stage, transaction_event, mapping_status, orphan_flag, duplicate_flag, time_gap_ms FROM bt_matched
UNION ALL SELECT profile_id, journey_id, order_id, NULL, tx_id, NULL, transaction_event, 'transaction_only', 1, duplicate_flag, NULL
FROM transactions_flagged WHERE tx_id NOT IN (SELECT tx_id FROM bt_matched WHERE tx_id IS NOT NULL)"""
RELATIONS["tx_expected"] = """SELECT *, CASE transaction_event WHEN 'order_created' THEN 'order_status_created' WHEN 'payment_approved' THEN 'order_status_created'
  WHEN 'refund_completed' THEN 'refund_status_completed' END AS expected FROM transaction_events"""
RELATIONS["ts_matched"] = """SELECT * FROM (
  SELECT t.profile_id, t.journey_id, t.order_id, t.tx_id, s.state_id, t.transaction_event, s.state_event, t.expected,
    CASE WHEN s.state_id IS NULL THEN 'transaction_without_state' ELSE 'matched' END AS mapping_status, CASE WHEN s.state_id IS NULL THEN 1 ELSE 0 END AS orphan_flag,
    coalesce(s.duplicate_flag, 0) AS duplicate_flag, CASE WHEN s.state_id IS NULL THEN 'missing' ELSE 'observed' END AS state_transition_flag,
    CAST(trunc((s.event_us - t.event_us) / 1000.0) AS BIGINT) AS time_gap_ms,
    row_number() OVER (PARTITION BY t.tx_id ORDER BY abs(s.event_us - t.event_us), s.state_id) AS rn
  FROM tx_expected t LEFT JOIN states_flagged s ON t.profile_id = s.profile_id AND t.journey_id = s.journey_id AND (t.expected IS NULL OR t.expected = s.state_event)) x WHERE rn = 1"""
RELATIONS["ts_mapping"] = """SELECT profile_id, journey_id, order_id, tx_id, state_id, transaction_event, state_event, mapping_status, orphan_flag, duplicate_flag, state_transition_flag, time_gap_ms
FROM ts_matched WHERE state_id IS NOT NULL OR expected IS NOT NULL
UNION ALL SELECT profile_id, journey_id, order_id, NULL, state_id, NULL, state_event, 'orphan_state', 1, duplicate_flag, 'orphan', NULL
FROM states_flagged WHERE state_id NOT IN (SELECT state_id FROM ts_matched WHERE state_id IS NOT NULL)"""


def bt(i):
    return R.match_behavior_transaction(i.behavior_events, i.transaction_events)


def ts(i, states=None):
    # states are derived by a join here; a deployment reads them as a table
    return R.match_transaction_state(i.transaction_events, materialize(i.state_events, "states") if states is None else states)


@query("match_behavior_transaction", "J01", "profile_id journey_id:i order_id:i behavior_id:i tx_id:i behavior_stage transaction_event mapping_status orphan_flag:i duplicate_flag:i time_gap_ms:i",
       "SELECT * FROM bt_mapping")
def match_behavior_transaction(i):
    return bt(i)


@query("match_transaction_state", "J02", "profile_id journey_id:i order_id:i tx_id:i state_id:i transaction_event state_event mapping_status orphan_flag:i duplicate_flag:i state_transition_flag time_gap_ms:i",
       "SELECT * FROM ts_mapping")
def match_transaction_state(i):
    return ts(i)


@query("untracked_transactions", "J02", "profile_id untracked:i",
       "SELECT profile_id, count(*) AS untracked FROM transaction_events WHERE tx_id NOT IN (SELECT tx_id FROM ts_mapping WHERE tx_id IS NOT NULL) GROUP BY ALL")
def untracked_transactions(i):
    return R.untracked_transactions(i.transaction_events, ts(i))


@query("positional_pair", "J03", "profile_id pair_no:i behavior_id:i tx_id:i match_score:d",
       """SELECT profile_id, pair_no, behavior_id, tx_id, 1.0 AS match_score FROM
  (SELECT profile_id, behavior_id, row_number() OVER (PARTITION BY profile_id ORDER BY event_us, behavior_id) AS pair_no FROM behavior_events) b JOIN
  (SELECT profile_id, tx_id, row_number() OVER (PARTITION BY profile_id ORDER BY event_us, tx_id) AS pair_no FROM transaction_events) t USING (profile_id, pair_no)""")
def positional_pair(i):
    b = i.behavior_events.select("profile_id", "behavior_id", "event_us")
    t = i.transaction_events.select("profile_id", "tx_id", F.col("event_us").alias("tx_us"))
    return J.positional_pair(b, t, ["profile_id"], ["event_us", "behavior_id"], ["tx_us", "tx_id"])


def status_counts(rel: str, prefix: str, statuses) -> str:
    picks = ", ".join(f"count(*) FILTER (mapping_status = '{s}') AS {n}" for s, n in statuses)
    return f"""SELECT count(*) AS {prefix}_total_count, {picks}, CAST(sum(duplicate_flag) AS BIGINT) AS {prefix}_dup,
  CAST(trunc(avg(time_gap_ms) FILTER (mapping_status = 'matched')) AS BIGINT) AS avg_{prefix}_gap_ms,
  quantile_disc(time_gap_ms, 0.95) FILTER (mapping_status = 'matched') AS p95_{prefix}_gap_ms FROM {rel}"""


RECON_COLS = """profile_id behavior_event_count:i transaction_event_count:i state_event_count:i behavior_transaction_total_count:i behavior_transaction_matched_count:i
behavior_only_count:i transaction_only_count:i behavior_transaction_match_rate:d conversion_gap:d transaction_state_total_count:i transaction_state_matched_count:i
orphan_state_count:i transaction_without_state_count:i transaction_state_match_rate:d payment_order_gap:d refund_transition_gap:d avg_behavior_transaction_gap_ms:i
p95_behavior_transaction_gap_ms:i avg_transaction_state_gap_ms:i p95_transaction_state_gap_ms:i payment_processing_delay_ms:i delivery_state_delay_ms:i refund_delay_ms:i
duplicate_order_count:i duplicate_payment_count:i coupon_reconciliation_gap:d propagation_distortion_count:i"""
RELATIONS["reconciliation_day"] = f"""SELECT 'p0' AS profile_id, *, round(behavior_transaction_matched_count / behavior_transaction_total_count, 6) AS behavior_transaction_match_rate,
  round(abs(behavior_transaction_matched_count - orders_made) / greatest(behavior_transaction_matched_count, orders_made, 1), 6) AS conversion_gap,
  round(transaction_state_matched_count / transaction_state_total_count, 6) AS transaction_state_match_rate,
  round(abs(payments - orders_made) / greatest(payments, 1), 6) AS payment_order_gap, round(abs(refunds - refund_states) / greatest(refunds, 1), 6) AS refund_transition_gap,
  round(abs(coupon_behavior - coupon_tx) / greatest(coupon_behavior, 1), 6) AS coupon_reconciliation_gap,
  behavior_only_count + transaction_only_count + orphan_state_count + transaction_without_state_count + behavior_transaction_dup + transaction_state_dup AS propagation_distortion_count
FROM (SELECT count(*) AS behavior_event_count, count(coupon_id) AS coupon_behavior FROM behavior_events) b,
  (SELECT count(*) AS transaction_event_count, count(*) FILTER (transaction_event = 'payment_approved') AS payments, count(*) FILTER (transaction_event = 'order_created') AS orders_made,
    count(*) FILTER (transaction_event = 'refund_completed') AS refunds, count(*) FILTER (transaction_event = 'coupon_applied') AS coupon_tx,
    CAST(trunc(avg(transaction_delay_ms) FILTER (transaction_event = 'payment_approved')) AS BIGINT) AS payment_processing_delay_ms FROM transaction_events) t,
  (SELECT count(*) AS state_event_count, count(*) FILTER (state_event = 'refund_status_completed') AS refund_states,
    CAST(trunc(avg(state_transition_delay_ms) FILTER (state_event LIKE 'delivery%')) AS BIGINT) AS delivery_state_delay_ms,
    CAST(trunc(avg(state_transition_delay_ms) FILTER (state_event LIKE 'refund%')) AS BIGINT) AS refund_delay_ms FROM state_events) s,
  ({status_counts('bt_mapping', 'behavior_transaction', [('matched', 'behavior_transaction_matched_count'), ('behavior_only', 'behavior_only_count'), ('transaction_only', 'transaction_only_count')])}) bm,
  ({status_counts('ts_mapping', 'transaction_state', [('matched', 'transaction_state_matched_count'), ('orphan_state', 'orphan_state_count'), ('transaction_without_state', 'transaction_without_state_count')])}) tm,
  (SELECT count(*) FILTER (c > 3) AS duplicate_order_count FROM (SELECT count(*) AS c FROM transaction_events GROUP BY order_id) o) dord,
  (SELECT count(*) FILTER (c > 1) AS duplicate_payment_count FROM (SELECT count(*) AS c FROM transaction_events WHERE payment_id IS NOT NULL GROUP BY payment_id, transaction_event) p) dpay"""


@query("reconciliation_measurement", "A11", RECON_COLS, "SELECT * FROM reconciliation_day")
def reconciliation_measurement(i):
    # mappings are written once; counts and quantiles read them
    states = materialize(i.state_events, "states")
    return R.reconciliation_measurement(i.behavior_events, i.transaction_events, states, materialize(bt(i), "bt"), materialize(ts(i, states), "ts"))


# the same within profile and day, with as many profiles as the journeys give
SCOPED = "SELECT * EXCLUDE (profile_id), concat('p', CAST(journey_id % 7 AS VARCHAR)) AS profile_id, CAST(make_timestamp(event_us) AS DATE) AS dt FROM {0}"
_CHANGES = [("b.profile_id = t.profile_id", "b.profile_id = t.profile_id AND b.dt = t.dt"), ("t.profile_id = s.profile_id", "t.profile_id = s.profile_id AND t.dt = s.dt"), ("PARTITION BY profile_id, journey_id", "PARTITION BY profile_id, dt, journey_id"),
            ("SELECT b.profile_id,", "SELECT b.profile_id, b.dt,"), ("SELECT t.profile_id,", "SELECT t.profile_id, t.dt,"), ("SELECT profile_id, journey_id", "SELECT profile_id, dt, journey_id")]


def scoped_sql(name: str) -> str:
    """A relation of the match with the day in its keys, on the scoped events."""
    text = RELATIONS[name]
    for old, new in _CHANGES:
        text = text.replace(old, new)
    for rel in ("behavior_events", "transaction_events", "state_events", "transactions_flagged", "states_flagged", "bt_matched", "tx_expected", "ts_matched"):
        text = text.replace(rel, f"{rel}_by_day")
    return text


for _name in ("behavior_events", "transaction_events", "state_events"):
    RELATIONS[f"{_name}_by_day"] = SCOPED.format(_name)
for _name in ("transactions_flagged", "states_flagged", "bt_matched", "bt_mapping", "tx_expected", "ts_matched", "ts_mapping"):
    RELATIONS[f"{_name}_by_day"] = scoped_sql(_name)


def by_scope(rel: str, picks: str, where: str = "true") -> str:
    return f"(SELECT profile_id, dt, {picks} FROM {rel}_by_day WHERE {where} GROUP BY profile_id, dt)"


def counts_by_scope(rel: str, prefix: str, statuses) -> str:
    return by_scope(rel, status_counts("x", prefix, statuses).removeprefix("SELECT ").split(" FROM x")[0])


_ZERO = "behavior_event_count transaction_event_count state_event_count behavior_transaction_total_count behavior_transaction_matched_count behavior_only_count transaction_only_count transaction_state_total_count transaction_state_matched_count orphan_state_count transaction_without_state_count duplicate_order_count duplicate_payment_count coupon_behavior coupon_tx payments orders_made refunds refund_states behavior_transaction_dup transaction_state_dup".split()
_KEPT = "avg_behavior_transaction_gap_ms p95_behavior_transaction_gap_ms avg_transaction_state_gap_ms p95_transaction_state_gap_ms".split()
_DELAYS = "payment_processing_delay_ms delivery_state_delay_ms refund_delay_ms".split()
RECON_BY_SCOPE = f"""SELECT *, CASE WHEN behavior_transaction_total_count > 0 THEN round(behavior_transaction_matched_count / behavior_transaction_total_count, 6) ELSE 0 END AS behavior_transaction_match_rate,
  round(abs(behavior_transaction_matched_count - orders_made) / greatest(behavior_transaction_matched_count, orders_made, 1), 6) AS conversion_gap,
  CASE WHEN transaction_state_total_count > 0 THEN round(transaction_state_matched_count / transaction_state_total_count, 6) ELSE 0 END AS transaction_state_match_rate,
  round(abs(payments - orders_made) / greatest(payments, 1), 6) AS payment_order_gap, round(abs(refunds - refund_states) / greatest(refunds, 1), 6) AS refund_transition_gap,
  round(abs(coupon_behavior - coupon_tx) / greatest(coupon_behavior, 1), 6) AS coupon_reconciliation_gap,
  behavior_only_count + transaction_only_count + orphan_state_count + transaction_without_state_count + behavior_transaction_dup + transaction_state_dup AS propagation_distortion_count
FROM (SELECT profile_id, dt, {", ".join(f"coalesce({n}, 0) AS {n}" for n in [*_ZERO, *_DELAYS])}, {", ".join(_KEPT)} FROM
  {by_scope("behavior_events", "count(*) AS behavior_event_count, count(coupon_id) AS coupon_behavior")} b
  FULL JOIN {by_scope("transaction_events", "count(*) AS transaction_event_count, count(*) FILTER (transaction_event = 'payment_approved') AS payments, count(*) FILTER (transaction_event = 'order_created') AS orders_made, count(*) FILTER (transaction_event = 'refund_completed') AS refunds, count(*) FILTER (transaction_event = 'coupon_applied') AS coupon_tx, CAST(trunc(avg(transaction_delay_ms) FILTER (transaction_event = 'payment_approved')) AS BIGINT) AS payment_processing_delay_ms")} t USING (profile_id, dt)
  FULL JOIN {by_scope("state_events", "count(*) AS state_event_count, count(*) FILTER (state_event = 'refund_status_completed') AS refund_states, CAST(trunc(avg(state_transition_delay_ms) FILTER (state_event LIKE 'delivery%')) AS BIGINT) AS delivery_state_delay_ms, CAST(trunc(avg(state_transition_delay_ms) FILTER (state_event LIKE 'refund%')) AS BIGINT) AS refund_delay_ms")} s USING (profile_id, dt)
  FULL JOIN {counts_by_scope('bt_mapping', 'behavior_transaction', [('matched', 'behavior_transaction_matched_count'), ('behavior_only', 'behavior_only_count'), ('transaction_only', 'transaction_only_count')])} bm USING (profile_id, dt)
  FULL JOIN {counts_by_scope('ts_mapping', 'transaction_state', [('matched', 'transaction_state_matched_count'), ('orphan_state', 'orphan_state_count'), ('transaction_without_state', 'transaction_without_state_count')])} tm USING (profile_id, dt)
  FULL JOIN (SELECT profile_id, dt, count(*) FILTER (c > 3) AS duplicate_order_count FROM (SELECT profile_id, dt, count(*) AS c FROM transaction_events_by_day GROUP BY profile_id, dt, order_id) o GROUP BY ALL) dord USING (profile_id, dt)
  FULL JOIN (SELECT profile_id, dt, count(*) FILTER (c > 1) AS duplicate_payment_count FROM (SELECT profile_id, dt, count(*) AS c FROM transaction_events_by_day WHERE payment_id IS NOT NULL GROUP BY profile_id, dt, payment_id, transaction_event) p GROUP BY ALL) dpay USING (profile_id, dt)) z"""


def by_day(df):
    return df.withColumn("profile_id", F.concat(F.lit("p"), (F.col("journey_id") % 7).cast("string"))).withColumn("dt", F.to_date(F.timestamp_micros("event_us")))


@query("reconciliation_by_scope", "A11 J01 J02", RECON_COLS.replace("profile_id ", "profile_id dt:date ", 1), RECON_BY_SCOPE)
def reconciliation_by_scope(i):
    scope = ["profile_id", "dt"]
    b, t, s = (materialize(by_day(x), "scoped") for x in (i.behavior_events, i.transaction_events, i.state_events))
    btm, tsm = materialize(R.match_behavior_transaction(b, t, scope), "bt"), materialize(R.match_transaction_state(t, s, scope), "ts")
    return R.reconciliation_measurement(b, t, s, btm, tsm, scope)


@query("mapping_coverage_join", "J05", "path mapping_id:i prefix n:i",
       """SELECT path, id AS mapping_id, url_pattern AS prefix, count(*) AS n FROM source_hits LEFT JOIN (SELECT * FROM event_mapping WHERE is_active = 1) m
  ON starts_with(path, url_pattern) GROUP BY ALL""")
def mapping_coverage_join(i):
    counts = i.source_hits.groupBy("path").agg(F.count("*").alias("n"))
    return counts.join(J.path_mapping(counts, i.event_mapping, longest=False), "path", "left")


@query("mapping_coverage_longest", "J05", "path mapping_id:i prefix n:i",
       """SELECT path, arg_max(id, length(url_pattern)) AS mapping_id, arg_max(url_pattern, length(url_pattern)) AS prefix, n FROM
  (SELECT path, count(*) AS n FROM source_hits GROUP BY ALL) h LEFT JOIN (SELECT * FROM event_mapping WHERE is_active = 1) m ON starts_with(path, url_pattern) GROUP BY path, n""")
def mapping_coverage_longest(i):
    counts = i.source_hits.groupBy("path").agg(F.count("*").alias("n"))
    return counts.join(J.path_mapping(counts, i.event_mapping), "path", "left")


UNMAPPED = """SELECT path, count(*) AS hit_count FROM source_hits h WHERE NOT EXISTS
  (SELECT 1 FROM event_mapping m WHERE is_active = 1 AND url_pattern <> '/' AND starts_with(h.path, m.url_pattern)) GROUP BY path"""


@query("unmapped_paths", "J06", "path hit_count:i", UNMAPPED)
def unmapped_paths(i):
    return J.unmapped_paths(i.source_hits, i.event_mapping)


@query("top_unmapped", "T01", "path hit_count:i", f"{UNMAPPED} ORDER BY hit_count DESC, path LIMIT 100")
def top_unmapped(i):
    return J.unmapped_paths(i.source_hits, i.event_mapping).orderBy(F.desc("hit_count"), "path").limit(100)


@query("enrich_from_raw", "J08", "canonical_event_id:i path uid ua",
       "SELECT r.canonical_event_id, s.path, s.uid, s.ua FROM replay_events r LEFT JOIN source_hits s ON r.canonical_event_id = s.hit_id")
def enrich_from_raw(i):
    raw = i.source_hits.withColumnRenamed("hit_id", "canonical_event_id")
    left = i.replay_events.select("canonical_event_id").withColumn("uid", F.lit(None).cast("string"))
    return J.enrich(left, raw, "canonical_event_id", ["path", "uid", "ua"])


@query("null_safe_scope_join", "J11", "uid events:i kept:i",
       """SELECT s.uid, s.n AS events, coalesce(c.n, 0) AS kept FROM (SELECT uid, count(*) AS n FROM source_hits GROUP BY uid) s
  LEFT JOIN (SELECT uid, count(*) AS n FROM collected_hits GROUP BY uid) c ON s.uid IS NOT DISTINCT FROM c.uid""")
def null_safe_scope_join(i):
    web = i.source_hits.groupBy("uid").agg(F.count("*").alias("events"))
    wc = i.collected_hits.groupBy("uid").agg(F.count("*").alias("kept"))
    return J.null_safe_join(web, wc, ["uid"]).fillna(0, subset=["kept"])


@query("new_entities", "J19", "profile_id dt:date pcid",
       """SELECT DISTINCT profile_id, dt, pcid FROM collected_hits t WHERE NOT EXISTS (SELECT 1 FROM collected_hits h
  WHERE h.profile_id = t.profile_id AND h.pcid = t.pcid AND h.dt < t.dt AND h.dt >= t.dt - 7)""")
def new_entities(i):
    return J.new_entities(i.collected_hits, "pcid", "dt", ["profile_id"], 7)


@query("first_seen", "W14", "profile_id pcid first_seen:date", "SELECT profile_id, pcid, min(dt) AS first_seen FROM collected_hits GROUP BY ALL")
def first_seen(i):
    return J.first_seen(i.collected_hits, "pcid", "dt", ["profile_id"])


@query("cross_run_counts", "J20", "profile_id journey_id:i behavior:i transactions:i states:i",
       """SELECT profile_id, journey_id, b.n AS behavior, coalesce(t.n, 0) AS transactions, coalesce(s.n, 0) AS states FROM
  (SELECT profile_id, journey_id, count(*) AS n FROM behavior_events GROUP BY ALL) b LEFT JOIN
  (SELECT profile_id, journey_id, count(*) AS n FROM transaction_events GROUP BY ALL) t USING (profile_id, journey_id) LEFT JOIN
  (SELECT profile_id, journey_id, count(*) AS n FROM state_events GROUP BY ALL) s USING (profile_id, journey_id)""")
def cross_run_counts(i):
    keys = ["profile_id", "journey_id"]
    count = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(n))
    out = count(i.behavior_events, "behavior").join(count(i.transaction_events, "transactions"), keys, "left")
    return out.join(count(i.state_events, "states"), keys, "left").fillna(0)
