"""Small fixtures: brute force, golden values, skew, restarts and reruns."""

import hashlib
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from hitledger.functions import text as X
from hitledger.operators import decisions as D, evidence as E, gaps as G, kpi as K, quality as Q, reconcile as R, split as S, whatif as W
from hitledger.operators.joins import nearest_in_time
from hitledger.operators.quantiles import exact_quantiles
from hitledger.sources import logs, records
from hitledger.streaming import quality as SQ


def folder():
    return tempfile.mkdtemp(prefix="run-")


# --- groups cut into slices -----------------------------------------------------


def skewed_rows(n=3000, seed=5):
    rnd = random.Random(seed)
    # one key holds a third of the rows, and times repeat
    return [("hot" if i % 3 == 0 else f"k{rnd.randrange(40)}", rnd.randrange(20_000) * 1_000_000, i, rnd.randrange(5)) for i in range(n)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_sliced_windows_equal_plain_ones(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, us bigint, id bigint, v bigint")
    part = S.time_slice(F.col("us"), 600)
    lag = {r.id: r.o for r in S.lag_in_slices(df, ["k"], ["us", "id"], part, "v", "o").collect()}
    total = {r.id: r.o for r in S.sum_in_slices(df, ["k"], ["us", "id"], part, "v", "o").collect()}
    number = {r.id: r.o for r in S.number_in_slices(df, ["k"], ["us", "id"], part, "o").collect()}
    for group in by_key(rows).values():
        run = 0
        for n, r in enumerate(group):
            run += r[3]
            assert lag[r[2]] == (group[n - 1][3] if n else None)
            assert total[r[2]] == run
            assert number[r[2]] == n + 1


def test_nearest_in_time_equals_brute_force(spark):
    rnd = random.Random(3)
    points = [(rnd.choice("abc"), rnd.randrange(50_000) * 1_000_000) for _ in range(400)]
    cands = [(rnd.choice("abd"), rnd.randrange(50_000) * 1_000_000, i) for i in range(300)]
    left = spark.createDataFrame(points, "k string, t bigint")
    right = spark.createDataFrame(cands, "k string, t bigint, id bigint").select("k", "t", F.struct("id").alias("row"))
    got = {(r.k, r.t): r.best for r in nearest_in_time(left, right, 600).collect()}
    assert set(got) == set(points)
    for (k, t), best in got.items():
        mine = [(abs(c[1] - t), c[2]) for c in cands if c[0] == k]
        if mine:
            assert (best.gap, best.row.id) == min(mine)
        else:
            assert best is None


def test_match_handles_missing_times_and_journeys(spark):
    b = spark.createDataFrame(
        [(1, "p", None, None, "checkout", 10), (2, "p", "j1", None, "payment", None), (3, "p", "j9", None, "payment", 5), (4, "p", "j1", "o1", "browse", 50)],
        "behavior_id bigint, profile_id string, journey_id string, order_id string, journey_stage string, event_us bigint",
    )
    t = spark.createDataFrame(
        [(10, "p", None, "o0", "order_created", 20), (11, "p", "j1", "o2", "order_created", 30), (12, "p", "j1", "o1", "payment_approved", None), (13, "p", "j8", "o8", "order_created", 1)],
        "tx_id bigint, profile_id string, journey_id string, order_id string, transaction_event string, event_us bigint",
    )
    rows = R.match_behavior_transaction(b, t).collect()
    found = {r.behavior_id: r.tx_id for r in rows if r.behavior_id}
    # a null journey matches a null journey; without a time the smallest id wins
    assert found == {1: 10, 2: 11, 3: None, 4: 12}
    assert {r.tx_id for r in rows if r.mapping_status == "transaction_only"} == {13}


@pytest.mark.parametrize("kind", ["nearest", "linear", "two_ranks"])
def test_exact_quantiles(spark, kind):
    import math

    rnd = random.Random(9)
    data = [("a", rnd.randrange(1000)) for _ in range(997)] + [("b", 7)] * 50 + [("c", 3)]
    got = {r.k: r.q for r in exact_quantiles(spark.createDataFrame(data, "k string, v bigint"), ["k"], "v", {"q": 0.95}, kind).collect()}
    for key in "abc":
        v = sorted(x for k, x in data if k == key)
        n = len(v)
        if kind == "nearest":
            want = v[max(1, math.ceil(n * 0.95)) - 1]
        elif kind == "two_ranks":
            want = (v[max(1, math.floor(n * 0.95)) - 1] + v[max(1, math.ceil(n * 0.95)) - 1]) / 2
        else:
            pos = (n - 1) * 0.95
            low = math.floor(pos)
            want = v[low] + (pos - low) * (v[min(low + 1, n - 1)] - v[low])
        assert got[key] == pytest.approx(want)


def test_sessions_split_only_beyond_the_gap(spark):
    # exactly 30 minutes stays, one second more starts a new session; slices are crossed
    times = ["00:00:00", "00:30:00", "01:00:01", "01:10:00", "05:00:00"]
    rows = [("p", "2024-01-01", f"2024-01-01 {t}", "u", i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "profile_id string, dt string, ts string, identity string, event_id bigint").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("dt", F.col("dt").cast("date"))
    got = sorted((r.event_id, r.session_seq, r.duration_sec) for r in K.running_session_duration(K.sessionize(df)).collect())
    assert got == [(0, 1, 0), (1, 1, 1800), (2, 2, 0), (3, 2, 599), (4, 3, 0)]


# --- golden values ----------------------------------------------------------------


@pytest.mark.parametrize(
    "conversion, preservation, distortion, criticality",
    [(0.0, 1.0, 0.3500, 0.0), (0.5909, 0.0, 0.3841, 0.2068), (0.8823, 0.0, 0.5735, 0.3088), (0.9183, 0.0, 0.5969, 0.3214), (0.9655, 0.8287, 0.9176, 0.9176)],
)
def test_recorded_distortion_and_criticality(spark, conversion, preservation, distortion, criticality):
    row = spark.range(1).select(G.kpi_distortion(F.lit(conversion), F.lit(preservation)).alias("d"))
    row = row.select("d", E.criticality(F.lit(conversion), F.lit(preservation), F.col("d")).alias("c")).first()
    assert row.d == pytest.approx(distortion, abs=2e-4)
    assert row.c == pytest.approx(criticality, abs=2e-4)


def test_traffic_preservation_of_the_recorded_run(spark):
    assert spark.range(1).select(G.traffic_preservation(F.lit(0.0374))).first()[0] == pytest.approx(0.8287, abs=3e-4)


EVIDENCE = "profile_id string, dt string, scenario_name string, baseline_evidence double, statistical double, propagation double, impact double, concentration double, criticality double, business_kpi_distortion double, traffic_preservation double, reconciliation_gap_score double, transaction_loss_score double, customer_impact_score double, identity_integrity double, semantic_shift double, pv_gap_rate double"


def decide(spark, **over):
    base = dict(
        profile_id="p", dt="d", scenario_name="source_wc_collection_missing", baseline_evidence=0.2, statistical=0.1, propagation=0.1, impact=0.1, concentration=0.0, criticality=0.0, business_kpi_distortion=0.3,
        traffic_preservation=0.0, reconciliation_gap_score=0.0, transaction_loss_score=0.0, customer_impact_score=0.1, identity_integrity=0.0, semantic_shift=0.0, pv_gap_rate=0.5,
    )
    base.update(over)
    df = spark.createDataFrame([tuple(base.values())], EVIDENCE)
    return D.classify(D.risk(D.failure_mechanism(D.pattern(df))))


@pytest.mark.parametrize(
    "over, pattern, mechanism",
    [
        (dict(scenario_name="baseline", concentration=0.9), "stable", "none"),
        (dict(criticality=0.9, business_kpi_distortion=0.9, traffic_preservation=0.8), "silent_distortion", "critical_event_loss"),
        (dict(concentration=0.4), "localized_failure", "collection_completeness_loss"),
        (dict(concentration=0.4, identity_integrity=0.5, traffic_preservation=0.9), "localized_failure", "identity_integrity_breakage"),
        (dict(concentration=0.4, semantic_shift=0.5, traffic_preservation=0.9, pv_gap_rate=0.1), "localized_failure", "semantic_attribution_distortion"),
        (dict(reconciliation_gap_score=0.2), "reconciliation_failure", "cross_domain_mapping_gap"),
        (dict(propagation=0.6), "systemic_failure", "systemic_observability_degradation"),
        (dict(), "emerging_reliability_degradation", "emerging_reliability_degradation"),
    ],
)
def test_pattern_and_mechanism(spark, over, pattern, mechanism):
    row = decide(spark, **over).first()
    assert (row.risk_pattern, row.failure_mechanism) == (pattern, mechanism)
    assert 0 <= row.overall_risk_score <= 1
    assert row.overall_risk_score == pytest.approx(row.likelihood_score * row.impact_score)
    if pattern == "stable":
        assert (row.overall_risk_score, row.classification, row.root_cause_candidate) == (0, "None", "NONE")


def test_baseline_gets_no_action(spark):
    rows = D.authority_actions(decide(spark, scenario_name="baseline", concentration=0.9)).collect()
    assert [r.recommended_action for r in rows] == ["no action"]


def test_root_cause_falls_back_to_a_stable_row(spark):
    empty = spark.createDataFrame([], "profile_id string, dt string, scenario_name string, root_cause_dimension string, root_cause_value string, root_cause_confidence double, affected_metrics int")
    scopes = spark.createDataFrame([("p", "d", "s")], "profile_id string, dt string, scenario_name string")
    row = E.top_root_causes(empty, scopes).first()
    assert (row.analysis_status, row.root_cause_dimension) == ("NO_SIGNAL", "none")


# --- text ------------------------------------------------------------------------------


def test_event_names(spark):
    cases = [
        ("/card/apply/submit", "card_apply_submit"), ("/card/apply", "card_apply_start"), ("/loan/apply/submit", "loan_apply_submit"), ("/loan/product", "loan_view"), ("/auth/success", "auth_success"), ("/login/fail", "auth_fail"),
        ("/auth/otp/request", "otp_request"), ("/auth/risk", "risk_login"), ("/login", "auth_attempt"), ("/home", "page_view"),
    ]
    df = spark.createDataFrame([(p, "GET", 200) for p, _ in cases], "path string, method string, status int")
    got = {r.path: r.semantic_event for r in X.with_event_name(df).collect()}
    assert got == dict(cases)
    named = X.with_event_name(df.withColumn("event_name", F.lit("Coupon_Click"))).first()
    assert named.semantic_event == "coupon_click"


def test_expected_text_matching(spark):
    cases = [("Completeness Risk", "completeness", True), ("row loss", "completeness", True), ("Latency", "timeliness_or_stream_consistency", False), ("", "low", False), ("x", "", True), ("warning", "low_or_warning", True)]
    df = spark.createDataFrame(cases, "o string, e string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", Q.contains_expected("o", "e")).collect())


# --- files and tables ---------------------------------------------------------------------


def test_access_log_file(spark):
    path = f"{folder()}/a.log"
    good = '1.2.3.4 - - [05/Mar/2024:10:11:12 +0900] "GET /loan/apply?x=1 HTTP/1.1" 200 - "-" "Mozilla iPad" "uid=u1; evt=view; bytes; al=ko,en"'
    with open(path, "w") as f:
        f.write(f"{good}\n\nnot a line\n")
    hits, bad = logs.read_access_log(spark, path)
    row = hits.first()
    assert (str(row.ts), row.path, row.query, row.bytes, row.ref, row.device_type, row.service_domain, row.accept_lang) == ("2024-03-05 10:11:12", "/loan/apply", "x=1", None, None, "tablet", "loan", "ko,en")
    assert [r.line for r in bad.collect()] == ["not a line"]


def test_transaction_file_numbers_lines(spark):
    path = f"{folder()}/x_transaction.jsonl"
    rows = [{"event_time": "2024-01-01T00:00:01+09:00", "journey_id": "j1", "amount": 1.5, "anomaly_flag": True}, {"event_time": "bad", "journey_id": "j2"}]
    with open(path, "w") as f:
        f.write(json.dumps(rows[0]) + "\n\n" + json.dumps(rows[1]) + "\n")
    got = sorted((r.source_row_number, r.journey_id, str(r.event_time), r.anomaly_flag) for r in records.read_transactions(spark, path).collect())
    assert got == [(1, "j1", "2024-01-01 00:00:01", 1), (3, "j2", "None", 0)]


def test_file_manifest(spark):
    where = folder()
    with open(f"{where}/a.txt", "wb") as f:
        f.write(b"one\ntwo\nthree")
    row = logs.file_manifest(spark, where).first()
    assert (row.file_name, row.record_count, row.checksum) == ("a.txt", 3, hashlib.sha256(b"one\ntwo\nthree").hexdigest())


def test_overwrite_scope_is_idempotent(spark):
    path = f"{folder()}/t"
    day = lambda d, n: spark.range(n).withColumn("dt", F.lit(d))
    records.overwrite_scope(day("a", 3).unionByName(day("b", 4)), path, ["dt"])
    for _ in range(2):
        records.overwrite_scope(day("a", 5), path, ["dt"])
    assert {r.dt: r.n for r in spark.read.parquet(path).groupBy("dt").agg(F.count("*").alias("n")).collect()} == {"a": 5, "b": 4}


def test_upsert_prefers_the_higher_version(spark):
    base = spark.createDataFrame([(1, "old", 5), (2, "keep", 1)], "id int, v string, ver int")
    delta = spark.createDataFrame([(1, "late", 3), (3, "new", 1)], "id int, v string, ver int")
    assert {r.id: r.v for r in records.upsert(base, delta, ["id"], "ver").collect()} == {1: "old", 2: "keep", 3: "new"}
    assert {r.id: r.v for r in records.upsert(base, delta, ["id"]).collect()} == {1: "late", 2: "keep", 3: "new"}


# --- chance -----------------------------------------------------------------------------------


def test_damage_does_not_depend_on_partitions(spark):
    df = spark.range(20000)
    one = {r.id for r in W.drop_rows(df.coalesce(1), 0.3, "id").collect()}
    many = {r.id for r in W.drop_rows(df.repartition(13), 0.3, "id").collect()}
    assert one == many
    assert len(one) == pytest.approx(14000, rel=0.03)
    assert W.duplicate_rows(df, 0.1, "id").count() == pytest.approx(22000, rel=0.02)
    assert W.volume_spike(df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), 1.5, "id").count() == pytest.approx(30000, rel=0.03)


# --- streams ------------------------------------------------------------------------------------

SCHEMA = "raw_event_id bigint, profile_id string, ts timestamp, service_domain string, stream_partition bigint, stream_offset bigint, sequence_no bigint"


def message_files(spark, batches):
    where = folder()
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{where}/in")
    return where


def test_ordering_reaches_into_earlier_batches(spark):
    row = lambda i, sec, seq: (i, "p", f"2024-01-01 00:{sec // 60:02d}:{sec % 60:02d}", "d", 0, i, seq)
    batches = [[row(1, 1, 1), row(2, 2, 2)], [row(3, 700, 2), row(4, 701, 3)], [row(5, 1500, 9), row(6, 1501, 8)]]
    where = message_files(spark, batches)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    got = {r.raw_event_id: (r.prev_seq, r.violation) for r in SQ.stream_ordering(stream, path=f"{where}/out").collect()}
    assert got == {1: (None, 0), 2: (1, 0), 3: (2, 1), 4: (2, 0), 5: (3, 0), 6: (9, 1)}


def test_bounded_run_goes_on_where_it_ended(spark):
    row = lambda i: (i, "p", f"2024-01-01 00:00:{i:02d}", "d", 0, i, i)
    where = message_files(spark, [[row(1), row(2)]])
    read = lambda: spark.readStream.schema(SCHEMA).parquet(f"{where}/in")
    assert SQ.run_bounded(read().select("raw_event_id"), "x", path=f"{where}/out").count() == 2
    extra = spark.createDataFrame([row(3)], SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    extra.write.mode("append").parquet(f"{where}/in")
    assert sorted(r[0] for r in SQ.run_bounded(read().select("raw_event_id"), "x", path=f"{where}/out").collect()) == [1, 2, 3]


# --- invariants ------------------------------------------------------------------------------------


def test_matches_and_shares_add_up(spark):
    from hitledger.plans import all_queries  # noqa: F401  registers the relations
    from hitledger.plans.fixtures import Inputs

    i = Inputs(spark, "/root/testdata/sf0.001")
    m = R.match_behavior_transaction(i.behavior_events, i.transaction_events)
    anchors = i.behavior_events.where("journey_stage IN ('checkout', 'payment', 'order_complete', 'refund') OR order_id IS NOT NULL").count()
    assert m.where("mapping_status IN ('matched', 'behavior_only')").count() == anchors
    share = K.distribution(i.collected_hits).groupBy("dt", "dimension_name").agg(F.sum("event_ratio").alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in share.collect())


def test_no_plan_pairs_rows_without_a_key(spark):
    """Nested loops and cross joins would not survive large tables."""
    from hitledger.plans import all_queries

    for name in ("match_behavior_transaction", "match_transaction_state", "mapping_coverage_join", "unmapped_paths", "metric_baseline", "gap_by_url", "sessionize"):
        plan = all_queries()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
