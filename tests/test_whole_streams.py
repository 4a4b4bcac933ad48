"""Streams in several steps and with restarts: open windows, open absences, timers, carried state, sketches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hitledger.plans.fixtures import Inputs
from hitledger.plans.streams import sent
from hitledger.session import scratch_dir
from hitledger.streaming import quality as Q

AT = datetime(2024, 1, 1, 12, 0, 0)
SCHEMA = "raw_event_id long, profile_id string, service_domain string, user_id long, ts timestamp, event_delay_ms int, stream_partition long, stream_offset long, sequence_no long"


class Source:
    """A folder that rows are put into, and a folder that a query keeps its state in."""

    def __init__(self, spark, label):
        self.spark, self.where, self.n = spark, scratch_dir(spark, label), 0

    def put(self, *rows):
        """Rows of (seconds, domain, user, sequence)."""
        out = []
        for sec, domain, user, seq in rows:
            out.append((self.n, "p0", domain, user, AT + timedelta(seconds=sec), 10 * self.n, 0, self.n, seq))
            self.n += 1
        self.spark.createDataFrame(out, SCHEMA).write.mode("append").parquet(f"{self.where}/in")

    @property
    def stream(self):
        return self.spark.readStream.schema(SCHEMA).parquet(f"{self.where}/in")

    @property
    def rows(self):
        return self.spark.read.schema(SCHEMA).parquet(f"{self.where}/in")

    @property
    def out(self):
        return f"{self.where}/out"


def sec(t):
    return None if t is None else (t - AT).total_seconds()


def test_open_windows_are_given_and_replaced(spark):
    s = Source(spark, "restart")
    drain = lambda: {sec(r.metric_minute) // 60: r.events for r in Q.run_updated(Q.late_events(s.stream, 10), ["profile_id", "metric_minute"], "x", s.out).collect()}
    s.put((0, "a", 1, 1), (1200, "a", 1, 2), (1201, "a", 1, 3))
    assert drain() == {0: 1, 20: 2}
    assert drain() == {0: 1, 20: 2}  # nothing new, nothing changed
    s.put((1202, "a", 1, 4), (1260, "a", 1, 5))
    assert drain() == {0: 1, 20: 3, 21: 1}


def test_repeats_in_later_steps(spark):
    """A repeat that comes in a later micro-batch is one of its minute's; the same id in another minute is not."""
    s = Source(spark, "repeats")

    def put(*rows):
        s.spark.createDataFrame([(k, "p0", "a", 1, AT + timedelta(seconds=t), 0, 0, 0, 0) for k, t in rows], SCHEMA).write.mode("append").parquet(f"{s.where}/in")

    drain = lambda: {sec(r.metric_minute) // 60: (r.total_count, r.duplicate_count) for r in Q.run_updated(Q.stream_duplicates(s.stream), ["profile_id", "metric_minute", "service_domain"], "x", s.out).collect()}
    put((1, 0), (1, 5), (2, 6))
    assert drain() == {0: (3, 1)}
    put((1, 7), (3, 8), (1, 61))
    assert drain() == {0: (5, 2), 1: (1, 0)}


def test_sessions_go_on_after_a_restart(spark):
    s = Source(spark, "sessions")
    drain = lambda: sorted((r.user_id or 0, sec(r.session_start), sec(r.last_ts), r.events) for r in Q.run_sessions(s.stream, "user_id", path=s.out).collect())
    s.put((0, "a", 1, 1), (1800, "a", 1, 2), (3601, "a", 1, 3), (5, "a", None, 4))
    assert drain() == [(0, 5, 5, 1), (1, 0, 1800, 2), (1, 3601, 3601, 1)]
    s.put((3700, "a", 1, 5), (9000, "a", 1, 6))
    assert drain() == [(0, 5, 5, 1), (1, 0, 1800, 2), (1, 3601, 3700, 2), (1, 9000, 9000, 1)]


def test_absences_that_are_not_settled(spark):
    """Old absences are appended once the watermark passes; new ones are given each time until an arrival comes."""
    e, a = Source(spark, "expected"), Source(spark, "arrived")

    def put(source, *rows):
        spark.createDataFrame([(k, "p0", "a", 1, AT + timedelta(seconds=t), 0, 0, 0, 0) for k, t in rows], SCHEMA).write.mode("append").parquet(f"{source.where}/in")

    def drain():
        actual = Q.stream_dedup_ingest(a.stream, ["raw_event_id"], "10 minutes")
        got = Q.run_completeness(e.stream, actual, e.rows, a.rows.agg(F.max("ts")).first()[0], "x", path=e.out).collect()
        assert len({r.raw_event_id for r in got}) == len(got)
        return {r.raw_event_id: r.arrived_id is not None for r in got}

    put(e, (1, 0), (2, 10), (3, 2000))
    put(a, (1, 20), (9, 1990))
    assert drain() == {1: True, 2: False, 3: False}
    put(e, (4, 2001))
    put(a, (3, 2030), (3, 2031))
    assert drain() == {1: True, 2: False, 3: True, 4: False}
    put(e, (5, 9000))
    put(a, (5, 9000))
    assert drain() == {1: True, 2: False, 3: True, 4: False, 5: True}


def silences(s, keys):
    got = Q.no_data_alert(s.stream, keys, 5, path=s.out, watermark="1 minute").collect()
    return sorted(((*[r[k] for k in keys], sec(r.since), sec(r.ts), r.gap_sec, r.downtime_sec) for r in got), key=lambda x: x[:2])


def test_a_silence_is_seen_while_it_lasts(spark):
    """A source that has stopped is counted up to the watermark, by timers; its next event settles it."""
    s, keys = Source(spark, "timers"), ["service_domain"]
    s.put((0, "a", 1, 1), (5.9, "a", 1, 2), (12.0, "a", 1, 3), (0, "b", 1, 4), *[(t, "c", 1, 5) for t in range(0, 101, 5)])
    # the watermark is at 40: b is silent since 0 and a since 12
    assert silences(s, keys) == [("a", 5.9, 12.0, 6, 1), ("a", 12.0, None, 28, 23), ("b", 0.0, None, 40, 35)]
    s.put((102, "a", 1, 6), *[(t, "c", 1, 5) for t in range(105, 301, 5)])
    # at 240: a is silent again, since 102; b's alert has grown
    assert silences(s, keys) == [("a", 5.9, 12.0, 6, 1), ("a", 12.0, 102.0, 90, 85), ("a", 102.0, None, 138, 133), ("b", 0.0, None, 240, 235)]
    assert silences(s, keys) == [("a", 5.9, 12.0, 6, 1), ("a", 12.0, 102.0, 90, 85), ("a", 102.0, None, 138, 133), ("b", 0.0, None, 240, 235)]


def test_order_is_carried_over_steps_and_forgotten(spark):
    s = Source(spark, "order")
    drain = lambda: [(r.raw_event_id, r.prev_seq, r.violation) for r in Q.stream_ordering(s.stream, path=s.out, watermark="1 minute", forget="1 hour").orderBy("raw_event_id").collect()]
    s.put((1, "a", 1, 5), (0, "a", 1, 3), (2, "a", 1, 4))
    assert drain() == [(0, 3, 0), (1, None, 0), (2, 5, 1)]
    s.put((3, "a", 1, 4), (4, "b", 1, 1))
    assert drain()[3:] == [(3, 4, 1), (4, None, 0)]
    s.put((9000, "b", 1, 2))
    assert drain()[5:] == [(5, 1, 0)]  # the timer of both goes off after this batch
    s.put((9001, "a", 1, 1), (9002, "b", 1, 3))
    assert drain()[6:] == [(6, None, 0), (7, 2, 0)]


def test_sketch_quantiles_are_within_their_bound(spark):
    """Of every window, the rank of the sketch's median and 95th percentile among the window's delays."""
    i = Inputs(spark, "/root/testdata/sf0.01")
    rows = sent(i).where("ts < timestamp'2024-01-04'").toPandas()
    s = spark.createDataFrame(rows).withColumn("event_delay_ms", F.col("event_delay_ms").cast("long"))
    where = scratch_dir(spark, "sketch")
    s.write.parquet(f"{where}/in")
    moments = Q.run_updated(Q.minute_moments(spark.readStream.schema(s.schema).parquet(f"{where}/in")), ["profile_id", "metric_minute"], "x", f"{where}/out")
    got = Q.sliding_windows(moments, 600).toPandas()
    assert len(got) > 3000
    for r in got.iloc[::200].itertuples():
        inside = rows[(rows["ts"] < r.window_end) & (rows["ts"] >= r.window_end - timedelta(minutes=600))]["event_delay_ms"].to_numpy()
        assert len(inside) == r.events and abs(inside.mean() - r.avg_delay_ms) < 1e-6 and abs(inside.mean() + 3 * inside.std() - r.upper_limit_ms) < 1e-6
        for q, v in ((0.5, r.p50_delay_ms), (0.95, r.p95_delay_ms)):
            low, high = (inside < v).mean(), (inside <= v).mean()
            assert low - 0.03 - 1 / len(inside) <= q <= high + 0.03 + 1 / len(inside)


def test_events_are_shuffled_once_for_sliding_windows(spark):
    """A window's plan explodes minutes, never events."""
    s = Source(spark, "plan")
    s.put((0, "a", 1, 1))
    plan = Q.minute_moments(s.stream)._jdf.queryExecution().analyzed().toString()
    assert "Expand" not in plan and "Generate" not in plan
