import random

import pytest
from pyspark.sql import functions as F

from rivulet.exceptions import ConfigurationError
from rivulet.functions import scalar
from rivulet.operators import flow, health, introspect, metrics, publish, retry, routing
from rivulet.operators.sequence import carried, neighbour, numbered


def test_numbers_by_lots_equal_one_window(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if rnd.random() < 0.7 else rnd.choice("ab"), i if rnd.random() < 0.3 else None) for i in rnd.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "event_id long, feed string, v long")
    for lot in (10**6, 37):
        seen, last = {}, {}
        want = {}
        for i, f, v in sorted(rows):
            seen[f] = seen.get(f, 0) + 1
            last[f] = v if v is not None else last.get(f)
            want[i] = (seen[f], last[f])
        a = {r.event_id: r.seq for r in numbered(df, ["feed"], "event_id", rows_per_lot=lot).collect()}
        b = {r.event_id: r.w for r in carried(df, ["feed"], "event_id", "v", "w", rows_per_lot=lot).collect()}
        assert {i: (a[i], b[i]) for i in a} == want


def test_nulls_take_no_number_and_failures_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "f", "1"), (2, "f", None), (3, "f", "x"), (4, "f", "4")], "event_id long, feed string, value string")
    got = publish.publish(df, mapped=F.expr("try_cast(value as int)")).orderBy("event_id").collect()
    assert [(r.event_id, r.seq) for r in got] == [(1, 1), (4, 2)]
    good, dead = publish.map_safely(df, F.expr("try_cast(value as int)"))
    assert [r.event_id for r in dead.collect()] == [3] and {r.event_id for r in good.collect()} == {1, 4}


def test_routing(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, feed string")
    subs = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "b")], "processor string, feed string")
    assert routing.route(e, routing.active(subs)).count() == 2
    gone = spark.createDataFrame([("q",)], "processor string")
    assert {r.processor for r in routing.active(subs, gone).collect()} == {"p"}
    assert routing.broadcast_route(e, subs).count() == 4


def test_retry(spark):
    e = spark.createDataFrame([(0,), (2,), (9,)], "n int")
    got = [(r.attempts, r.dropped, r.backoff_ms) for r in retry.schedule(e, F.col("n")).orderBy("n").collect()]
    assert got == [(1, False, 0), (3, False, 15), (3, True, 15)]
    assert spark.range(1).select(scalar.retry_delay_ms(F.lit(10))).first()[0] == 100
    assert retry.recent(spark.createDataFrame([(1,)], "event_id long"), 0).count() == 0


def test_percentiles_drop_negatives_and_clamp(spark):
    e = spark.createDataFrame([("n", v) for v in [-5, 1, 2, 3, 4_000_000]], "node string, v long")
    r = metrics.percentiles(e, "node", F.col("v")).first()
    assert (r.n, r.p50, r.max_ms) == (4, 2, 3_600_000)


def test_rollup(spark):
    c = spark.createDataFrame([("a", "UP", True), ("a", "DOWN", False), ("b", "DOWN", False), ("c", "DEGRADED", True), ("c", "UNKNOWN", True)], "service string, verdict string, enabled boolean")
    assert {r.service: r.verdict for r in health.rollup(c).collect()} == {"a": "UP", "b": "UNKNOWN", "c": "DEGRADED"}


def test_bounded_queue_by_key(spark):
    rnd = random.Random(2)
    rows = [(k, t, rnd.randint(0, 6)) for k in "xy" for t in range(40)]
    got = {(r.k, r.t): (r.depth, r.dropped) for r in flow.bounded_queue(spark.createDataFrame(rows, "k string, t long, arrived long"), "t", 4, 2, by="k").collect()}
    depth = {}
    for k, t, n in rows:
        d = depth.get(k, 0)
        lost, d = max(0, d + n - 4), max(0, min(d + n, 4) - 2)
        depth[k] = d
        assert got[k, t] == (d, lost)


def test_introspection(spark):
    subs = spark.createDataFrame([("g", "p", "f", "c"), ("g", "q", "f", "c")], "grp string, processor string, feed string, callback string")
    assert introspect.topology(subs).first().processors == "p,q"
    assert introspect.feed_topology(subs).first().consumers[0].processors == ["p", "q"]
    audit = "processor string, last_write_at long"
    got = introspect.audit_list(spark.createDataFrame([("p", 1), ("r", 9)], audit), spark.createDataFrame([("p", 5)], audit)).collect()
    assert [(r.processor, r.last_write_at, r.is_live) for r in got] == [("p", 5, True), ("r", 9, False)]


def test_wheel_ticks(spark):
    assert flow.fire_times(spark.range(1), F.lit(1000), F.lit(30), tick_ms=1024).first().fire_ms == 2048


def test_null_keys_and_null_orders_stay(spark):
    """With one lot and with many, held against SQL."""
    rnd = random.Random(3)
    rows = [(i if rnd.random() < 0.9 else None, rnd.choice(["a", "b", None]), rnd.choice([None, 1, 2, 3]), k) for k, i in enumerate(rnd.sample(range(10_000), 300))]
    rows += [(None, None, None, 1000), (2**60, "a", 5, 1001), (2**60 + 1, "a", None, 1002)]
    df = spark.createDataFrame(rows, "event_id long, feed string, v long, k long")
    df.createOrReplaceTempView("given")
    w = "OVER (PARTITION BY feed ORDER BY event_id"
    want = {r.k: r for r in spark.sql(f"SELECT *, row_number() {w}) AS n, last(v) IGNORE NULLS {w} ROWS UNBOUNDED PRECEDING) AS c, lag(v) {w}) AS b, lead(v) {w}) AS a FROM given").where("event_id is not null").collect()}
    for lot in (10**6, 40):
        n = {r.k: r.n for r in numbered(df, ["feed"], "event_id", "n", lot).collect()}
        assert len(n) == len(rows) and {k: n[k] for k in want} == {k: r.n for k, r in want.items()}
        for feed in ("a", "b", None):
            assert sorted(n[k] for e, f, _, k in rows if f == feed) == list(range(1, 1 + sum(f == feed for _, f, _, _ in rows)))
        known = df.where("event_id is not null")
        known.createOrReplaceTempView("given")
        for got, sql in [
            (carried(known, ["feed"], "event_id", "v", "x", lot), f"last(v) IGNORE NULLS {w} ROWS UNBOUNDED PRECEDING)"),
            (neighbour(known, ["feed"], "event_id", "v", "x", False, lot), f"lag(v) {w})"),
            (neighbour(known, ["feed"], "event_id", "v", "x", True, lot), f"lead(v) {w})"),
        ]:
            assert sorted(map(str, got.select("k", "x").collect())) == sorted(map(str, spark.sql(f"SELECT k, {sql} AS x FROM given").collect()))
    assert publish.publish(spark.createDataFrame([(1, None, 1.0), (2, None, 2.0), (3, "a", 1.0), (4, "a", 1.0)], "event_id long, feed string, value double")).count() == 4


def test_gaps_and_intervals_by_lots(spark):
    rnd = random.Random(4)
    seqs = sorted(rnd.sample(range(1, 2000), 700))
    df = spark.createDataFrame([("f", s) for s in seqs], "feed string, seq long")
    want = {(b, b - a - 1) for a, b in zip(seqs, seqs[1:]) if b - a > 1}
    for lot in (10**6, 90):
        assert {(r.seq, r.missing) for r in publish.missing(df, rows_per_lot=lot).collect()} == want
        got = {r.seq: r.d for r in metrics.intervals(df, "feed", "seq", F.col("seq") * 10, "d", lot).collect()}
        assert got == {a: b and (b - a) * 10 for a, b in zip(seqs, [*seqs[1:], None])}


def test_bounded_queue_by_lots(spark):
    rnd = random.Random(5)
    rows = [(k, t, rnd.randint(0, 6)) for k in ("x", None) for t in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, arrived long")
    one, many = ({(r.k, r.t): (r.depth, r.dropped) for r in flow.bounded_queue(df, "t", 4, 2, by="k", rows_per_lot=n).collect()} for n in (10**6, 50))
    assert one == many and len(one) == 600


def test_suppression_with_null_keys_and_times(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, 2, 5), (None, 3, 12), ("a", 1, None), ("a", 2, 3), ("a", 3, 4)], "k string, o long, t long")
    got = {(r.k, r.o): r.evaluated for r in flow.suppressed(df, "k", "o", "t", 10).collect()}
    assert got == {(None, 1): True, (None, 2): False, (None, 3): True, ("a", 1): False, ("a", 2): True, ("a", 3): False}


def test_broadcast_refuses_too_many_processors(spark, monkeypatch):
    monkeypatch.setattr(routing, "BROADCAST_ROWS", 3)
    events = spark.createDataFrame([(1,), (2,)], "event_id long")
    assert routing.broadcast_route(events, spark.range(3).selectExpr("cast(id as string) as processor")).count() == 6
    with pytest.raises(ConfigurationError):
        routing.broadcast_route(events, spark.range(4).selectExpr("cast(id as string) as processor"))


def test_ring_and_delta_rules(spark):
    snapshots = spark.createDataFrame([("c", 0, 100), ("c", 10_000, 150), ("d", 59_000, 7)] + [("e", i, i) for i in range(100)], "label string, ts_ms long, value long")
    now = spark.createDataFrame([("c", 175), ("d", 9), ("e", 200), ("none", 5)], "label string, value long")
    delta = lambda w: {r.label: r.delta for r in metrics.ring_delta(snapshots, now, 60_000, w).collect()}
    assert delta(55_000) == {"c": 75, "d": 2, "e": 101, "none": None}  # of e the newest 60 snapshots, 40 to 99
    assert delta(40_000)["c"] == 25 and delta(60_000)["e"] == 160
    assert set(delta(60_001).values()) == {None} and set(delta(0).values()) == {0}


def test_counters_and_statistics(spark):
    c = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "label string, amount long")
    assert {r.label: r.value for r in metrics.every_counter(metrics.counter(c), metrics.counter(c.where("label = 'b'"))).collect()} == {"a": 3, "b": 5}
    r = metrics.statistics(spark.createDataFrame([("f", 1.5), ("f", 2.5), ("f", None)], "feed string, v double"), "feed", "v").first()
    assert (r.n, r.min_v, r.max_v, r.sum_v, r.avg_v) == (2, 1.5, 2.5, 4.0, 2.0)


def test_polls_fire_at_most_so_many(spark):
    timers = flow.fire_times(spark.range(250), F.lit(0), F.lit(5), tick_ms=flow.TICK_MS)
    sizes = {r.poll: r["count"] for r in flow.polls(timers, "id").groupBy("poll").count().collect()}
    assert sizes == {0: 100, 1: 100, 2: 50}


def test_unwrapping(spark):
    df = spark.createDataFrame([(1, ("x",), None), (2, None, "y")], "event_id long, b struct<event:string>, value string")
    assert [r.value for r in publish.unwrapped(df, "b", "event").orderBy("event_id").collect()] == ["x", "y"]
