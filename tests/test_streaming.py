import pytest
from pyspark.sql import functions as F

from rivulet.exceptions import CommandError, ConfigurationError, PublishError, RegistrationError
from rivulet.operators import retry
from rivulet.sources import feeds, lines, sinks
from rivulet.streaming import stateful
from rivulet.streaming.engine import Engine, Feed, Handler


def drain(df, path, checkpoint):
    q = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_line_ranges_hold_every_line_once(tmp_path):
    p = tmp_path / "f"
    p.write_bytes("äb\r\nc\rd\n\né\nlast".encode())
    end = lines.complete(str(p))
    want = ["äb", "c", "d", "", "é"]
    for size in range(1, 12):
        got = [x for r in lines.LineReader(str(p), "EARLIEST", size).partitions({"pos": 0}, {"pos": end}) for x in lines.lines(str(p), *r.values)]
        assert got == want, size
    p.write_bytes(b"a\r")
    assert lines.complete(str(p)) == 0
    p.write_bytes(b"a\rb")
    assert lines.complete(str(p)) == 2
    assert lines.complete(str(tmp_path / "none")) == 0


def test_ranges_read_their_bytes_only(tmp_path, monkeypatch):
    p = tmp_path / "f"
    p.write_bytes(b"".join(b"line %d\r\n" % i for i in range(50_000)) + b"x" * 300_000 + b"\n" + b"end\n")
    end, read = lines.complete(str(p)), []

    class Counting(type(open(p, "rb"))):
        def read(self, n=-1):
            data = super().read(n)
            read.append(len(data))
            return data

    monkeypatch.setattr(lines, "open", lambda path, mode: Counting(open(path, mode).detach()), raising=False)
    got = []
    for r in lines.LineReader(str(p), "EARLIEST", 100_000).partitions({"pos": 0}, {"pos": end}):
        got += list(lines.lines(str(p), *r.values))
    assert got == [f"line {i}" for i in range(50_000)] + ["x" * 300_000, "end"]
    assert sum(read) < 3 * end


def test_strategies_of_the_line_source(spark, tmp_path):
    """What is there and what comes, for every strategy; an unfinished line waits, a missing file is empty, a blank path is refused."""
    lines.register(spark)
    for strategy, want in [("EARLIEST", ["a1", "a2", "a3"]), ("COMMITED", ["a1", "a2", "a3"]), ("LATEST", ["a3"])]:
        p, out, cp = tmp_path / f"{strategy}.txt", str(tmp_path / f"{strategy}.out"), str(tmp_path / f"{strategy}.cp")
        p.write_text("a1\na2\n")
        q = spark.readStream.format("line_tail").option("path", str(p)).option("strategy", strategy).load().writeStream.format("json").option("path", out).option("checkpointLocation", cp).start()
        q.processAllAvailable()
        with p.open("a") as f:
            f.write("a3\nhalf")
        q.processAllAvailable()
        q.stop()
        assert sorted(r.value for r in spark.read.schema("value string").json(out).collect()) == want, strategy
    p = str(tmp_path / "EARLIEST.txt")
    assert [r.value for r in lines.read_once(spark, p).collect()] == ["a1", "a2", "a3"]
    assert lines.read_once(spark, p, "ONCE_LATEST").count() == 0
    assert lines.read_once(spark, str(tmp_path / "none")).count() == 0
    for path, strategy in [(" ", "EARLIEST"), (p, "ONCE_EARLIEST"), (p, "NEVER")]:
        with pytest.raises(Exception, match="line_tail needs a path|is none of"):
            spark.readStream.format("line_tail").option("path", path).option("strategy", strategy).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"x{path.strip()[-3:]}{strategy}")).start().processAllAvailable()


def test_line_tail_resumes_after_its_bytes(spark, tmp_path):
    lines.register(spark)
    p, out, cp = tmp_path / "events.txt", str(tmp_path / "out"), str(tmp_path / "cp")
    p.write_text("item 1\nitem ä2\npart", encoding="utf-8")
    stream = lambda: spark.readStream.format("line_tail").option("path", str(p)).option("rangeBytes", 5).load()
    q = stream().writeStream.format("json").option("path", out).option("checkpointLocation", cp).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.read.json(out).collect()) == ["item 1", "item ä2"]
    with p.open("a", encoding="utf-8") as f:
        f.write("ial 3\nitem 4\n")
    q = stream().writeStream.format("json").option("path", out).option("checkpointLocation", cp).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.read.json(out).collect()) == ["item 1", "item 4", "item ä2", "partial 3"]
    assert lines.read_once(spark, str(p)).count() == 4 and lines.read_once(spark, str(p), "ONCE_LATEST").count() == 0


def test_streamed_numbers_go_on(spark, tmp_path):
    log, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "event_id long, feed string"
    for part in ([(1, "a"), (2, "b"), (3, "a")], [(4, "a"), (5, "b")]):
        feeds.write_log(spark.createDataFrame(part, schema), log)
        drain(stateful.numbered(feeds.stream_log(spark, log, schema)), out, cp)
    assert sorted((r.feed, r.event_id, r.seq) for r in spark.read.json(out).collect()) == [("a", 1, 1), ("a", 3, 2), ("a", 4, 3), ("b", 2, 1), ("b", 5, 2)]


def test_engine(spark, tmp_path):
    log = str(tmp_path / "log")
    feeds.write_log(spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, feed string"), log)
    seen = []
    fn = lambda own: own["prices"].writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(sinks.fan_out({"x": lambda b, i: seen.append(b.count()), "bad": lambda b, i: 1 / 0}))
    config = {"feeds": [{"name": "prices", "path": log, "schema": "event_id long, feed string", "broadcast": True}], "handlers": [{"name": "h", "group": "g", "fn": "h"}]}
    engine = Engine.from_config(spark, config, {"h": fn})
    assert engine.health().first().verdict == "UNKNOWN"
    engine.start("g", "h").awaitTermination(120)
    assert sum(seen) == 2
    assert [(r.grp, r.processor, r.feed) for r in engine.subscriptions().collect()] == [("g", "h", "prices")]
    assert engine.execute("eventSources") == ["prices"]
    assert engine.execute("server.processors.list") == {"g": ["h"]}
    assert engine.execute("server.processors.stop g h") is True and engine.execute("server.processors.stop g h") is False
    with pytest.raises(CommandError):
        engine.execute("nothing")
    with pytest.raises(RegistrationError):
        engine.add_feed(Feed("prices", log))
    with pytest.raises(RegistrationError):
        engine.add_handler(Handler("h", "g", [], fn))
    with pytest.raises(ConfigurationError):
        engine.add_handler(Handler("i", "g", ["nope"], fn))
    with pytest.raises(ConfigurationError):
        Engine.from_config(spark, {"handlers": [{"name": "h"}]}, {})


def test_windowed_counts(spark, tmp_path):
    log, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "event_id long, ts timestamp_ntz, feed string"
    rows = spark.range(20).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)").alias("ts"), F.lit("a").alias("feed"))
    feeds.write_log(rows.where("event_id < 10"), log)
    drain(stateful.windowed_counts(feeds.stream_log(spark, log, schema), "ts", "2 minutes", "1 minute"), out, cp)
    feeds.write_log(rows.where("event_id >= 10"), log)
    drain(stateful.windowed_counts(feeds.stream_log(spark, log, schema), "ts", "2 minutes", "1 minute"), out, cp)
    got = spark.read.json(out).collect()
    assert got and all(r.n == 2 for r in got)


def one_batch(writer, timeout=120):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(timeout)
    assert q.exception() is None


def test_sinks(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "event_id long, feed string, ts timestamp_ntz"
    rows = [(1, "a"), (2, "b"), (None, None)]
    feeds.write_log(spark.createDataFrame(rows, "event_id long, feed string").withColumn("ts", F.expr("timestamp_ntz'2024-01-02 10:00:00'")), log)
    stream = lambda: feeds.stream_log(spark, log, schema)
    one_batch(sinks.text_sink(stream(), str(tmp_path / "text"), F.concat("feed", F.lit(":"), "event_id"), str(tmp_path / "c1")))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["a:1", "b:2"]
    one_batch(sinks.memory_sink(stream().select("event_id"), "held").option("checkpointLocation", str(tmp_path / "c2")))
    assert sorted(r.event_id for r in spark.table("held").collect()) == [1, 2]
    one_batch(sinks.pipe(stream().where("event_id > 1"), str(tmp_path / "pipe"), str(tmp_path / "c3")))
    one_batch(sinks.pipe(feeds.stream_log(spark, str(tmp_path / "pipe"), schema).withColumn("hop", F.lit(2)), str(tmp_path / "end"), str(tmp_path / "c4")))
    assert [(r.event_id, r.hop) for r in spark.read.parquet(str(tmp_path / "end")).collect()] == [(2, 2)]
    one_batch(sinks.audit_sink(stream().where("event_id is not null").withColumnRenamed("feed", "processor"), str(tmp_path / "audit"), str(tmp_path / "c5")))
    assert (tmp_path / "audit" / "processor=a" / "day=2024-01-02").is_dir()


def test_fan_out_policies(spark):
    batch, seen, errors = spark.range(3), [], []

    def flaky(times):
        left = [times]

        def write(b, i):
            if left[0] > 0:
                left[0] -= 1
                raise RuntimeError("down")
            seen.append(b.count())

        return write

    sinks.fan_out({"x": flaky(2)}, "RETRY_THEN_DROP", on_error=lambda n, e: errors.append(n))(batch, 0)
    assert (seen, errors) == ([3], ["x", "x"])
    sinks.fan_out({"x": flaky(9), "y": flaky(0)}, "RETRY_THEN_DROP")(batch, 0)
    sinks.fan_out({"x": flaky(1), "y": flaky(0)}, "CONTINUE")(batch, 0)
    assert seen == [3, 3, 3]
    with pytest.raises(PublishError):
        sinks.fan_out({"x": flaky(1), "y": flaky(0)}, "FAIL_FAST")(batch, 0)
    assert seen == [3, 3, 3]
    with pytest.raises(ConfigurationError):
        sinks.fan_out({}, "SOMETIMES")


def test_breaker_keeps_a_failing_target_out(spark):
    now, calls, errors = [0.0], [], []
    breaker = sinks.Breaker(failures=2, cool_s=10, clock=lambda: now[0])
    state = {"down": True}

    def target(b, i):
        calls.append(i)
        if state["down"]:
            raise RuntimeError("down")

    write = sinks.fan_out({"x": target}, "CONTINUE", wait_s=0, on_error=lambda n, e: errors.append(str(e)), breaker=breaker)
    for i in range(4):
        write(spark.range(1), i)
    assert calls == [0, 1] and errors == ["down", "down", "x is open", "x is open"]
    now[0], state["down"] = 11.0, False
    write(spark.range(1), 4)
    write(spark.range(1), 5)
    assert calls == [0, 1, 4, 5]


def test_batches_that_come_twice_are_there_once(spark, tmp_path):
    target = sinks.once_per_batch(str(tmp_path / "t"))
    for batch_id in (0, 1, 1):
        target(spark.range(5), batch_id)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_offered_feed(spark, tmp_path):
    feed = feeds.OfferedFeed(spark, str(tmp_path / "spool"), "v string")
    for v in ("a", None, "b"):
        feed.offer(v and (v,))
    feed.publish_now(("first",))
    assert feed.drain() == 2 and feed.drain() == 0
    one_batch(sinks.memory_sink(feed.stream(spark), "offered").option("checkpointLocation", str(tmp_path / "c")))
    assert sorted(r.v for r in spark.table("offered").collect()) == ["a", "b", "first"]


def test_streamed_suppression_and_last_values(spark, tmp_path):
    log, out, cp, schema = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp"), "event_id long, feed string, t long"
    for part in ([(1, "a", 0), (2, "a", 5), (3, "b", 1)], [(4, "a", 9), (5, "a", 10), (6, "b", 2)]):
        feeds.write_log(spark.createDataFrame(part, schema), log)
        drain(stateful.suppressed(feeds.stream_log(spark, log, schema), "feed", "event_id", "t", 10), out, cp)
    assert {r.event_id: r.evaluated for r in spark.read.json(out).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}
    q = stateful.last_values(feeds.stream_log(spark, log, schema), "feed", "t").writeStream.format("memory").queryName("last").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.label: r.value for r in spark.table("last").collect()} == {"a": 10, "b": 2}


class Transient(RuntimeError):
    pass


def test_retries_in_a_stream(spark, tmp_path):
    """E1 fails twice and succeeds, E2 always fails, E3 fails with an error that isn't retried."""
    log, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    folder = str(tmp_path)

    def handle(v):
        with open(f"{folder}/{v}.tries", "a+") as f:
            f.seek(0)
            n = len(f.read())
            f.write("x")
        if v == "E3":
            raise ValueError("never")
        if v == "E2" or v == "E1" and n < 2:
            raise RuntimeError("down")
        return v.lower()

    feeds.write_log(spark.createDataFrame([("E0",), ("E1",), ("E2",), ("E3",)], "value string").withColumn("feed", F.lit("f")), log)
    policy = retry.RetryPolicy(attempts=3, initial_ms=0, errors=(RuntimeError,))
    drain(retry.attempted(feeds.stream_log(spark, log, "value string, feed string"), handle, "value", "string", policy), out, cp)
    tried = spark.read.schema("value string, feed string, result string, attempts int, error string").json(out)
    assert {r.value: (r.result, r.attempts) for r in tried.collect()} == {"E0": ("e0", 1), "E1": ("e1", 3), "E2": (None, 3), "E3": (None, 1)}
    assert {r.value: r.error for r in retry.dead_letters(tried).collect()} == {"E2": "RuntimeError: down", "E3": "ValueError: never"}


def test_batches_are_tried_again_or_given_up(spark):
    calls, dead = [], []

    def handler(b, i):
        calls.append(i)
        if i == 1 and calls.count(1) < 3 or i == 2:
            raise Transient("down")
        if i == 3:
            raise ValueError("never")

    write = retry.retrying(handler, lambda b, i: dead.append((i, b.first().error)), retry.RetryPolicy(initial_ms=0))
    for i in range(4):
        write(spark.range(1), i)
    assert calls == [0, 1, 1, 1, 2, 2, 2, 3] and dead == [(2, "Transient: down"), (3, "ValueError: never")]
    assert [retry.RetryPolicy().delay_ms(k) for k in (1, 2, 6, 9)] == [5, 10, 100, 100]
    assert retry.RetryPolicy(errors=()).again(ValueError(), 1) and not retry.RetryPolicy().again(ValueError(), 1)
