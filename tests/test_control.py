"""The control plane: health, counters, capture, services, configuration, commands."""

import json
import time

import pytest
from pyspark.sql import functions as F

from rivulet.config import ConfigKey, ConfigMap
from rivulet.exceptions import CommandError, ConfigurationError, RegistrationError
from rivulet.operators import health as rollups
from rivulet.operators import metrics
from rivulet.sources import feeds, sinks
from rivulet.streaming.engine import Engine, Feed, Handler
from rivulet.streaming.health import Health, Status
from rivulet.streaming.monitor import Counters, Latencies
from rivulet.streaming.services import Services

SCHEMA = "event_id long, feed string, v long"


def until(condition, seconds=60):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end, "it did not come about"
        time.sleep(0.2)


def log_of(spark, path, rows):
    feeds.write_log(spark.createDataFrame(rows, SCHEMA), path)


def test_checks_are_cached_silenced_and_closed(spark):
    now, calls = [100.0], []
    health = Health(clock=lambda: now[0])

    def slow():
        calls.append(1)
        return Status("DEGRADED", "slow")

    check = health.register("s", "slow", slow)
    health.register("s", "fine", lambda: "UP")
    assert health.verdict("s") == Status("DEGRADED", "slow", 100_000) and health.status("s", "slow").reason == "slow"
    assert len(calls) == 1
    now[0] += 1
    health.status("s", "slow")
    assert len(calls) == 2
    check.cache_ms = 0
    health.status("s", "slow")
    health.status("s", "slow")
    assert len(calls) == 4
    check.enabled = False
    assert health.verdict("s").verdict == "UP"
    health.register("t", "bad", lambda: 1 / 0)
    health.register("t", "none", lambda: None)
    assert health.status("t", "bad").reason == "check threw: ZeroDivisionError" and health.status("t", "none").verdict == "UNKNOWN"
    assert {r.service: r.verdict for r in rollups.rollup(health.table(spark)).collect()} == {"s": "UP", "t": "UNKNOWN"}
    health.close("s", "fine")
    assert health.verdict("s").reason == "all checks silenced"
    health.close("s")
    assert health.verdict("s").reason == "no checks registered" and health.status("s", "fine").reason == "check not registered"


def test_counters_and_latencies(spark):
    c = Counters()
    c.increment("a")
    c.increment("a", 2)
    c.set("g", 7)
    for t in range(70):
        c.snapshot(t * 1000)
    c.increment("a", 10)
    assert c.every() == {"a": 3 + 10, "g": 7} and c.get("none") == 0
    assert c.snapshots(spark).select("ts_ms").distinct().count() == 60
    delta = {r.label: r.delta for r in metrics.ring_delta(c.snapshots(spark), c.table(spark), 69_000, 30_000).collect()}
    assert delta == {"a": 10, "g": 0}
    latencies = Latencies()
    for ms in [*range(1, 1001), -5, 4_000_000]:
        latencies.record("p", "n", ms)
    r = latencies.read(spark).first()
    assert (r["count"], r.p50, r.p90, r.p99, r.p999, r["max"]) == (1001, 501, 901, 991, 1000, 3_600_000)
    assert latencies.read(spark).count() == 0
    latencies.enabled = False
    latencies.record("p", "n", 1)
    assert latencies.read(spark).count() == 0


def test_live_counters_of_queries(spark, tmp_path):
    log = str(tmp_path / "log")
    log_of(spark, log, [(1, "a", 1), (2, "b", 2), (3, "a", 3)])
    engine = Engine.from_config(spark, json.dumps({"monitoring": True, "feeds": [{"name": "prices", "path": log, "schema": SCHEMA}]}), {})

    @engine.on("prices", name="h")
    def handle(own):
        return own["prices"].writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)

    engine.start("default", "h").awaitTermination(120)
    counters = engine.monitor.counters
    until(lambda: counters.get("processor.h.events") == 3)
    assert counters.get("feed.prices.published") == 3 and counters.get("group.default.processed") == 1
    assert "triggerExecution" in {r.node for r in engine.monitor.latencies.read(spark).collect()}
    assert engine.execute("latency.status") == "latency: ENABLED" and engine.execute("latency.toggle") == "latency: DISABLED"
    assert engine.execute("latency.enable") == "latency: ENABLED" and engine.execute("latency.reset") == "latency: histograms reset"
    assert "server.service.list" in engine.execute("?") == engine.execute("commands")
    engine.shut_down()
    bare = Engine(spark)
    assert bare.execute("latency.status") == "latency: not installed"
    for command in ("latency.enable", "audit.start x", "audit.list", "audit.start", "nothing"):
        with pytest.raises(CommandError):
            bare.execute(command)


def test_capture_is_idempotent_and_listed(spark, tmp_path):
    log = str(tmp_path / "log")
    log_of(spark, log, [(1, "a", 1), (2, "b", 2)])
    engine = Engine.from_config(spark, {"audit": str(tmp_path / "audit"), "feeds": [{"name": "prices", "path": log, "schema": SCHEMA}]}, {})
    for name in ("h", "i"):
        engine.add_handler(Handler(name, "g", ["prices"], lambda own: own["prices"].writeStream.format("noop")))
    assert engine.execute("audit.list") == [] and engine.execute("audit.status") == []
    with pytest.raises(CommandError):
        engine.capture.start("nobody")
    for name in ("h", "i"):
        query = engine.capture.start(name)
        assert engine.execute(f"audit.start {name}") == f"audit: RECORDING {name}" and engine.capture.start(name) is query
        query.processAllAvailable()
    assert engine.execute("audit.status h") == "audit: h RECORDING"
    assert engine.execute("audit.stop h") == "audit: STOPPED h" == engine.execute("audit.stop h")
    found = engine.execute("audit.list")
    assert [(r["processor"], r["is_live"]) for r in found] == [("i", True), ("h", False)] and all(r["size_bytes"] > 0 for r in found)
    assert engine.execute("audit.status") == ["i"]
    records = spark.read.parquet(str(tmp_path / "audit" / "records" / "h"))
    assert sorted(json.loads(r.event)["event_id"] for r in records.collect()) == [1, 2]
    engine.shut_down()
    assert not engine.capture.recording("i")


class Clock:
    def __init__(self):
        self.steps = []

    def start(self):
        self.steps.append("start")

    def start_complete(self):
        self.steps.append("complete")

    def stop(self):
        self.steps.append("stop")


class FastClock(Clock):
    pass


def test_services_start_are_injected_and_refused_twice():
    services = Services()
    plain, fast = Clock(), FastClock()
    services.register("fast", fast, group="workers")
    services.register("plain", plain)
    with pytest.raises(RegistrationError):
        services.register("plain", Clock())
    got = []

    class Target:
        def use_clock(self, clock: Clock) -> None:
            got.append(clock)

        def use_named(self, clock: FastClock, name: str) -> None:
            got.append((clock, name))

        def use_other(self, text: str) -> None:
            got.append(text)

    assert services.inject(Target()) == 3 and got == [plain, fast, (fast, "fast")]
    services.start()
    late = Clock()
    services.register("late", late)
    assert plain.steps == fast.steps == ["start", "complete"] and late.steps == ["start"]
    assert services.remove("late") is late and late.steps == ["start", "stop"]
    services.stop()
    assert plain.steps[-1] == fast.steps[-1] == "stop"
    with pytest.raises(RegistrationError):
        services.remove("late")


def test_sinks_pipes_strategies_and_sources_by_configuration(spark, tmp_path):
    """A source of one's own, a strategy, a pipe between two handlers, a sink with a mapper."""
    log = str(tmp_path / "log")
    log_of(spark, log, [(1, "a", 1), (2, "b", 200)])

    class Source:
        def stream(self, spark):
            return feeds.stream_log(spark, log, SCHEMA)

    cp = lambda n: str(tmp_path / n)
    functions = {
        "make": Source,
        "big": lambda events: events.where("v > 100"),
        "first": lambda own, engine: engine.write("hop.sink", own["prices"].select("event_id", "v"), cp("c1")).trigger(availableNow=True),
        "second": lambda own, engine: engine.write("out", own["hop"], cp("c2")).trigger(availableNow=True),
        "text": lambda events, checkpoint: sinks.text_sink(events, cp("text"), F.col("line"), checkpoint),
        "lines": lambda events: events.withColumn("line", F.concat_ws("=", "event_id", "v")),
    }
    config = {
        "services": [{"name": "src", "make": "make"}, {"name": "orphan", "make": "make"}],
        "feeds": [{"name": "prices", "source": "src"}],
        "pipes": [{"name": "hop", "path": cp("hop"), "schema": "event_id long, v long", "broadcast": False}],
        "sinks": [{"name": "out", "open": "text", "mapper": "lines"}],
        "strategies": {"onBig": "big"},
        "handlers": [{"name": "one", "feeds": ["prices"], "fn": "first", "callback": "onBig"}, {"name": "two", "feeds": ["hop"], "fn": "second"}],
        "settings": {"depth": 3},
    }
    engine = Engine.from_config(spark, config, functions)
    for name in ("one", "two"):
        engine.start("default", name).awaitTermination(120)
    assert [r.value for r in spark.read.text(cp("text")).collect()] == ["2=200"]
    assert [(p.name, p.sink) for p in engine.pipes.values()] == [("hop", "hop.sink")]
    with pytest.warns(UserWarning, match="orphan"):
        assert engine.orphans() == ["orphan"]
    assert engine.settings.require(ConfigKey("depth", int)) == 3
    assert {(r.feed, r.consumers[0].callback) for r in engine.topology().collect()} == {("prices", "onBig"), ("hop", "onEvent")}
    assert engine.execute("server.service.list") == {"orphan": "Source", "src": "Source"}
    for bad in ({"handlers": [{"name": "x", "fn": "first", "callback": "onNothing"}]}, {"sinks": [{"name": "s", "open": "nope"}]}, {"pipes": [{"name": "p", "path": "", "schema": "v long"}]}):
        with pytest.raises(ConfigurationError):
            Engine.from_config(spark, bad, functions)
    with pytest.raises(ConfigurationError):
        engine.write("nowhere", None, "")
    with pytest.raises(RegistrationError):
        engine.add_sink(engine.sinks["out"])
    engine.shut_down()


def test_commands_as_a_feed(spark, tmp_path):
    engine = Engine(spark)
    engine.add_command("ping", lambda *a: ("pong", *a))
    engine.add_command_feed("resize", str(tmp_path / "spool"))
    assert engine.execute("ping 1") == ("pong", "1")
    engine.execute("resize big 7")

    @engine.on("adminCommand.resize", name="h")
    def handle(own):
        return own["adminCommand.resize"].writeStream.format("memory").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)

    engine.add_handler(Handler("twin", "g", [], handle))
    q = handle({"adminCommand.resize": engine.feeds["adminCommand.resize"].stream(spark)}).queryName("resized").start()
    q.awaitTermination(120)
    assert [(r.command, r.args) for r in spark.table("resized").collect()] == [("resize", ["big", "7"])]
    with pytest.raises(RegistrationError):
        engine.add_feed(Feed("adminCommand.resize", "x"))


def test_config_map():
    c = ConfigMap({"a": 1, "b": "x"})
    assert c.get("a") == 1 and c.get("z", 5) == 5 and c.get(ConfigKey("a", int)) == 1 and c.get(ConfigKey("z", int), 9) == 9
    assert c.require(ConfigKey("b", str)) == "x"
    for key in (ConfigKey("b", int), ConfigKey("z", int)):
        with pytest.raises(ConfigurationError):
            c.require(key)
    with pytest.raises(ConfigurationError):
        c.get(ConfigKey("a", str))
