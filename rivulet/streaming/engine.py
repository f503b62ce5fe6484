"""Feeds, sinks, services and handlers by name, and the streaming queries between them."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from rivulet.config import ConfigMap
from rivulet.exceptions import CommandError, ConfigurationError, RegistrationError
from rivulet.operators import introspect
from rivulet.sources import lines, sinks
from rivulet.sources.feeds import OfferedFeed, stream_log
from rivulet.streaming.capture import Capture
from rivulet.streaming.health import Health, Status
from rivulet.streaming.monitor import Monitor
from rivulet.streaming.services import Services


@dataclass
class Feed:
    """A source of events: a table (path of Parquet files with a schema), a text file (format "line_tail"), or any object with
    stream(spark) -> DataFrame."""

    name: str
    path: str = ""
    format: str = "parquet"
    schema: str = "value string"
    strategy: str = "COMMITED"
    broadcast: bool = False
    wrap: bool = False
    mapper: Callable[[DataFrame], DataFrame] | None = None
    source: object | None = None

    def stream(self, spark: SparkSession) -> DataFrame:
        if self.source is not None:
            events = self.source.stream(spark)
        elif self.format == "line_tail":
            lines.register(spark)
            events = spark.readStream.format("line_tail").option("path", self.path).option("strategy", self.strategy).load()
        else:
            events = stream_log(spark, self.path, self.schema)
        events = self.mapper(events) if self.mapper else events
        if self.wrap:
            events = events.select(F.lit(self.name).alias("feed"), F.struct(*events.columns).alias("data"))
        return events


@dataclass
class Handler:
    """Events of some feeds (and of all broadcast ones), by feed, to a writer: fn(events by feed[, engine]) -> DataStreamWriter. callback names
    the engine's strategy that each feed's events pass first."""

    name: str
    group: str
    feeds: list[str]
    fn: Callable[..., DataStreamWriter]
    callback: str = "onEvent"


@dataclass
class Sink:
    """Where handlers write by name: open(events, checkpoint) -> DataStreamWriter, after the value mapper."""

    name: str
    open: Callable[[DataFrame, str], DataStreamWriter]
    mapper: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Pipe:
    """A sink whose table is a feed: what one handler writes, others receive."""

    name: str
    path: str
    schema: str
    sink: str = ""
    broadcast: bool = True


@dataclass
class Engine:
    spark: SparkSession
    feeds: dict[str, Feed] = field(default_factory=dict)
    handlers: dict[tuple[str, str], Handler] = field(default_factory=dict)
    queries: dict[tuple[str, str], StreamingQuery] = field(default_factory=dict)
    commands: dict[str, Callable[..., object]] = field(default_factory=dict)
    sinks: dict[str, Sink] = field(default_factory=dict)
    pipes: dict[str, Pipe] = field(default_factory=dict)
    strategies: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    services: Services = field(default_factory=Services)
    checks: Health = field(default_factory=Health)
    monitor: Monitor | None = None
    capture: Capture | None = None
    settings: ConfigMap = field(default_factory=lambda: ConfigMap({}))

    def __post_init__(self) -> None:
        listed = lambda: sorted(self.commands)
        self.commands |= {
            "help": listed,
            "?": listed,
            "commands": listed,
            "eventSources": lambda: sorted(self.feeds),
            "server.service.list": lambda: {n: type(s).__name__ for n, s in sorted(self.services.named.items())},
            "server.processors.list": lambda: {g: sorted(n for h, n in self.handlers if h == g) for g, _ in self.handlers},
            "server.processors.stop": lambda group, name: self.stop(group, name),
            "latency.status": lambda: "latency: not installed" if self.monitor is None else self._latency(),
            "latency.enable": lambda: self._latency(True),
            "latency.disable": lambda: self._latency(False),
            "latency.toggle": lambda: self._latency(not self._monitored().latencies.enabled),
            "latency.reset": self._reset_latency,
            "audit.start": self._audit_start,
            "audit.stop": self._audit_stop,
            "audit.status": self._audit_status,
            "audit.list": lambda: [r.asDict() for r in self._captured().listing().collect()],
        }
        if self.monitor:
            self.spark.streams.addListener(self.monitor)

    @classmethod
    def from_config(cls, spark: SparkSession, config: str | dict, functions: dict[str, Callable]) -> Engine:
        """config, a dict or JSON text: {"feeds": [...], "pipes": [{name, path, schema}], "sinks": [{name, open, mapper}], "services": [{name, make,
        group}], "strategies": {callback: fn}, "handlers": [{name, group, feeds, fn, callback}], "monitoring": true, "audit": folder, "settings": {...}}.
        fn, mapper, open and make name entries of functions."""
        tree = json.loads(config) if isinstance(config, str) else config
        try:
            audit = tree.get("audit")
            engine = cls(spark, monitor=Monitor() if tree.get("monitoring") else None, capture=Capture(spark, audit) if audit else None, settings=ConfigMap(tree.get("settings", {})))
            mapper = lambda x: functions[x["mapper"]] if x.get("mapper") else None
            for x in tree.get("services", []):
                engine.services.register(x["name"], functions[x["make"]](), x.get("group"))
            for x in tree.get("feeds", []):
                source = engine.services.named[x["source"]] if x.get("source") else None
                engine.add_feed(Feed(**{**x, "mapper": mapper(x), "source": source}))
            for x in tree.get("pipes", []):
                engine.add_pipe(Pipe(**x))
            for x in tree.get("sinks", []):
                engine.add_sink(Sink(x["name"], functions[x["open"]], mapper(x)))
            engine.strategies |= {k: functions[f] for k, f in tree.get("strategies", {}).items()}
            for x in tree.get("handlers", []):
                engine.add_handler(Handler(x["name"], x.get("group", "default"), x.get("feeds", []), functions[x["fn"]], x.get("callback", "onEvent")))
        except (KeyError, TypeError) as e:
            raise ConfigurationError(f"bad configuration: {e}") from e
        return engine

    # -- what is there --------------------------------------------------------------------------------------------------

    def add_feed(self, feed: Feed) -> None:
        if feed.name in self.feeds:
            raise RegistrationError(f"feed {feed.name} is there already")
        if feed.source is None and not feed.path.strip():
            raise ConfigurationError(f"feed {feed.name} has no path")
        self.feeds[feed.name] = feed

    def add_sink(self, sink: Sink) -> None:
        if sink.name in self.sinks:
            raise RegistrationError(f"sink {sink.name} is there already")
        self.sinks[sink.name] = sink

    def add_pipe(self, pipe: Pipe) -> None:
        pipe.sink = pipe.sink or f"{pipe.name}.sink"
        self.add_feed(Feed(pipe.name, pipe.path, schema=pipe.schema, broadcast=pipe.broadcast))
        self.add_sink(Sink(pipe.sink, lambda events, checkpoint: sinks.pipe(events, pipe.path, checkpoint)))
        self.pipes[pipe.name] = pipe

    def add_handler(self, handler: Handler) -> None:
        key = (handler.group, handler.name)
        if key in self.handlers:
            raise RegistrationError(f"{handler.name} is in group {handler.group} already")
        if unknown := [f for f in handler.feeds if f not in self.feeds]:
            raise ConfigurationError(f"{handler.name} subscribes to unknown feeds {unknown}")
        if handler.callback != "onEvent" and handler.callback not in self.strategies:
            raise ConfigurationError(f"{handler.name} needs the unknown strategy {handler.callback}")
        self.handlers[key] = handler
        up = lambda: Status("UNKNOWN", "not started") if (q := self.queries.get(key)) is None else Status("UP") if q.isActive else Status("DOWN", "query ended")
        self.checks.register(handler.name, "up", up, cache_ms=0)
        if self.capture:
            self.capture.attach(handler.name, lambda: self._records(handler))

    def on(self, *feeds: str, name: str | None = None, group: str = "default") -> Callable:
        """A decorator that adds a function as the handler of some feeds."""

        def add(fn: Callable[..., DataStreamWriter]) -> Callable[..., DataStreamWriter]:
            self.add_handler(Handler(name or fn.__name__, group, list(feeds), fn))
            return fn

        return add

    def add_command(self, name: str, function: Callable[..., object]) -> None:
        self.commands[name] = function

    def add_command_feed(self, name: str, path: str) -> OfferedFeed:
        """A command whose calls are events of the feed ``adminCommand.<name>``: command, args."""
        offered = OfferedFeed(self.spark, path, "command string, args array<string>")
        self.add_feed(Feed(f"adminCommand.{name}", source=offered, schema=offered.schema))
        self.commands[name] = lambda *args: offered.publish_now((name, list(args)))
        return offered

    # -- running --------------------------------------------------------------------------------------------------------

    def start(self, group: str, name: str) -> StreamingQuery:
        key = (group, name)
        if key not in self.handlers:
            raise RegistrationError(f"no {name} in group {group}")
        if key in self.queries and self.queries[key].isActive:
            return self.queries[key]
        handler = self.handlers[key]
        self.services.start()
        self.services.inject(handler.fn)
        own = {}
        for f in self._feeds_of(handler):
            events = self.feeds[f].stream(self.spark)
            events = self.strategies[handler.callback](events) if handler.callback in self.strategies else events
            own[f] = self.monitor.observed(events, f) if self.monitor else events
        takes = len(inspect.signature(handler.fn).parameters)
        writer = handler.fn(own, self) if takes > 1 else handler.fn(own)
        self.queries[key] = writer.queryName(f"{group}.{name}").start()
        return self.queries[key]

    def stop(self, group: str, name: str) -> bool:
        query = self.queries.pop((group, name), None)
        if query is None:
            return False
        query.stop()
        return True

    def shut_down(self) -> None:
        """Stops captures, queries and services."""
        if self.capture:
            self.capture.stop_all()
        for key in list(self.queries):
            self.stop(*key)
        self.services.stop()
        if self.monitor:
            self.spark.streams.removeListener(self.monitor)

    def write(self, sink: str, events: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A writer of events to the named sink."""
        if sink not in self.sinks:
            raise ConfigurationError(f"no sink {sink}")
        own = self.sinks[sink]
        return own.open(own.mapper(events) if own.mapper else events, checkpoint)

    def execute(self, line: str) -> object:
        """An admin command: words by spaces, the first is its name."""
        name, *args = line.split()
        if name not in self.commands:
            raise CommandError(f"unknown command {name}")
        try:
            return self.commands[name](*args)
        except TypeError as e:
            raise CommandError(f"{name}: {e}") from e

    # -- views ------------------------------------------------------------------------------------------------------------

    def subscriptions(self) -> DataFrame:
        rows = [(h.group, h.name, f, h.callback) for h in self.handlers.values() for f in self._feeds_of(h)]
        return self.spark.createDataFrame(rows, "grp string, processor string, feed string, callback string")

    def topology(self) -> DataFrame:
        return introspect.feed_topology(self.subscriptions())

    def health(self) -> DataFrame:
        """A row for each check. Every handler has one named up: UP while its query runs, DOWN after it ended, UNKNOWN before its start."""
        return self.checks.table(self.spark)

    def orphans(self) -> list[str]:
        return self.services.warn_of_orphans(self.feeds)

    # -- parts of commands --------------------------------------------------------------------------------------------------

    def _feeds_of(self, handler: Handler) -> list[str]:
        return list(dict.fromkeys([*handler.feeds, *(f.name for f in self.feeds.values() if f.broadcast)]))

    def _records(self, handler: Handler) -> DataFrame:
        """What the handler receives, as feed, ts (of its capture) and the event as JSON."""
        out = None
        for f in self._feeds_of(handler):
            own = self.feeds[f].stream(self.spark).select(F.lit(f).alias("feed"), F.current_timestamp().alias("ts"), F.to_json(F.struct("*")).alias("event"))
            out = own if out is None else out.unionByName(own)
        if out is None:
            raise CommandError(f"{handler.name} has no feed to capture")
        return out

    def _monitored(self) -> Monitor:
        if self.monitor is None:
            raise CommandError("latency: not installed")
        return self.monitor

    def _latency(self, enabled: bool | None = None) -> str:
        latencies = self._monitored().latencies
        latencies.enabled = latencies.enabled if enabled is None else enabled
        return f"latency: {'ENABLED' if latencies.enabled else 'DISABLED'}"

    def _reset_latency(self) -> str:
        self._monitored().latencies.reset()
        return "latency: histograms reset"

    def _captured(self) -> Capture:
        if self.capture is None:
            raise CommandError("audit: not installed")
        return self.capture

    def _audit_start(self, processor: str) -> str:
        self._captured().start(processor)
        return f"audit: RECORDING {processor}"

    def _audit_stop(self, processor: str) -> str:
        self._captured().stop(processor)
        return f"audit: STOPPED {processor}"

    def _audit_status(self, processor: str | None = None) -> object:
        capture = self._captured()
        if processor is None:
            return sorted(n for _, n in self.handlers if capture.recording(n))
        return f"audit: {processor} {'RECORDING' if capture.recording(processor) else 'idle'}"
