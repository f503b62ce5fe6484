"""The registered queries over the event tables; every one has SQL in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import scalar
from rivulet.operators import flow, health, introspect, metrics, publish, replay, retry, routing
from rivulet.operators.sequence import numbered
from rivulet.plans.oracles import ORACLES
from rivulet.sources import sinks
from rivulet.sources.feeds import feed_table, stream_log
from rivulet.sources.places import shared_folder

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, feed, value, props."""
    return feed_table(spark, f"{sf_dir}/events.parquet", feed="event_type")


def rows(spark: SparkSession, columns: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), columns)


def ntz(day: str):
    return F.lit(day).cast("timestamp_ntz")


def payload():
    return F.get_json_object("props", "$.k").cast("bigint")


SUBS = "processor string, feed string"


# -- publishing -------------------------------------------------------------------------------------------------------


@query
def feed_publish(spark, sf_dir):
    return publish.publish(events(spark, sf_dir)).select("event_id", "feed", "user_id", "value", "seq")


@query
def value_mapper(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.upper("feed").alias("mapped_feed"), payload().alias("k"))


@query
def mapper_null_drop(spark, sf_dir):
    return publish.publish(events(spark, sf_dir), mapped=F.when(F.col("value") >= 20, F.col("value"))).select("event_id", "feed", "seq")


@query
def mapper_errors(spark, sf_dir):
    text = events(spark, sf_dir).select("feed", F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("event_id").cast("string")).alias("value"))
    failed = F.expr("try_cast(value AS bigint)").isNull()
    return text.groupBy("feed").agg(F.count("*").alias("published"), F.sum(failed.cast("bigint")).alias("failed"))


@query
def named_envelope(spark, sf_dir):
    e = publish.envelope(publish.publish(events(spark, sf_dir)), F.col("value"))
    return e.select(F.concat_ws("/", "envelope.feed", F.col("envelope.seq").cast("string")).alias("envelope_key"), F.col("envelope.data").alias("data"))


@query
def wrap_matrix(spark, sf_dir):
    flags = rows(spark, "wrap boolean, bcast boolean", *[(w, b) for w in (True, False) for b in (True, False)])
    return flags.withColumn("strategy", scalar.wrap_strategy(F.col("wrap"), F.col("bcast")))


@query
def batch_flatten(spark, sf_dir):
    """Turns packed into a batch for each conversation, and taken out again in order."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    batches = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("items"))
    return publish.flatten(batches).select("conv_id", "item.turn", "item.role")


@query
def merge_feeds(spark, sf_dir):
    e = events(spark, sf_dir)
    return publish.merge(*[routing.subscribed(e, [f]) for f in ("click", "view")]).select("event_id", "feed", "pos")


@query
def gap_detect(spark, sf_dir):
    sent = publish.publish(events(spark, sf_dir))
    return publish.missing(sent.where(F.col("event_id") % 10 != 0))


# -- routing ----------------------------------------------------------------------------------------------------------


@query
def named_subscription(spark, sf_dir):
    return routing.subscribed(events(spark, sf_dir), ["purchase", "signup"]).select("event_id", "feed", "value")


@query
def subscription_route(spark, sf_dir):
    subs = rows(spark, SUBS, ("p1", "purchase"), ("p1", "signup"), ("p2", "purchase"), ("p3", "error"))
    return routing.route(events(spark, sf_dir), subs).select("processor", "feed", "event_id")


@query
def subscription_dedupe(spark, sf_dir):
    subs = rows(spark, SUBS, ("p1", "purchase"), ("p1", "purchase"), ("p2", "error"))
    return routing.route(events(spark, sf_dir), routing.active(subs)).select("processor", "event_id")


@query
def unsubscribe(spark, sf_dir):
    subs = rows(spark, SUBS, ("p1", "purchase"), ("p2", "purchase"), ("p2", "error"))
    return routing.route(events(spark, sf_dir), routing.active(subs, rows(spark, SUBS, ("p2", "purchase")))).select("processor", "event_id")


@query
def listener_count(spark, sf_dir):
    return routing.listeners(rows(spark, SUBS, ("p1", "purchase"), ("p2", "purchase"), ("p3", "error")))


@query
def broadcast_route(spark, sf_dir):
    return routing.broadcast_route(events(spark, sf_dir), rows(spark, "processor string", ("p1",), ("p2",), ("p3",))).select("processor", "event_id")


@query
def group_fanout(spark, sf_dir):
    """Events are summed by feed before the join fans them out."""
    subs = rows(spark, f"grp string, {SUBS}", ("g1", "p1", "purchase"), ("g1", "p2", "purchase"), ("g2", "p3", "purchase"))
    by_feed = events(spark, sf_dir).groupBy("feed").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return routing.route(by_feed, subs).groupBy("grp", "processor").agg(F.sum("n").alias("delivered"), F.round(F.sum("v"), 2).alias("total_value"))


@query
def typed_dispatch(spark, sf_dir):
    marked = F.col("feed").isin("purchase", "signup")
    return routing.dispatch(events(spark, sf_dir), [(marked, "onString", F.upper("feed"))], ("onEvent", F.col("feed"))).select("event_id", "delivered", "callback")


@query
def late_subscriber(spark, sf_dir):
    subs = rows(spark, f"{SUBS}, since timestamp_ntz", ("p1", "purchase", datetime(2024, 1, 1)), ("p2", "purchase", datetime(2024, 1, 20)))
    return routing.route(events(spark, sf_dir), subs, since="since").select("processor", "event_id")


@query
def service_match(spark, sf_dir):
    services = rows(spark, "name string, iface string", ("s1", "Sink"), ("s2", "FileSink"), ("s3", "Clock"))
    isa = rows(spark, "child string, parent string", ("Sink", "Sink"), ("FileSink", "FileSink"), ("FileSink", "Sink"), ("Clock", "Clock"))
    return routing.matching_services(rows(spark, "target string, iface string", ("h1", "Sink"), ("h2", "Clock")), services, isa)


@query
def pipe_chain(spark, sf_dir):
    """One query's output feed is the next one's input."""
    piped = events(spark, sf_dir).where("value > 100").select(F.concat(F.lit("big."), "feed").alias("feed"))
    return piped.groupBy("feed").agg(F.count("*").alias("n"))


# -- flow -------------------------------------------------------------------------------------------------------------


@query
def duty_cycle_batches(spark, sf_dir):
    cycles = flow.duty_cycles(publish.publish(events(spark, sf_dir)))
    return cycles.groupBy("feed", "cycle").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query
def queue_depth(spark, sf_dir):
    return flow.queue_depth(flow.arrivals(events(spark, sf_dir), scalar.truncated("hour", F.col("ts")), "hour"), "hour", drained=3)


@query
def bounded_queue_drop(spark, sf_dir):
    return flow.bounded_queue(flow.arrivals(events(spark, sf_dir), scalar.truncated("hour", F.col("ts")), "hour"), "hour", capacity=4, drained=2)


@query
def check_cache(spark, sf_dir):
    e = numbered(events(spark, sf_dir), ["feed"], "event_id", "i").select(F.col("feed").alias("chk"), "i", scalar.epoch_ms(F.col("ts")).alias("t"))
    return flow.suppressed(e, "chk", "i", "t", interval=3_600_000).select("chk", "i", "evaluated")


@query
def scheduler_fire(spark, sf_dir):
    return flow.fire_times(events(spark, sf_dir), scalar.epoch_ms(F.col("ts")), payload()).select("event_id", "fire_ms")


@query
def reentrant(spark, sf_dir):
    made = F.concat(F.lit("Re-Entrant Event ["), F.col("i").cast("string"), F.lit("]"))
    return flow.reentrant(events(spark, sf_dir), F.col("event_id") % 4 + 1, made).select("event_id", "emitted")


# -- counters and latencies -------------------------------------------------------------------------------------------


@query
def counter_feed_published(spark, sf_dir):
    return metrics.published(events(spark, sf_dir))


@query
def counter_group_cycles(spark, sf_dir):
    return metrics.busy_cycles(flow.duty_cycles(publish.publish(events(spark, sf_dir))))


@query
def counter_idle_cycles(spark, sf_dir):
    return metrics.idle_cycles(events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts")), "feed", "hour")


@query
def counter_processor_node(spark, sf_dir):
    nodes = rows(spark, "processor string, node string, feed string", ("pnl", "a", "purchase"), ("pnl", "b", "purchase"), ("risk", "c", "error"))
    return metrics.node_invocations(events(spark, sf_dir), nodes)


@query
def gauge_last(spark, sf_dir):
    return metrics.gauge(events(spark, sf_dir), "feed", "value")


@query
def node_intervals(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("user_id", "cycle")
    return metrics.intervals(e, "cycle", "event_id", scalar.epoch_us(F.col("ts")), "elapsed_us").select("cycle", "event_id", "elapsed_us")


@query
def latency_percentiles(spark, sf_dir):
    e = metrics.intervals(events(spark, sf_dir), F.date_trunc("day", "ts"), "event_id", scalar.epoch_us(F.col("ts")), "us")
    ms = F.least(F.floor(F.col("us") / 1000).cast("bigint"), F.lit(scalar.LATENCY_CEILING))  # an interval that is still open counts as the ceiling
    return metrics.percentiles(e.withColumnRenamed("feed", "node"), "node", ms)


@query
def latency_summary(spark, sf_dir):
    return metrics.summary(events(spark, sf_dir), "feed", "value")


@query
def throughput_rate(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy("feed", scalar.truncated("day", F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    return metrics.change(counts, "feed", "day", "n")


@query
def counter_delta(spark, sf_dir):
    from pyspark.sql import Window

    hours = flow.arrivals(events(spark, sf_dir), scalar.truncated("hour", F.col("ts")), "hour")
    snapshots = hours.select("hour", F.sum("arrived").over(Window.orderBy("hour")).alias("v"))  # a row for each hour
    return metrics.delta(snapshots, "hour", "v", str(6 * 3600))


# -- health, errors, introspection ------------------------------------------------------------------------------------


@query
def health_rollup(spark, sf_dir):
    verdict = F.when(F.col("feed") == "error", "DOWN").when(F.col("feed") == "signup", "DEGRADED").when(F.col("feed") == "view", "UNKNOWN").otherwise("UP")
    enabled = (F.col("feed") != "error") | (F.col("user_id") % 2 == 0)
    return health.rollup(events(spark, sf_dir).select(F.col("user_id").alias("service"), verdict.alias("verdict"), enabled.alias("enabled")))


@query
def error_ring(spark, sf_dir):
    errors = routing.subscribed(events(spark, sf_dir), ["error"]).withColumnRenamed("user_id", "service")
    return retry.ring(errors, "service").select("service", "event_id", "rn")


@query
def error_recent(spark, sf_dir):
    return retry.recent(routing.subscribed(events(spark, sf_dir), ["error"]).select("event_id", "user_id"))


@query
def retry_schedule(spark, sf_dir):
    return retry.schedule(events(spark, sf_dir), F.col("event_id") % 5).select("event_id", "attempts", "dropped", "backoff_ms")


@query
def topology(spark, sf_dir):
    return introspect.topology(rows(spark, f"grp string, {SUBS}", ("g1", "p1", "purchase"), ("g1", "p2", "purchase"), ("g2", "p3", "error")))


@query
def audit_list(spark, sf_dir):
    return introspect.audit(events(spark, sf_dir), "feed", "props")


@query
def command_parse(spark, sf_dir):
    words = scalar.command_words(F.concat(F.lit("  audit.start "), "feed", F.lit(" ")))
    parsed = events(spark, sf_dir).select(words.alias("w")).select(F.col("w")[0].alias("command"), F.col("w")[1].alias("arg"))
    return parsed.groupBy("command", "arg").agg(F.count("*").alias("n"))


# -- replay and sources -----------------------------------------------------------------------------------------------


@query
def data_clock(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("wall", F.when(F.col("event_id") % 3 == 0, scalar.epoch_ms(F.col("ts"))))
    return replay.data_clock(e, "wall").select("event_id", "clock_ms")


@query
def cache_then_live(spark, sf_dir):
    return replay.cache_then_live(events(spark, sf_dir), ntz("2024-01-10")).select("event_id", "phase", "dispatched_at")


@query
def event_log(spark, sf_dir):
    return replay.event_log(events(spark, sf_dir), ntz("2024-01-10")).select("feed", "seq", "event_id")


@query
def catchup_then_live(spark, sf_dir):
    e = events(spark, sf_dir)
    cut = ntz("2024-01-15")
    return replay.catchup_then_live(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)).select("event_id", "mode")


@query
def read_strategy(spark, sf_dir):
    e = events(spark, sf_dir)
    existing, committed = F.col("ts") < ntz("2024-01-15"), F.col("event_id") < 100
    first, *rest = [replay.read(e, s, existing, committed).select(F.lit(s).alias("strategy"), "event_id") for s in replay.STRATEGIES]
    for r in rest:
        first = first.unionByName(r)
    return first


@query
def latest_per_batch(spark, sf_dir):
    return replay.latest_per_batch(events(spark, sf_dir), scalar.truncated("day", F.col("ts")))


@query
def file_sink_lines(spark, sf_dir):
    return events(spark, sf_dir).select(F.concat_ws(",", F.col("event_id").cast("string"), "feed").alias("line"))


# -- the same by stream, and what the operators above leave out ---------------------------------------------------------


def streamed(spark, sf_dir) -> DataFrame:
    """The events table as a stream; the glob fits a file and a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumnRenamed("event_type", "feed")


def finish(writer) -> None:
    """Runs a query over what is there."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@query
def file_sink_written(spark, sf_dir):
    """Lines that a stream wrote to text files."""
    place = shared_folder(spark)
    line = F.concat_ws(",", F.col("event_id").cast("string"), "feed")
    finish(sinks.text_sink(streamed(spark, sf_dir), f"{place}/lines", line, f"{place}/checkpoint"))
    return spark.read.text(f"{place}/lines").select(F.col("value").alias("line"))


@query
def pipe_stream(spark, sf_dir):
    """One stream's pipe is the next one's feed."""
    place = shared_folder(spark)
    big = streamed(spark, sf_dir).where("value > 100").select("event_id", F.concat(F.lit("big."), "feed").alias("feed"))
    finish(sinks.pipe(big, f"{place}/pipe", f"{place}/first"))
    finish(sinks.pipe(stream_log(spark, f"{place}/pipe", "event_id bigint, feed string"), f"{place}/end", f"{place}/second"))
    return spark.read.parquet(f"{place}/end").groupBy("feed").agg(F.count("*").alias("n"))


@query
def mapper_isolation(spark, sf_dir):
    """Failed mappings become dead letters, and the others go on."""
    text = events(spark, sf_dir).select("feed", F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("event_id").cast("string")).alias("value"))
    good, dead = publish.map_safely(text, F.expr("try_cast(value AS bigint)"))
    both = good.select("feed", F.lit(0).alias("bad"), "value").unionByName(dead.select("feed", F.lit(1).alias("bad"), F.lit(None).cast("bigint").alias("value")))
    return both.groupBy("feed").agg(F.count("*").alias("published"), F.sum("bad").cast("bigint").alias("failed"), F.sum("value").alias("mapped"))


@query
def broadcast_unwrap(spark, sf_dir):
    wrapped = events(spark, sf_dir).withColumn("envelope", F.when(F.col("feed") == "error", F.struct((F.col("value") * 2).alias("event"))))
    return publish.unwrapped(wrapped, "envelope", "event").select("event_id", "value")


@query
def counter_processor_events(spark, sf_dir):
    subs = rows(spark, SUBS, ("p1", "purchase"), ("p1", "signup"), ("p2", "purchase"), ("p3", "error"))
    return metrics.processor_events(events(spark, sf_dir), subs)


@query
def counters_every(spark, sf_dir):
    e = events(spark, sf_dir)
    weights = metrics.counter(e.select(scalar.label("feed", F.col("feed"), "weight").alias("label"), payload().alias("amount")))
    return metrics.every_counter(metrics.published(e), counter_processor_events(spark, sf_dir), weights)


@query
def summary_statistics(spark, sf_dir):
    return metrics.statistics(events(spark, sf_dir), "feed", "value")


@query
def counter_ring_delta(spark, sf_dir):
    samples = events(spark, sf_dir).select(F.col("feed").alias("label"), scalar.epoch_ms(F.col("ts")).alias("ts_ms"), F.col("event_id").alias("value"))
    now = samples.groupBy("label").agg((F.max("value") + 100).alias("value"))
    return metrics.ring_delta(samples, now, samples.agg(F.max("ts_ms")).first()[0] + 10_000, 60_000)


@query
def timer_wheel(spark, sf_dir):
    timers = flow.fire_times(events(spark, sf_dir), scalar.epoch_ms(F.col("ts")), payload(), tick_ms=flow.TICK_MS)
    return flow.polls(timers, "event_id").select("event_id", "fire_ms", "poll")


@query
def audit_listing(spark, sf_dir):
    """Captures on disk and live ones; a processor that has both is listed as live."""
    e = events(spark, sf_dir)
    live = e.where(F.col("feed").isin("click", "view") & (F.col("ts") >= ntz("2024-01-15")))
    return introspect.audit_list(introspect.audit(e, "feed", "props"), introspect.audit(live, "feed", "props"))


@query
def retry_attempts(spark, sf_dir):
    """A handler that fails for some events, with an error that is retried and with one that isn't."""

    def handle(event_id: int) -> int:
        if event_id % 5 == 3:
            raise RuntimeError("busy")
        if event_id % 5 == 4:
            raise ValueError("bad")
        return event_id * 2

    tried = retry.attempted(events(spark, sf_dir).select("event_id"), handle, "event_id", "bigint", retry.RetryPolicy(initial_ms=0))
    return tried.select("event_id", "result", F.col("attempts").cast("bigint").alias("attempts"), "error")


@query
def poison_drop(spark, sf_dir):
    return retry.dead_letters(retry.schedule(events(spark, sf_dir), F.col("event_id") % 5)).select("event_id", "attempts", "severity")


@query
def clock_units(spark, sf_dir):
    ns = scalar.epoch_us(F.col("ts")) * 1000 + 7
    return events(spark, sf_dir).select("event_id", scalar.ns_to_us(ns).alias("us"), scalar.ns_to_ms(ns).alias("ms"))


@query
def time_in_text(spark, sf_dir):
    text = F.concat_ws(" ", F.col("feed"), F.concat(F.lit("time="), scalar.epoch_ms(F.col("ts")).cast("string")), F.concat("feed", F.lit("-out")))
    return events(spark, sf_dir).select("event_id", F.concat("feed", F.lit("-out")).alias("mapped"), scalar.time_in(text).alias("time_ms"))
