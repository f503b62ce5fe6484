"""DuckDB statements that each registered query is held against."""

ORACLES = {
    "feed_publish": """SELECT event_id, event_type AS feed, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events""",
    "named_subscription": """SELECT event_id, event_type AS feed, value FROM events WHERE event_type IN ('purchase','signup')""",
    "subscription_route": """WITH subs(processor, feed) AS (VALUES ('p1','purchase'),('p1','signup'),('p2','purchase'),('p3','error'))
SELECT s.processor, e.event_type AS feed, e.event_id FROM events e JOIN subs s ON e.event_type = s.feed""",
    "subscription_dedupe": """WITH subs(processor, feed) AS (VALUES ('p1','purchase'),('p1','purchase'),('p2','error'))
SELECT s.processor, e.event_id FROM events e JOIN (SELECT DISTINCT processor, feed FROM subs) s ON e.event_type = s.feed""",
    "unsubscribe": """WITH subs(processor, feed) AS (VALUES ('p1','purchase'),('p2','purchase'),('p2','error')), gone(processor, feed) AS (VALUES ('p2','purchase'))
SELECT s.processor, e.event_id FROM events e JOIN subs s ON e.event_type = s.feed WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.processor = s.processor AND g.feed = s.feed)""",
    "listener_count": """WITH subs(processor, feed) AS (VALUES ('p1','purchase'),('p2','purchase'),('p3','error'))
SELECT feed, count(*) AS listeners FROM subs GROUP BY feed""",
    "broadcast_route": """WITH procs(processor) AS (VALUES ('p1'),('p2'),('p3'))
SELECT p.processor, e.event_id FROM events e CROSS JOIN procs p""",
    "group_fanout": """WITH subs(grp, processor, feed) AS (VALUES ('g1','p1','purchase'),('g1','p2','purchase'),('g2','p3','purchase'))
SELECT s.grp, s.processor, count(*) AS delivered, round(sum(e.value), 2) AS total_value FROM events e JOIN subs s ON e.event_type = s.feed GROUP BY s.grp, s.processor""",
    "value_mapper": """SELECT event_id, upper(event_type) AS mapped_feed, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events""",
    "mapper_null_drop": """SELECT event_id, event_type AS feed, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events WHERE value >= 20""",
    "mapper_errors": """SELECT event_type AS feed, count(*) AS published, sum(CASE WHEN TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END AS BIGINT) IS NULL THEN 1 ELSE 0 END)::BIGINT AS failed FROM events GROUP BY event_type""",
    "named_envelope": """SELECT event_type || '/' || CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS VARCHAR) AS envelope_key, value AS data FROM events""",
    "wrap_matrix": """SELECT w.wrap, b.bcast, CASE WHEN b.bcast AND w.wrap THEN 'BROADCAST_NAMED_EVENT' WHEN b.bcast THEN 'BROADCAST_NOWRAP' WHEN w.wrap THEN 'SUBSCRIPTION_NAMED_EVENT' ELSE 'SUBSCRIPTION_NOWRAP' END AS strategy FROM (VALUES (true),(false)) w(wrap) CROSS JOIN (VALUES (true),(false)) b(bcast)""",
    "typed_dispatch": """SELECT event_id, CASE WHEN event_type IN ('purchase','signup') THEN upper(event_type) ELSE event_type END AS delivered, CASE WHEN event_type IN ('purchase','signup') THEN 'onString' ELSE 'onEvent' END AS callback FROM events""",
    "batch_flatten": """SELECT conv_id, turn, role FROM conversations""",
    "merge_feeds": """SELECT event_id, event_type AS feed, row_number() OVER (ORDER BY event_id) AS pos FROM events WHERE event_type IN ('click','view')""",
    "duty_cycle_batches": """SELECT feed, (seq - 1) // 64 AS cycle, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_type AS feed, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events) GROUP BY 1, 2""",
    "counter_feed_published": """SELECT 'feed.' || event_type || '.published' AS label, count(*) AS value FROM events GROUP BY event_type""",
    "counter_group_cycles": """SELECT 'group.' || feed || '.processed' AS label, count(DISTINCT cycle) AS value FROM (SELECT event_type AS feed, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 64 AS cycle FROM events) GROUP BY feed""",
    "counter_idle_cycles": """WITH spine AS (SELECT f.feed, h.hour FROM (SELECT DISTINCT event_type AS feed FROM events) f CROSS JOIN (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events) h), busy AS (SELECT DISTINCT event_type AS feed, date_trunc('hour', ts) AS hour FROM events)
SELECT s.feed, count(*) FILTER (WHERE b.feed IS NULL) AS idle, count(b.feed) AS active FROM spine s LEFT JOIN busy b ON s.feed = b.feed AND s.hour = b.hour GROUP BY s.feed""",
    "counter_processor_node": """WITH nodes(processor, node, feed) AS (VALUES ('pnl','a','purchase'),('pnl','b','purchase'),('risk','c','error'))
SELECT 'node.' || n.processor || '.' || n.node || '.invocations' AS label, count(*) AS value FROM events e JOIN nodes n ON e.event_type = n.feed GROUP BY n.processor, n.node""",
    "gauge_last": """SELECT event_type AS label, arg_max(value, event_id) AS value FROM events GROUP BY event_type""",
    "queue_depth": """WITH t AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS arrived FROM events GROUP BY 1), s AS (SELECT hour, sum(arrived - 3) OVER (ORDER BY hour) AS net FROM t)
SELECT hour, (net - least(0, min(net) OVER (ORDER BY hour)))::BIGINT AS depth FROM s""",
    "bounded_queue_drop": """WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY hour) AS i, hour, arrived FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS arrived FROM events GROUP BY 1)), r AS (
 SELECT i, hour, arrived, greatest(0, least(arrived, 4) - 2)::BIGINT AS depth, greatest(0, arrived - 4)::BIGINT AS dropped FROM t WHERE i = 1
 UNION ALL SELECT t.i, t.hour, t.arrived, greatest(0, least(r.depth + t.arrived, 4) - 2)::BIGINT, greatest(0, r.depth + t.arrived - 4)::BIGINT FROM r JOIN t ON t.i = r.i + 1)
SELECT hour, arrived, depth, dropped FROM r""",
    "gap_detect": """WITH s AS (SELECT event_type AS feed, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events), d AS (SELECT feed, seq, lag(seq) OVER (PARTITION BY feed ORDER BY seq) AS prev FROM s WHERE event_id % 10 <> 0)
SELECT feed, seq, seq - prev - 1 AS missing FROM d WHERE seq - prev > 1""",
    "node_intervals": """SELECT user_id AS cycle, event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) - epoch_us(ts) AS elapsed_us FROM events""",
    "latency_percentiles": """WITH x AS (SELECT event_type AS node, least((epoch_us(lead(ts) OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_id)) - epoch_us(ts)) // 1000, 3600000) AS ms FROM events)
SELECT node, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.9) AS p90, quantile_disc(ms, 0.99) AS p99, quantile_disc(ms, 0.999) AS p999, max(ms) AS max_ms FROM x WHERE ms >= 0 GROUP BY node""",
    "latency_summary": """SELECT event_type AS feed, count(*) AS n, min(value) AS min_v, max(value) AS max_v FROM events GROUP BY event_type""",
    "health_rollup": """WITH c AS (SELECT user_id AS service, event_type AS chk, CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS rnk, (event_type <> 'error' OR user_id % 2 = 0) AS enabled FROM events)
SELECT service, CASE coalesce(max(rnk) FILTER (WHERE enabled), 1) WHEN 3 THEN 'DOWN' WHEN 2 THEN 'DEGRADED' WHEN 1 THEN 'UNKNOWN' ELSE 'UP' END AS verdict FROM c GROUP BY service""",
    "counter_delta": """WITH snap AS (SELECT hour, sum(n) OVER (ORDER BY hour) AS v FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1)), old AS (SELECT arg_min(v, hour) AS v0 FROM snap)
SELECT a.hour, (a.v - coalesce((SELECT max(b.v) FROM snap b WHERE b.hour <= a.hour - INTERVAL 6 HOUR), (SELECT v0 FROM old)))::BIGINT AS delta FROM snap a""",
    "error_ring": """SELECT user_id AS service, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type = 'error') WHERE rn <= 16""",
    "error_recent": """SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100""",
    "retry_schedule": """SELECT event_id, least(event_id % 5 + 1, 3) AS attempts, (event_id % 5) >= 3 AS dropped, CASE least(event_id % 5 + 1, 3) WHEN 1 THEN 0 WHEN 2 THEN 5 ELSE 15 END AS backoff_ms FROM events""",
    "data_clock": """SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clock_ms FROM events""",
    "cache_then_live": """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'cached' ELSE 'live' END AS phase, greatest(ts, TIMESTAMP '2024-01-10') AS dispatched_at FROM events""",
    "event_log": """SELECT event_type AS feed, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq, event_id FROM events WHERE ts < TIMESTAMP '2024-01-10'""",
    "catchup_then_live": """SELECT event_id, 'replay' AS mode FROM events WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT event_id, 'live' AS mode FROM events WHERE ts >= TIMESTAMP '2024-01-15'""",
    "late_subscriber": """WITH subs(processor, feed, since) AS (VALUES ('p1','purchase',TIMESTAMP '2024-01-01'),('p2','purchase',TIMESTAMP '2024-01-20'))
SELECT s.processor, e.event_id FROM events e JOIN subs s ON e.event_type = s.feed AND e.ts >= s.since""",
    "read_strategy": """WITH p AS (SELECT event_id, ts < TIMESTAMP '2024-01-15' AS existing, event_id < 100 AS committed FROM events)
SELECT 'EARLIEST' AS strategy, event_id FROM p UNION ALL SELECT 'COMMITED', event_id FROM p WHERE NOT committed UNION ALL SELECT 'LATEST', event_id FROM p WHERE NOT existing UNION ALL SELECT 'ONCE_EARLIEST', event_id FROM p WHERE existing UNION ALL SELECT 'ONCE_LATEST', event_id FROM p WHERE false""",
    "latest_per_batch": """SELECT date_trunc('day', ts) AS batch, max(event_id) AS event_id FROM events GROUP BY 1""",
    "pipe_chain": """SELECT feed, count(*) AS n FROM (SELECT 'big.' || event_type AS feed FROM events WHERE value > 100) GROUP BY feed""",
    "file_sink_lines": """SELECT CAST(event_id AS VARCHAR) || ',' || event_type AS line FROM events""",
    "scheduler_fire": """SELECT event_id, epoch_us(ts) // 1000 + CAST(json_extract_string(props,'$.k') AS BIGINT) AS fire_ms FROM events""",
    "reentrant": """SELECT event_id, 'Re-Entrant Event [' || CAST(i AS VARCHAR) || ']' AS emitted FROM (SELECT event_id, unnest(range(0, event_id % 4 + 1)) AS i FROM events)""",
    "throughput_rate": """SELECT feed, day, n, n - lag(n) OVER (PARTITION BY feed ORDER BY day) AS change FROM (SELECT event_type AS feed, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)""",
    "service_match": """WITH svc(name, iface) AS (VALUES ('s1','Sink'),('s2','FileSink'),('s3','Clock')), isa(child, parent) AS (VALUES ('Sink','Sink'),('FileSink','FileSink'),('FileSink','Sink'),('Clock','Clock')), want(target, iface) AS (VALUES ('h1','Sink'),('h2','Clock'))
SELECT w.target, s.name, s.iface = w.iface AS is_exact FROM want w JOIN isa i ON i.parent = w.iface JOIN svc s ON s.iface = i.child""",
    "topology": """WITH subs(grp, processor, feed) AS (VALUES ('g1','p1','purchase'),('g1','p2','purchase'),('g2','p3','error'))
SELECT feed, grp, string_agg(processor, ',' ORDER BY processor) AS processors FROM subs GROUP BY feed, grp""",
    "audit_list": """SELECT event_type AS processor, count(*) AS record_count, sum(length(props))::BIGINT AS size_bytes, min(ts) AS started_at, max(ts) AS last_write_at FROM events GROUP BY event_type""",
    "command_parse": """SELECT split_part(trim('  audit.start ' || event_type || ' '), ' ', 1) AS command, split_part(trim('  audit.start ' || event_type || ' '), ' ', 2) AS arg, count(*) AS n FROM events GROUP BY 1, 2""",
    "check_cache": """WITH RECURSIVE e AS (SELECT event_type AS chk, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), r AS (
 SELECT chk, i, t, t AS last_eval, true AS evaluated FROM e WHERE i = 1
 UNION ALL SELECT e.chk, e.i, e.t, CASE WHEN e.t - r.last_eval >= 3600000 THEN e.t ELSE r.last_eval END, e.t - r.last_eval >= 3600000 FROM r JOIN e ON e.chk = r.chk AND e.i = r.i + 1)
SELECT chk, i, evaluated FROM r""",
    "file_sink_written": """SELECT CAST(event_id AS VARCHAR) || ',' || event_type AS line FROM events""",
    "pipe_stream": """SELECT feed, count(*) AS n FROM (SELECT 'big.' || event_type AS feed FROM events WHERE value > 100) GROUP BY feed""",
    "mapper_isolation": """WITH m AS (SELECT event_type AS feed, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS v FROM events)
SELECT feed, count(*) AS published, count(*) FILTER (WHERE v IS NULL) AS failed, sum(v)::BIGINT AS mapped FROM m GROUP BY feed""",
    "broadcast_unwrap": """SELECT event_id, CASE WHEN event_type = 'error' THEN value * 2 ELSE value END AS value FROM events""",
    "counter_processor_events": """WITH subs(processor, feed) AS (VALUES ('p1','purchase'),('p1','signup'),('p2','purchase'),('p3','error'))
SELECT 'processor.' || s.processor || '.events' AS label, count(*) AS value FROM events e JOIN subs s ON e.event_type = s.feed GROUP BY s.processor""",
    "counters_every": """WITH subs(processor, feed) AS (VALUES ('p1','purchase'),('p1','signup'),('p2','purchase'),('p3','error'))
SELECT 'feed.' || event_type || '.published' AS label, count(*) AS value FROM events GROUP BY event_type
UNION ALL SELECT 'processor.' || s.processor || '.events', count(*) FROM events e JOIN subs s ON e.event_type = s.feed GROUP BY s.processor
UNION ALL SELECT 'feed.' || event_type || '.weight', sum(CAST(json_extract_string(props,'$.k') AS BIGINT))::BIGINT FROM events GROUP BY event_type""",
    "summary_statistics": """SELECT event_type AS feed, count(value) AS n, min(value) AS min_v, max(value) AS max_v, sum(CAST(value AS DECIMAL(28,6)))::DOUBLE AS sum_v, sum(CAST(value AS DECIMAL(28,6)))::DOUBLE / count(value) AS avg_v FROM events GROUP BY event_type""",
    "counter_ring_delta": """WITH s AS (SELECT event_type AS label, epoch_us(ts) // 1000 AS ts_ms, event_id AS value FROM events), m AS (SELECT max(ts_ms) + 10000 AS now_ms FROM s),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ts_ms DESC) AS rn FROM s) WHERE rn <= 60),
b AS (SELECT label, coalesce(arg_max(value, ts_ms) FILTER (WHERE ts_ms <= (SELECT now_ms FROM m) - 60000), arg_min(value, ts_ms)) AS base FROM k GROUP BY label)
SELECT label, (max(s.value) + 100 - any_value(base))::BIGINT AS delta FROM s JOIN b USING (label) GROUP BY label""",
    "timer_wheel": """WITH t AS (SELECT event_id, ((epoch_us(ts) // 1000 + CAST(json_extract_string(props,'$.k') AS BIGINT) + 1023) // 1024) * 1024 AS fire_ms FROM events)
SELECT event_id, fire_ms, (row_number() OVER (PARTITION BY fire_ms ORDER BY event_id) - 1) // 100 AS poll FROM t""",
    "audit_listing": """WITH a AS (SELECT event_type AS processor, event_type IN ('click','view') AS is_live, props, ts FROM events WHERE event_type NOT IN ('click','view') OR ts >= TIMESTAMP '2024-01-15')
SELECT processor, count(*) AS record_count, sum(length(props))::BIGINT AS size_bytes, min(ts) AS started_at, max(ts) AS last_write_at, is_live FROM a GROUP BY processor, is_live""",
    "retry_attempts": """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN event_id * 2 END AS result, (CASE WHEN event_id % 5 = 3 THEN 3 ELSE 1 END)::BIGINT AS attempts, CASE event_id % 5 WHEN 3 THEN 'RuntimeError: busy' WHEN 4 THEN 'ValueError: bad' END AS error FROM events""",
    "poison_drop": """SELECT event_id, 3::BIGINT AS attempts, 'ERROR' AS severity FROM events WHERE event_id % 5 >= 3""",
    "clock_units": """SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms FROM events""",
    "time_in_text": """SELECT event_id, event_type || '-out' AS mapped, epoch_us(ts) // 1000 AS time_ms FROM events""",
}
