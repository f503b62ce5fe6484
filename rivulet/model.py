"""Schemas of the engine's views."""

COUNTER = "label string, value bigint"
COUNTER_SNAPSHOT = "ts_ms bigint, label string, value bigint"
LATENCY_SNAPSHOT = "processor string, node string, count bigint, p50 bigint, p90 bigint, p99 bigint, p999 bigint, max bigint"
HEALTH_STATUS = "service string, check_name string, verdict string, reason string, as_of_ms bigint, enabled boolean"
