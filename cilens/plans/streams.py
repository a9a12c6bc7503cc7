"""Telemetry stream queries. Names ending in _stream run Structured Streaming to completion."""

from pyspark.sql import functions as F

from cilens import rules
from cilens.plans.registry import cte, query
from cilens.streaming import incidents as I, timers

_TERMINAL = "(action IN ('PIPELINE_HALTED', 'PIPELINE_CRASHED') OR (action = 'STATE_TRANSITION' AND output_summary IN ('COMPLETED', 'FAILED', 'PENDING_APPROVAL')))"
cte("d_delivered", f"""
SELECT *, {_TERMINAL} AS terminal FROM telemetry QUALIFY coalesce(sum(CAST({_TERMINAL} AS INT)) OVER (PARTITION BY incident_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""")
cte("d_subs", "SELECT c_custkey AS subscriber_id, 'inc_' || CAST(c_custkey // 10 AS VARCHAR) AS incident_id FROM customer")


def live(t, files_per_batch=None):
    return I.view_stream(t.spark, t.folder, "telemetry", "events", files_per_batch)


def subscriptions(t):
    return t.customer.select(F.col("c_custkey").alias("subscriber_id"), F.concat(F.lit("inc_"), F.floor(F.col("c_custkey") / 10).cast("string")).alias("incident_id"))


@query("t1_ingest_stream", "SELECT event_id, incident_id, agent, action, output_summary, result FROM telemetry")
def ingest_stream(t):
    """Every event is delivered twice; each arrives once."""
    twice = live(t).unionByName(live(t))
    return I.run_to_table(I.ingest(twice).select("event_id", "incident_id", "agent", "action", "output_summary", "result"), "ingest")


@query("t2_routing_stream", "SELECT subscriber_id, incident_id, event_id, action FROM telemetry JOIN d_subs USING (incident_id)")
def routing_stream(t):
    return I.run_to_table(I.route(live(t), subscriptions(t)), "routing")


@query("t3_until_terminal", "SELECT incident_id, event_id, terminal FROM d_delivered")
def until_terminal(t):
    return I.until_terminal(t.telemetry).select("incident_id", "event_id", "terminal")


@query("t3_until_terminal_stream", "SELECT incident_id, event_id, terminal FROM d_delivered")
def until_terminal_stream(t):
    events = live(t, files_per_batch=32).withColumn("at", F.col("ts").cast("timestamp"))
    return I.run_to_table(timers.until_terminal(events, I.is_terminal()), "terminal")


@query("t4_heartbeats", """
SELECT incident_id, event_id, CASE WHEN terminal THEN 0 ELSE coalesce(CAST(floor((lead(epoch_us(ts)) OVER (PARTITION BY incident_id ORDER BY ts, event_id) - epoch_us(ts)) / 15000000) AS BIGINT), 0) END AS keepalives FROM d_delivered""")
def heartbeats(t):
    return I.heartbeats(t.telemetry)


@query("t5_bounded_backlog", """
SELECT subscriber_id, incident_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY subscriber_id, incident_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) ORDER BY ts, event_id) AS p FROM telemetry JOIN d_subs USING (incident_id)) WHERE p <= 1000""")
def bounded_backlog(t):
    """One batch per day; events beyond the room of a subscriber are dropped."""
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86_400)
    return I.backlog(t.telemetry.join(subscriptions(t), "incident_id"), day, capacity=rules.BACKLOG).select("subscriber_id", "incident_id", "event_id")


_STATE = """SELECT incident_id, arg_max(output_summary, {'t': ts, 'e': event_id}) AS state, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM telemetry WHERE action = 'STATE_TRANSITION' GROUP BY incident_id"""
cte("d_state", _STATE)


@query("t6_current_state", "SELECT * FROM d_state")
def current_state(t):
    return I.current_state(t.telemetry)


@query("t6_current_state_stream", "SELECT * FROM d_state")
def current_state_stream(t):
    return I.run_upserts(I.current_state(live(t)), ["incident_id"], "state")


@query("t7_live_feed", "SELECT incident_id, count(*) AS events, arg_max(event_id, {'t': ts, 'e': event_id}) AS last_event_id FROM telemetry GROUP BY incident_id ORDER BY incident_id")
def live_feed(t):
    return I.feed(t.telemetry).orderBy("incident_id")


_WINDOWS = "SELECT provider, CAST(floor(t_sec / 60) * 60 AS BIGINT) AS window_start, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM api_requests GROUP BY ALL"


def _timed(requests):
    return requests.withColumn("at", F.timestamp_seconds("t_sec"))


@query("t8_quota_windows", _WINDOWS)
def quota_windows(t):
    return I.quota_windows(_timed(t.api_requests))


@query("t8_quota_windows_stream", _WINDOWS)
def quota_windows_stream(t):
    requests = _timed(I.view_stream(t.spark, t.folder, "api_requests", "events")).withWatermark("at", "10 minutes")
    return I.run_upserts(I.quota_windows(requests), ["provider", "window_start"], "quota")


@query("t8_sliding_quota_stream", """
WITH s AS (SELECT coalesce(provider, '') AS provider, t_sec, count(*) AS requests, sum(coalesce(least(tokens, 240000), 0)) AS tokens FROM api_requests GROUP BY ALL)
SELECT a.provider, a.t_sec, a.requests, CAST(a.tokens AS BIGINT) AS tokens, CAST(coalesce(sum(b.requests), 0) AS BIGINT) AS requests_minute, CAST(coalesce(sum(b.tokens), 0) AS BIGINT) AS tokens_minute
FROM s a LEFT JOIN s b ON b.provider = a.provider AND b.t_sec BETWEEN a.t_sec - 59 AND a.t_sec - 1 GROUP BY ALL""")
def sliding_quota_stream(t):
    """The minute before each second, as w7_quota_usage counts it, from a stream whose state ends with its slice of time."""
    return I.run_upserts(timers.sliding_use(I.view_stream(t.spark, t.folder, "api_requests", "events")), ["provider", "t_sec"], "sliding")


@query("f16_stage_progress", """
SELECT incident_id, stage, CASE WHEN state = 'FAILED' THEN CASE WHEN stage = 'VERIFYING' THEN 'failed' WHEN i <= 3 THEN 'completed' ELSE 'pending' END WHEN state IN ('COMPLETED', 'PENDING_APPROVAL') THEN 'completed'
 WHEN p = 0 THEN 'pending' WHEN i < p THEN 'completed' WHEN i = p THEN 'active' ELSE 'pending' END AS status
FROM (SELECT d.*, s.stage, s.i, coalesce(list_position(['LOCALIZING','RETRIEVING','PATCHING','VERIFYING','CHECKING_SAFETY'], state), 0) AS p FROM d_state d, (VALUES ('LOCALIZING', 1), ('RETRIEVING', 2), ('PATCHING', 3), ('VERIFYING', 4), ('CHECKING_SAFETY', 5)) s(stage, i))""")
def stage_progress(t):
    return I.stage_progress(I.current_state(t.telemetry))
