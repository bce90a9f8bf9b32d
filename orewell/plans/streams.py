"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import events as S
from .registry import Tables, query

STATES = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.STATE_OF.items()) + " END"


@query("""WITH k AS (SELECT user_id AS scan_id, count(*) AS last FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT e.user_id AS scan_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) + coalesce(last, 0) AS seq FROM events e LEFT JOIN k ON e.user_id = k.scan_id WHERE event_type <> 'error'""")
def str_sequence(t: Tables) -> DataFrame:
    e = t.events.withColumnRenamed("user_id", "scan_id")
    known = e.where("event_type = 'error'").groupBy("scan_id").agg(F.count("*").alias("last"))
    return S.sequence(e.where("event_type <> 'error'"), known, "ts", "event_id").select("scan_id", "event_id", "seq")


@query("SELECT scan_id, seq, type FROM v_scan_events WHERE seq > 3")
def str_dedup_replay(t: Tables) -> DataFrame:
    e = t.v_scan_events.select("scan_id", F.col("seq").cast("long").alias("seq"), "type")
    return S.replay(e.unionAll(e.where("seq % 50 = 0")), 3)


@query("SELECT scan_id, seq, coalesce(seq <= max(seq) OVER (PARTITION BY scan_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS is_late FROM v_scan_events")
def str_late(t: Tables) -> DataFrame:
    return S.late(t.v_scan_events, "event_id").select("scan_id", F.col("seq").cast("long").alias("seq"), "is_late")


@query(f"""SELECT scan_id, max(seq) AS last_seq, coalesce(arg_max({STATES}, seq) FILTER (WHERE {STATES} IS NOT NULL), 'queued') AS state, coalesce(max(progress), 0) AS progress,
    count(*) FILTER (WHERE type = 'agent_finding') AS findings, count(*) FILTER (WHERE type = 'agent_error') AS errors FROM v_scan_events GROUP BY scan_id""")
def str_fold(t: Tables) -> DataFrame:
    return S.fold(t.v_scan_events.withColumn("seq", F.col("seq").cast("long")))


@query("""SELECT scan_id, agent_ord, CASE WHEN bool_or(type = 'agent_error') THEN 'error' ELSE coalesce(arg_max(CASE type WHEN 'agent_started' THEN 'started' WHEN 'agent_finding' THEN 'complete' END, seq)
    FILTER (WHERE type IN ('agent_started', 'agent_finding')), 'waiting') END AS status, max(seq) AS last_seq FROM v_scan_events GROUP BY scan_id, agent_ord""")
def str_agent_lifecycle(t: Tables) -> DataFrame:
    return S.agents(t.v_scan_events.withColumn("seq", F.col("seq").cast("long")))


@query("""SELECT scan_id, agent_ord, started_seq, CASE WHEN e > started_seq THEN e END AS completed_seq FROM (SELECT scan_id, agent_ord, max(seq) FILTER (WHERE type = 'agent_started') AS started_seq,
    max(seq) FILTER (WHERE type = 'agent_finding') AS e FROM v_scan_events GROUP BY scan_id, agent_ord) WHERE started_seq IS NOT NULL""")
def str_pair_validation(t: Tables) -> DataFrame:
    return S.pairs(t.v_scan_events.withColumn("seq", F.col("seq").cast("long")), "agent_started", "agent_finding", "scan_id", "agent_ord")


#: Microseconds that fill one token of ``str_token_bucket``.
TOKEN = 3_600_000_000


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    b AS (SELECT user_id, event_id, us, n, 2 * {TOKEN} AS held, true AS allowed FROM e WHERE n = 1
        UNION ALL SELECT user_id, event_id, us, n, x - CASE WHEN x >= {TOKEN} THEN {TOKEN} ELSE 0 END, x >= {TOKEN} FROM (SELECT e.*, least(3 * {TOKEN}, held + e.us - b.us) AS x FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1) y)
    SELECT user_id, event_id, allowed, CAST(held // {TOKEN} AS INT) AS remaining FROM b""")
def str_token_bucket(t: Tables) -> DataFrame:
    return S.token_bucket(t.events, "user_id", "ts", "event_id", capacity=3, per_second=1 / 3600)


@query("""SELECT scan_id, agent_ord, count(*) FILTER (WHERE type = 'agent_progress') AS tool_runs, CAST(date_diff('second', min("at") FILTER (WHERE type = 'agent_started'), max("at") FILTER (WHERE type = 'agent_finding')) AS BIGINT) AS seconds FROM v_scan_events GROUP BY scan_id, agent_ord""")
def agg_agent_durations(t: Tables) -> DataFrame:
    """Per scan and agent what it ran, and the seconds from its first start to its last finding; null without both."""
    at = lambda kind, f: f(F.when(F.col("type") == kind, F.unix_seconds(F.col("at").cast("timestamp"))))
    return t.v_scan_events.groupBy("scan_id", "agent_ord").agg(F.count_if(F.col("type") == "agent_progress").alias("tool_runs"), (at("agent_finding", F.max) - at("agent_started", F.min)).alias("seconds"))
