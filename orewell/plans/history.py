"""Queries over scans and their findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import history as H
from .registry import Tables, query

NEWEST = "row_number() OVER (PARTITION BY workspace_id, lower(repo_slug) ORDER BY created_at DESC, scan_id DESC)"


@query(f"SELECT scan_id, lower(repo_slug) AS repo, CAST(rn AS INT) AS rn FROM (SELECT *, {NEWEST} AS rn FROM v_scans) WHERE rn <= 2")
def win_latest_scans(t: Tables) -> DataFrame:
    return H.newest(t.v_scans, ["workspace_id", F.lower("repo_slug")]).where("rn <= 2").select("scan_id", F.lower("repo_slug").alias("repo"), "rn")


@query("SELECT workspace_id, lower(repo_slug) AS repo, arg_max(repo_slug, (created_at, scan_id)) AS slug FROM v_scans GROUP BY ALL")
def win_first_value(t: Tables) -> DataFrame:
    return t.v_scans.groupBy("workspace_id", F.lower("repo_slug").alias("repo")).agg(F.max_by("repo_slug", F.struct("created_at", "scan_id")).alias("slug"))


TREND = """s AS (SELECT workspace_id, lower(repo_slug) AS repo, scan_id, score, created_at, row_number() OVER w AS index, score - lag(score) OVER w AS delta FROM v_scans WHERE state = 'complete'
    WINDOW w AS (PARTITION BY workspace_id, lower(repo_slug) ORDER BY created_at, scan_id)),
    n AS (SELECT scan_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high FROM v_scan_findings GROUP BY scan_id),
    t AS (SELECT workspace_id, repo, scan_id, score, CAST(index AS INT) AS index, delta, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high FROM s LEFT JOIN n USING (scan_id) WHERE index <= 40)"""


@query(f"WITH {TREND} SELECT * FROM t")
def agg_trend_points(t: Tables) -> DataFrame:
    return H.trend(t.v_scans, t.v_scan_findings).drop("created_at")


@query(f"WITH {TREND} SELECT scan_id, delta FROM t WHERE delta IS NOT NULL")
def win_delta(t: Tables) -> DataFrame:
    return H.trend(t.v_scans, t.v_scan_findings).where("delta is not null").select("scan_id", "delta")


@query(f"WITH {TREND} SELECT scan_id, index FROM t")
def win_index(t: Tables) -> DataFrame:
    return H.trend(t.v_scans, t.v_scan_findings).select("scan_id", "index")


HISTORY = f"""a AS (SELECT workspace_id, lower(repo_slug) AS repo, count(*) AS scans, max(created_at) AS last_at, arg_max(repo_slug, (created_at, scan_id)) AS slug FROM v_scans GROUP BY ALL),
    d AS (SELECT workspace_id, lower(repo_slug) AS repo, scan_id, score, {NEWEST} AS rn FROM v_scans WHERE state = 'complete'),
    p AS (SELECT workspace_id, repo, max(scan_id) FILTER (WHERE rn = 1) AS latest, max(score) FILTER (WHERE rn = 1) AS score, max(score) FILTER (WHERE rn = 2) AS previous FROM d GROUP BY ALL),
    f AS (SELECT scan_id AS latest, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high FROM v_scan_findings GROUP BY ALL),
    h AS (SELECT a.*, latest, score, previous, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high FROM a LEFT JOIN p USING (workspace_id, repo) LEFT JOIN f USING (latest))"""


@query(f"WITH {HISTORY} SELECT workspace_id, repo, scans, slug, latest, score, previous, critical, high FROM h")
def agg_repo_history(t: Tables) -> DataFrame:
    return H.repo_history(t.v_scans, t.v_scan_findings).drop("last_at")


@query(f"WITH {HISTORY} SELECT workspace_id, repo, latest, score, previous, score - previous AS change FROM h")
def join_repo_latest(t: Tables) -> DataFrame:
    return H.repo_history(t.v_scans, t.v_scan_findings).select("workspace_id", "repo", "latest", "score", "previous", (F.col("score") - F.col("previous")).alias("change"))


@query(f"WITH {HISTORY}, l AS (SELECT workspace_id, repo, CASE WHEN latest IS NOT NULL THEN last_at END AS done_at FROM h) SELECT workspace_id, repo, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY done_at DESC NULLS LAST, repo) AS INT) AS place FROM l")
def srt_nulls_last(t: Tables) -> DataFrame:
    h = H.repo_history(t.v_scans, t.v_scan_findings).withColumn("done_at", F.when(F.col("latest").isNotNull(), F.col("last_at")))
    return h.select("workspace_id", "repo", F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc_nulls_last("done_at"), "repo")).alias("place"))


@query("SELECT scan_id, workspace_id, place FROM (SELECT scan_id, workspace_id, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, scan_id DESC) AS INT) AS place FROM v_scans) WHERE place <= 20")
def lim_scans(t: Tables) -> DataFrame:
    """The newest scans of each workspace: a report of twenty."""
    return H.newest(t.v_scans, ["workspace_id"]).where("rn <= 20").select("scan_id", "workspace_id", F.col("rn").alias("place"))


@query("""WITH k AS (SELECT scan_id FROM v_scans ORDER BY created_at DESC, scan_id DESC LIMIT 500)
    SELECT k.scan_id, (SELECT count(*) FROM v_scan_findings f WHERE f.scan_id = k.scan_id) AS findings, least(4000, (SELECT count(*) FROM events e WHERE e.user_id = k.scan_id)) AS events FROM k""")
def sink_retention(t: Tables) -> DataFrame:
    """The newest 500 scans stay, with their findings and the last 4,000 events of each."""
    kept, findings, events = H.retained(t.v_scans, t.v_scan_findings, t.events.select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("seq")))
    count = lambda df, name: df.groupBy("scan_id").agg(F.count("*").alias(name))
    return kept.select("scan_id").join(count(findings, "findings"), "scan_id", "left").join(count(events, "events"), "scan_id", "left").na.fill(0)


@query("SELECT scan_id FROM v_scans WHERE workspace_id = 'ws1' OR scan_id % 7 = 0")
def flt_visible(t: Tables) -> DataFrame:
    """Own workspace, or shared."""
    shared = F.when(F.col("scan_id") % 7 == 0, F.lit("share"))
    return t.v_scans.withColumn("share_id", shared).where((F.col("workspace_id") == "ws1") | F.col("share_id").isNotNull()).select("scan_id")


@query("SELECT scan_id, state FROM v_scans WHERE state NOT IN ('complete', 'failed', 'cancelled')")
def flt_running(t: Tables) -> DataFrame:
    return t.v_scans.where(~F.col("state").isin(*H.TERMINAL)).select("scan_id", "state")


@query("SELECT s.scan_id, count(*) AS findings FROM v_scans s JOIN v_scan_findings f USING (scan_id) WHERE s.scan_id % 7 = 0 GROUP BY s.scan_id")
def join_share(t: Tables) -> DataFrame:
    """Shared scans with their reports."""
    shared = t.v_scans.where("scan_id % 7 = 0").select("scan_id")
    return shared.join(t.v_scan_findings, "scan_id").groupBy("scan_id").agg(F.count("*").alias("findings"))


@query("SELECT workspace_id, lower(repo_slug) AS repo, arg_min(scan_id, (least(scan_id % 3, 1), created_at, scan_id)) AS id, arg_max(repo_slug, (least(scan_id % 3, 1), created_at, scan_id)) AS slug FROM v_scans GROUP BY ALL")
def sink_upsert_repo(t: Tables) -> DataFrame:
    """Repositories that exist (scans with id % 3 = 0) and arrive (the others): the id stays, the rest is the newest."""
    s = t.v_scans.select("workspace_id", F.lower("repo_slug").alias("repo"), F.col("scan_id").alias("id"), F.col("repo_slug").alias("slug"), F.struct("created_at", "scan_id").alias("at"))
    old, new = s.where("id % 3 = 0"), s.where("id % 3 <> 0")
    return H.upsert(old, new, ["workspace_id", "repo"], ["id"], "at").drop("at")


@query("""WITH p AS (SELECT l_orderkey AS scan_id, l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'state-' || l_linenumber END AS state, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber END AS score FROM lineitem),
    l AS (SELECT scan_id, arg_max(state, seq) FILTER (WHERE state IS NOT NULL) AS st, arg_max(score, seq) FILTER (WHERE score IS NOT NULL) AS sc FROM p GROUP BY scan_id)
    SELECT s.scan_id, coalesce(st, state) AS state, coalesce(sc, score) AS score FROM v_scans s LEFT JOIN l USING (scan_id)""")
def sink_patch_scan(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    patches = t.lineitem.select(F.col("l_orderkey").alias("scan_id"), n.alias("seq"), F.when(n % 2 == 0, F.concat(F.lit("state-"), n.cast("string"))).alias("state"), F.when(n % 3 == 0, n.cast("long")).alias("score"))
    return H.patch(t.v_scans.select("scan_id", "state", "score"), patches, "scan_id", "seq")


@query("""WITH s AS (SELECT scan_id, lag(scan_id) OVER (PARTITION BY workspace_id, lower(repo_slug) ORDER BY created_at, scan_id) AS before FROM v_scans WHERE state = 'complete'),
    i AS (SELECT DISTINCT scan_id, issue FROM v_scan_findings), n AS (SELECT s.scan_id, issue FROM s JOIN i USING (scan_id) WHERE before IS NOT NULL), o AS (SELECT s.scan_id, issue FROM s JOIN i ON s.before = i.scan_id)
    SELECT coalesce(n.scan_id, o.scan_id) AS scan_id, coalesce(n.issue, o.issue) AS issue, CASE WHEN n.issue IS NOT NULL AND o.issue IS NOT NULL THEN 'open' WHEN n.issue IS NOT NULL THEN 'new' ELSE 'fixed' END AS state
    FROM n FULL JOIN o ON n.scan_id = o.scan_id AND n.issue = o.issue""")
def set_issue_diff(t: Tables) -> DataFrame:
    return H.issue_changes(t.v_scans, t.v_scan_findings)


@query("""SELECT s.scan_id, count(f.scan_id) AS raw, count(*) FILTER (WHERE validation = 'dismissed') AS dismissed, count(DISTINCT issue) AS issues, date_diff('day', min(l_shipdate), max(l_shipdate)) AS days
    FROM v_scans s LEFT JOIN v_scan_findings f USING (scan_id) LEFT JOIN lineitem l ON f.scan_id = l_orderkey AND finding_no = l_linenumber GROUP BY s.scan_id""")
def agg_telemetry(t: Tables) -> DataFrame:
    """Counts and durations of each scan."""
    ship = t.lineitem.select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("finding_no"), "l_shipdate")
    f = t.v_scan_findings.join(ship, ["scan_id", "finding_no"], "left")
    n = f.groupBy("scan_id").agg(F.count("*").alias("raw"), F.count_if(F.col("validation") == "dismissed").alias("dismissed"), F.count_distinct("issue").alias("issues"), F.date_diff(F.max("l_shipdate"), F.min("l_shipdate")).cast("long").alias("days"))
    return t.v_scans.select("scan_id").join(n, "scan_id", "left").na.fill(0, ["raw", "dismissed", "issues"])
