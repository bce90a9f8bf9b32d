"""Queries over raw findings: merging, filters, orders, counts, scores, causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import findings as O
from ..operators import rules as R
from ..operators import scoring as P
from .registry import Tables, query

SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
SEV_NAME = "CASE {} WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END"
CLASS = "CASE " + " ".join(f"WHEN regexp_matches(rule_id, '{p}') THEN '{c}'" for p, c in O.ISSUE_CLASSES) + " ELSE rule_id END"
KEY = f"CASE WHEN starts_with(rule_id, 'dep.') THEN rule_id || '#' || title ELSE {CLASS} || '@' || path || '#' || CASE WHEN coalesce(start_line, 0) <> 0 THEN CAST(CAST(floor(start_line / 5) AS BIGINT) AS VARCHAR) ELSE 'file' END END"
CANON = "CASE root_cause " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in O.CAUSE_ALIASES.items()) + " ELSE root_cause END"
POINTS = (
    "floor(CASE severity WHEN 'critical' THEN CAST(30 AS DOUBLE) WHEN 'high' THEN 14 WHEN 'medium' THEN 5 WHEN 'low' THEN 1.5 ELSE 0.3 END * confidence"
    " * CASE validation WHEN 'confirmed' THEN CAST(1 AS DOUBLE) WHEN 'likely' THEN 0.75 WHEN 'potential' THEN 0.45 ELSE 0 END * 10 + 0.500000001) / 10"
)
CEIL = "CASE severity WHEN 'medium' THEN least(40.0, raw) WHEN 'low' THEN least(18.0, raw) WHEN 'info' THEN least(5.0, raw) ELSE raw END"
DAMP = "CASE WHEN {0} <= 40 THEN {0} ELSE 40 + sqrt({0} - 40) * 5 END"
WEIGHT = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in S.CATEGORY_WEIGHT.items()) + " END"
CATEGORIES = ", ".join(f"('{c}')" for c in S.CATEGORY_WEIGHT)


def scores_sql(findings: str, scans: str, keys: str) -> str:
    """CTEs t (tier points) and cs (category scores) over ``findings`` and ``scans``."""
    return f"""t AS (SELECT {keys}, category, severity, sum({POINTS}) AS raw FROM {findings} WHERE validation <> 'dismissed' GROUP BY ALL),
    pts AS (SELECT {keys}, category, sum({CEIL}) AS points FROM t GROUP BY ALL),
    cnt AS (SELECT {keys}, category, count(*) AS finding_count FROM {findings} GROUP BY ALL),
    grid AS (SELECT {keys}, category FROM (SELECT DISTINCT {keys} FROM {scans}), (VALUES {CATEGORIES}) c(category)),
    cs0 AS (SELECT {keys}, category, coalesce(finding_count, 0) AS finding_count, round(coalesce(points, 0), 6) AS points FROM grid LEFT JOIN cnt USING ({keys}, category) LEFT JOIN pts USING ({keys}, category)),
    cs AS (SELECT {keys}, category, finding_count, points, CAST(least(100, greatest(0, floor(100 - ({DAMP.format('points')}) + 0.5))) AS BIGINT) AS score FROM cs0)"""


CWE = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{w}'" for r, (w, _) in R.WEAKNESSES.items()) + " END"
OWASP = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{c}'" for r, (_, c) in R.WEAKNESSES.items() if c) + " END"


@query("SELECT raw_id, scan_id, severity, confidence FROM v_raw_findings WHERE validation <> 'dismissed'")
def flt_live(t: Tables) -> DataFrame:
    return t.v_raw_findings.where("validation <> 'dismissed'").select("raw_id", "scan_id", "severity", "confidence")


@query("SELECT raw_id, scan_id, severity, validation FROM v_raw_findings WHERE severity IN ('critical', 'high') AND validation IN ('confirmed', 'likely')")
def flt_urgent(t: Tables) -> DataFrame:
    return t.v_raw_findings.where(O.urgent()).select("raw_id", "scan_id", "severity", "validation")


@query("""SELECT raw_id, scan_id, category FROM v_raw_findings WHERE validation <> 'dismissed' AND severity IN ('critical', 'low') AND category IN ('security', 'performance')
    AND contains(lower(title || ' ' || path || ' ' || rule_id), 'src') AND contains(lower(title || ' ' || path || ' ' || rule_id), 'm1')""")
def flt_findings(t: Tables) -> DataFrame:
    q = O.FindingQuery("src M1", severities=("critical", "low"), categories=("security", "performance"))
    return t.v_raw_findings.where(q.column(F.concat_ws(" ", "title", "path", "rule_id"))).select("raw_id", "scan_id", "category")


@query(f"""WITH h AS (SELECT *, lower(concat_ws(' ', title, path, rule_id, {CWE}, category)) AS hay FROM v_raw_findings WHERE validation <> 'dismissed')
    SELECT raw_id, scan_id, {CWE} AS cwe, {OWASP} AS owasp FROM h WHERE contains(hay, 'cwe-9') AND contains(hay, 'sec')""")
def flt_weakness(t: Tables) -> DataFrame:
    """A search by weakness: the haystack holds it."""
    rule = F.col("rule_id")
    return t.v_raw_findings.where(O.FindingQuery("CWE-9 sec").column(O.haystack())).select("raw_id", "scan_id", R.cwe(rule).alias("cwe"), R.owasp(rule).alias("owasp"))


@query("""SELECT scan_id, count(*) FILTER (WHERE severity IN ('critical', 'high') AND validation <> 'dismissed') AS blocking,
    count(*) FILTER (WHERE severity IN ('critical', 'high') AND validation <> 'dismissed') = 0 AS passed FROM v_raw_findings GROUP BY scan_id""")
def flt_gate(t: Tables) -> DataFrame:
    n = F.count_if((S.severity_ord(F.col("severity")) <= 1) & (F.col("validation") != "dismissed"))
    return t.v_raw_findings.groupBy("scan_id").agg(n.alias("blocking"), (n == 0).alias("passed"))


@query(f"SELECT raw_id, {KEY} AS dedupe_key FROM v_raw_findings")
def agg_dedupe_key(t: Tables) -> DataFrame:
    return t.v_raw_findings.select("raw_id", O.dedupe_key(F.col("rule_id"), F.col("title"), F.col("path"), F.col("start_line")).alias("dedupe_key"))


NOISY = """a AS (SELECT scan_id, k, agent_ord, max(confidence) AS c FROM r GROUP BY ALL),
    n AS (SELECT scan_id, k, count(*) AS agents, CASE WHEN count(*) = 1 THEN max(c) ELSE least(0.97, greatest(max(c), 1 - product(1 - c) * 0.92)) END AS confidence FROM a GROUP BY ALL)"""


@query(f"WITH r AS (SELECT *, {KEY} AS k FROM v_raw_findings), {NOISY} SELECT scan_id, k AS dedupe_key, agents, round(confidence, 6) AS confidence FROM n")
def agg_noisy_or(t: Tables) -> DataFrame:
    keyed = t.v_raw_findings.withColumn("dedupe_key", O.dedupe_key(F.col("rule_id"), F.col("title"), F.col("path"), F.col("start_line")))
    return O.noisy_or(keyed, ["scan_id", "dedupe_key"]).withColumn("confidence", F.round("confidence", 6))


#: Evidence of a raw finding: its place, and every third one's title too, so that primaries differ.
EVIDENCE = "CASE WHEN raw_id % 3 = 0 THEN [path || ':' || start_line, title] ELSE [path || ':' || start_line] END"
MERGED = f"""r AS (SELECT *, {KEY} AS k, {SEV} AS sev, {EVIDENCE} AS held FROM v_raw_findings), {NOISY},
    p AS (SELECT *, row_number() OVER (PARTITION BY scan_id, k ORDER BY len(held) DESC, sev, agent_ord, raw_id) AS rn FROM r),
    g AS (SELECT scan_id, k, count(*) AS n_raw, min(sev) AS worst, string_agg(DISTINCT CAST(agent_ord AS VARCHAR), ',' ORDER BY CAST(agent_ord AS VARCHAR)) AS detected_by, list_sort(list(DISTINCT (path, start_line))) AS places FROM r GROUP BY ALL),
    e AS (SELECT scan_id, k, list_sort(list(DISTINCT x)) AS evidence FROM (SELECT scan_id, k, unnest(held) AS x FROM r) GROUP BY ALL),
    m AS (SELECT p.scan_id, p.k AS dedupe_key, {SEV_NAME.format('worst')} AS severity, n_raw, rule_id, effort_minutes, {CANON} AS root_cause, path, start_line, category, detected_by,
          array_to_string(list_transform(list_filter(places, lambda x: NOT (x[1] = path AND x[2] = start_line))[1:12], lambda x: x[1] || ':' || x[2]), ',') AS other_places, array_to_string(evidence[1:8], ',') AS evidence, round(n.confidence, 6) AS confidence
          FROM p JOIN g ON p.scan_id = g.scan_id AND p.k = g.k JOIN e ON p.scan_id = e.scan_id AND p.k = e.k JOIN n ON p.scan_id = n.scan_id AND p.k = n.k WHERE rn = 1)"""


def _merged(t: Tables) -> DataFrame:
    place = F.concat_ws(":", "path", "start_line")
    m = O.merge_findings(t.v_raw_findings, evidence=F.when(F.col("raw_id") % 3 == 0, F.array(place, F.col("title"))).otherwise(F.array(place)))
    return m.withColumn("detected_by", F.concat_ws(",", F.transform("detected_by", lambda a: a.cast("string")))).withColumn("other_places", F.array_join(F.transform("other_places", lambda x: F.concat_ws(":", x["path"], x["start_line"])), ",")).withColumn("evidence", F.array_join("evidence", ","))


@query(f"WITH {MERGED} SELECT * FROM m")
def agg_merge_findings(t: Tables) -> DataFrame:
    return _merged(t)


@query(f"SELECT raw_id, root_cause, {CANON} AS canonical FROM v_raw_findings")
def agg_root_cause_canon(t: Tables) -> DataFrame:
    return t.v_raw_findings.select("raw_id", "root_cause", O.canonical_cause(F.col("root_cause")).alias("canonical"))


@query(f"SELECT raw_id, {POINTS} AS points FROM v_raw_findings")
def agg_deduction(t: Tables) -> DataFrame:
    return t.v_raw_findings.select("raw_id", S.deduction(F.col("severity"), F.col("confidence"), F.col("validation")).alias("points"))


@query(f"WITH {scores_sql('v_raw_findings', 'v_raw_findings', 'scan_id')} SELECT scan_id, category, severity, round(raw, 6) AS raw, round({CEIL}, 6) AS points FROM t")
def agg_tier_ceiling(t: Tables) -> DataFrame:
    return P.tier_points(t.v_raw_findings, ["scan_id"]).select("scan_id", "category", "severity", F.round("raw", 6).alias("raw"), F.round("points", 6).alias("points"))


@query(f"WITH s AS (SELECT scan_id, round(sum({POINTS}), 6) AS raw FROM v_raw_findings GROUP BY scan_id) SELECT scan_id, raw, round({DAMP.format('raw')}, 6) AS damped FROM s")
def agg_damp(t: Tables) -> DataFrame:
    raw = t.v_raw_findings.groupBy("scan_id").agg(F.round(F.sum(S.deduction(F.col("severity"), F.col("confidence"), F.col("validation"))), 6).alias("raw"))
    return raw.select("scan_id", "raw", F.round(S.damp(F.col("raw")), 6).alias("damped"))


@query(f"WITH {scores_sql('v_raw_findings', 'v_raw_findings', 'scan_id')} SELECT * FROM cs")
def agg_category_score(t: Tables) -> DataFrame:
    return P.category_scores(t.v_raw_findings, t.v_raw_findings.select("scan_id").distinct(), ["scan_id"])


METRICS = """SELECT user_id AS scan_id, count(*) FILTER (WHERE event_type = 'view') % 4 AS test_files, (count(*) % 50) / 100.0 AS test_ratio, CASE WHEN user_id % 3 <> 0 THEN (user_id % 100) / 100.0 END AS coverage,
    (user_id % 30) / 100.0 AS duplication, CAST(user_id % 15 AS DOUBLE) AS avg_complexity, user_id % 70 AS dead_code_count FROM events GROUP BY user_id"""


def _metrics(t: Tables) -> DataFrame:
    u = F.col("user_id")
    return t.events.groupBy(u.alias("scan_id")).agg(
        (F.count_if(F.col("event_type") == "view") % 4).alias("test_files"), (F.count("*") % 50 / 100).alias("test_ratio"), F.when(F.first(u) % 3 != 0, F.first(u) % 100 / 100).alias("coverage"),
        (F.first(u) % 30 / 100).alias("duplication"), (F.first(u) % 15).cast("double").alias("avg_complexity"), (F.first(u) % 70).alias("dead_code_count"),
    )


STRUCTURAL = f"""x AS ({METRICS}), st AS (SELECT scan_id, 'testing' AS category, CASE WHEN test_files = 0 THEN 45 WHEN test_ratio < 0.3 THEN floor((0.3 - test_ratio) * 80 + 0.5) ELSE 0 END
      + CASE WHEN coverage < 0.6 THEN floor((0.6 - coverage) * 40 + 0.5) ELSE 0 END AS extra FROM x
    UNION ALL SELECT scan_id, 'maintainability', CASE WHEN duplication > 0.05 THEN floor(least(20, duplication * 150) + 0.5) ELSE 0 END + CASE WHEN avg_complexity > 8 THEN floor(least(15, (avg_complexity - 8) * 3) + 0.5) ELSE 0 END FROM x
    UNION ALL SELECT scan_id, 'ai-code', CASE WHEN dead_code_count > 10 THEN least(15, floor(dead_code_count / 4.0 + 0.5)) ELSE 0 END FROM x)"""


@query(f"WITH {STRUCTURAL} SELECT scan_id, category, CAST(extra AS DOUBLE) AS points FROM st")
def agg_structural(t: Tables) -> DataFrame:
    m = _metrics(t)
    parts = F.array(*[F.struct(F.lit(c).alias("category"), x.cast("double").alias("points")) for c, x in P.structural().items()])
    return m.select("scan_id", F.explode(F.transform(parts, lambda p: p)).alias("p")).select("scan_id", "p.category", "p.points")


@query(f"""WITH {scores_sql('v_raw_findings', 'v_raw_findings', 'scan_id')}, {STRUCTURAL},
    f AS (SELECT scan_id, category, finding_count, round(points + coalesce(extra, 0), 6) AS points FROM cs0 LEFT JOIN st USING (scan_id, category))
    SELECT scan_id, category, finding_count, points, CAST(least(100, greatest(0, floor(100 - ({DAMP.format('points')}) + 0.5))) AS BIGINT) AS score FROM f""")
def scan_category_scores(t: Tables) -> DataFrame:
    """Category scores with the scans' structural points: the flagship."""
    return P.category_scores(t.v_raw_findings, t.v_raw_findings.select("scan_id").distinct(), ["scan_id"], _metrics(t))


HEALTH = f"CAST(least(100, greatest(0, floor(round(sum(score * {WEIGHT}), 6) + 0.5))) AS BIGINT)"


@query(f"WITH {scores_sql('v_raw_findings', 'v_raw_findings', 'scan_id')} SELECT scan_id, {HEALTH} AS overall FROM cs GROUP BY scan_id")
def agg_health_score(t: Tables) -> DataFrame:
    return P.health(agg_category_score(t), ["scan_id"])


@query(f"""WITH sc AS (SELECT DISTINCT scan_id, root_cause AS scenario FROM v_raw_findings),
    lf AS (SELECT f.*, sc.scenario FROM v_raw_findings f JOIN sc ON f.scan_id = sc.scan_id WHERE f.root_cause <> sc.scenario),
    {scores_sql('lf', 'sc', 'scan_id, scenario')} SELECT scan_id, scenario, {HEALTH} AS overall FROM cs GROUP BY scan_id, scenario""")
def agg_project_score(t: Tables) -> DataFrame:
    """The score of each scan if one cause were resolved, for every cause, in one plan."""
    f = t.v_raw_findings
    return P.what_if(f, f.select("scan_id", F.col("root_cause").alias("scenario"), "raw_id"), ["scan_id"], "raw_id")


LOW = "greatest(1, floor((minutes * 0.6 + first * 0.4) / 60 + 0.5))"
CAUSES = f"""l AS (SELECT *, {CANON} AS cause, {SEV} AS sev FROM v_raw_findings WHERE validation <> 'dismissed'),
    c0 AS (SELECT scan_id, cause, count(*) AS n, min(sev) AS sev, sum(effort_minutes) AS minutes, arg_min(effort_minutes, raw_id) AS first, array_to_string(list_sort(list(raw_id)), ',') AS ids FROM l GROUP BY ALL),
    c AS (SELECT scan_id, cause, n, {SEV_NAME.format('sev')} AS severity, CAST({LOW} AS BIGINT) AS hours_low, CAST(greatest({LOW} + 1, floor(minutes / 60 * 1.2 + 0.5)) AS BIGINT) AS hours_high, ids FROM c0)"""


def _causes(t: Tables) -> DataFrame:
    return P.root_causes(t.v_raw_findings, O.canonical_cause(F.col("root_cause")), ["scan_id"], ["raw_id"])


@query(f"WITH {CAUSES} SELECT * FROM c")
def agg_root_causes(t: Tables) -> DataFrame:
    return _causes(t)


@query(f"""WITH {CAUSES}, {STRUCTURAL} SELECT scan_id, CAST(sum(hours_low) AS BIGINT) AS hours_low, CAST(sum(hours_high) AS BIGINT) AS hours_high, CAST(sum(n) AS BIGINT) AS covered, count(*) AS causes, any_value(overall) AS projected FROM c JOIN (SELECT scan_id, {HEALTH} AS overall FROM (SELECT scan_id, category, CAST(least(100, greatest(0, floor(100 - ({DAMP.format('coalesce(extra, 0)')}) + 0.5))) AS BIGINT) AS score
    FROM (SELECT DISTINCT scan_id FROM v_raw_findings) CROSS JOIN (VALUES {CATEGORIES}) k(category) LEFT JOIN st USING (scan_id, category)) GROUP BY scan_id) USING (scan_id) GROUP BY scan_id""")
def agg_plan(t: Tables) -> DataFrame:
    """Each scan's plan, with the score that its metrics leave once all findings are resolved."""
    scans = t.v_raw_findings.select("scan_id").distinct()
    then = P.health(P.category_scores(t.v_raw_findings.limit(0), scans, ["scan_id"], _metrics(t)), ["scan_id"]).withColumnRenamed("overall", "projected")
    plan = _causes(t).groupBy("scan_id").agg(F.sum("hours_low").alias("hours_low"), F.sum("hours_high").alias("hours_high"), F.sum("n").alias("covered"), F.count("*").alias("causes"))
    return plan.join(then, "scan_id")


@query(f"WITH {CAUSES} SELECT scan_id, cause, hours_low, hours_high FROM c WHERE n > 1")
def agg_effort(t: Tables) -> DataFrame:
    return _causes(t).where("n > 1").select("scan_id", "cause", "hours_low", "hours_high")


@query(f"""WITH {CAUSES}, k AS (SELECT scan_id, row_number() OVER w AS k, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS covered, sum(n) OVER (PARTITION BY scan_id) AS "all" FROM c WINDOW w AS (PARTITION BY scan_id ORDER BY n DESC, cause))
    SELECT scan_id, CAST(min(k) AS INT) AS causes, CAST(min(covered) AS BIGINT) AS covered, CAST(max("all") AS BIGINT) AS findings FROM k WHERE covered >= ceil(0.6 * "all") GROUP BY scan_id""")
def agg_concentration(t: Tables) -> DataFrame:
    return P.concentration(_causes(t), ["scan_id"])


@query(f"""WITH {CAUSES} SELECT scan_id, cause, severity, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY {SEV}, n / hours_high DESC, cause) AS INT) AS place FROM c""")
def srt_root_causes(t: Tables) -> DataFrame:
    w = Window.partitionBy("scan_id").orderBy(S.severity_ord(F.col("severity")), F.desc(F.col("n") / F.col("hours_high")), "cause")
    return _causes(t).select("scan_id", "cause", "severity", F.row_number().over(w).alias("place"))


COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in S.SEVERITIES)


@query(f"SELECT scan_id, {COUNTS} FROM v_raw_findings WHERE validation <> 'dismissed' GROUP BY scan_id")
def agg_count_severity(t: Tables) -> DataFrame:
    return O.severity_counts(flt_live(t))


@query("SELECT scan_id, category, count(*) AS n FROM v_raw_findings WHERE validation <> 'dismissed' GROUP BY ALL")
def agg_count_category(t: Tables) -> DataFrame:
    return t.v_raw_findings.where("validation <> 'dismissed'").groupBy("scan_id", "category").agg(F.count("*").alias("n"))


@query("SELECT scan_id, severity, count(*) FILTER (WHERE validation <> 'dismissed') AS live, count(*) AS with_dismissed FROM v_raw_findings GROUP BY ALL")
def agg_count_toggle(t: Tables) -> DataFrame:
    return t.v_raw_findings.groupBy("scan_id", "severity").agg(F.count_if(F.col("validation") != "dismissed").alias("live"), F.count("*").alias("with_dismissed"))


@query(f"WITH {MERGED}, ag AS (SELECT scan_id, unnest(string_split(detected_by, ',')) AS agent FROM m) SELECT scan_id, agent, count(*) AS findings FROM ag GROUP BY ALL")
def agg_agent_runs(t: Tables) -> DataFrame:
    return _merged(t).select("scan_id", F.explode(F.split("detected_by", ",")).alias("agent")).groupBy("scan_id", "agent").agg(F.count("*").alias("findings"))


@query(f"""WITH s AS (SELECT scan_id, {COUNTS.replace("severity = ", "validation <> 'dismissed' AND severity = ")}, count(*) FILTER (WHERE severity IN ('critical', 'high') AND validation IN ('confirmed', 'likely')) AS urgent, count(*) FILTER (WHERE validation = 'dismissed') AS dismissed, count(*) FILTER (WHERE validation <> 'dismissed') AS live FROM v_raw_findings GROUP BY scan_id)
    SELECT *, CASE WHEN live = 0 THEN 'No high-confidence issues were identified by this analysis.' WHEN critical > 0 THEN critical || CASE critical WHEN 1 THEN ' critical issue needs' ELSE ' critical issues need' END || ' attention before anything else.'
    WHEN urgent > 0 THEN urgent || CASE urgent WHEN 1 THEN ' issue requires' ELSE ' issues require' END || ' attention; nothing is critical.' ELSE 'No critical or high-confidence issues, but there is technical debt worth scheduling.' END AS headline FROM s""")
def agg_summary(t: Tables) -> DataFrame:
    """Counts and the headline of each scan."""
    return O.summary(t.v_raw_findings)


def _order_sql(by: str) -> str:
    return f"SELECT raw_id, scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY {by}, raw_id) AS INT) AS place FROM v_raw_findings"


@query(f"""SELECT a.raw_id, a.scan_id, a.place AS by_severity, b.place AS by_confidence, c.place AS by_file, d.place AS by_category FROM ({_order_sql(SEV + ', round(confidence, 6) DESC')}) a
    JOIN ({_order_sql('round(confidence, 6) DESC')}) b USING (raw_id) JOIN ({_order_sql('path, start_line')}) c USING (raw_id) JOIN ({_order_sql('category, ' + SEV)}) d USING (raw_id)""")
def srt_findings(t: Tables) -> DataFrame:
    f = t.v_raw_findings.withColumn("confidence", F.round("confidence", 6))
    place = lambda kind: F.row_number().over(Window.partitionBy("scan_id").orderBy(*O.order(kind))).alias(f"by_{kind}")
    return f.select("raw_id", "scan_id", *[place(k) for k in ("severity", "confidence", "file", "category")])


@query(f"SELECT raw_id, scan_id, place FROM ({_order_sql(SEV + ', round(confidence, 6) DESC')})")
def srt_severity_conf(t: Tables) -> DataFrame:
    return O.ranked(t.v_raw_findings.withColumn("confidence", F.round("confidence", 6)), "severity").select("raw_id", "scan_id", "place")


@query(f"SELECT raw_id, scan_id, place FROM ({_order_sql(SEV + ', round(confidence, 6) DESC')}) WHERE place <= 5")
def top_priorities(t: Tables) -> DataFrame:
    return srt_severity_conf(t).where("place <= 5")


@query(f"""SELECT raw_id, {SEV} AS severity_ord, CASE WHEN confidence >= 0.85 THEN 'confirmed' WHEN confidence >= 0.65 THEN 'likely' ELSE 'potential' END AS status,
    'fnd_' || substr(sha256(scan_id || '|#|' || rule_id || '|#|' || path), 1, 16) AS id FROM (SELECT * REPLACE (round(confidence, 6) AS confidence) FROM v_raw_findings)""")
def fn_finding_columns(t: Tables) -> DataFrame:
    """fn_severity_ord, fn_status and fn_stable_id on one table."""
    f = t.v_raw_findings.withColumn("confidence", F.round("confidence", 6))
    return f.select("raw_id", S.severity_ord(F.col("severity")).alias("severity_ord"), S.status(F.col("confidence")).alias("status"), S.stable_id("fnd", F.col("scan_id").cast("string"), F.col("rule_id"), F.col("path")).alias("id"))


@query("SELECT scan_id, overall, CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 80 THEN 'Healthy' WHEN overall >= 70 THEN 'Fair' WHEN overall >= 50 THEN 'At risk' ELSE 'Critical' END AS label FROM "
       "(SELECT scan_id, score AS overall FROM v_scans WHERE score IS NOT NULL)")
def prj_score_label(t: Tables) -> DataFrame:
    return t.v_scans.where("score is not null").select("scan_id", F.col("score").alias("overall"), S.score_label(F.col("score")).alias("label"))


@query("""SELECT scan_id, category, raw_id, title FROM v_raw_findings WHERE agent_ord < 4 UNION ALL SELECT scan_id, category, raw_id, NULL AS title FROM v_raw_findings WHERE agent_ord >= 4""")
def set_union_findings(t: Tables) -> DataFrame:
    f = t.v_raw_findings
    first, rest = f.where("agent_ord < 4").select("scan_id", "category", "raw_id", "title"), f.where("agent_ord >= 4").select("scan_id", "raw_id", "category")
    return first.unionByName(rest, allowMissingColumns=True)


@query("SELECT raw_id, scan_id FROM v_raw_findings f WHERE NOT EXISTS (SELECT 1 FROM v_raw_findings r WHERE r.raw_id = f.raw_id AND r.root_cause IN ('cause-5', 'cause-7'))")
def set_difference_resolved(t: Tables) -> DataFrame:
    f = t.v_raw_findings
    return f.select("raw_id", "scan_id").join(f.where(F.col("root_cause").isin("cause-5", "cause-7")).select("raw_id"), "raw_id", "left_anti")


@query("SELECT scan_id, count(*) FILTER (WHERE path LIKE 'src/m1%') AS suppressed, count(*) FILTER (WHERE path NOT LIKE 'src/m1%') AS kept FROM v_raw_findings GROUP BY scan_id")
def set_partition_suppressed(t: Tables) -> DataFrame:
    hit = F.col("path").startswith("src/m1")
    return t.v_raw_findings.groupBy("scan_id").agg(F.count_if(hit).alias("suppressed"), F.count_if(~hit).alias("kept"))


@query("""WITH e AS (SELECT scan_id, k, kind, label, min(raw_id) AS first FROM (SELECT scan_id, path || '#' || start_line AS k, category AS kind, substr(title, 1, 80) AS label, raw_id FROM v_raw_findings) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY scan_id, k ORDER BY first) AS rn FROM e) SELECT scan_id, k, kind, label, CAST(rn AS INT) AS place FROM o WHERE rn <= 8""")
def set_distinct_evidence(t: Tables) -> DataFrame:
    e = t.v_raw_findings.select("scan_id", F.concat_ws("#", "path", "start_line").alias("k"), F.col("category").alias("kind"), F.substring("title", 1, 80).alias("label"), "raw_id")
    e = e.groupBy("scan_id", "k", "kind", "label").agg(F.min("raw_id").alias("first"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("scan_id", "k").orderBy("first"))).where("place <= 8").drop("first")


@query("""SELECT raw_id, round(CASE WHEN raw_id % 3 <> 0 THEN confidence WHEN raw_id % 2 = 0 THEN greatest(0.05, least(0.99, least(confidence, (raw_id % 10) / 10.0) * 0.5))
    ELSE greatest(0.05, least(0.99, (confidence + (raw_id % 10) / 10.0) / 2)) END, 6) AS confidence FROM v_raw_findings""")
def join_judgement(t: Tables) -> DataFrame:
    f = t.v_raw_findings
    j = f.where("raw_id % 3 = 0").select("raw_id", F.when(F.col("raw_id") % 2 == 0, "false_positive").otherwise("real").alias("verdict"), (F.col("raw_id") % 10 / 10).alias("judged"))
    return O.blend(f, j, "raw_id").select("raw_id", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {SEV}, round(confidence, 6) DESC, raw_id) AS rn FROM v_raw_findings WHERE severity IN ('critical', 'high'))
    SELECT raw_id, round(greatest(0.05, least(0.97, (confidence + (raw_id % 10) / 10.0) / 2)), 6) AS confidence, raw_id % 10 < 2 AS dismissed FROM r WHERE rn <= 8""")
def join_verdict(t: Tables) -> DataFrame:
    """At most eight critical or high findings of a scan are adjudicated."""
    f = t.v_raw_findings.where(F.col("severity").isin("critical", "high")).withColumn("confidence", F.round("confidence", 6))
    asked = O.ranked(f, "severity").where("place <= 8")
    verdicts = t.v_raw_findings.select("raw_id", (F.col("raw_id") % 10 / 10).alias("judged"))
    j = asked.join(verdicts, "raw_id", "left")
    return j.select("raw_id", F.round(S.clamp((F.col("confidence") + F.col("judged")) / 2, 0.05, 0.97), 6).alias("confidence"), (F.col("judged") < 0.2).alias("dismissed"))


SIGNALS = """s AS (SELECT raw_id, confidence AS base, 'corroborated' AS signal, 0.12 AS weight FROM v_raw_findings WHERE agent_ord >= 6
    UNION ALL SELECT raw_id, confidence, 'in a test', -0.30 FROM v_raw_findings WHERE path LIKE '%m7.ts' UNION ALL SELECT raw_id, confidence, 'reachable', 0.08 FROM v_raw_findings WHERE start_line % 2 = 0
    UNION ALL SELECT raw_id, confidence, 'bound parameters', -0.45 FROM v_raw_findings WHERE rule_id = 'sec.sql-injection' AND start_line % 5 = 0)"""


@query(f"""WITH {SIGNALS}, a AS (SELECT raw_id, sum(weight) AS total, min(weight) AS least_weight, count(*) AS signals FROM s GROUP BY raw_id)
    SELECT raw_id, coalesce(signals, 0) AS signals, round(greatest(0.05, least(0.97, confidence + coalesce(total, 0))), 6) AS confidence,
    round(confidence + coalesce(total, 0), 6) < 0.3 OR coalesce(least_weight, 0) <= -0.4 AS dismissed FROM v_raw_findings LEFT JOIN a USING (raw_id)""")
def agg_signal_sum(t: Tables) -> DataFrame:
    """val_signals as weighted rows, and their sum: clamped, and dismissed if low or if one signal weighs heavily against."""
    f = t.v_raw_findings
    rows = [
        ("corroborated", 0.12, F.col("agent_ord") >= 6),
        ("in a test", -0.30, F.col("path").endswith("m7.ts")),
        ("reachable", 0.08, F.col("start_line") % 2 == 0),
        ("bound parameters", -0.45, (F.col("rule_id") == "sec.sql-injection") & (F.col("start_line") % 5 == 0)),
    ]
    held = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("signal"), F.lit(w).alias("weight"))) for n, w, c in rows]))
    s = f.select("raw_id", F.explode(held).alias("s")).groupBy("raw_id").agg(F.sum("s.weight").alias("total"), F.min("s.weight").alias("least"), F.count("*").alias("signals"))
    j = f.join(s, "raw_id", "left")
    total = F.col("confidence") + F.coalesce("total", F.lit(0.0))
    return j.select("raw_id", F.coalesce("signals", F.lit(0)).alias("signals"), F.round(S.clamp(total, 0.05, 0.97), 6).alias("confidence"), ((F.round(total, 6) < 0.3) | (F.coalesce("least", F.lit(0.0)) <= -0.4)).alias("dismissed"))


@query("""WITH r AS (SELECT rule_id, min(raw_id) AS first FROM v_raw_findings WHERE validation <> 'dismissed' GROUP BY rule_id),
    i AS (SELECT rule_id, row_number() OVER (ORDER BY first) - 1 AS rule_index FROM r)
    SELECT f.raw_id, CAST(rule_index AS INT) AS rule_index, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' WHEN severity = 'info' THEN 'none' ELSE 'note' END AS level, path AS uri, greatest(1, start_line) AS region
    FROM v_raw_findings f JOIN i USING (rule_id) WHERE validation <> 'dismissed'""")
def sink_sarif(t: Tables) -> DataFrame:
    """The flat part of the SARIF export: rules in the order of first appearance, levels, places; dismissed findings are left out."""
    live = t.v_raw_findings.where("validation <> 'dismissed'")
    rules = live.groupBy("rule_id").agg(F.min("raw_id").alias("first"))  # a row for each rule
    rules = rules.withColumn("rule_index", F.row_number().over(Window.orderBy("first")) - 1)
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").when(F.col("severity") == "info", "none").otherwise("note")
    return live.join(F.broadcast(rules), "rule_id").select("raw_id", "rule_index", level.alias("level"), F.col("path").alias("uri"), F.greatest(F.lit(1), "start_line").alias("region"))


@query("""SELECT raw_id, replace(replace(title, 'error', 'e…r'), 'click', 'c…k') AS title FROM v_raw_findings""")
def sec_redact(t: Tables) -> DataFrame:
    """Values found anywhere in a scan are masked in its findings' text."""
    f = t.v_raw_findings
    kinds = f.where(F.col("severity").isin("critical", "low")).select("scan_id", F.when(F.col("severity") == "critical", "error").otherwise("click").alias("value")).distinct()
    secrets = kinds.withColumn("mask", F.concat(F.left("value", F.lit(1)), F.lit("…"), F.right("value", F.lit(1))))
    return O.redact(f, secrets, ["title"]).select("raw_id", "title")


@query(f"""WITH p AS (SELECT raw_id, scan_id, category, {POINTS} AS points FROM v_raw_findings WHERE validation <> 'dismissed'), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, category ORDER BY points DESC, raw_id) AS place FROM p)
    SELECT scan_id, category, raw_id, points, CAST(place AS INT) AS place FROM r WHERE place <= 8""")
def agg_category_deductions(t: Tables) -> DataFrame:
    """The eight findings that cost each category most."""
    p = t.v_raw_findings.where("validation <> 'dismissed'").select("raw_id", "scan_id", "category", S.deduction(F.col("severity"), F.col("confidence"), F.col("validation")).alias("points"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("scan_id", "category").orderBy(F.desc("points"), "raw_id"))).where("place <= 8")
