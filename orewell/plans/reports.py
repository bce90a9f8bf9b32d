"""Queries of plans, validation, sinks, sources and package findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.scores import stable_id
from ..operators import detect as D
from ..operators import graph as G
from ..operators import packages as K
from ..operators import plan as L
from ..operators import reports as O
from ..operators import structure as S
from ..operators import validate as V
from ..operators import rules as R
from ..operators.findings import canonical_cause, dedupe_key
from ..operators.imports import module_edges
from ..session import scratch, staged
from ..streaming import events as E
from ..streaming import sinks
from .audit import BASE, EDGES, _hits_sql, _plain, _quoted, _sql
from .files import ENTRIES, any_of
from .findings import CANON, CAUSES, CWE, HEALTH, KEY, OWASP, scores_sql
from .graphs import COMP, COMPONENTS
from .packages import PACK, REGISTRY, _registry
from .registry import Tables, query
from .structure import _NOTABLE, FUNCTIONS, REFS, RESOLVED, _code, _resolved, _shared

# Plans

_CATEGORY = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.CAUSE_CATEGORY.items()) + " ELSE 'maintainability' END"
_PHASE = "CASE theme " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(L.PHASES)) + " END"
_TITLE = "CASE theme " + " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in L.PHASES.items()) + " END"


@query(f"""WITH {CAUSES}, w AS (SELECT scan_id, {_CATEGORY.format('cause')} AS theme, count(*) AS causes, CAST(sum(n) AS BIGINT) AS findings, CAST(sum(hours_low) AS BIGINT) AS hours_low, CAST(sum(hours_high) AS BIGINT) AS hours_high FROM c GROUP BY ALL),
    lv AS (SELECT * FROM v_raw_findings WHERE validation <> 'dismissed'), {scores_sql('lv', 'lv', 'scan_id')}, b AS (SELECT scan_id, {HEALTH} AS base FROM cs GROUP BY scan_id),
    sx AS (SELECT DISTINCT scan_id, {_CATEGORY.format(CANON)} AS theme FROM lv), lf AS (SELECT lv.*, sx.theme FROM lv JOIN sx ON lv.scan_id = sx.scan_id WHERE {_CATEGORY.format(CANON)} <> sx.theme),
    {scores_sql('lf', 'sx', 'scan_id, theme').replace('t AS (', 't2 AS (', 1).replace('FROM t GROUP', 'FROM t2 GROUP').replace('pts', 'pts2').replace('cnt', 'cnt2').replace('grid', 'grid2').replace('cs0', 'csb').replace('cs AS', 'cs2 AS')}, o AS (SELECT scan_id, theme, {HEALTH} AS overall FROM cs2 GROUP BY scan_id, theme)
    SELECT w.scan_id, w.theme, {_TITLE.replace('theme', 'w.theme')} AS title, CAST(row_number() OVER (PARTITION BY w.scan_id ORDER BY {_PHASE.replace('theme', 'w.theme')}) AS INT) AS place, causes, findings, hours_low, hours_high, greatest(0, overall - base) AS gain FROM w JOIN o USING (scan_id, theme) JOIN b USING (scan_id)""")
def agg_phases(t: Tables) -> DataFrame:
    return L.phases(t.v_raw_findings, canonical_cause(F.col("root_cause")), ["raw_id"])


#: Bound to the causes that the findings over v_code have.
_RECS = ", ".join(f"('{n}', '{c}')" for n, c, _ in L.RECOMMENDATIONS)
_KNOWN = " UNION ALL ".join(f"SELECT '{n}' AS name, '{p}' AS package" for n, _, ps in L.RECOMMENDATIONS for p in ps)
_DECLARED = "d AS (SELECT DISTINCT scan_id, CASE scan_id % 3 WHEN 0 THEN 'dompurify' WHEN 1 THEN 'pino' ELSE 'lodash' END AS package FROM v_code)"


@query(f"{BASE}, h AS ({_hits_sql(_plain([*R.SECURITY, *R.AI_CODE]))}), {_DECLARED}, kn AS ({_KNOWN}) SELECT scan_id, v.name, count(*) AS findings FROM h JOIN (VALUES {_RECS}) v(name, cause) ON cause = root_cause WHERE NOT EXISTS (SELECT 1 FROM d JOIN kn ON kn.package = d.package WHERE d.scan_id = h.scan_id AND kn.name = v.name) GROUP BY ALL")
def agg_recommendations(t: Tables) -> DataFrame:
    n = F.col("scan_id") % 3
    packages = t.v_code.select("scan_id", F.when(n == 0, "dompurify").when(n == 1, "pino").otherwise("lodash").alias("name")).distinct()
    return L.recommendations(D.by_rules(_code(t), [*R.SECURITY, *R.AI_CODE]), packages)


@query(f"WITH l AS (SELECT scan_id, {CANON} AS cause, raw_id, 'fix ' || rule_id || ' in ' || path AS patch FROM v_raw_findings WHERE validation <> 'dismissed' AND raw_id % 5 = 0) SELECT scan_id, cause, count(*) AS patches, string_agg(patch, chr(10) ORDER BY raw_id) AS bundle FROM l GROUP BY ALL")
def join_patches(t: Tables) -> DataFrame:
    live = t.v_raw_findings.where("validation <> 'dismissed'").select("scan_id", canonical_cause(F.col("root_cause")).alias("cause"), "raw_id")
    patches = t.v_raw_findings.where("raw_id % 5 = 0").select("raw_id", F.concat(F.lit("fix "), "rule_id", F.lit(" in "), "path").alias("patch"))
    return L.patch_bundles(live, patches)


# Titles of findings about functions.
TITLES = {"complex": ("`%s()` has a complexity of %d", "complexity"), "long": ("`%s()` runs to %d lines", "lines"), "wide": ("`%s()` takes %d parameters", "parameters"), "deep": ("`%s()` branches %d ways", "complexity")}
_TITLED = "CASE kind " + " ".join(f"WHEN '{k}' THEN printf('{f}', name, {c})" for k, (f, c) in TITLES.items()) + " END"


@query(f"{FUNCTIONS} SELECT scan_id, path, start_line, kind, {_TITLED} AS title, CASE WHEN kind = 'complex' AND complexity >= 30 THEN 'medium' ELSE 'low' END AS severity FROM ({_NOTABLE})")
def prj_title_severity(t: Tables) -> DataFrame:
    title = F.lit(None).cast("string")
    for kind, (text, value) in TITLES.items():
        title = F.when(F.col("kind") == kind, F.format_string(text, "name", value)).otherwise(title)
    return S.notable(S.function_spans(_code(t))).select("scan_id", "path", "start_line", "kind", title.alias("title"), F.when((F.col("kind") == "complex") & (F.col("complexity") >= 30), "medium").otherwise("low").alias("severity"))


@query(f"{BASE}, h AS ({_hits_sql(_plain(R.SHIPPED))}) SELECT h.scan_id, {COMP.format('h.path')} AS component, count(*) AS findings FROM h GROUP BY ALL")
def join_membership(t: Tables) -> DataFrame:
    """Findings by the component that their file belongs to: an equi-join on scan and path."""
    f = _code(t)
    members = f.select("scan_id", "path", G.component(F.col("path"), COMPONENTS).alias("component"))
    return D.by_rules(f, R.SHIPPED).join(members, ["scan_id", "path"]).groupBy("scan_id", "component").agg(F.count("*").alias("findings"))


# Services by the packages and addresses that code names.
SERVICES = (
    ("Stripe", r"(?i)['\"]stripe['\"]|stripe\.(com|js)"), ("AWS", r"(?i)@aws-sdk|['\"]aws-sdk['\"]|boto3"), ("PostgreSQL", r"(?i)['\"]pg['\"]|postgres(?:ql)?:\/\/|psycopg"), ("MySQL", r"['\"]mysql2?['\"]|mysql:\/\/"), ("MongoDB", r"mongoose|mongodb(\+srv)?:\/\/"),
    ("Redis", r"['\"]ioredis['\"]|['\"]redis['\"]|redis:\/\/"), ("Email provider", r"(?i)@sendgrid|['\"]resend['\"]|['\"]nodemailer['\"]|postmark"), ("Object storage", r"(?i)s3\.|S3Client|cloudinary|['\"]@vercel\/blob['\"]"), ("Identity provider", r"(?i)next-auth|@auth\/|clerk|auth0|@supabase\/auth"),
    ("AI provider", r"(?i)['\"]openai['\"]|@anthropic-ai|generativelanguage"), ("Message broker", r"(?i)['\"]bullmq['\"]|amqplib|kafkajs|@aws-sdk\/client-sqs"),
)


def externals(files: DataFrame, services: tuple = SERVICES, most: int = 8) -> DataFrame:
    """scan_id, service, files, components: services that the files of a scan name (one match a file, the first ``most`` files), and the components that call them."""
    from pyspark.sql import Window

    own = files.where("not is_vendor and not is_generated and not is_test")
    named = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(n)) for n, p in services]))
    rows = own.select("scan_id", "path", F.explode(named).alias("service"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("scan_id", "service").orderBy("path"))).where(F.col("place") <= most)
    return rows.groupBy("scan_id", "service").agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_set(G.component(F.col("path"), COMPONENTS))), ",").alias("components"))


_USED = (*SERVICES, ("Lodash", r"['\"]lodash['\"]"))


@query(f"""{BASE}, x AS (SELECT f.scan_id, f.path, service FROM f JOIN (VALUES {', '.join(f"('{n}', '{_quoted(p)}')" for n, p in _USED)}) v(service, pattern) ON regexp_matches(content, pattern) WHERE NOT is_vendor AND NOT is_generated AND NOT is_test),
    o AS (SELECT *, row_number() OVER (PARTITION BY scan_id, service ORDER BY path) AS place FROM x) SELECT scan_id, service, count(*) AS files, array_to_string(list_sort(list(DISTINCT {COMP.format('path')})), ',') AS components FROM o WHERE place <= 8 GROUP BY ALL""")
def grf_externals(t: Tables) -> DataFrame:
    """The services, and one more that v_code names."""
    return externals(_code(t), _USED)


# Validation

_REACH = f"{EDGES}, rc AS (SELECT scan_id, path FROM f WHERE {any_of(ENTRIES, 'path')} UNION SELECT e.scan_id, e.dst FROM rc JOIN e ON e.scan_id = rc.scan_id AND e.src = rc.path)"
_SIGNALS = f"""h AS ({_hits_sql(_plain(R.SHIPPED))}), ne AS (SELECT scan_id, count(*) AS entries FROM f WHERE {any_of(ENTRIES, 'path')} GROUP BY scan_id),
    s0 AS (SELECT h.*, f.is_test, rc.path IS NOT NULL AS reached, coalesce(entries, 0) > 0 AS has_entries, {any_of(ENTRIES, 'h.path')} AS is_entry FROM h JOIN f ON f.scan_id = h.scan_id AND f.path = h.path LEFT JOIN rc ON rc.scan_id = h.scan_id AND rc.path = h.path LEFT JOIN ne ON ne.scan_id = h.scan_id),
    s1 AS (SELECT *, list_filter([CASE WHEN has_entries AND NOT reached AND NOT is_entry THEN {{'label': 'not reachable from an entry point', 'weight': -0.28}} END, CASE WHEN has_entries AND reached THEN {{'label': 'reachable from an entry point', 'weight': 0.08}} END,
        CASE WHEN is_test THEN {{'label': 'test-only code', 'weight': -0.30}} END], lambda x: x IS NOT NULL) AS sg FROM s0), s2 AS (SELECT *, round(confidence + coalesce(list_sum(list_transform(sg, lambda x: x.weight)), 0), 6) AS total FROM s1),
    s AS (SELECT *, round(least(0.97, greatest(0.05, total)), 6) AS after, total < 0.3 OR coalesce(list_min(list_transform(sg, lambda x: x.weight)), 0) <= -0.4 AS dismissed FROM s2)"""
_CHECKED = f"{BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {REFS}, {RESOLVED}, {_REACH}, {_SIGNALS}"


def _validated(t: Tables) -> DataFrame:
    """Findings of all shipped rules over v_code with their signals; each file's reachability is known by scan. Code and findings, which several steps read, are written once."""
    f = _code(_shared(t))
    edges = module_edges(_resolved(t))
    entry = P.matches(F.col("path"), ENTRIES)
    modules = f.select("scan_id", "path", entry.alias("is_entry"))
    reached = G.scan_reachable(modules, edges).withColumn("reached", F.lit(True))
    with_entry = modules.groupBy("scan_id").agg(F.bool_or("is_entry").alias("has_entries"))
    known = modules.join(reached, ["scan_id", "path"], "left").join(with_entry, "scan_id").select("scan_id", "path", "is_entry", F.when(F.col("has_entries"), F.coalesce("reached", F.lit(False))).alias("reachable"))
    p = V.placed(staged(D.by_rules(f, R.SHIPPED)), f).join(known, ["scan_id", "path"], "left")
    return V.summed(V.signals(p, F.lit(1), F.col("reachable"), F.col("is_entry")))


@query(f"{_CHECKED} SELECT scan_id, path, line, rule_id, len(sg) AS signals, after, dismissed FROM s WHERE rule_id NOT IN ('sec.xss-dangerous-html', 'sec.jwt-unverified')")
def val_signals(t: Tables) -> DataFrame:
    """Signals that v_code can raise; tests on fixtures have the others."""
    return _validated(t).where(~F.col("rule_id").isin("sec.xss-dangerous-html", "sec.jwt-unverified")).select("scan_id", "path", "line", "rule_id", F.size("signals").cast("long").alias("signals"), "after", "dismissed")


_PCT = "CAST(floor(round({} * 100, 4) + 0.5) AS BIGINT) || '%'"
_SAID = f"""concat_ws(' ', CASE WHEN len(list_filter(sg, lambda x: x.weight > 0)) > 0 THEN 'Supporting: ' || array_to_string(list_transform(list_filter(sg, lambda x: x.weight > 0), lambda x: x.label), ', ') || '.' END,
    CASE WHEN len(list_filter(sg, lambda x: x.weight < 0)) > 0 THEN 'Against: ' || array_to_string(list_transform(list_filter(sg, lambda x: x.weight < 0), lambda x: x.label), ', ') || '.' END,
    'Confidence ' || CASE WHEN after > confidence THEN 'raised' WHEN after < confidence THEN 'lowered' ELSE 'unchanged' END || ' from ' || {_PCT.format('confidence')} || ' to ' || {_PCT.format('after')} || '.')"""


@query(f"{_CHECKED} SELECT scan_id, path, line, rule_id, {_SAID} AS rationale FROM s")
def fn_rationale(t: Tables) -> DataFrame:
    return _validated(t).select("scan_id", "path", "line", "rule_id", V.rationale(F.col("signals"), F.col("confidence"), F.col("after")).alias("rationale"))


@query(f"{_CHECKED}, g AS (SELECT *, list_filter(sg, lambda x: x.weight < 0)[1].label AS challenge FROM s) SELECT scan_id, path, line, rule_id, CASE WHEN len(sg) > 1 AND len(list_filter(sg, lambda x: x.weight > 0)) > 0 THEN 5 ELSE 4 END AS turns, challenge, {_SAID} AS verdict FROM g WHERE challenge IS NOT NULL")
def val_debate(t: Tables) -> DataFrame:
    d = _validated(t).withColumn("d", V.debate(F.col("signals"), F.col("confidence"), F.col("after"))).where("d is not null")
    return d.select("scan_id", "path", "line", "rule_id", F.size("d").alias("turns"), F.col("d")[1]["message"].alias("challenge"), F.element_at("d", -1)["message"].alias("verdict"))


@query(f"{_CHECKED} SELECT scan_id, count(*) AS findings, count(*) FILTER (WHERE len(list_filter(sg, lambda x: x.weight < 0)) > 0) AS debated FROM s GROUP BY scan_id")
def join_debate(t: Tables) -> DataFrame:
    """Each finding with its debate, if it has one."""
    turns = V.debate(F.col("signals"), F.col("confidence"), F.col("after"))
    return _validated(t).select("scan_id", turns.alias("turns")).groupBy("scan_id").agg(F.count("*").alias("findings"), F.count("turns").alias("debated"))


# Sinks and sources


@query("SELECT scan_id, count(*) AS n, sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END)::BIGINT AS critical FROM v_raw_findings GROUP BY scan_id")
def sink_report(t: Tables) -> DataFrame:
    """Report documents written by scan, twice; read back and opened."""
    docs, path = O.documents(t.v_raw_findings, "raw_id", "rule_id", "severity", "path"), scratch(t.spark)
    O.replace_scans(docs, path)
    O.replace_scans(docs.where("scan_id % 2 = 0"), path)
    held = F.from_json("document", "n long, findings array<struct<severity:string>>").alias("d")
    d = O.read_scans(t.spark, path, docs).select("scan_id", held)
    return d.select("scan_id", "d.n", F.size(F.filter("d.findings", lambda x: x["severity"] == "critical")).cast("long").alias("critical"))


@query("SELECT scan_id, raw_id, rule_id, CASE WHEN scan_id % 3 = 0 THEN 'info' ELSE severity END AS severity FROM v_raw_findings")
def sink_projections(t: Tables) -> DataFrame:
    """A projection table in which every third scan is replaced by a second write."""
    rows, path = t.v_raw_findings.select("scan_id", "raw_id", "rule_id", "severity"), scratch(t.spark)
    O.replace_scans(rows, path)
    O.replace_scans(rows.where("scan_id % 3 = 0").withColumn("severity", F.lit("info")), path)
    return O.read_scans(t.spark, path, rows)


@query("SELECT raw_id, scan_id, rule_id, severity, path, start_line FROM v_raw_findings")
def sink_json(t: Tables) -> DataFrame:
    """Findings as JSON lines, written and read back."""
    rows, path = t.v_raw_findings.select("raw_id", "scan_id", "rule_id", "severity", "path", "start_line"), scratch(t.spark)
    rows.write.json(path)
    return t.spark.read.schema(rows.schema).json(path)


@query("SELECT scan_id, seq, type FROM v_scan_events WHERE seq > 5")
def sink_events(t: Tables) -> DataFrame:
    """What an append of repeated events writes, if the first five of each scan are stored."""
    e = t.v_scan_events.select("scan_id", F.col("seq").cast("long").alias("seq"), "type")
    return O.append_events(e.where("seq <= 5"), e.unionByName(e.where("seq % 4 = 0")))


@query(f"""WITH l AS (SELECT *, {KEY} AS k FROM v_raw_findings WHERE validation <> 'dismissed'), f AS (SELECT scan_id, rule_id, min(raw_id) AS first FROM l GROUP BY ALL), x AS (SELECT scan_id, rule_id, row_number() OVER (PARTITION BY scan_id ORDER BY first) AS i FROM f)
    SELECT l.scan_id, '2.1.0' AS version, max(i) AS rules, count(*) AS results, arg_min(l.rule_id, raw_id) AS first_rule, arg_min(CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' WHEN severity = 'info' THEN 'none' ELSE 'note' END, raw_id) AS first_level,
    CAST(sum(i - 1) AS BIGINT) AS index_sum, count(*) FILTER (WHERE start_line % 2 = 0) AS related FROM l JOIN x ON x.scan_id = l.scan_id AND x.rule_id = l.rule_id GROUP BY l.scan_id""")
def sink_sarif_document(t: Tables) -> DataFrame:
    """The SARIF document of each scan, opened again."""
    other = F.when(F.col("start_line") % 2 == 0, F.array(F.struct("path", "start_line"))).otherwise(F.array().cast("array<struct<path:string,start_line:int>>"))
    f = t.v_raw_findings.withColumn("other_places", other).withColumn("id", stable_id("fnd", F.col("scan_id").cast("string"), dedupe_key(F.col("rule_id"), F.col("title"), F.col("path"), F.col("start_line"))))
    kind = "version string, runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleId:string,ruleIndex:long,level:string,relatedLocations:array<struct<id:long>>>>>>"
    d = O.sarif(f).select("scan_id", F.from_json("document", kind).alias("d")).select("scan_id", "d.version", F.col("d.runs")[0].alias("r"))
    results = F.col("r.results")
    return d.select("scan_id", "version", F.size("r.tool.driver.rules").cast("long").alias("rules"), F.size(results).cast("long").alias("results"), results[0]["ruleId"].alias("first_rule"), results[0]["level"].alias("first_level"),
                    F.aggregate(results, F.lit(0).cast("long"), lambda s, x: s + x["ruleIndex"]).alias("index_sum"), F.size(F.flatten(F.transform(results, lambda x: x["relatedLocations"]))).cast("long").alias("related"))


@query(f"""WITH r AS (SELECT scan_id, rule_id, arg_min(severity, raw_id) AS severity, arg_min(category, raw_id) AS category, arg_min(title, raw_id) AS title FROM v_raw_findings WHERE validation <> 'dismissed' GROUP BY ALL), w AS (SELECT *, {CWE} AS cwe, {OWASP} AS owasp FROM r)
    SELECT scan_id, rule_id, array_to_string(list_transform(regexp_split_to_array(rule_id, '[.-]'), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END), '') AS name, title, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' WHEN severity = 'info' THEN 'none' ELSE 'note' END AS level,
    concat_ws(',', category, cwe, CASE WHEN owasp IS NOT NULL THEN 'owasp' END) AS tags, CASE severity WHEN 'critical' THEN '9.5' WHEN 'high' THEN '7.5' WHEN 'medium' THEN '5.0' WHEN 'low' THEN '3.0' ELSE '1.0' END AS security_severity, cwe, owasp FROM w""")
def sink_sarif_rules(t: Tables) -> DataFrame:
    """The rules of each scan's SARIF document, opened again: name, level, tags and weakness."""
    f = t.v_raw_findings.withColumn("other_places", F.array().cast("array<struct<path:string,start_line:int>>")).withColumn("id", F.col("raw_id").cast("string"))
    kind = "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,name:string,shortDescription:struct<text:string>,defaultConfiguration:struct<level:string>,properties:struct<tags:array<string>,`security-severity`:string,cwe:string,owasp:string>>>>>>>"
    r = O.sarif(f).select("scan_id", F.explode(F.from_json("document", kind)["runs"][0]["tool"]["driver"]["rules"]).alias("r"))
    return r.select("scan_id", F.col("r.id").alias("rule_id"), "r.name", F.col("r.shortDescription.text").alias("title"), "r.defaultConfiguration.level", F.array_join("r.properties.tags", ",").alias("tags"), F.col("r.properties.`security-severity`").alias("security_severity"), "r.properties.cwe", "r.properties.owasp")


@query("SELECT advisory_id, ecosystem, name, severity FROM v_advisories")
def src_advisories(t: Tables) -> DataFrame:
    """The advisory table read from JSON lines."""
    path = scratch(t.spark)
    t.v_advisories.write.json(path)
    return O.advisories(t.spark, path).select("advisory_id", "ecosystem", "name", "severity")


_COVER = "CASE p_partkey % 4 WHEN 0 THEN '{\"total\":{\"lines\":{\"pct\":' || CAST(p_size AS STRING) || '}}}' WHEN 1 THEN '{\"total\":{\"statements\":{\"pct\":' || CAST(p_size + 1 AS STRING) || '}}}' WHEN 2 THEN '{\"total\":' ELSE '{}' END"


@query(f"""WITH f AS (SELECT CAST(floor(p_partkey / 3.0) AS BIGINT) AS scan_id, p_partkey % 3 AS o, CASE WHEN p_partkey % 4 = 0 THEN p_size WHEN p_partkey % 4 = 1 THEN p_size + 1 END AS pct FROM part) SELECT scan_id, round(arg_min(pct, o) FILTER (WHERE pct IS NOT NULL) / 100.0, 6) AS coverage FROM f WHERE pct IS NOT NULL GROUP BY scan_id""")
def src_coverage(t: Tables) -> DataFrame:
    n = F.col("p_partkey")
    path = F.element_at(F.array(*map(F.lit, O.COVERAGE_FILES)), (n % 3 + 1).cast("int"))
    files = t.part.select(F.floor(n / 3).alias("scan_id"), path.alias("path"), F.expr(_COVER).alias("content"))
    return O.coverage(files).select("scan_id", F.round("coverage", 6).alias("coverage"))


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN CASE WHEN s_suppkey % 10 >= 9 THEN 'critical' WHEN s_suppkey % 10 >= 7 THEN 'high' WHEN s_suppkey % 10 >= 4 THEN 'medium' ELSE 'low' END ELSE 'medium' END AS severity FROM supplier""")
def fn_osv_severity(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 6
    label = F.when(k == 0, "CRITICAL").when(k == 1, "moderate").when(k == 2, "Low")
    score = F.when(k == 3, F.concat((F.col("s_suppkey") % 10).cast("string"), F.lit(".0"))).when(k == 4, F.lit("CVSS:3.1/AV:N"))
    return t.supplier.select("s_suppkey", O.osv_severity(label, score).alias("severity"))


# The event log

_STATES = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.STATE_OF.items()) + " END"


@query("SELECT scan_id, seq, type, agent_ord, round(progress, 6) AS progress FROM v_scan_events")
def str_source(t: Tables) -> DataFrame:
    """The log as JSON lines, read as a stream into a table."""
    source, sink, marks = scratch(t.spark), scratch(t.spark), scratch(t.spark)
    t.v_scan_events.select(F.col("scan_id").cast("long"), F.col("seq").cast("long"), "type", F.col("agent_ord").cast("long"), "progress").select(F.to_json(F.struct("*")).alias("value")).write.text(source)
    stream = E.read_events(t.spark, source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
    stream.awaitTermination()
    return t.spark.read.schema(E.EVENT).parquet(sink).withColumn("progress", F.round("progress", 6))


def _log_stream(t: Tables, more: DataFrame | None = None) -> tuple[DataFrame, str, str]:
    """The log as JSON lines, read as a stream; a table's path and a checkpoint's."""
    source, e = scratch(t.spark), t.v_scan_events.select(F.col("scan_id").cast("long"), F.col("seq").cast("long"), "type", F.col("agent_ord").cast("long"), "progress")
    (e.unionByName(more) if more is not None else e).select(F.to_json(F.struct("*")).alias("value")).write.text(source)
    return E.read_events(t.spark, source), scratch(t.spark), scratch(t.spark)


@query("SELECT scan_id, seq, type, agent_ord, round(progress, 6) AS progress FROM v_scan_events")
def sink_events_stream(t: Tables) -> DataFrame:
    """The log, a fifth of it delivered twice, streamed into the sink that writes each event once, and read back."""
    again = t.v_scan_events.where("event_id % 5 = 0").select(F.col("scan_id").cast("long"), F.col("seq").cast("long"), "type", F.col("agent_ord").cast("long"), "progress")
    events, path, marks = _log_stream(t, again)
    sinks.start(events, path, marks, keys=("scan_id", "seq")).awaitTermination()
    return sinks.read(t.spark, path, E.EVENT).withColumn("progress", F.round("progress", 6))


@query(f"""SELECT scan_id, max(seq) AS last_seq, coalesce(arg_max({_STATES}, seq) FILTER (WHERE {_STATES} IS NOT NULL), 'queued') AS state, round(coalesce(max(progress), 0), 6) AS progress,
    count(*) FILTER (WHERE type = 'agent_finding') AS findings, count(*) FILTER (WHERE type = 'agent_error') AS errors FROM v_scan_events GROUP BY scan_id""")
def str_fold_stream(t: Tables) -> DataFrame:
    """The fold as a stream of states, the last one of each scan read back."""
    events, path, marks = _log_stream(t)
    sinks.start(E.fold_stream(events), path, marks, mode="update").awaitTermination()
    return sinks.latest(t.spark, path, f"scan_id long, {E.STATE}", "scan_id").withColumn("progress", F.round("progress", 6))


@query("WITH l AS (SELECT scan_id, min(seq) AS last FROM v_scan_events WHERE type = 'agent_error' GROUP BY scan_id) SELECT scan_id, seq, type FROM v_scan_events LEFT JOIN l USING (scan_id) WHERE last IS NULL OR seq <= last")
def str_terminal(t: Tables) -> DataFrame:
    """An error is taken for the end, as the log has no events of a scan's end."""
    return E.until_terminal(t.v_scan_events, ("agent_error",)).select("scan_id", F.col("seq").cast("long").alias("seq"), "type")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, type ORDER BY seq DESC) AS place FROM v_scan_events WHERE type IN ('log', 'agent_finding', 'agent_progress')) SELECT scan_id, seq, type FROM r WHERE place <= CASE type WHEN 'log' THEN 220 WHEN 'agent_finding' THEN 120 ELSE 40 END")
def lim_tail(t: Tables) -> DataFrame:
    return E.tail(t.v_scan_events).select("scan_id", F.col("seq").cast("long").alias("seq"), "type")


@query("SELECT scan_id, seq, type FROM v_scan_events")
def set_merge_log(t: Tables) -> DataFrame:
    e = t.v_scan_events.select("scan_id", F.col("seq").cast("long").alias("seq"), "type")
    return E.merge_logs(e.where("seq % 3 <> 1"), e.where("seq % 3 <> 2"))


# Package findings

_RISK = "CASE licence " + " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in K.LICENCE_RISK.items()) + " END"


@query(f"""WITH {PACK}, {REGISTRY}, {'{}'}
    SELECT scan_id, 'dep.known-vulnerability' AS rule_id, o.name, CASE WHEN dev AND severity = 'critical' THEN 'high' ELSE severity END AS severity FROM o JOIN v ON o.ecosystem = v.ecosystem AND o.name = v.name AND lo <= vn AND vn < hi
    UNION ALL SELECT scan_id, 'dep.unpinned-version', name, 'medium' FROM u WHERE version IN ('unpinned', '*', 'latest')
    UNION ALL SELECT DISTINCT scan_id, 'dep.missing-lockfile', 'package.json', 'medium' FROM o WHERE ecosystem = 'npm' AND scan_id % 2 = 1
    UNION ALL SELECT scan_id, 'dep.license-review', o.name, {_RISK} FROM o JOIN g USING (ecosystem, name) WHERE NOT dev AND {_RISK} IS NOT NULL""".replace(", {}", ", u AS (SELECT scan_id, name, CASE WHEN ord % 6 = 1 THEN 'unpinned' ELSE version END AS version FROM o)"))
def det_deps(t: Tables) -> DataFrame:
    """The four findings about packages. Every sixth declaration is taken for unpinned, and even scans for locked, as the packages table has neither."""
    own = K.one_each(t.v_packages)
    locked = own.where("scan_id % 2 = 0").select("scan_id").distinct()
    return K.findings(own, t.v_advisories, _registry(t), own.withColumn("version", F.when(F.col("ord") % 6 == 1, "unpinned").otherwise(F.col("version"))), locked)


@query(f"WITH {PACK}, n AS (SELECT scan_id, name FROM o WHERE NOT dev AND ord % 4 <> 1) SELECT scan_id, 'dep.unused' AS rule_id, count(*) AS packages, array_to_string((list_sort(list(name)))[1:6], ',') AS names FROM n GROUP BY scan_id HAVING count(*) >= 3")
def det_deps_unused(t: Tables) -> DataFrame:
    """Runtime packages that no file imports, if a scan has several; every fourth declaration is taken for imported."""
    own = K.one_each(t.v_packages)
    return K.unused(own, own.where("ord % 4 = 1").select("scan_id", F.col("name").alias("package"))).select("scan_id", F.lit("dep.unused").alias("rule_id"), "packages", "names")
