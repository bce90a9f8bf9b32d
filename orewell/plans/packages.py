"""Queries over packages and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import versions as V
from ..operators import packages as K
from .registry import Tables, query

CLEAN = "trim(regexp_replace(regexp_replace(trim({}), '^[\\^~>=<! v]+', ''), '[ ,|].*$', ''))"
PART = "CAST(coalesce(nullif(regexp_extract({0}, '^(\\d+)\\.(\\d+)(?:\\.(\\d+))?', {1}), ''), '0') AS INT)"


def ver(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^(\\d+)\\.(\\d+)') THEN {PART.format(x, 1)} * 1000000 + {PART.format(x, 2)} * 1000 + {PART.format(x, 3)} END"


PACK = f"""k AS (SELECT *, {CLEAN.format('version')} AS cv FROM v_packages), q AS (SELECT *, {ver('cv')} AS vn FROM k),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, ecosystem, name ORDER BY dev, ord) AS rn FROM q) WHERE rn = 1),
    v AS (SELECT ecosystem, name, advisory_id, severity, {ver('introduced_in')} AS lo, {ver('fixed_in')} AS hi FROM v_advisories)"""


@query(f"WITH {PACK} SELECT ord, cv AS version FROM q")
def fn_clean_version(t: Tables) -> DataFrame:
    return t.v_packages.select("ord", V.clean_version(F.col("version")).alias("version"))


@query(f"WITH {PACK} SELECT ord, {PART.format('cv', 1)} AS major, {PART.format('cv', 2)} AS minor, {PART.format('cv', 3)} AS patch FROM q")
def fn_semver(t: Tables) -> DataFrame:
    return t.v_packages.select("ord", V.semver(V.clean_version(F.col("version"))).alias("v")).select("ord", "v.major", "v.minor", "v.patch")


@query(f"WITH {PACK} SELECT a.ord, CAST(sign(a.vn - b.vn) AS INT) AS cmp FROM q a JOIN q b ON b.ord = a.ord + 1")
def fn_version_cmp(t: Tables) -> DataFrame:
    p = t.v_packages.select("ord", V.semver(V.clean_version(F.col("version"))).alias("v"))
    q = p.select((F.col("ord") - 1).alias("ord"), F.col("v").alias("w"))
    return p.join(q, "ord").select("ord", V.version_cmp(F.col("v"), F.col("w")).alias("cmp"))


@query(f"WITH {PACK} SELECT scan_id, q.ecosystem, q.name, ord, advisory_id, severity FROM q JOIN v ON q.ecosystem = v.ecosystem AND q.name = v.name AND lo <= vn AND vn < hi")
def join_advisory(t: Tables) -> DataFrame:
    return K.with_advisories(t.v_packages, t.v_advisories).select("scan_id", "ecosystem", "name", "ord", "advisory_id", "severity")


@query(f"WITH {PACK} SELECT scan_id, ecosystem, name, version, dev, ord FROM o")
def agg_dep_dedupe(t: Tables) -> DataFrame:
    return K.one_each(t.v_packages)


SEVN = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END"
REPORT = f"""{PACK}, h AS (SELECT scan_id, o.ecosystem, o.name, min({SEVN}) AS sev FROM o JOIN v ON o.ecosystem = v.ecosystem AND o.name = v.name AND lo <= vn AND vn < hi GROUP BY ALL)"""


@query(f"""WITH {REPORT} SELECT o.scan_id, count(*) AS packages, count(*) FILTER (WHERE NOT dev) AS runtime, count(sev) AS vulnerable, CASE min(sev) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' END AS worst
    FROM o LEFT JOIN h USING (scan_id, ecosystem, name) GROUP BY o.scan_id""")
def agg_dep_report(t: Tables) -> DataFrame:
    return K.report(t.v_packages, t.v_advisories)


@query(f"WITH {REPORT} SELECT scan_id, o.name, ecosystem, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY sev NULLS LAST, o.name, ecosystem) AS INT) AS place FROM o LEFT JOIN h USING (scan_id, ecosystem, name)")
def srt_risk_name(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    from ..functions.scores import severity_ord

    own = K.one_each(t.v_packages)
    hit = K.with_advisories(own, t.v_advisories).groupBy("scan_id", "ecosystem", "name").agg(F.min(severity_ord(F.col("severity"))).alias("sev"))
    w = Window.partitionBy("scan_id").orderBy(F.asc_nulls_last("sev"), "name", "ecosystem")
    return own.join(hit, ["scan_id", "ecosystem", "name"], "left").select("scan_id", "name", "ecosystem", F.row_number().over(w).alias("place"))


LICENCE = "CASE s_suppkey % 5 WHEN 0 THEN 'GPL-3.0' WHEN 1 THEN 'MIT' WHEN 2 THEN 'AGPL-3.0' WHEN 3 THEN 'Apache-2.0' ELSE 'BUSL-1.1' END"
REGISTRY = f"g AS (SELECT ecosystem, name, max(advisory_id % 9) || '.0.0' AS latest, arg_max({LICENCE.replace('s_suppkey', 'advisory_id')}, advisory_id) AS licence FROM v_advisories GROUP BY ALL)"


def _registry(t: Tables) -> DataFrame:
    k = F.col("advisory_id") % 5
    licence = F.when(k == 0, "GPL-3.0").when(k == 1, "MIT").when(k == 2, "AGPL-3.0").when(k == 3, "Apache-2.0").otherwise("BUSL-1.1")
    return t.v_advisories.groupBy("ecosystem", "name").agg(F.concat(F.max(F.col("advisory_id") % 9).cast("string"), F.lit(".0.0")).alias("latest"), F.max_by(licence, "advisory_id").alias("licence"))


@query(f"WITH {PACK}, {REGISTRY} SELECT ord, latest, greatest(0, {PART.format('latest', 1)} - {PART.format('cv', 1)}) AS majors_behind FROM q LEFT JOIN g USING (ecosystem, name) WHERE latest IS NOT NULL")
def join_registry(t: Tables) -> DataFrame:
    j = t.v_packages.join(_registry(t), ["ecosystem", "name"], "left").where("latest is not null")
    major = lambda v: V.semver(V.clean_version(F.col(v)))["major"]
    return j.select("ord", "latest", F.greatest(F.lit(0), major("latest") - major("version")).alias("majors_behind"))


@query(f"WITH {PACK}, {REGISTRY} SELECT scan_id, o.name, ecosystem, licence FROM o JOIN g USING (ecosystem, name) WHERE NOT dev AND licence IN ({', '.join(repr(x) for x in K.RISKY_LICENCES)})")
def join_license(t: Tables) -> DataFrame:
    j = K.one_each(t.v_packages).where("not dev").join(_registry(t), ["ecosystem", "name"])
    return j.where(F.col("licence").isin(*K.RISKY_LICENCES)).select("scan_id", "name", "ecosystem", "licence")


def _manifest_lines(t: Tables, line, head: str = "", tail: str = "", by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Manifests made of the packages table: a scan's packages, a line each."""
    own = K.one_each(t.v_packages).withColumn("cv", V.clean_version(F.col("version")))
    return own.groupBy(*by).agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit(tail)).alias("content"))


@query(f"WITH {PACK} SELECT scan_id, name, version, dev FROM o WHERE ecosystem = 'npm'")
def man_npm(t: Tables) -> DataFrame:
    pair = F.struct("name", "version")
    held = lambda dev, name: F.map_from_entries(F.collect_list(F.when(F.col("dev") == dev, pair))).alias(name)
    own = K.one_each(t.v_packages).where("ecosystem = 'npm'").groupBy("scan_id").agg(held(False, "dependencies"), held(True, "devDependencies"))
    files = own.select("scan_id", F.lit("package.json").alias("path"), F.to_json(F.struct("dependencies", "devDependencies")).alias("content"))
    return K.manifest_npm(files).select("scan_id", "name", "version", "dev")


@query(f"WITH {PACK} SELECT scan_id, name, cv AS version, dev FROM o WHERE regexp_matches(cv, '^[0-9]') GROUP BY ALL")
def man_pip(t: Tables) -> DataFrame:
    files = _manifest_lines(t, F.concat("name", F.lit("=="), "cv", F.lit("  # pinned")), by=("scan_id", "dev"))
    files = files.select("scan_id", F.when(F.col("dev"), "requirements-dev.txt").otherwise("requirements.txt").alias("path"), "content")
    return K.manifest_pip(files).select("scan_id", "name", "version", "dev").distinct()


@query(f"WITH {PACK} SELECT scan_id, name, 'v' || cv AS version, NOT dev AS direct FROM o GROUP BY ALL")
def man_go(t: Tables) -> DataFrame:
    line = F.concat(F.lit("\t"), "name", F.lit(" v"), "cv", F.when(F.col("dev"), " // indirect").otherwise(""))
    files = _manifest_lines(t, line, "module m\n\nrequire (\n", "\n)\n").withColumn("path", F.lit("go.mod"))
    return K.manifest_go(files).select("scan_id", "name", "version", "direct").distinct()


@query(f"WITH {PACK} SELECT scan_id, name, cv AS version, dev FROM o GROUP BY ALL")
def man_toml(t: Tables) -> DataFrame:
    line = F.concat("name", F.lit(' = "'), "cv", F.lit('"'))
    files = _manifest_lines(t, line, by=("scan_id", "dev"))
    files = files.select("scan_id", F.lit("Cargo.toml").alias("path"), F.concat(F.when(F.col("dev"), "[dev-dependencies]\n").otherwise("[dependencies]\n"), "content").alias("content"), "dev")
    # Two sections of one file are two files here, as each has its own path.
    files = files.withColumn("path", F.concat(F.when(F.col("dev"), "a/").otherwise("b/"), "path"))
    return K.manifest_toml(files).select("scan_id", "name", "version", "dev").distinct()
