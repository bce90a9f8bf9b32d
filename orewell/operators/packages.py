"""Declared packages: manifests to rows, advisories by version ranges, licences, registries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import trimmed
from ..functions.scores import severity_of, severity_ord
from ..functions.versions import clean_version, ranges_of, semver, version_number

# Licences that need a look, and how much they weigh.
LICENCE_RISK = {"AGPL-3.0": "high", "AGPL-3.0-only": "high", "AGPL-3.0-or-later": "high", "GPL-3.0": "medium", "GPL-2.0": "medium", "LGPL-3.0": "low", "SSPL-1.0": "high", "BUSL-1.1": "high", "CC-BY-NC-4.0": "high"}
RISKY_LICENCES = tuple(LICENCE_RISK)


def one_each(packages: DataFrame) -> DataFrame:
    """One row for each (scan, ecosystem, name): a runtime declaration before a development one, then the first."""
    w = Window.partitionBy("scan_id", "ecosystem", "name").orderBy("dev", "ord")
    return packages.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def with_advisories(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Package x advisory where introduced <= version < fixed.

    An advisory's range of versions is parted into aligned blocks, at most two of each level, and each different version of a package looks up the block it lies in, on the levels that the
    package's advisories use: an equi-join, so that a version meets only advisories whose range holds it (or whose numbers it shares), however many its package has.
    Rows without a name, a version or a range have no advisory.
    """
    key = ["ecosystem", "name"]
    a = advisories.select(*key, "advisory_id", "severity", semver(F.col("introduced_in")).alias("low"), semver(F.col("fixed_in")).alias("high")).where(F.col("low") < F.col("high"))
    a = a.withColumn("first", version_number(F.col("low"))).withColumn("last", version_number(F.col("high"))).withColumn("b", F.explode(ranges_of("first", "last"))).select(*key, "b.level", "b.block", "advisory_id", "severity", "low", "high")
    p = packages.withColumn("v", semver(clean_version(F.col("version"))))
    levels = a.groupBy(*key).agg(F.collect_set("level").alias("levels"))  # at most one for each bit
    versions = p.where("v is not null").select(*key, "v").distinct().join(levels, key).withColumn("level", F.explode("levels")).withColumn("number", version_number(F.col("v")))
    met = versions.withColumn("block", F.expr("shiftright(number, level)")).select(*key, "v", "level", "block").join(a, [*key, "level", "block"]).where((F.col("low") <= F.col("v")) & (F.col("v") < F.col("high")))
    return p.join(met.drop("level", "block"), [*key, "v"])


def report(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Per scan: direct and vulnerable packages, worst severity (null without a vulnerable one)."""
    own = one_each(packages)
    hit = with_advisories(own, advisories).groupBy("scan_id", "ecosystem", "name").agg(F.min(severity_ord(F.col("severity"))).alias("sev"))
    j = own.join(hit, ["scan_id", "ecosystem", "name"], "left")
    return j.groupBy("scan_id").agg(F.count("*").alias("packages"), F.count_if(~F.col("dev")).alias("runtime"), F.count("sev").alias("vulnerable"), F.when(F.min("sev").isNotNull(), severity_of(F.min("sev"))).alias("worst"))


def manifest_npm(files: DataFrame) -> DataFrame:
    """package.json files (scan_id, path, content) to scan_id, path, name, version, dev; malformed ones give no rows."""
    kind = "map<string,string>"
    c = F.from_json("content", f"dependencies {kind}, devDependencies {kind}, optionalDependencies {kind}")
    part = lambda name, dev: F.transform(F.map_entries(F.coalesce(c[name], F.create_map().cast(kind))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(dev).alias("dev")))
    rows = F.concat(part("dependencies", False), part("devDependencies", True), part("optionalDependencies", False))
    return files.select("scan_id", "path", F.explode(rows).alias("p")).select("scan_id", "path", "p.*")


def manifest_pip(files: DataFrame) -> DataFrame:
    """requirements.txt lines; without an operator the version is null; development files by their path."""
    line = files.select("scan_id", "path", F.explode(F.split("content", "\n")).alias("l")).withColumn("l", trimmed(F.regexp_replace("l", r"#.*$", "")))
    line = line.where((F.col("l") != "") & ~F.col("l").startswith("-"))
    name = F.lower(F.regexp_extract("l", r"^([A-Za-z0-9._-]+)", 1))
    return line.select("scan_id", "path", name.alias("name"), F.nullif(F.regexp_extract("l", r"(?:==|>=|<=|~=|!=|>|<)\s*([0-9][^,; ]*)", 1), F.lit("")).alias("version"), F.col("path").rlike(r"(?i)(dev|test)").alias("dev")).where("name <> ''")


def manifest_go(files: DataFrame) -> DataFrame:
    """go.mod requirements, in a block or single; ``direct`` is false for those marked indirect."""
    rows = _numbered(files).withColumn("l", trimmed(F.col("l")))
    block = F.when(F.col("l").rlike(r"^require\s*\("), True).when(F.col("l").startswith(")"), False)
    rows = rows.withColumn("inside", F.coalesce(F.last(block, True).over(_upto()), F.lit(False)))
    bare = F.regexp_replace("l", r"^require\s+", "")
    rows = rows.where((F.col("inside") | F.col("l").rlike(r"^require\s+[^(]")) & bare.rlike(r"^\S+\s+v[0-9]"))
    return rows.select("scan_id", "path", F.regexp_extract(bare, r"^(\S+)\s+(v\S+)", 1).alias("name"), F.regexp_extract(bare, r"^(\S+)\s+(v\S+)", 2).alias("version"), (~F.contains(bare, F.lit("// indirect"))).alias("direct"))


def manifest_toml(files: DataFrame) -> DataFrame:
    """pyproject.toml and Cargo.toml: the lines under headers that name dependencies."""
    rows = _numbered(files).withColumn("l", trimmed(F.col("l")))
    rows = rows.withColumn("section", F.last(F.nullif(F.regexp_extract("l", r"^\[+([^\]]+)\]+", 1), F.lit("")), True).over(_upto()))
    rows = rows.where(F.col("section").rlike("(?i)dependencies") & F.col("l").rlike(r"^[A-Za-z0-9_-]+\s*="))
    version = F.coalesce(F.nullif(F.regexp_extract("l", r'version\s*=\s*"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract("l", r'=\s*"([^"]+)"', 1), F.lit("")))
    return rows.select("scan_id", "path", F.regexp_extract("l", r"^([A-Za-z0-9_-]+)", 1).alias("name"), version.alias("version"), F.col("section").rlike("(?i)dev").alias("dev"))


def manifests(files: DataFrame) -> DataFrame:
    """Every manifest of ``files``, read by its base name: scan_id, path, ecosystem, name, version, dev, direct."""
    base = F.substring_index("path", "/", -1)
    readers = (("npm", base == "package.json", manifest_npm), ("pypi", base.rlike(r"^requirements.*\.txt$"), manifest_pip), ("go", base == "go.mod", manifest_go), ("pypi", base == "pyproject.toml", manifest_toml), ("crates", base == "Cargo.toml", manifest_toml))
    out = None
    for ecosystem, own, read in readers:
        rows = read(files.where(own))
        direct = F.col("direct") if "direct" in rows.columns else F.lit(True)
        dev = F.col("dev") if "dev" in rows.columns else F.lit(False)
        rows = rows.select("scan_id", "path", F.lit(ecosystem).alias("ecosystem"), "name", "version", dev.alias("dev"), direct.alias("direct"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _numbered(files: DataFrame) -> DataFrame:
    return files.select("scan_id", "path", F.posexplode(F.split("content", "\n")).alias("no", "l"))


def _upto():
    return Window.partitionBy("scan_id", "path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)


UNPINNED = ("unpinned", "*", "latest")


def findings(own: DataFrame, advisories: DataFrame, registry: DataFrame, declared: DataFrame, locked: DataFrame) -> DataFrame:
    """scan_id, rule_id, name, severity: known vulnerabilities of ``own`` packages, unpinned ones of ``declared``, npm scans without a lock file (``locked``: scan_id), licences to review."""
    row = lambda rule, name, severity: ("scan_id", F.lit(rule).alias("rule_id"), name.alias("name"), severity.alias("severity"))
    worst = F.when(F.col("dev") & (F.col("severity") == "critical"), "high").otherwise(F.col("severity"))
    out = with_advisories(own, advisories).select(*row("dep.known-vulnerability", F.col("name"), worst))
    out = out.unionByName(declared.where(F.col("version").isin(*UNPINNED)).select(*row("dep.unpinned-version", F.col("name"), F.lit("medium"))))
    out = out.unionByName(own.where("ecosystem = 'npm'").select("scan_id").distinct().join(locked, "scan_id", "left_anti").select(*row("dep.missing-lockfile", F.lit("package.json"), F.lit("medium"))))
    risk = F.create_map(*[F.lit(x) for kv in LICENCE_RISK.items() for x in kv])[F.col("licence")]
    return out.unionByName(own.where("not dev").join(registry, ["ecosystem", "name"]).withColumn("risk", risk).where("risk is not null").select(*row("dep.license-review", F.col("name"), F.col("risk"))))


def unused(own: DataFrame, usage: DataFrame, least: int = 3, named: int = 6) -> DataFrame:
    """scan_id, packages, names (the first ones): runtime packages without an importer (``usage``: scan_id, package), if there are several."""
    idle = own.where("not dev").join(usage.select("scan_id", F.col("package").alias("name")).distinct(), ["scan_id", "name"], "left_anti")
    g = idle.groupBy("scan_id").agg(F.count("*").alias("packages"), F.sort_array(F.collect_list("name")).alias("names")).where(F.col("packages") >= least)
    return g.select("scan_id", "packages", F.array_join(F.slice("names", 1, named), ",").alias("names"))
