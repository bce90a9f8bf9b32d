"""What leaves the engine: reports and projections written by scan, SARIF documents, event logs; and small tables that come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scores import lookup
from .rules import cwe, owasp

ADVISORY = "advisory_id long, ecosystem string, name string, introduced_in string, fixed_in string, severity string"
# Committed coverage summaries, first come first; SARIF levels.
COVERAGE_FILES = ("coverage/coverage-summary.json", "coverage-summary.json", ".nyc_output/coverage-summary.json")
#: Numbers by which code hosts filter alerts.
SECURITY_SEVERITY = {"critical": "9.5", "high": "7.5", "medium": "5.0", "low": "3.0", "info": "1.0"}
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


#: The column of the file layout that numbers the writes of a table.
WRITE = "write_no"


def replace_scans(rows: DataFrame, path: str) -> None:
    """Write ``rows`` so that each scan in them replaces what ``path`` held of it; other scans stay. Repeating it changes nothing that is read. One writer at a time.

    A write is one folder with a few sorted files, however many scans it holds; readers take of each scan its last write. ``compact_scans`` drops what was replaced.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    held = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    number = 1 + max((int(n.split("=")[1]) for n in held if n.startswith(f"{WRITE}=")), default=0)
    rows.repartitionByRange("scan_id").sortWithinPartitions("scan_id").write.parquet(f"{path}/{WRITE}={number}")


def read_scans(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What ``replace_scans`` wrote, with the columns of ``like``: of each scan its last write."""
    held = spark.read.schema(StructType([*like.schema.fields, StructField(WRITE, LongType())])).parquet(path)
    last = held.groupBy(F.col("scan_id").alias("scan")).agg(F.max(WRITE).alias("last"))
    return held.join(last, F.col("scan_id").eqNullSafe(F.col("scan")) & (F.col(WRITE) == F.col("last")), "left_semi").select(*like.columns)


def compact_scans(spark: SparkSession, path: str, like: DataFrame, to: str) -> None:
    """The scans of ``path`` as the first write of the new table ``to``, without what was replaced."""
    replace_scans(read_scans(spark, path, like), to)


def documents(findings: DataFrame, *fields: str) -> DataFrame:
    """One JSON document for each scan: its findings in the order of their ids. A scan's findings meet in one row."""
    held = findings.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("findings"), F.count("*").alias("n"))
    return held.select("scan_id", F.to_json(F.struct("scan_id", "n", "findings")).alias("document"))


def level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").when(severity == "info", "none").otherwise("note")


def rule_name(rule_id: Column) -> Column:
    """A rule's id in camel case."""
    words = F.split(rule_id, "[.-]")
    return F.concat(words[0], F.array_join(F.transform(F.slice(words, 2, F.size(words)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), ""))


def rule_row() -> Column:
    """A rule of a SARIF document: what its first finding says, and the weakness that it reports."""
    rule, severity = F.col("rule_id"), F.col("first.severity")
    tags = F.array_compact(F.array(F.col("first.category"), cwe(rule), F.when(owasp(rule).isNotNull(), "owasp")))
    held = F.struct(tags.alias("tags"), lookup(severity, SECURITY_SEVERITY).alias("security-severity"), cwe(rule).alias("cwe"), owasp(rule).alias("owasp"))
    return F.struct(rule.alias("id"), rule_name(rule).alias("name"), F.struct(F.col("first.title").alias("text")).alias("shortDescription"), F.struct(level(severity).alias("level")).alias("defaultConfiguration"), held.alias("properties"))


def sarif(findings: DataFrame, tool: str = "code audit") -> DataFrame:
    """scan_id, document: SARIF 2.1.0 of each scan's findings (raw_id, rule_id, category, severity, title, path, start_line, other_places as array<struct<path,start_line>>, id, validation).

    Rules stand in the order of first appearance with the first finding's text; dismissed findings are left out.
    """
    live = findings.where("validation <> 'dismissed'")
    place = lambda p, n: F.struct(F.struct(F.struct(p.alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), n).alias("startLine")).alias("region")).alias("physicalLocation"))
    rules = live.groupBy("scan_id", "rule_id").agg(F.min(F.struct("raw_id", "title", "severity", "category")).alias("first"))
    listed = rules.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("first.raw_id", rule_row().alias("rule")))).alias("rules"))
    ids = F.transform("rules", lambda r: r["rule"]["id"])
    result = F.struct(
        "raw_id", F.col("rule_id").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place(F.col("path"), F.col("start_line"))).alias("locations"),
        F.transform("other_places", lambda x, i: F.struct((i + 1).alias("id"), place(x["path"], x["start_line"])["physicalLocation"].alias("physicalLocation"))).alias("relatedLocations"), F.struct(F.col("id").alias("findingId")).alias("partialFingerprints"),
    )
    results = live.groupBy("scan_id").agg(F.sort_array(F.collect_list(result)).alias("results"))
    made = results.join(listed, "scan_id")
    numbered = F.transform("results", lambda r: F.struct(r["ruleId"].alias("ruleId"), (F.array_position(ids, r["ruleId"]) - 1).alias("ruleIndex"), r["level"].alias("level"), r["message"].alias("message"), r["locations"].alias("locations"), r["relatedLocations"].alias("relatedLocations"), r["partialFingerprints"].alias("partialFingerprints")))
    driver = F.struct(F.lit(tool).alias("name"), F.transform("rules", lambda r: r["rule"]).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), numbered.alias("results"))
    return made.select("scan_id", F.to_json(F.struct(F.lit(SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def append_events(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The new events that are not stored yet, each (scan, seq) once: what an append has to write."""
    return new.dropDuplicates(["scan_id", "seq"]).join(stored.select("scan_id", "seq"), ["scan_id", "seq"], "left_anti")


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """The advisory table from JSON lines; a feed becomes this table by writing it anew. Rows without a package are left out."""
    return spark.read.schema(ADVISORY).json(path).where("name is not null and ecosystem is not null")


def coverage(files: DataFrame) -> DataFrame:
    """scan_id, coverage (0 to 1): of the committed summaries the first that holds a share of lines, else of statements; malformed ones hold none."""
    order = F.array_position(F.array(*map(F.lit, COVERAGE_FILES)), F.col("path"))
    share = F.coalesce(*[F.expr(f"try_cast(get_json_object(content, '$.total.{k}.pct') AS double)") for k in ("lines", "statements")])
    held = files.where(F.col("path").isin(*COVERAGE_FILES)).select("scan_id", order.alias("o"), share.alias("pct")).where("pct is not null")
    return held.groupBy("scan_id").agg((F.min_by("pct", "o") / 100).alias("coverage"))


def osv_severity(label: Column, score: Column) -> Column:
    """A feed's own label, else the thresholds of a plain score; vectors and everything else are medium."""
    up, n = F.upper(label), F.when(~F.contains(score, F.lit("/")), F.try_to_number(score, F.lit("99.99")).cast("double"))
    named = F.when(up == "CRITICAL", "critical").when(up == "HIGH", "high").when(up.isin("MODERATE", "MEDIUM"), "medium").when(up == "LOW", "low")
    return F.coalesce(named, F.when(n >= 9, "critical").when(n >= 7, "high").when(n >= 4, "medium").when(n.isNotNull(), "low"), F.lit("medium"))
