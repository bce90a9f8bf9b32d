"""Detectors: what rules, functions, imports, tests and copies say of a scan, as raw findings.

A finding has scan_id, rule_id, severity, confidence, root_cause, effort_minutes, path, line (null for a file or a scan) and ``n``, how many places it stands for.
A detector is a callable (tables) -> findings; ``run`` unions those of a registry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import lookup
from .graph import components_of, cycles
from .search import Rule, search

COLUMNS = ("scan_id", "rule_id", "severity", "confidence", "root_cause", "effort_minutes", "path", "line", "n")
# Paths whose failures cost most, disabled tests, files of continuous integration, error handling.
CRITICAL = r"(?i)(payment|billing|checkout|charge|invoice|subscription|auth|login|session|permission|password|token|refund|order)"
SKIPPED_TEST = Rule("test.skipped", r"\b(?:it|test|describe)\.(?:skip|todo)\s*\(|\bxit\s*\(|@pytest\.mark\.skip|t\.Skip\(", "testing", "low", 0.92, "no-test-safety-net", 45, per_scan=30)
CI_FILE = r"^\.github/workflows/|^\.gitlab-ci\.yml$|^\.circleci/|^Jenkinsfile$|^\.travis\.yml$|^azure-pipelines\.yml$"
HANDLES = r"try\s*\{|\.catch\(|except\b|rescue\b"
# Severity (or the limit from which it is the higher one), confidence, cause and minutes of what is not a pattern rule.
FUNCTION_RULES = {"complex": ("maint.high-complexity", 0.85, "complexity-debt", 60), "long": ("maint.long-function", 0.9, "complexity-debt", 45), "wide": ("maint.wide-signature", 0.88, "complexity-debt", 30), "deep": ("perf.deep-branching", 0.7, "complex-hot-paths", 60)}
STEM_CHARS, MAX_CYCLES, LOCAL_EDGES = 4, 5, 200_000


def finding(rows: DataFrame, rule_id: Column | str, severity: Column | str, confidence, root_cause: Column | str, minutes, path: Column, line: Column | None = None, n: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("scan_id", lit(rule_id).alias("rule_id"), lit(severity).alias("severity"), lit(confidence).cast("double").alias("confidence"), lit(root_cause).alias("root_cause"), lit(minutes).cast("int").alias("effort_minutes"),
                       path.alias("path"), (F.lit(None) if line is None else line).cast("int").alias("line"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def by_rules(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """One finding for each match that a rule keeps."""
    meta = lambda f: lookup(F.col("rule_id"), {r.id: f(r) for r in rules})
    hits = search(files, rules)
    return finding(hits, F.col("rule_id"), meta(lambda r: r.severity), meta(lambda r: r.confidence), meta(lambda r: r.cause), meta(lambda r: r.minutes), F.col("path"), F.col("line"))


def _first(rows: DataFrame, *order: str) -> DataFrame:
    """Per scan the number of rows and the first place."""
    return rows.groupBy("scan_id").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("at"))


def no_error_handling(files: DataFrame, least: int = 3) -> DataFrame:
    """Modules that await and catch nothing, if a scan has several."""
    bare = files.where("is_code and not is_vendor and not is_generated").where(F.col("content").rlike(r"await\s") & ~F.col("content").rlike(HANDLES))
    g = _first(bare.select("scan_id", "path"), "path").where(F.col("n") >= least)
    return finding(g, "bug.no-error-handling-module", "medium", 0.72, "missing-failure-handling", 60, F.col("at.path"), n=F.col("n"))


def functions(notable: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Findings of the functions that ``structure.notable`` names."""
    part = lambda i: lookup(F.col("kind"), {k: FUNCTION_RULES[k][i] for k in kinds})
    severity = F.when((F.col("kind") == "complex") & (F.col("complexity") >= 30), "medium").otherwise("low")
    return finding(notable.where(F.col("kind").isin(*kinds)), part(0), severity, part(1), part(2), part(3), F.col("path"), F.col("start_line"))


def oversized(top_files: DataFrame, limit: int = 800, high: int = 1500, most: int = 3) -> DataFrame:
    """The largest files (scan_id, path, loc, place) beyond a limit."""
    big = top_files.where((F.col("loc") > limit) & (F.col("place") <= most))
    return finding(big, "maint.oversized-file", F.when(F.col("loc") > high, "medium").otherwise("low"), 0.92, "complexity-debt", 90, F.col("path"), n=F.col("loc"))


def duplicated(blocks: DataFrame, ratio: DataFrame, least: float = 0.03, high: float = 0.1) -> DataFrame:
    """A scan whose share of repeated lines is large; the place is that of its most frequent block."""
    worst = blocks.where("place = 1").select("scan_id", F.split("first", ":")[0].alias("path"))
    some = ratio.where(F.col("ratio") > least).join(worst, "scan_id")
    return finding(some, "maint.duplication", F.when(F.col("ratio") > high, "medium").otherwise("low"), 0.8, "duplicated-logic", 90, F.col("path"))


def repeated(blocks: DataFrame, least: int = 3, high: int = 10) -> DataFrame:
    """A scan with several blocks that more than one file holds."""
    g = blocks.where("files > 1").groupBy("scan_id").agg(F.count("*").alias("n"), F.min_by("first", "place").alias("first")).where(F.col("n") >= least)
    return finding(g, "ai.repeated-implementation", F.when(F.col("n") > high, "medium").otherwise("low"), 0.78, "duplicated-logic", 90, F.split("first", ":")[0], F.split("first", ":")[1], F.col("n"))


def unresolved(resolved: DataFrame) -> DataFrame:
    """A scan's local imports that no file answers to."""
    g = _first(resolved.where("kind <> 'external' and resolved is null"), "path", "line_no")
    return finding(g, "ai.unresolved-import", "high", 0.9, "incomplete-implementations", 45, F.col("at.path"), F.col("at.line_no"), F.col("n"))


def unused(unused_exports: DataFrame, least: int = 5) -> DataFrame:
    g = _first(unused_exports, "path", "line_no").where(F.col("n") >= least)
    return finding(g, "ai.unused-exports", "low", 0.7, "dead-code", 40, F.col("at.path"), F.col("at.line_no"), F.col("n"))


def layers(resolved: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Imports across layers, one finding for each rule (name, from, to)."""
    target = F.coalesce("resolved", "specifier")
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(x) & target.rlike(y), F.lit(name)) for name, x, y in rules]))
    g = resolved.select("scan_id", "path", "line_no", F.explode(hits).alias("label")).groupBy("scan_id", "label").agg(F.count("*").alias("n"), F.min(F.struct("path", "line_no")).alias("at"))
    return finding(g, "arch.layer-violation", "medium", 0.75, "layer-leakage", 120, F.col("at.path"), F.col("at.line_no"), F.col("n"))


def large_modules(sizes: DataFrame, loc: int = 500, exports: int = 12, high: int = 1000, most: int = 4) -> DataFrame:
    """Modules (scan_id, path, loc, n_exports) of many lines and exports."""
    big = sizes.where((F.col("loc") > loc) & (F.col("n_exports") >= exports))
    big = big.withColumn("place", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("loc"), "path"))).where(F.col("place") <= most)
    return finding(big, "arch.god-module", F.when(F.col("loc") > high, "high").otherwise("medium"), 0.85, "module-coupling", 150, F.col("path"), n=F.col("n_exports"))


def scan_cycles(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """scan_id, cycle (its least path), path: strongly connected components in each scan's imports (scan_id, src, dst).

    A scan of at most ``local`` edges is one group; larger ones go through rounds of joins over the whole graph (``graph.cycles``).
    """
    sizes = edges.groupBy("scan_id").agg(F.count("*").alias("n_edges"))
    sized = edges.where("src <> dst").join(sizes, "scan_id")

    def run(rows: pa.Table) -> pa.Table:
        out: dict[str, list[str]] = {}
        for a, b in zip(rows["src"].to_pylist(), rows["dst"].to_pylist(), strict=True):
            out.setdefault(a, []).append(b)
        found = [(c[0], p) for c in components_of(out) for p in c]
        scan = pa.array([rows["scan_id"][0]] * len(found), rows.schema.field("scan_id").type)
        return pa.table({"scan_id": scan, "cycle": pa.array([c for c, _ in found], pa.string()), "path": pa.array([p for _, p in found], pa.string())})

    kind = edges.schema["scan_id"].dataType.simpleString()
    small = sized.where(F.col("n_edges") <= local).select("scan_id", "src", "dst").groupBy("scan_id").applyInArrow(run, f"scan_id {kind}, cycle string, path string")
    large = sized.where(F.col("n_edges") > local)
    if large.isEmpty():
        return small
    node = lambda c: F.struct("scan_id", F.col(c).alias("path"))
    found = cycles(large.select(node("src").alias("src"), node("dst").alias("dst")), finish=local)
    return small.unionByName(found.select("node.scan_id", F.col("cycle.path").alias("cycle"), "node.path"))


def circular(members: DataFrame, most: int = MAX_CYCLES) -> DataFrame:
    """The first cycles of each scan."""
    g = members.groupBy("scan_id", "cycle").agg(F.count("*").alias("n"))
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("scan_id").orderBy("cycle"))).where(F.col("place") <= most)
    return finding(g, "arch.circular-dependency", F.when(F.col("n") > 3, "high").otherwise("medium"), 0.95, "module-coupling", 90, F.col("cycle"), F.lit(1), F.col("n"))


def cycle_labels(members: DataFrame, component: Column, most: int = 6) -> DataFrame:
    """The first cycles of each scan by the components that they cross, or by their files' names if they stay in one."""
    g = members.withColumn("c", component).groupBy("scan_id", "cycle").agg(F.sort_array(F.collect_set("c")).alias("parts"), F.sort_array(F.collect_set(F.substring_index("path", "/", -1))).alias("names"))
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("scan_id").orderBy("cycle"))).where(F.col("place") <= most)
    return g.select("scan_id", "cycle", F.array_join(F.when(F.size("parts") > 1, F.col("parts")).otherwise(F.col("names")), " > ").alias("label"))


def untested(files: DataFrame) -> DataFrame:
    """Critical source files whose name no test file's path or text holds. A scan's names go to its test files as one array; no pairs are formed."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", "")
    source = files.where("is_code and not is_vendor and not is_generated and not is_test and not is_doc").where(F.col("path").rlike(CRITICAL)).select("scan_id", "path", stem.alias("stem")).where(F.length("stem") >= STEM_CHARS)
    stems = source.groupBy("scan_id").agg(F.collect_set("stem").alias("stems"))
    tests = files.where("is_test and not is_vendor").select("scan_id", F.concat_ws("\n", "path", "content").alias("text")).join(stems, "scan_id")
    named = tests.select("scan_id", F.explode(F.filter("stems", lambda s: F.contains(F.col("text"), s))).alias("stem")).distinct()
    return source.join(named, ["scan_id", "stem"], "left_anti").select("scan_id", "path", "stem")


def untested_critical(files: DataFrame, high: int = 3) -> DataFrame:
    g = _first(untested(files), "path")
    return finding(g, "test.untested-critical-path", F.when(F.col("n") > high, "high").otherwise("medium"), 0.72, "no-test-safety-net", 120, F.col("at.path"), n=F.col("n"))


def skipped_tests(files: DataFrame) -> DataFrame:
    """Disabled tests: at most thirty matches of a scan, in tests too."""
    g = _first(search(files, [SKIPPED_TEST], per_file=12, skip=("is_vendor", "is_generated")), "path", "line")
    return finding(g, "test.skipped", "low", 0.92, "no-test-safety-net", 45, F.col("at.path"), F.col("at.line"), F.col("n"))


def no_ci(files: DataFrame) -> DataFrame:
    """Scans with tests that nothing runs."""
    g = files.groupBy("scan_id").agg(F.count_if(F.col("is_test") & ~F.col("is_vendor")).alias("n"), F.bool_or(F.col("path").rlike(CI_FILE)).alias("ci")).where("n > 0 and not ci")
    return finding(g, "test.no-ci", "medium", 0.88, "no-automated-verification", 45, F.lit(".github/workflows"), n=F.col("n"))


def run(detectors: dict[str, Callable[[object], DataFrame]], tables: object) -> DataFrame:
    """All findings of a registry of detectors, with the detector's name."""
    return reduce(DataFrame.unionByName, [f(tables).select(*COLUMNS).withColumn("detector", F.lit(name)) for name, f in detectors.items()])
