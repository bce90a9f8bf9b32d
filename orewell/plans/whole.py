"""A whole audit in one call: files to findings, merged, suppressed and validated, and what is reported of a scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import paths as P
from ..functions.scores import stable_id
from ..operators import detect as D
from ..operators import findings as O
from ..operators import graph as G
from ..operators import imports as I
from ..operators import packages as K
from ..operators import plan as L
from ..operators import rules as R
from ..operators import scoring as S
from ..operators import structure as T
from ..operators import suppress as X
from ..operators import validate as V
from ..operators.literals import holds_literal
from ..operators.reports import ADVISORY, coverage
from ..session import staged
from ..sources.files import within_limits
from .audit import LAYERS, LISTED, _loc, by_frequency, copied_blocks
from .files import CREDENTIALS, ENTRIES, PLACEHOLDER, SOURCE
from .registry import Tables, query

#: The agents in the order of their numbers, by the category of what they report.
AGENTS = ("security", "reliability", "architecture", "testing", "dependencies", "performance", "ai-code", "maintainability")
#: The ignore file at the root of a scan.
IGNORE_FILE = ".auditignore"
LOCKS = r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb)$"
REGISTRY = "ecosystem string, name string, licence string"
# From which confidence a finding is confirmed, and likely; confidence, cause and minutes of findings about packages.
CONFIRMED, LIKELY = 0.85, 0.65
PACKAGE_RULES = {"dep.known-vulnerability": (0.95, "vulnerable-dependencies", 20), "dep.unpinned-version": (0.9, "unreproducible-builds", 10), "dep.missing-lockfile": (0.93, "unreproducible-builds", 10), "dep.license-review": (0.8, "license-obligations", 30)}
#: Severity, confidence, cause and minutes of credentials.
CREDENTIAL = ("critical", 0.9, "secrets-in-source", 20)
#: A caller's detector: a callable from files (scan_id, path, content, language, flags) to findings, with its category.
Detectors = dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]


@dataclass(frozen=True)
class Audit:
    """What an audit leaves: tables by scan, each of them written or made from written ones."""

    files: DataFrame
    raw: DataFrame
    findings: DataFrame  # all merged ones, with suppressed, validation, signals and rationale
    metrics: DataFrame
    packages: DataFrame

    @property
    def kept(self) -> DataFrame:
        return self.findings.where("not suppressed")

    def scans(self) -> DataFrame:
        return self.files.select("scan_id").distinct()

    def category_scores(self) -> DataFrame:
        return S.category_scores(self.kept, self.scans(), ["scan_id"], self.metrics)

    def phases(self) -> DataFrame:
        return L.phases(self.kept, F.col("root_cause"), ["finding_id"], self.metrics)

    def summary(self) -> DataFrame:
        return O.summary(self.kept)

    def report(self) -> DataFrame:
        """One row for each scan, those without findings too."""
        n = self.findings.groupBy("scan_id").agg(F.sum("n_raw").alias("raw"), F.count("*").alias("merged"), F.count_if("suppressed").alias("suppressed"))
        out = self.scans().join(S.health(self.category_scores(), ["scan_id"]), "scan_id").join(n, "scan_id", "left").join(self.summary(), "scan_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return out.select("scan_id", "overall", *map(zero, ("raw", "merged", "suppressed", "dismissed", "live", "urgent", "critical", "high", "medium", "low", "info")), F.coalesce("headline", F.lit("No high-confidence issues were identified by this analysis.")).alias("headline"))


def credentials(files: DataFrame) -> DataFrame:
    """A finding for each line that holds a credential which is no placeholder, and for each committed environment file."""
    of_kind = lambda k, p: F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(1)), lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))
    held = F.flatten(F.array(*[of_kind(k, p) for k, p in CREDENTIALS]))
    patterns = [p for _, p in CREDENTIALS]
    own = files.where("not is_vendor and not is_generated").where(holds_literal(F.col("content"), *patterns)).where(reduce(lambda a, b: a | b, [F.col("content").rlike(p) for p in patterns]))
    found = own.select("scan_id", "path", F.posexplode(F.split("content", "\n")).alias("i", "line")).where(holds_literal(F.col("line"), *patterns)).select("scan_id", "path", "i", F.explode(held).alias("s"))
    real = found.where(~F.col("s.value").rlike(PLACEHOLDER) & ((F.col("s.kind") != "assignment") | (F.round(C.entropy(F.col("s.value")), 6) >= 3.5)))
    one = lambda rows, rule, line: D.finding(rows, rule, CREDENTIAL[0], CREDENTIAL[1], CREDENTIAL[2], CREDENTIAL[3], F.col("path"), line)
    env = files.where(F.col("path").rlike(r"(^|/)\.env(\.[a-z]+)?$") & ~F.col("path").rlike("example|sample|template"))
    return one(real, F.concat(F.lit("sec.secret."), "s.kind"), F.col("i") + 1).unionByName(one(env, "sec.secret.env-committed", None)).distinct()


def _packages(f: DataFrame, advisories: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packages that scans declare, and the findings about them, placed at a manifest that declares them."""
    declared = K.manifests(f).withColumn("ord", F.concat_ws("#", "path", "name"))
    own = staged(K.one_each(declared))
    locked = f.where(F.col("path").rlike(LOCKS)).select("scan_id").distinct()
    said = K.findings(own, advisories, registry, own, locked)
    at = own.groupBy("scan_id", "name").agg(F.min("path").alias("path"))
    meta = lambda i: D.lookup(F.col("rule_id"), {r: v[i] for r, v in PACKAGE_RULES.items()})
    placed = said.join(at, ["scan_id", "name"], "left").withColumn("path", F.coalesce("path", F.lit("package.json")))
    found = placed.select("scan_id", "rule_id", "severity", meta(0).alias("confidence"), meta(1).alias("root_cause"), meta(2).cast("int").alias("effort_minutes"), "path", F.lit(None).cast("int").alias("line"), F.lit(1).cast("long").alias("n"), F.col("name").alias("title"))
    return own, found


def _as(category: Column | str, rows: DataFrame) -> DataFrame:
    held = rows if "title" in rows.columns else rows.withColumn("title", F.col("rule_id"))
    return held.select(*D.COLUMNS, "title", (F.lit(category) if isinstance(category, str) else category).alias("category"))


def audit(files: DataFrame, advisories: DataFrame | None = None, registry: DataFrame | None = None, detectors: Detectors | None = None, limits: dict | None = None) -> Audit:
    """``files`` (scan_id, path, content; null content: a binary file) through limits, all detectors, merging, suppressions and validation.

    ``advisories`` and ``registry`` (ecosystem, name, licence) may be left out; ``detectors`` are a caller's own. Files, what several steps read, raw and merged findings are written
    once to the session's shared folder. Rows without a scan or a path are left out; an empty table gives empty tables.
    """
    spark = files.sparkSession
    advisories = spark.createDataFrame([], ADVISORY) if advisories is None else advisories
    registry = spark.createDataFrame([], REGISTRY) if registry is None else registry
    sized = files.where("scan_id is not null and path is not null and content is not null").select("scan_id", "path", "content", F.octet_length("content").cast("long").alias("size"))
    f = within_limits(sized, **(limits or {})).withColumn("language", P.language(F.col("path")))
    f = staged(f.withColumns(P.flags(F.col("path"), F.col("language"))))

    resolved = staged(I.resolve(staged(I.imports(f)), f.select("scan_id", "path")))
    edges = staged(I.module_edges(resolved))
    exported, entry = staged(I.exports(f)), P.matches(F.col("path"), ENTRIES)
    unused = staged(I.unused_exports(exported, resolved, entry))
    spans, blocks = staged(T.function_spans(f.where("is_code"))), staged(copied_blocks(f.where(SOURCE)))
    sizes = staged(_loc(f).select("scan_id", "path", "is_test", F.expr(SOURCE).alias("is_source"), F.expr("is_code and not is_test and not is_vendor and not is_generated").alias("is_own"), "loc"))
    loc = sizes.groupBy("scan_id").agg(F.sum("loc").alias("loc"), F.count_if("is_test").alias("test_files"), F.count_if("is_own").alias("source_files"))
    again = blocks.groupBy("scan_id").agg(F.sum(6 * (F.col("occurrences") - 1)).alias("again"))
    ratio = loc.join(again, "scan_id", "left").select("scan_id", F.round(F.least(F.lit(1.0), F.coalesce(F.coalesce("again", F.lit(0)) / F.nullif("loc", F.lit(0)), F.lit(0.0))), 6).alias("ratio"))
    shape = T.complexity(spans.join(sizes.where("is_source").select("scan_id", "path"), ["scan_id", "path"], "left_semi"))
    measured = loc.join(shape, "scan_id", "left").join(ratio, "scan_id", "left").join(unused.groupBy("scan_id").agg(F.count("*").alias("dead")), "scan_id", "left").join(coverage(f), "scan_id", "left")
    share = F.round(F.coalesce(F.col("test_files") / F.nullif(F.col("source_files"), F.lit(0)), F.lit(0.0)), 6)
    metrics = staged(measured.select("scan_id", "test_files", share.alias("test_ratio"), F.coalesce("avg_complexity", F.lit(0.0)).alias("avg_complexity"), F.col("ratio").alias("duplication"), F.coalesce("dead", F.lit(0)).alias("dead_code_count"), "coverage"))

    own, about_packages = _packages(f, advisories, registry)
    notable = T.notable(spans)
    large = sizes.where("is_source")
    top = large.withColumn("place", F.row_number().over(D.Window.partitionBy("scan_id").orderBy(F.desc("loc"), "path"))).where("place <= 8")
    modules = large.join(exported.groupBy("scan_id", "path").agg(F.count("*").alias("n_exports")), ["scan_id", "path"])
    category = D.lookup(F.col("rule_id"), {r.id: r.category for r in R.SHIPPED})
    parts = [
        _as(category, D.by_rules(f, R.SHIPPED)), _as("security", credentials(f)), _as("reliability", D.no_error_handling(f)),
        _as("architecture", D.layers(resolved, LAYERS)), _as("architecture", D.circular(D.scan_cycles(edges))), _as("architecture", D.large_modules(modules)),
        _as("testing", D.untested_critical(f)), _as("testing", D.skipped_tests(f)), _as("testing", D.no_ci(f)), _as("dependencies", about_packages),
        _as("performance", D.functions(notable, ("deep",))), _as("ai-code", D.unresolved(resolved)), _as("ai-code", D.unused(unused)), _as("ai-code", D.repeated(by_frequency(blocks, LISTED))),
        _as("maintainability", D.functions(notable, ("complex", "long", "wide"))), _as("maintainability", D.oversized(top)), _as("maintainability", D.duplicated(by_frequency(blocks, 1), ratio)),
    ]
    parts += [_as(c, find(f)) for c, find in (detectors or {}).values()]
    found = reduce(DataFrame.unionByName, parts)
    agent = F.array_position(F.array(*map(F.lit, AGENTS)), F.col("category")).cast("int") - 1
    ident = stable_id("raw", F.col("scan_id").cast("string"), "rule_id", "path", F.coalesce(F.col("line").cast("string"), F.lit("")), "title")
    raw = staged(found.withColumn("agent_ord", agent).withColumn("raw_id", ident).withColumnRenamed("line", "start_line"))

    merged = O.merge_findings(raw).withColumnRenamed("start_line", "line").withColumn("finding_id", stable_id("fnd", F.col("scan_id").cast("string"), "dedupe_key"))
    commented = X.by_comment(merged, X.directives(f)).withColumnRenamed("suppressed", "by_comment")
    ignored = X.parse_ignore(f.where(F.col("path") == IGNORE_FILE), ["scan_id"])
    told = staged(X.by_globs(commented, ignored).withColumn("suppressed", F.col("suppressed") | F.col("by_comment")).drop("by_comment"))

    known = f.select("scan_id", "path", entry.alias("is_entry"))
    reached = G.scan_reachable(known, edges).withColumn("reached", F.lit(True))
    entries = known.groupBy("scan_id").agg(F.bool_or("is_entry").alias("has_entries"))
    known = known.join(reached, ["scan_id", "path"], "left").join(entries, "scan_id").select("scan_id", "path", "is_entry", F.when(F.col("has_entries"), F.coalesce("reached", F.lit(False))).alias("reachable"))
    uses = resolved.where("kind = 'external'").select("scan_id", F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|[^/]+)", 1).alias("package"), "path").distinct().groupBy("scan_id", "package").agg(F.count("*").alias("uses"))
    dev = own.groupBy("scan_id", F.col("name").alias("package")).agg(F.bool_and("dev").alias("dev"))
    p = V.placed(told, f).join(known, ["scan_id", "path"], "left")
    p = p.withColumn("package", F.when(F.col("rule_id").startswith("dep."), F.substring_index("dedupe_key", "#", -1))).join(uses, ["scan_id", "package"], "left").join(dev, ["scan_id", "package"], "left")
    judged = V.summed(V.signals(p, F.size("detected_by"), F.col("reachable"), F.col("is_entry"), F.coalesce("uses", F.lit(0)), F.col("dev")))
    status = F.when(F.col("dismissed"), "dismissed").when(F.col("after") >= CONFIRMED, "confirmed").when(F.col("after") >= LIKELY, "likely").otherwise("potential")
    columns = [c for c in told.columns if c != "confidence"]
    out = judged.select(*columns, F.col("after").alias("confidence"), status.alias("validation"), "signals", V.rationale(F.col("signals"), F.col("confidence"), F.col("after")).alias("rationale"))
    return Audit(f, raw, staged(out), metrics, own)


@query()
def audit_report(t: Tables) -> DataFrame:
    """A whole audit over v_code: one row for each scan. Its steps have SQL of their own; tests compare the whole with them and with written trees."""
    return audit(t.v_code).report()
