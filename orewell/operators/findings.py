"""Raw findings to merged findings, and what is asked of findings: filters, orders, counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import SEVERITIES, clamp, lookup, severity_of, severity_ord
from .rules import cwe

# Issue classes by rule id, first match wins.
ISSUE_CLASSES = (
    (r"^sec\.secret\.", "exposed-credential"),
    (r"^sec\.sql-injection", "injection.sql"),
    (r"^sec\.command-injection|^sec\.eval-usage", "injection.code"),
    (r"^sec\.xss", "injection.xss"),
    (r"^sec\.ssrf", "ssrf"),
    (r"^sec\.path-traversal", "path-traversal"),
    (r"^sec\.jwt|^sec\.auth", "auth-verification"),
    (r"^sec\.(cors|insecure-cookie|debug-enabled|tls)", "insecure-configuration"),
    (r"^sec\.(mass-assignment|unvalidated-input)", "input-validation"),
    (r"^dep\.", "dependency"),
    (r"^perf\.n-plus-one|^bug\.await-in-loop", "per-iteration-io"),
    (r"^perf\.", "performance"),
    (r"duplicat|repeated-implementation", "duplication"),
    (r"unused-export|dead-code", "dead-code"),
    (r"^bug\.(empty-catch|bare-except)", "swallowed-error"),
    (r"^bug\.", "reliability"),
    (r"^arch\.", "architecture"),
    (r"^test\.", "testing"),
    (r"^maint\.|^ai\.", "maintainability"),
)
# Causes of rules to canonical causes.
CAUSE_ALIASES = {
    "unvalidated-outbound-requests": "untrusted-input-boundary",
    "unvalidated-filesystem-paths": "untrusted-input-boundary",
    "unvalidated-redirects": "untrusted-input-boundary",
    "missing-input-validation": "untrusted-input-boundary",
    "unsafe-shell-usage": "data-executed-as-code",
    "unsafe-dynamic-execution": "data-executed-as-code",
    "weak-transport-security": "weak-cryptography",
    "missing-null-checks": "undefined-failure-paths",
    "missing-failure-handling": "undefined-failure-paths",
    "silent-failure-handling": "undefined-failure-paths",
    "unbounded-data-access": "data-access-scales-with-data",
    "n-plus-one-access": "data-access-scales-with-data",
    "quadratic-algorithms": "data-access-scales-with-data",
    "no-automated-verification": "no-test-safety-net",
    "unnecessary-indirection": "complexity-debt",
    "hardcoded-configuration": "config-in-source",
    "react-reconciliation": "client-rendering-cost",
    "bundle-weight": "client-rendering-cost",
}
BUCKET_LINES, MAX_CONFIDENCE, JOINT, EVIDENCE, PLACES = 5, 0.97, 0.92, 8, 12


def issue_class(rule_id: Column) -> Column:
    return reduce(lambda w, x: w.when(rule_id.rlike(x[0]), x[1]), ISSUE_CLASSES[1:], F.when(rule_id.rlike(ISSUE_CLASSES[0][0]), ISSUE_CLASSES[0][1])).otherwise(rule_id)


def dedupe_key(rule_id: Column, title: Column, path: Column, line: Column) -> Column:
    """Dependency findings by rule and title; others by issue class, path and a bucket of five lines, or the file."""
    bucket = F.when(F.coalesce(line, F.lit(0)) != 0, F.floor(line / BUCKET_LINES).cast("string")).otherwise("file")
    return F.when(rule_id.startswith("dep."), F.concat(rule_id, F.lit("#"), title)).otherwise(F.concat(issue_class(rule_id), F.lit("@"), path, F.lit("#"), bucket))


def canonical_cause(cause: Column) -> Column:
    return F.coalesce(lookup(cause, CAUSE_ALIASES), cause)


def noisy_or(agents: DataFrame, keys: list[str], confidence: str = "confidence", agent: str = "agent_ord") -> DataFrame:
    """One confidence for each key: the best of each agent; of several agents, 1 - 0.92 x the product of doubts, at most 0.97."""
    best = agents.groupBy(*keys, agent).agg(F.max(confidence).alias("c"))
    out = best.groupBy(*keys).agg(F.count("*").alias("agents"), F.max("c").alias("top"), F.exp(F.sum(F.log1p(-F.least("c", F.lit(1 - 1e-12))))).alias("doubt"))
    joint = F.least(F.lit(MAX_CONFIDENCE), F.greatest("top", 1 - F.col("doubt") * JOINT))
    return out.select(*keys, "agents", F.when(F.col("agents") == 1, F.col("top")).otherwise(joint).alias("confidence"))


def merge_findings(raw: DataFrame, scan: str = "scan_id", evidence: Column | None = None) -> DataFrame:
    """Raw findings (raw_id, agent_ord, rule_id, title, severity, confidence, path, start_line, effort_minutes, root_cause) to one row for each (scan, key).

    The primary has the most ``evidence`` (an array of strings, by default the place), then the worst severity, then the first agent and id; its rule, effort and
    cause stand for the group. Of different evidence the first eight are kept, and of the other members' places the first twelve. Members meet first
    by agent, which also gives the joint confidence: one pass, then one over a few rows for each group.
    """
    held = F.array(F.concat_ws(":", "path", "start_line")) if evidence is None else evidence
    keyed = raw.withColumn("dedupe_key", dedupe_key(F.col("rule_id"), F.col("title"), F.col("path"), F.col("start_line"))).withColumn("sev", severity_ord(F.col("severity"))).withColumn("held", held)
    rank = F.struct((-F.size("held")).alias("e"), "sev", "agent_ord", "raw_id")
    member = F.struct("raw_id", "rule_id", "effort_minutes", "root_cause", "path", "start_line", "category")
    place = F.struct("path", "start_line")
    by_agent = keyed.groupBy(scan, "dedupe_key", "agent_ord").agg(
        F.min("sev").alias("sev"), F.count("*").alias("n"), F.max("confidence").alias("c"), F.min(rank).alias("rank"), F.min_by(member, rank).alias("p"), F.collect_set(place).alias("places"), F.array_distinct(F.flatten(F.collect_set("held"))).alias("evidence"),
    )
    joint = F.least(F.lit(MAX_CONFIDENCE), F.greatest(F.max("c"), 1 - F.exp(F.sum(F.log1p(-F.least("c", F.lit(1 - 1e-12))))) * JOINT))
    out = by_agent.groupBy(scan, "dedupe_key").agg(
        F.min("sev").alias("sev"), F.sum("n").alias("n_raw"), F.min_by("p", "rank").alias("p"), F.array_sort(F.collect_set("agent_ord")).alias("detected_by"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), 1, EVIDENCE).alias("evidence"), F.when(F.count("*") == 1, F.max("c")).otherwise(joint).alias("confidence"),
    )
    others = F.slice(F.filter("places", lambda x: ~((x["path"] == F.col("p.path")) & x["start_line"].eqNullSafe(F.col("p.start_line")))), 1, PLACES)
    return out.select(
        scan, "dedupe_key", severity_of(F.col("sev")).alias("severity"), "n_raw", "p.rule_id", "p.effort_minutes", canonical_cause(F.col("p.root_cause")).alias("root_cause"), "p.path", "p.start_line", "p.category",
        "detected_by", others.alias("other_places"), "evidence", F.round("confidence", 6).alias("confidence"),
    )


@dataclass(frozen=True)
class FindingQuery:
    """A filter over findings; empty parts ask nothing."""

    search: str = ""
    severities: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    validations: tuple[str, ...] = ()
    root_cause: str | None = None
    hide_dismissed: bool = True

    def column(self, haystack: Column) -> Column:
        terms = [F.contains(F.lower(haystack), F.lit(t)) for t in self.search.lower().split()]
        asked = [F.col(c).isin(*v) for c, v in (("severity", self.severities), ("category", self.categories), ("validation", self.validations)) if v]
        cause = [F.col("root_cause") == self.root_cause] if self.root_cause else []
        live = [F.col("validation") != "dismissed"] if self.hide_dismissed else []
        return reduce(lambda a, b: a & b, [*live, *asked, *cause, *terms], F.lit(True))


def haystack() -> Column:
    """What a search looks through: title, path, rule, weakness and category of a finding."""
    return F.concat_ws(" ", "title", "path", "rule_id", cwe(F.col("rule_id")), "category")


def urgent() -> Column:
    return F.col("severity").isin("critical", "high") & F.col("validation").isin("confirmed", "likely")


def order(kind: str) -> list[Column]:
    """The four orders of findings; every order ends with the id."""
    sev = severity_ord(F.col("severity"))
    return {
        "severity": [sev, F.desc("confidence")],
        "confidence": [F.desc("confidence")],
        "file": [F.asc("path"), F.asc("start_line")],
        "category": [F.asc("category"), sev],
    }[kind] + [F.asc("raw_id")]


def ranked(findings: DataFrame, kind: str, scan: str = "scan_id") -> DataFrame:
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(scan).orderBy(*order(kind))))


def severity_counts(findings: DataFrame, scan: str = "scan_id") -> DataFrame:
    return findings.groupBy(scan).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def redact(findings: DataFrame, secrets: DataFrame, columns: list[str], scan: str = "scan_id") -> DataFrame:
    """Every secret value of a scan is masked in every text column of its findings. ``secrets``: scan, ``value``, ``mask``; longest first."""
    held = secrets.groupBy(F.col(scan).alias("__s")).agg(F.reverse(F.array_sort(F.collect_set(F.struct(F.length("value").alias("n"), "value", "mask")))).alias("__held"))
    out = findings.join(held, F.col(scan) == F.col("__s"), "left").withColumn("__held", F.coalesce("__held", F.array().cast(held.schema["__held"].dataType)))
    mask = lambda c: F.aggregate("__held", F.col(c), lambda t, s: F.replace(t, s["value"], s["mask"]))
    return out.withColumns({c: mask(c) for c in columns}).drop("__s", "__held")


def mask(value: Column) -> Column:
    """The first four characters, an ellipsis, the last four."""
    return F.concat(F.substring(value, 1, 4), F.lit("…"), F.right(value, F.lit(4)))


def blend(findings: DataFrame, judgements: DataFrame, key: str) -> DataFrame:
    """An outside judgement (``verdict``, ``judged``) halves a false positive's confidence, else is averaged in; clamped."""
    j = findings.join(judgements, key, "left")
    new = F.when(F.col("verdict") == "false_positive", F.least("confidence", "judged") * 0.5).otherwise((F.col("confidence") + F.col("judged")) / 2)
    return j.withColumn("confidence", F.when(F.col("judged").isNull(), F.col("confidence")).otherwise(clamp(new, 0.05, 0.99)))


def summary(findings: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Counts of live findings by severity, urgent and dismissed ones, and a headline. The headlines."""
    live = F.col("validation") != "dismissed"
    out = findings.groupBy(scan).agg(*[F.count_if(live & (F.col("severity") == s)).alias(s) for s in SEVERITIES], F.count_if(urgent()).alias("urgent"), F.count_if(~live).alias("dismissed"), F.count_if(live).alias("live"))
    many = lambda c, one, more: F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, one).otherwise(more))
    head = F.when(F.col("live") == 0, "No high-confidence issues were identified by this analysis.")
    head = head.when(F.col("critical") > 0, F.concat(many("critical", " critical issue needs", " critical issues need"), F.lit(" attention before anything else.")))
    head = head.when(F.col("urgent") > 0, F.concat(many("urgent", " issue requires", " issues require"), F.lit(" attention; nothing is critical.")))
    return out.withColumn("headline", head.otherwise("No critical or high-confidence issues, but there is technical debt worth scheduling."))
