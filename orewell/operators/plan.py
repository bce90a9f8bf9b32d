"""Improvement plans: phases of causes, their joint gain, recommendations, patch bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import lookup
from .scoring import health, category_scores, root_causes, what_if

# The category of each canonical cause; others are maintainability.
CAUSE_CATEGORY = {
    "secrets-in-source": "security", "unparameterised-queries": "security", "data-executed-as-code": "security", "untrusted-input-boundary": "security", "unescaped-output": "security", "auth-trust-boundary": "security", "weak-cryptography": "security",
    "permissive-configuration": "security", "vulnerable-dependencies": "dependencies", "unreproducible-builds": "dependencies", "dependency-drift": "dependencies", "license-obligations": "dependencies", "undefined-failure-paths": "reliability",
    "money-precision": "reliability", "module-coupling": "architecture", "layer-leakage": "architecture", "no-test-safety-net": "testing", "data-access-scales-with-data": "performance", "blocking-event-loop": "performance", "complex-hot-paths": "performance",
    "client-rendering-cost": "performance", "complexity-debt": "maintainability", "duplicated-logic": "maintainability", "dead-code": "maintainability", "config-in-source": "ai-code", "incomplete-implementations": "ai-code", "inconsistent-error-contract": "ai-code",
    "no-logging-strategy": "ai-code",
}
# Phases in the order in which they are worked, with their titles.
PHASES = {"security": "Security", "dependencies": "Supply chain", "reliability": "Reliability", "testing": "Verification", "architecture": "Architecture", "performance": "Performance", "maintainability": "Maintainability", "ai-code": "Consistency"}
# What is recommended for a cause, unless a scan declares one of the packages.
RECOMMENDATIONS = (
    ("Zod", "missing-input-validation", ("zod", "yup", "joi", "valibot", "superstruct", "pydantic")),
    ("Helmet", "permissive-configuration", ("helmet", "next-safe")),
    ("Vitest", "no-test-safety-net", ("vitest", "jest", "mocha", "ava", "pytest", "node:test")),
    ("Pino", "no-logging-strategy", ("pino", "winston", "bunyan", "structlog")),
    ("Dinero.js", "money-precision", ()),
    ("Drizzle ORM", "unparameterised-queries", ()),
    ("DOMPurify", "unescaped-output", ("dompurify", "sanitize-html")),
)


def cause_category(cause: Column) -> Column:
    return F.coalesce(lookup(cause, CAUSE_CATEGORY), F.lit("maintainability"))


def phases(findings: DataFrame, cause: Column, order: list[str], metrics: DataFrame | None = None) -> DataFrame:
    """scan_id, theme, title, place, causes, findings, hours_low, hours_high, gain: a phase for each theme with causes.

    The gain is scored for all of a phase's findings together, as points are damped: resolved one by one they hardly count.
    """
    live = findings.where("validation <> 'dismissed'").withColumn("cause", cause)
    causes = root_causes(findings, cause, ["scan_id"], order).withColumn("theme", cause_category(F.col("cause")))
    work = causes.groupBy("scan_id", "theme").agg(F.count("*").alias("causes"), F.sum("n").alias("findings"), F.sum("hours_low").alias("hours_low"), F.sum("hours_high").alias("hours_high"))
    base = health(category_scores(live, live.select("scan_id").distinct(), ["scan_id"], metrics), ["scan_id"]).withColumnRenamed("overall", "base")
    then = what_if(live, live.select("scan_id", cause_category(F.col("cause")).alias("scenario"), *order), ["scan_id"], order[-1], metrics).withColumnRenamed("scenario", "theme")
    number = lookup(F.col("theme"), {t: i + 1 for i, t in enumerate(PHASES)})
    out = work.join(then, ["scan_id", "theme"]).join(base, "scan_id")
    before = F.array_sort(F.collect_set(number).over(_scan()))
    return out.select("scan_id", "theme", lookup(F.col("theme"), PHASES).alias("title"), F.array_position(before, number).cast("int").alias("place"), "causes", "findings", "hours_low", "hours_high", F.greatest(F.lit(0), F.col("overall") - F.col("base")).alias("gain"))


def _scan():
    from pyspark.sql import Window

    return Window.partitionBy("scan_id")


def recommendations(findings: DataFrame, packages: DataFrame, rules: tuple = RECOMMENDATIONS) -> DataFrame:
    """scan_id, name, findings: rules whose cause live findings have, but for scans (``packages``: scan_id, name) that declare a package of the rule's."""
    names = F.array_compact(F.array(*[F.when(F.col("root_cause") == cause, F.lit(name)) for name, cause, _ in rules]))
    asked = findings.select("scan_id", F.explode(names).alias("name")).groupBy("scan_id", "name").agg(F.count("*").alias("findings"))
    has = F.array_compact(F.array(*[F.when(F.col("name").isin(*known), F.lit(name)) for name, _, known in rules if known]))
    declared = packages.select("scan_id", F.explode(has).alias("name")).distinct()
    return asked.join(declared, ["scan_id", "name"], "left_anti")


def patch_bundles(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """scan_id, cause, patches, bundle: the patch texts of a cause's findings in the order of their ids; ``patches``: raw_id, patch."""
    held = findings.join(patches, "raw_id").groupBy("scan_id", "cause").agg(F.sort_array(F.collect_list(F.struct("raw_id", "patch"))).alias("p"))
    return held.select("scan_id", "cause", F.size("p").cast("long").alias("patches"), F.array_join(F.transform("p", lambda x: x["patch"]), "\n").alias("bundle"))
