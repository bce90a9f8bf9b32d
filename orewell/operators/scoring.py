"""Scores of scans: category scores, health, what-if scenarios, causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import CATEGORY_WEIGHT, SEVERITY_POINTS, TIER_CEILING, ceiling, clamp, damp, deduction, lookup, severity_of, severity_ord


# Points for missing tests, and (limit, factor, most) of what is measured.
NO_TESTS, TEST_RATIO, COVERAGE, DUPLICATION, COMPLEXITY, DEAD_CODE = 45.0, (0.3, 80), (0.6, 40), (0.05, 150, 20.0), (8, 3, 15.0), (10, 4, 15.0)


def structural() -> dict[str, Column]:
    """Points of a category that come from the scan's metrics, not from findings: columns test_files, test_ratio, coverage, duplication, avg_complexity, dead_code_count."""
    up = lambda x: F.floor(x + 0.5)
    zero = F.lit(0.0)
    tests = F.when(F.col("test_files") == 0, F.lit(NO_TESTS)).when(F.col("test_ratio") < TEST_RATIO[0], up((TEST_RATIO[0] - F.col("test_ratio")) * TEST_RATIO[1])).otherwise(zero)
    cover = F.when(F.col("coverage") < COVERAGE[0], up((COVERAGE[0] - F.col("coverage")) * COVERAGE[1])).otherwise(zero)
    dup = F.when(F.col("duplication") > DUPLICATION[0], up(F.least(F.lit(DUPLICATION[2]), F.col("duplication") * DUPLICATION[1]))).otherwise(zero)
    branchy = F.when(F.col("avg_complexity") > COMPLEXITY[0], up(F.least(F.lit(COMPLEXITY[2]), (F.col("avg_complexity") - COMPLEXITY[0]) * COMPLEXITY[1]))).otherwise(zero)
    dead = F.when(F.col("dead_code_count") > DEAD_CODE[0], F.least(F.lit(DEAD_CODE[2]), up(F.col("dead_code_count") / DEAD_CODE[1]))).otherwise(zero)
    return {"testing": tests + cover, "maintainability": dup + branchy, "ai-code": dead}


def tier_points(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Points of each (keys, category, severity), under the tier's ceiling; dismissed findings count nothing."""
    live = findings.where("validation <> 'dismissed'").withColumn("points", deduction(F.col("severity"), F.col("confidence"), F.col("validation")))
    tiers = live.groupBy(*keys, "category", "severity").agg(F.sum("points").alias("raw"))
    return tiers.withColumn("points", ceiling(F.col("severity"), F.col("raw")))


def category_scores(findings: DataFrame, scans: DataFrame, keys: list[str], metrics: DataFrame | None = None) -> DataFrame:
    """Eight rows for each scan: findings (dismissed too), points and score; scans without findings are there as well."""
    found = findings.groupBy(*keys, "category").agg(F.count("*").alias("finding_count"))
    points = tier_points(findings, keys).groupBy(*keys, "category").agg(F.sum("points").alias("points"))
    grid = scans.select(*keys).withColumn("category", F.explode(F.array(*map(F.lit, CATEGORY_WEIGHT))))
    out = grid.join(found, [*keys, "category"], "left").join(points, [*keys, "category"], "left")
    total = F.coalesce("points", F.lit(0.0))
    if metrics is not None:
        out = out.join(metrics, keys, "left")
        for category, extra in structural().items():
            total = total + F.when(F.col("category") == category, F.coalesce(extra, F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("total", F.round(total, 6))
    score = clamp(F.floor(100 - damp(F.col("total")) + 0.5), 0, 100)
    return out.select(*keys, "category", F.coalesce("finding_count", F.lit(0)).alias("finding_count"), F.col("total").alias("points"), score.cast("long").alias("score"))


def health(scores: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """The weighted mean of the category scores, rounded; weights are normalised."""
    w = CATEGORY_WEIGHT | (weights or {})
    total = sum(w.values()) or 1
    mean = F.sum(F.col("score") * lookup(F.col("category"), {c: x / total for c, x in w.items()}))
    return scores.groupBy(*keys).agg(clamp(F.floor(F.round(mean, 6) + 0.5), 0, 100).cast("long").alias("overall"))


def what_if(findings: DataFrame, scenarios: DataFrame, keys: list[str], finding: str, metrics: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Overall scores under scenarios that resolve findings: ``scenarios`` has keys, ``scenario``, and the ids that it resolves.

    Points are summed once by tier, and once more for each scenario's own findings; a scenario's score is the scan's with the touched categories
    scored anew without their own part. So the work grows with the scenarios' members, not with findings times scenarios.
    """
    live = findings.where("validation <> 'dismissed'").select(*keys, finding, "category", "severity", deduction(F.col("severity"), F.col("confidence"), F.col("validation")).alias("p"))
    tiers = [F.sum(F.when(F.col("severity") == s, F.col("p")).otherwise(0.0)).alias(s) for s in SEVERITY_POINTS]
    whole = live.groupBy(*keys, "category").agg(*tiers)
    own = live.join(scenarios.select(*keys, "scenario", finding).distinct(), [*keys, finding]).groupBy(*keys, "scenario", "category").agg(*tiers)
    each = scenarios.select(*keys, "scenario").distinct()
    base = category_scores(findings, scenarios.select(*keys).distinct(), keys, metrics).select(*keys, "category", "score")
    w = CATEGORY_WEIGHT | (weights or {})
    total = sum(w.values()) or 1
    share = lookup(F.col("category"), {c: x / total for c, x in w.items()})
    sums = base.groupBy(*keys).agg(F.sum(F.col("score") * share).alias("held"))
    left = lambda s: ceiling(F.lit(s), F.round(F.col(f"a.{s}") - F.col(f"o.{s}"), 9)) if s in TIER_CEILING else F.round(F.col(f"a.{s}") - F.col(f"o.{s}"), 9)
    touched = own.alias("o").join(whole.alias("a"), [*keys, "category"]).select(*keys, "o.scenario", "category", sum((left(s) for s in list(SEVERITY_POINTS)[1:]), left(next(iter(SEVERITY_POINTS)))).alias("points"))
    points = F.col("points")
    if metrics is not None:
        touched = touched.join(metrics, keys, "left")
        for category, extra in structural().items():
            points = points + F.when(F.col("category") == category, F.coalesce(extra, F.lit(0.0))).otherwise(0.0)
    new = clamp(F.floor(100 - damp(F.round(points, 6)) + 0.5), 0, 100)
    gained = touched.join(base, [*keys, "category"]).groupBy(*keys, "scenario").agg(F.sum((new - F.col("score")) * share).alias("gain"))
    out = each.join(sums, keys).join(gained, [*keys, "scenario"], "left")
    mean = F.col("held") + F.coalesce("gain", F.lit(0.0))
    return out.select(*keys, "scenario", clamp(F.floor(F.round(mean, 6) + 0.5), 0, 100).cast("long").alias("overall"))


def effort_hours(minutes: Column, first: Column) -> tuple[Column, Column]:
    """(low, high) hours of a cause: members after the first are cheaper."""
    low = F.greatest(F.lit(1), F.floor((minutes * 0.6 + first * 0.4) / 60 + 0.5))
    return low, F.greatest(low + 1, F.floor(minutes / 60 * 1.2 + 0.5))


def root_causes(findings: DataFrame, cause: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Live findings by cause: number, worst severity, effort range, ids (a scan's, so a list is bounded by a scan). ``order`` decides which member is the first."""
    live = findings.where("validation <> 'dismissed'").withColumn("cause", cause)
    out = live.groupBy(*keys, "cause").agg(F.count("*").alias("n"), F.min(severity_ord(F.col("severity"))).alias("sev"), F.sum("effort_minutes").alias("minutes"), F.min_by("effort_minutes", F.struct(*order)).alias("first"), F.sort_array(F.collect_list(order[-1])).alias("ids"))
    low, high = effort_hours(F.col("minutes"), F.col("first"))
    return out.select(*keys, "cause", "n", severity_of(F.col("sev")).alias("severity"), low.cast("long").alias("hours_low"), high.cast("long").alias("hours_high"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def concentration(causes: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """The fewest causes that cover the share of the findings."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "cause")
    run = causes.select(*keys, F.row_number().over(w).alias("k"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("covered"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return run.where(F.col("covered") >= F.ceil(share * F.col("all"))).groupBy(*keys).agg(F.min("k").alias("causes"), F.min("covered").alias("covered"), F.max("all").alias("findings"))
