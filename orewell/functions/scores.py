"""Column helpers for severities, confidence and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scoring model.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_POINTS = {"critical": 30.0, "high": 14.0, "medium": 5.0, "low": 1.5, "info": 0.3}
VALIDATION_FACTOR = {"confirmed": 1.0, "likely": 0.75, "potential": 0.45, "dismissed": 0.0}
TIER_CEILING = {"medium": 40.0, "low": 18.0, "info": 5.0}
LINEAR_POINTS, DAMP_FACTOR = 40.0, 5.0
CATEGORY_WEIGHT = {
    "security": 0.25, "reliability": 0.15, "architecture": 0.15, "testing": 0.1, "dependencies": 0.1, "performance": 0.1, "maintainability": 0.1, "ai-code": 0.05,
}
LABELS = ((90, "Excellent"), (80, "Healthy"), (70, "Fair"), (50, "At risk"))
STATUS = ((0.85, "confirmed"), (0.65, "likely"))


def lookup(key: Column, values: dict, default=None) -> Column:
    """The value of a small fixed map."""
    out = reduce(lambda w, kv: w.when(key == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(key == next(iter(values)), F.lit(next(iter(values.values())))))
    return out if default is None else out.otherwise(default)


def severity_ord(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)})


def severity_of(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), ordinal + 1)


def deduction(severity: Column, confidence: Column, validation: Column) -> Column:
    """Points of one finding, to one decimal; halves go up, whatever their binary representation."""
    return F.floor(lookup(severity, SEVERITY_POINTS) * confidence * lookup(validation, VALIDATION_FACTOR) * 10 + (0.5 + 1e-9)) / 10


def ceiling(severity: Column, points: Column) -> Column:
    """A severity tier's points under its ceiling; critical and high have none."""
    return F.least(points, lookup(severity, TIER_CEILING))


def damp(points: Column) -> Column:
    return F.when(points <= LINEAR_POINTS, points).otherwise(LINEAR_POINTS + F.sqrt(points - LINEAR_POINTS) * DAMP_FACTOR)


def score_label(score: Column) -> Column:
    return reduce(lambda w, x: w.when(score >= x[0], x[1]), LABELS[1:], F.when(score >= LABELS[0][0], LABELS[0][1])).otherwise("Critical")


def status(confidence: Column) -> Column:
    return F.when(confidence >= STATUS[0][0], STATUS[0][1]).when(confidence >= STATUS[1][0], STATUS[1][1]).otherwise("potential")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and 16 hex digits of the parts' SHA-256; parts are joined by ``|#|``."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|#|", *parts), 256), 1, 16))
