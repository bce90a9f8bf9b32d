"""Column helpers for package versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMVER = r"^(\d+)\.(\d+)(?:\.(\d+))?"


def clean_version(v: Column) -> Column:
    """Without range operators, a leading v, and what follows the first space, comma or bar."""
    v = F.regexp_replace(F.trim(v), r"^[\^~>=<! v]+", "")
    return F.trim(F.regexp_replace(v, r"[ ,|].*$", ""))


def semver(v: Column) -> Column:
    """(major, minor, patch) or null; compares like a version. Numbers beyond an int count as the largest one."""
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(2**31 - 1))
    part = lambda i: F.regexp_extract(v, SEMVER, i)
    return F.when(v.rlike(SEMVER), F.struct(number(part(1)).alias("major"), number(part(2)).alias("minor"), number(F.coalesce(F.nullif(part(3), F.lit("")), F.lit("0"))).alias("patch")))


#: Bits of major, minor and patch in ``version_number``; a version with a larger number counts as the last one of its major or minor.
BITS = (25, 19, 18)


def version_number(v: Column) -> Column:
    """A ``semver`` as one number that never falls as versions rise; different versions may share one."""
    most = [2**b - 1 for b in BITS]
    minor = F.when(v["major"] >= most[0], most[1]).otherwise(F.least(v["minor"], F.lit(most[1])))
    patch = F.when((v["major"] >= most[0]) | (v["minor"] >= most[1]), most[2]).otherwise(F.least(v["patch"], F.lit(most[2])))
    return F.least(v["major"], F.lit(most[0])).cast("long") * 2 ** (BITS[1] + BITS[2]) + minor.cast("long") * 2 ** BITS[2] + patch


def ranges_of(low: str, high: str) -> Column:
    """The numbers from ``low`` to ``high`` (columns) as the fewest aligned blocks (level, block), a block of level k being 2^k numbers."""
    left, right = f"-shiftright(-{low}, k)", f"shiftright({high} + 1, k)"
    block = lambda ok, n: f"CASE WHEN {left} < {right} AND {ok} % 2 = 1 THEN named_struct('level', k, 'block', {n}) END"
    return F.expr(f"filter(flatten(transform(sequence(0, {sum(BITS)}), k -> array({block(left, left)}, {block(right, right + ' - 1')}))), x -> x IS NOT NULL)")


def version_cmp(a: Column, b: Column) -> Column:
    """-1, 0, 1, or null if either is no version."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)
