"""Validation of findings: weighted signals for and against, their sum, and what is said of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clamp
from .findings import issue_class
from .literals import holds_literal

# Signs of placeholders, helpers and libraries in code, and the weights of signals.
BOUND = r"\$\d|\?\s*[,)]|:\w+"
ORM = r"@prisma/client|drizzle-orm|sequelize|typeorm|sqlalchemy|knex"
HELPERS = {
    "guard": r"(?i)isPrivateIp|isAllowedHost|allowlist|ALLOWED_HOSTS|blockPrivate|ipaddress\.ip_address",
    "validator": r"""from ['"](?:zod|yup|joi|valibot|superstruct|pydantic)""",
    "sanitiser": r"(?i)dompurify|sanitize-html|bleach",
    "verifies": r"jwt\.verify|jwtVerify|verifyToken|decode\([^)]*verify\s*=\s*True",
}
TEMPLATE = r"(?i)example|sample|template|fixture"
#: Helpers that may stand in tests as well.
IN_TESTS = ("validator", "sanitiser")
LOW, HIGH, DISMISS_BELOW, DISMISS_WEIGHT = 0.05, 0.97, 0.3, -0.4


def helpers(files: DataFrame) -> DataFrame:
    """Per scan which helpers any of its own files has: one pass, one row."""
    own = files.where("not is_vendor and not is_generated")
    seen = lambda k, p: F.bool_or(holds_literal(F.col("content"), p) & F.col("content").rlike(p) & (F.lit(True) if k in IN_TESTS else ~F.col("is_test")))
    held = own.groupBy("scan_id").agg(*[F.coalesce(seen(k, p), F.lit(False)).alias(k) for k, p in HELPERS.items()])
    return held


def placed(findings: DataFrame, files: DataFrame) -> DataFrame:
    """``findings`` with what is to be known of their file: ``in_test``, the ``text`` of the line, ``orm``, and of the scan: helpers, ``ignores_env``.

    Only the lines that findings name leave a file's row.
    """
    asked = findings.where("line is not null").groupBy("scan_id", "path").agg(F.collect_set("line").alias("wanted"))
    own = files.join(asked, ["scan_id", "path"], "left_semi").select("scan_id", "path", "is_test", F.col("content").rlike(ORM).alias("in_file"), F.split("content", "\n").alias("all"))
    lines = own.join(asked, ["scan_id", "path"]).select("scan_id", "path", "is_test", "in_file", F.explode(F.transform("wanted", lambda n: F.struct(n.alias("line"), F.get("all", n - 1).alias("text")))).alias("x")).select("scan_id", "path", F.col("is_test").alias("in_test"), "in_file", "x.*")
    scan = helpers(files).join(files.groupBy("scan_id").agg(F.bool_or(F.col("path").endswith("package.json") & F.col("content").rlike(ORM)).alias("in_manifest"), F.bool_or((F.col("path") == ".gitignore") & F.contains("content", F.lit(".env"))).alias("ignores_env")), "scan_id", "left")
    return findings.join(lines, ["scan_id", "path", "line"], "left").join(scan, "scan_id", "left")


def signals(p: DataFrame, agents: Column, reachable: Column, entries: Column, package_uses: Column | None = None, package_dev: Column | None = None) -> DataFrame:
    """``p`` (of ``placed``) with ``signals``, an array of (label, weight) in a fixed order. ``reachable`` is null for a scan without entry points; ``entries`` marks entry points themselves."""
    p = p.withColumn("__kind", issue_class(F.col("rule_id")))  # a column, as several signals ask for it
    kind, dep = F.col("__kind"), F.col("rule_id").startswith("dep.")
    yes = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(False))
    uses, dev = (F.lit(None).cast("long") if package_uses is None else package_uses), (F.lit(None).cast("boolean") if package_dev is None else package_dev)
    rows = (
        ("independent corroboration", 0.12, agents > 1),
        ("not reachable from an entry point", -0.28, ~dep & reachable.isNotNull() & ~yes(reachable) & ~yes(entries)),
        ("reachable from an entry point", 0.08, ~dep & yes(reachable)),
        ("test-only code", -0.30, yes("in_test")),
        ("parameter placeholders present", -0.45, (kind == "injection.sql") & yes(F.col("text").rlike(BOUND))),
        ("orm available", -0.08, (kind == "injection.sql") & (yes("in_file") | yes("in_manifest"))),
        ("host-validation helper exists", -0.30, (kind == "ssrf") & yes("guard")),
        ("no host validation anywhere", 0.12, (kind == "ssrf") & ~yes("guard")),
        ("validation library present", -0.20, (kind == "input-validation") & yes("validator")),
        ("no validation library anywhere", 0.15, (kind == "input-validation") & ~yes("validator")),
        ("ignored but still tracked", 0.10, (kind == "exposed-credential") & yes("ignores_env") & F.contains("path", F.lit(".env"))),
        ("template file", -0.35, (kind == "exposed-credential") & F.col("path").rlike(TEMPLATE)),
        ("no import site found", -0.20, (kind == "dependency") & yes(uses == 0)),
        ("package is imported", 0.15, (kind == "dependency") & yes(uses > 0)),
        ("development dependency", -0.15, (kind == "dependency") & yes(dev)),
        ("sanitiser available", -0.22, (kind == "injection.xss") & yes("sanitiser")),
        ("verification exists elsewhere", -0.20, (kind == "auth-verification") & yes("verifies")),
        ("no line-level evidence", -0.10, F.col("line").isNull() & ~dep & ~F.col("rule_id").startswith("test.")),
    )
    return p.withColumn("signals", F.array_compact(F.array(*[F.when(test, F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"))) for label, weight, test in rows]))).drop("__kind")


def summed(p: DataFrame) -> DataFrame:
    """``after``: the confidence with the signals' weights, clamped; ``dismissed`` if it is low or one signal weighs heavily against."""
    total = F.round(F.aggregate("signals", F.col("confidence"), lambda s, x: s + x["weight"]), 6)
    worst = F.coalesce(F.array_min(F.transform("signals", lambda x: x["weight"])), F.lit(0.0))
    return p.withColumn("after", F.round(clamp(total, LOW, HIGH), 6)).withColumn("dismissed", (total < DISMISS_BELOW) | (worst <= DISMISS_WEIGHT))


def _percent(c: Column) -> Column:
    return F.concat(F.floor(F.round(c * 100, 4) + 0.5).cast("string"), F.lit("%"))


def rationale(signals: Column, before: Column, after: Column) -> Column:
    """A sentence for the signals of each side, and one for what became of the confidence."""
    names = lambda keep: F.array_join(F.transform(F.filter(signals, keep), lambda s: s["label"]), ", ")
    said = lambda head, keep: F.when(F.exists(signals, keep), F.concat(F.lit(head), names(keep), F.lit(".")))
    way = F.when(after > before, "raised").when(after < before, "lowered").otherwise("unchanged")
    return F.concat_ws(" ", said("Supporting: ", lambda s: s["weight"] > 0), said("Against: ", lambda s: s["weight"] < 0), F.concat(F.lit("Confidence "), way, F.lit(" from "), _percent(before), F.lit(" to "), _percent(after), F.lit(".")))


def debate(signals: Column, before: Column, after: Column) -> Column:
    """The turns (stance, message) about a finding that something speaks against; null for others."""
    by = lambda sign: F.array_sort(F.filter(signals, lambda s: s["weight"] * sign > 0), lambda x, y: F.when(x["weight"] * sign > y["weight"] * sign, -1).when(x["weight"] * sign < y["weight"] * sign, 1).otherwise(0))
    turn = lambda stance, message: F.struct(F.lit(stance).alias("stance"), message.alias("message"))
    against, rebuttal = F.get(by(-1), 0)["label"], F.get(by(1), 0)["label"]
    n = F.size(signals)
    test = F.concat(F.lit("Weighing "), n.cast("string"), F.when(n == 1, " signal").otherwise(" signals"), F.lit(" against a confidence of "), _percent(before), F.lit("."))
    turns = F.array(turn("claim", F.lit("claim")), F.when(against.isNotNull(), turn("challenge", against)), F.when(rebuttal.isNotNull(), turn("rebuttal", rebuttal)), turn("test", test), turn("verdict", rationale(signals, before, after)))
    return F.when(against.isNotNull(), F.array_compact(turns))
