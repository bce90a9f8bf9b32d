"""Scans over time: latest and previous, trends, retention, upserts, issues between scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("complete", "failed", "cancelled")


def newest(scans: DataFrame, keys: list[Column | str], time: str = "created_at", tie: str = "scan_id") -> DataFrame:
    """``scans`` with ``rn``, 1 for the newest of each key; ties go to the larger id."""
    return scans.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))))


def repo_history(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each (workspace, repository): scans, the latest and the previous completed score, urgent findings of the latest completed one."""
    repo = ["workspace_id", F.lower("repo_slug").alias("repo")]
    s = scans.select("*", repo[1])
    keys = ["workspace_id", "repo"]
    total = s.groupBy(*keys).agg(F.count("*").alias("scans"), F.max("created_at").alias("last_at"), F.max_by("repo_slug", F.struct("created_at", "scan_id")).alias("slug"))
    done = newest(s.where("state = 'complete'"), keys).where("rn <= 2")
    pair = done.groupBy(*keys).agg(F.max(F.when(F.col("rn") == 1, F.col("scan_id"))).alias("latest"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("previous"))
    n = findings.where(F.col("severity").isin("critical", "high")).groupBy(F.col("scan_id").alias("latest")).agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return total.join(pair, keys, "left").join(n, "latest", "left").na.fill(0, ["critical", "high"])


def trend(scans: DataFrame, findings: DataFrame, limit: int = 40) -> DataFrame:
    """The completed scans of each repository in order: index from 1, score, change, critical and high counts; the oldest ``limit``."""
    s = scans.where("state = 'complete'").select("workspace_id", F.lower("repo_slug").alias("repo"), "scan_id", "score", "created_at")
    w = Window.partitionBy("workspace_id", "repo").orderBy("created_at", "scan_id")
    s = s.withColumn("index", F.row_number().over(w)).withColumn("delta", F.col("score") - F.lag("score").over(w)).where(F.col("index") <= limit)
    n = findings.groupBy("scan_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return s.join(n, "scan_id", "left").na.fill(0, ["critical", "high"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], first: list[str], order: str) -> DataFrame:
    """One row for each key: columns in ``first`` keep the oldest value, the others take the newest. For tables without MERGE."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    at = F.struct("__new", order)
    return rows.groupBy(*keys).agg(*[(F.min_by if c in first else F.max_by)(c, at).alias(c) for c in rest])


def patch(base: DataFrame, patches: DataFrame, key: str, seq: str) -> DataFrame:
    """Partial updates: for each field the last patch that sets it, else the base."""
    fields = [c for c in patches.columns if c not in (key, seq)]
    last = patches.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__{c}") for c in fields])
    return base.join(last, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else c for c in base.columns])


def issue_changes(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Between consecutive completed scans of a repository: issues that are new, open or fixed."""
    s = scans.where("state = 'complete'").select("workspace_id", F.lower("repo_slug").alias("repo"), "scan_id", "created_at")
    w = Window.partitionBy("workspace_id", "repo").orderBy("created_at", "scan_id")
    pairs = s.select("scan_id", F.lag("scan_id").over(w).alias("before")).where("before is not null")
    issues = findings.select("scan_id", "issue").distinct()
    now = pairs.join(issues, "scan_id").select("scan_id", "issue", F.lit(True).alias("now"))
    old = pairs.join(issues.withColumnRenamed("scan_id", "before"), "before").select("scan_id", "issue", F.lit(True).alias("old"))
    state = F.when(F.col("now") & F.col("old"), "open").when(F.col("now"), "new").otherwise("fixed")
    return now.join(old, ["scan_id", "issue"], "full_outer").select("scan_id", "issue", state.alias("state"))


def retained(scans: DataFrame, findings: DataFrame, events: DataFrame, most: int = 500, most_events: int = 4000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The newest scans, their findings, and the last events (scan_id, seq) of each: a top-k, semi-joins, and a rank that Spark cuts in each partition."""
    kept = scans.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(most)
    ids = kept.select("scan_id")
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("seq")))
    return kept, findings.join(ids, "scan_id", "left_semi"), events.join(ids, "scan_id", "left_semi").withColumn("place", place).where(F.col("place") <= most_events).drop("place")
