"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for the nodes of ``edges`` (``a``, ``b``, longs).

    Each round gives every node the least root among its own and its neighbours', and then its root's root; rounds are cut by written
    tables. Stars end after two rounds, chains after about the logarithm of their length.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    for _ in range(rounds):
        seen = both.join(roots, both["b"] == roots["node"]).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("least"))
        near = roots.join(seen, roots["node"] == seen["n"]).select("node", F.col("root").alias("old"), F.least("root", "least").alias("r"))
        up = roots.select(F.col("node").alias("up"), F.col("root").alias("top"))
        new = stage(near.join(up, near["r"] == up["up"]).select("node", "old", F.least("r", "top").alias("root")))
        changed = new.where("root <> old").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return roots
