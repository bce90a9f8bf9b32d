"""Cycles and reachability: rounds of joins and the bounded finish give the same rows; chains take few rounds; paths may hold line ends."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from orewell.operators import detect as D
from orewell.operators import graph as G

from .test_streams_graphs import brute_cycles

EDGE = "src long, dst long"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_rounds_equal_brute_force(spark):
    draw = random.Random(5)
    edges = {(draw.randrange(30), draw.randrange(30)) for _ in range(34)} | {(40 + i, 41 + i) for i in range(6)} | {(46, 40), (3, 50), (50, 51), (51, 3), (60, 61), (61, 60), (70, 71), (71, 72), (72, 70), (72, 73), (73, 74), (74, 72)}
    df = spark.createDataFrame(sorted(edges), EDGE)
    assert rows(G.cycles(df, finish=0)) == rows(G.cycles(df)) == brute_cycles(edges)


def test_a_chain_of_a_hundred_thousand_links(spark):
    df = spark.range(100_000).selectExpr("id as src", "id + 1 as dst")
    assert G.cycles(df).count() == 0
    ring = G.cycles(df.unionByName(spark.createDataFrame([(100_000, 7)], EDGE)))
    assert ring.count() == 99_994 and ring.where("cycle <> 7").count() == 0


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    written, staged = [], G.staged
    monkeypatch.setattr(G, "staged", lambda df: written.append(0) or staged(df))
    ring = [(i, i + 1) for i in range(400)] + [(400, 0)]
    tail = [(1000 + i, 1001 + i) for i in range(300)] + [(1300, 5)]
    side = [(10, 2000)] + [(2000 + i, 2001 + i) for i in range(40)] + [(2040, 20)]  # a second way from 10 to 20
    found = rows(G.cycles(spark.createDataFrame(ring + tail + side, EDGE), finish=4))
    assert found == {(i, 0) for i in range(401)} | {(2000 + i, 0) for i in range(41)}
    assert len(written) < 40


def test_scans_beyond_the_local_limit_and_paths_with_line_ends(spark):
    edges = [(1, "a\nx", "b"), (1, "b", "a\nx"), (2, "b", "c"), (2, "c", "b"), (2, "c", "d"), (3, "p", "q")]
    df = spark.createDataFrame(edges, "scan_id long, src string, dst string")
    want = {(1, "a\nx", "a\nx"), (1, "a\nx", "b"), (2, "b", "b"), (2, "b", "c")}
    assert rows(D.scan_cycles(df)) == rows(D.scan_cycles(df, local=0)) == want
    modules = spark.createDataFrame([(s, p, p in ("b", "p")) for s in (1, 2, 3) for p in ("a\nx", "b", "c", "d", "p", "q")], "scan_id long, path string, is_entry boolean")
    want = {(s, p) for s in (1, 2, 3) for p in ("b", "p")} | {(1, "a\nx"), (2, "c"), (2, "d"), (3, "q")}
    assert rows(G.scan_reachable(modules, df)) == want
    assert rows(G.scan_reachable(modules, df, local=0)) | {(s, p) for s in (1, 2, 3) for p in ("b", "p")} == want


def test_reachable_by_rounds_and_in_one_task(spark):
    draw = random.Random(9)
    edges = spark.createDataFrame(sorted({(draw.randrange(60), draw.randrange(70)) for _ in range(70)}), EDGE)
    modules = spark.createDataFrame([(i, i in (3, 8, 59)) for i in range(60)], "node long, is_entry boolean")
    found = rows(G.reachable(modules, edges))
    assert found == rows(G.reachable(modules, edges, finish=0)) and len(found) > 10


def test_rounds_broadcast_nothing(spark, monkeypatch):
    plans, write = [], G.staged

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(G, "staged", recorded)
    edges = spark.createDataFrame([(i, (i * 7 + 3) % 60) for i in range(60)] + [(i, i - 1) for i in range(60) if i % 10], "src long, dst long")
    modules = spark.range(60).select(F.col("id").alias("node"), (F.col("id") % 30 == 0).alias("is_entry"))
    few, many = G.cycles(edges).collect(), G.cycles(edges, finish=3).collect()
    assert sorted(few) == sorted(many)
    assert sorted(G.reachable(modules, edges, finish=3).select("node").collect()) == sorted(G.reachable(modules, edges).select("node").collect())
    assert len(plans) > 10 and not [x for x in plans if "Broadcast" in x]
