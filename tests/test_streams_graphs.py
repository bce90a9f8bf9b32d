"""Cycles, imports, the event fold as a stream, token buckets, source trees and manifest dispatch against brute force."""

from __future__ import annotations

import random

from orewell.operators import graph as G
from orewell.operators import packages as K
from orewell.plans.registry import Tables
from orewell.sources.files import read_tree
from orewell.streaming import events as S

SF = "/root/testdata/sf0.001"


def brute_cycles(edges):
    out, nodes = {}, {x for e in edges for x in e}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            new = {b for a, b in edges if a == x} - seen
            seen |= new
            todo += new
        out[n] = seen
    groups = {n: min(m for m in nodes if m in out[n] and n in out[m]) for n in nodes if n in out[n]}
    return {(n, c) for n, c in groups.items() if sum(v == c for v in groups.values()) > 1}


def test_cycles_equal_brute_force(spark):
    draw = random.Random(3)
    edges = {(draw.randrange(60), draw.randrange(60)) for _ in range(75)} | {(1, 2), (2, 1), (70, 71), (71, 72), (80, 80)}
    got = G.cycles(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert {tuple(r) for r in got.collect()} == brute_cycles(edges)
    assert G.cycles(spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0


def test_the_streamed_fold_equals_the_batch_fold(spark, tmp_path):
    e = Tables(spark, SF).v_scan_events.selectExpr("scan_id", "cast(seq as long) as seq", "type", "progress")
    cut = 4
    first, second = e.where(f"seq <= {cut}"), e.where(f"seq > {cut}").unionByName(e.where("seq = 2"))  # the repeated ones come late
    first.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    stream = lambda: spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = []
    for i, more in enumerate((None, second)):
        if more is not None:
            more.coalesce(1).write.parquet(str(tmp_path / "in/b"))
        q = S.fold_stream(stream()).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: found.append({r.scan_id: tuple(r) for r in df.collect()}))
        q.trigger(availableNow=True).start().awaitTermination(180)
    last = {}
    for x in found:
        last |= x
    assert last == {r.scan_id: tuple(r) for r in S.fold(e).collect()}
    assert len(found) >= 2


def test_token_bucket_equals_brute_force(spark):
    t = Tables(spark, SF)
    got = {r.event_id: (r.allowed, r.remaining) for r in S.token_bucket(t.events, "user_id", "ts", "event_id", 3, 1 / 3600).collect()}
    want, held = {}, {}
    for r in sorted(t.events.collect(), key=lambda r: (r.ts, r.event_id)):
        tokens, then = held.get(r.user_id, (3.0, r.ts))
        tokens = min(3.0, tokens + (r.ts - then).total_seconds() / 3600)
        ok = tokens >= 1
        held[r.user_id] = (tokens - ok, r.ts)
        want[r.event_id] = (ok, int(tokens - ok))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want


def test_trees_and_manifests(spark, tmp_path):
    for name, data in {"r1/package.json": b'{"dependencies": {"a": "^1.0.0"}, "devDependencies": {"b": "2"}}', "r1/x/go.mod": b"module m\nrequire q.io/z v1.2.0 // indirect\n", "r2/package.json": b"{broken", "r2/img.png": b"x", "r2/node_modules/a.js": b"x", "r2/blob": b"\x89P\x00\x01", "r2/requirements.txt": b"# none\nFlask==2.0\n-r more.txt\nrequests\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = read_tree(spark, str(tmp_path))
    assert {(r.scan_id, r.path, r.content is None) for r in files.collect()} == {("r1", "package.json", False), ("r1", "x/go.mod", False), ("r2", "package.json", False), ("r2", "blob", True), ("r2", "requirements.txt", False)}
    assert read_tree(spark, str(tmp_path), max_bytes=8).count() == 2
    got = {(r.scan_id, r.ecosystem, r.name, r.version, r.dev, r.direct) for r in K.manifests(files).collect()}
    assert got == {("r1", "npm", "a", "^1.0.0", False, True), ("r1", "npm", "b", "2", True, True), ("r1", "go", "q.io/z", "v1.2.0", False, False), ("r2", "pypi", "flask", "2.0", False, True), ("r2", "pypi", "requests", None, False, True)}
