"""Streams that hold state only as long as they need it, and sinks that write once over failures."""

from __future__ import annotations

import datetime
import random

import pytest

from orewell.streaming import events as E
from orewell.streaming import sinks

START = datetime.datetime(2026, 1, 1)


def log(scans, per_scan, end=True):
    r, rows = random.Random(len(list(scans))), []
    for s in scans:
        kinds = ["agent_started", *(r.choice(["agent_progress", "agent_finding", "agent_error", "log"]) for _ in range(per_scan))] + ["scan_complete"] * end
        rows += [(s, i + 1, k, i % 3, r.random() if k == "agent_progress" else None) for i, k in enumerate(kinds)]
    return rows


def arrive(spark, rows, folder, schema=E.EVENT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema=E.EVENT):
    return spark.readStream.schema(schema).parquet(str(folder))


def held(spark, marks):
    return spark.read.format("statestore").option("stateVarName", "held").load(str(marks)).count()


TIMED = E.EVENT + ", at timestamp"


def timed(rows, minutes=0):
    return [(*r, START + datetime.timedelta(minutes=minutes + r[1])) for r in rows]


def test_fold_equals_batch_and_drops_the_state_of_ended_scans(spark, tmp_path):
    first, second = log(range(6), 5), log(range(6, 9), 4, end=False)
    late = [first[2], (0, 99, "agent_error", 0, None)]  # a repeat, and one beyond the end
    parts = [timed(first), timed(late) + timed(second, 10), timed([(6, 1, "agent_started", 0, None), (7, 50, "agent_finding", 0, None)], 200)]
    out, sizes = str(tmp_path / "out"), []
    for rows in parts:
        arrive(spark, rows, tmp_path / "in", TIMED)
        query = sinks.start(E.fold_stream(stream(spark, tmp_path / "in", TIMED), at="at", lateness="1 hour", keep_ms=1000), out, str(tmp_path / "marks"), mode="update")
        assert query.awaitTermination(120)
        sizes.append(held(spark, tmp_path / "marks"))
    got = {tuple(r) for r in sinks.latest(spark, out, f"scan_id long, {E.STATE}", "scan_id").collect()}
    assert got == {tuple(r) for r in E.fold(E.until_terminal(E.replay(spark.createDataFrame([r for p in parts for r in p], TIMED), 0))).collect()} and len(got) == 9
    assert sizes == [6, 3, 3]  # once an event at minute 99 has passed, the six that ended are gone; the three that did not are held


def test_the_streamed_log_ends_at_the_terminal_event(spark, tmp_path):
    rows = log(range(4), 3) + [(1, 50, "log", 0, None), (2, 2, "log", 0, None)]
    arrive(spark, rows[::-1], tmp_path / "in")
    out = str(tmp_path / "out")
    assert sinks.start(E.until_terminal_stream(stream(spark, tmp_path / "in")), out, str(tmp_path / "marks")).awaitTermination(120)
    got = sorted((r.scan_id, r.seq) for r in sinks.read(spark, out, E.EVENT).collect())
    assert got == sorted((s, q) for s in range(4) for q in range(1, 6))


def test_repeats_inside_the_lateness_are_dropped(spark, tmp_path):
    rows = timed(log(range(3), 6))
    for part in (rows[:10], rows[5:], rows[::2]):
        arrive(spark, part, tmp_path / "in", TIMED)
        q = sinks.start(E.dedup_stream(stream(spark, tmp_path / "in", TIMED), lateness="2 hours"), str(tmp_path / "out"), str(tmp_path / "marks"))
        assert q.awaitTermination(120)
    got = sorted((r.scan_id, r.seq) for r in sinks.read(spark, str(tmp_path / "out"), TIMED).collect())
    want = sorted((r.scan_id, r.seq) for r in E.replay(spark.createDataFrame(rows + rows, TIMED), 0).collect())
    assert got == want


def test_two_logs_become_one(spark, tmp_path):
    rows = timed(log(range(3), 6))
    arrive(spark, rows[:15], tmp_path / "a", TIMED)
    arrive(spark, rows[9:], tmp_path / "b", TIMED)
    q = sinks.start(E.merge_logs_stream(stream(spark, tmp_path / "a", TIMED), stream(spark, tmp_path / "b", TIMED)), str(tmp_path / "out"), str(tmp_path / "marks"))
    assert q.awaitTermination(120)
    a, b = (spark.createDataFrame(x, TIMED) for x in (rows[:15], rows[9:]))
    key = lambda df: sorted((r.scan_id, r.seq, r.type) for r in df.collect())
    assert key(sinks.read(spark, str(tmp_path / "out"), TIMED)) == key(E.merge_logs(a, b))


def test_a_broken_and_restarted_stream_writes_each_event_once(spark, tmp_path, monkeypatch):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    rows = log(range(5), 8)
    go = lambda: sinks.start(stream(spark, tmp_path / "in"), out, marks, keys=("scan_id", "seq")).awaitTermination(120)
    arrive(spark, rows[:20] + rows[:3], tmp_path / "in")
    go()
    arrive(spark, rows[20:], tmp_path / "in")
    commit = sinks._commit
    for broken in (lambda *a: 1 / 0, lambda *a: (commit(*a), 1 / 0)):  # before and after the ledger knows of the batch
        monkeypatch.setattr(sinks, "_commit", broken)
        with pytest.raises(Exception, match="ZeroDivision|division"):
            go()
    monkeypatch.setattr(sinks, "_commit", commit)
    go()
    got = [(r.scan_id, r.seq) for r in sinks.read(spark, out, E.EVENT).collect()]
    assert len(got) == len(set(got)) == len(rows) and set(got) == {r[:2] for r in rows}
    assert sum(r["rows"] for r in sinks.committed(spark, out).collect()) == len(rows)
    assert sinks.read(spark, str(tmp_path / "none"), E.EVENT).count() == 0


def test_scans_are_replaced_in_few_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from orewell.operators import reports as O

    path, n = str(tmp_path / "scans"), 500
    rows = spark.range(2 * n).select((F.col("id") % n).alias("scan_id"), F.col("id").alias("raw_id"), F.lit("first").alias("text"))
    rows = rows.unionByName(rows.limit(1).select(F.lit(None).cast("long").alias("scan_id"), F.lit(-1).cast("long").alias("raw_id"), F.lit("first").alias("text")))
    O.replace_scans(rows, path)
    again = rows.where("scan_id % 5 = 0 and raw_id < 500").withColumn("text", F.lit("second"))
    for _ in range(2):
        O.replace_scans(again, path)
    want = sorted([(-1, None, "first")] + [(i, i % n, "second" if i % 5 == 0 else "first") for i in range(2 * n) if i % 5 or i < n])
    assert sorted((r.raw_id, r.scan_id, r.text) for r in O.read_scans(spark, path, rows).collect()) == want
    assert len(list((tmp_path / "scans").rglob("*.parquet"))) <= 3 * 8  # not a file for each scan
    O.compact_scans(spark, path, rows, str(tmp_path / "compact"))
    assert sorted((r.raw_id, r.scan_id, r.text) for r in O.read_scans(spark, str(tmp_path / "compact"), rows).collect()) == want
