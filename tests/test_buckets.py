"""Token buckets in slices: the function of a slice against the walk from every start, and whole logs with busy keys against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orewell.streaming.buckets import Tokens, token_bucket, value_at


def walk(held, gaps, full, token):
    for gap in gaps:
        held = min(full, held + gap)
        held -= token * (held >= token)
    return held


@pytest.mark.parametrize("seed", range(30))
def test_a_slice_is_the_function_that_its_events_are(seed):
    rng = random.Random(seed)
    token, capacity = rng.randint(1, 12), rng.randint(1, 6)
    full = token * capacity + rng.choice([0, rng.randrange(token)])
    f, gaps = Tokens(full, token), []
    for _ in range(60):
        gaps.append(rng.choice([0, 0, 1, rng.randrange(token + 1), rng.randrange(full + 2)]))
        f.event(gaps[-1])
        assert [value_at(f.pieces, x) for x in range(full + 1)] == [walk(x, gaps, full, token) for x in range(full + 1)]
        assert [p[0] for p in f.pieces] == sorted({p[0] for p in f.pieces})


def test_pieces_stay_few_however_many_events():
    rng = random.Random(7)
    f, most = Tokens(10 * 1_000_000, 1_000_000), 0
    for _ in range(20_000):
        f.event(rng.choice([0, 5, 400_000, 999_999, 1_000_003]))
        most = max(most, len(f.pieces))
    assert most <= 24


def brute(rows, full, token):
    out, state = {}, {}
    for k, us, n in sorted(rows):
        held, then = state.get(k, (full, us))
        held = min(full, held + us - then)
        ok = held >= token
        state[k] = (held - token * ok, us)
        out[n] = (ok, (held - token * ok) // token)
    return out


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_busy_keys_lie_in_many_slices(spark, slices):
    rng = random.Random(slices)
    rows, us = [], 0
    for n in range(6000):
        us += rng.choice([0, 0, 1, 3_000, 400_000, 1_500_000])
        rows.append(("busy" if rng.random() < 0.7 else f"k{rng.randrange(40)}", us, n))
    df = spark.createDataFrame(rows, "who string, us long, n long").withColumn("at", F.timestamp_micros("us"))
    got = {r.n: (r.allowed, r.remaining) for r in token_bucket(df.unionAll(df.where("n < 0")), "who", "at", "n", 4, 1.0, slices).collect()}
    assert got == brute(rows, 4_000_000, 1_000_000)


def test_one_key_of_many_events_is_walked_by_many_tasks(spark):
    df = spark.range(1_000_000, numPartitions=8).select(F.lit(1).alias("who"), F.col("id").alias("n"), F.timestamp_micros((F.col("id") * 7_919) % 1_000_003 * 250_000).alias("at"))
    out = token_bucket(df, "who", "at", "n", 3, 1.0, 16)
    got = out.select(F.count("*").alias("rows"), F.count_if("allowed").alias("allowed"), F.sum(F.col("n") * F.col("allowed").cast("int") + F.col("remaining")).alias("sum")).first()
    rows = [(1, (n * 7_919) % 1_000_003 * 250_000, n) for n in range(1_000_000)]
    want = brute(rows, 3_000_000, 1_000_000)
    assert (got.rows, got.allowed, got.sum) == (1_000_000, sum(a for a, _ in want.values()), sum(n * a + r for n, (a, r) in want.items()))


def test_odd_logs(spark):
    schema = "who string, at timestamp, n long, allowed int"
    assert token_bucket(spark.createDataFrame([], schema), "who", "at", "n", 2, 1.0).collect() == []
    df = spark.sql("SELECT * FROM VALUES (NULL, timestamp'2024-01-01', 1L, 0), ('a', NULL, 2L, 0), ('a', timestamp'2024-01-01', 3L, 0), ('a', timestamp'2024-01-01', 3L, 0), ('a', timestamp'2024-01-01', 3L, 0) AS t(who, at, n, allowed)")
    assert sorted((r.n, r.allowed, r.remaining) for r in token_bucket(df, "who", "at", "n", 2, 1.0).collect()) == [(3, False, 0), (3, True, 0), (3, True, 1)]
