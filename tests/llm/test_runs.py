"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow.parquet as pq
import pytest

from orewell.llm import queries, runs

from .test_operators import SF, SCHEMA, docs, documents, empty  # noqa: F401

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """start, period, length of every run, by comparing every word with that of each period later."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # a smaller period of the same stretch came first
            i = j + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def report(key, words):
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
    drop = {i for s, q, n in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told, kept = "".join(f"{s},{n},{q}\n" for s, q, n in found), " ".join(w for i, w in enumerate(words) if i not in drop)
    return (key, len(found), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else [None] * 4), sha(told), sha(kept))


def looped(key, text):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def some_words(r):
    n, letters = r.randint(0, 150), r.choice((1, 2, 3, 9))
    words = [f"w{r.randrange(letters)}" for _ in range(n)]
    for _ in range(r.randint(0, 3) if n > 10 else 0):
        i, p = r.randrange(n), r.randint(1, n // 5)
        for x in range(i + p, min(n, i + r.randint(p, n))):
            words[x] = words[x - p]
    return words


@pytest.mark.parametrize("block", [40, runs.BLOCK])
def test_tiles_and_fragments_give_the_runs(block):
    r = random.Random(block)
    for _ in range(400):
        words, held = some_words(r), {}
        ids = runs.word_ids(words)
        for _, k, first, part, at in runs.blocks([ids], block):
            for q, s, e in runs.solve(k, part, at):
                held.setdefault(q, set()).update(range(first + s, first + e))
        got = []
        for q, at in held.items():
            for s in (x for x in at if x - 1 not in at):
                n = next(x for x in range(s, len(words) + 1) if x not in at) - s + q
                got += [(s, q, n)] * (n >= max(6, 4 * q))
        assert sorted(got) == brute(words)


def test_report_equals_brute_force_on_odd_rows(spark, docs, empty):  # noqa: F811
    r = random.Random(7)
    rows = [(i, " ".join(some_words(r))) for i in range(300)] + [(7, "a b " * 9), (7, "a b " * 9), (None, "x " * 6), (1, None), (2, ""), (3, " \n\t"), (1004, "x " * 70_000 + "y"), (5, "é z\n" * 8)]
    got = sorted(map(tuple, runs.run_report(documents(spark, rows)).collect()), key=str)
    assert got == sorted((report(i, WORDS.findall(t or "")) if i != 1004 else got_long(i) for i, t in rows), key=str)
    assert runs.run_report(empty).collect() == [] and runs.collapse_runs(empty).collect() == [] and runs.periodic_runs(empty).collect() == []
    assert runs.run_report(docs).count() == docs.count()


def got_long(key):
    """70,000 equal words and another one."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (key, 1, 0, 70_000, 1, 70_000_000, sha("0,70000,1\n"), sha("x y"))


def test_query_equals_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    small = {i for i, x in zip(t["doc_id"], t["text"], strict=True) if len(x or "") < 12_000}
    got = {r["doc_id"]: tuple(r) for r in queries.op11_tiled_runs(spark, SF).collect()}
    assert len(got) == len(t["doc_id"]) and sum(r[1] > 0 for r in got.values()) > 10
    for i, x in zip(t["doc_id"], t["text"], strict=True):
        if i in small:
            assert got[i] == report(i, looped(i, x))


def test_runs_and_collapsed_texts(spark):
    df = documents(spark, [(1, "a b c " * 4 + "d"), (2, "plain\ntext"), (3, None), (1, "a b c " * 4 + "d")])
    assert sorted((r["doc_id"], r["start"], r["length"], r["period"]) for r in runs.periodic_runs(df).collect()) == [(1, 0, 12, 3)] * 2
    assert sorted(map(tuple, runs.collapse_runs(df).collect()), key=str) == [(1, "a b c d"), (1, "a b c d"), (2, "plain\ntext"), (3, None)]
    clash = documents(spark, [(1, "q " * 8)]).withColumnRenamed("row", "rid").withColumnRenamed("node", "runs").withColumnRenamed("size", "octave")
    assert [tuple(r)[1:5] for r in runs.run_report(clash).collect()] == [(1, 0, 8, 1)]
