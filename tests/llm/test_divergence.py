"""Divergence of sources against its SQL and against counts by hand, on odd tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa

from orewell.llm import divergence

from .test_operators import docs, documents, empty  # noqa: F401


def sql_rows(df):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in df.select("doc_id", "text", "lang", "source").collect()], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])))
    found = con.execute(divergence.SQL)
    names = [c[0] for c in found.description]
    return sorted(tuple(dict(zip(names, r, strict=True))[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found.fetchall())


def mixed(spark, n=400):
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("Ka", "lo", "é", "Éx", "mi") for b in ("ra", "TO", "ßu", "1x", "-y", "日本")]
    rows = []
    for i in range(n):
        k = r.randrange(4, len(words))
        rows.append((i, " ".join(r.choices(words[:k], k=r.randrange(0, 60))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", None, "hot", "hot", "hot"])))
    rows += [(1, None, "fr", "a"), (1, None, "fr", "b"), (2, "1 2 3", "fr", "a"), (3, "x " * 20_000, "en", "long"), (3, "x " * 20_000, "en", "long"), (4, "alone", "xx", "one")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_divergence_equals_sql(spark, docs, empty):  # noqa: F811
    for df in (mixed(spark), docs):
        got = sorted(map(tuple, divergence.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()))
        assert got == sql_rows(df)
    assert any(r[2] == "term" for r in sql_rows(mixed(spark))) and any(r[4] == 0 for r in sql_rows(mixed(spark)) if r[0] == "fr")
    assert divergence.divergence(empty).collect() == []


def test_many_spills_give_the_same_rows(spark):
    df = mixed(spark).repartition(5)
    rows = lambda n: sorted(map(tuple, divergence.divergence(df, entries=n).collect()))
    assert rows(20) == rows(divergence.ENTRIES)


def test_the_heap_merges_chunks_of_many_runs():
    r, want, docs_of, chunks = random.Random(2), Counter(), Counter(), []
    for _ in range(30):
        block = divergence.Block()
        for _ in range(20):
            source, text = r.choice("abc"), " ".join(f"T{chr(97 + r.randrange(26))}{chr(97 + r.randrange(3))}" for _ in range(r.randrange(12)))
            block.add("l", source, text)
            found = re.findall("[a-z]+", text.lower())
            want.update((source, t) for t in found)
            docs_of.update(set(found))
        chunks += list(divergence.chunks(block.spill(3)))
    got, got_docs = Counter(), Counter()
    last = {}
    for bucket in range(3):
        for lang, term, n, counts in divergence.merged(iter(sorted((c for c in chunks if c.key[0] == bucket), key=lambda c: c.first))):
            assert lang == "l" and last.get(bucket, b"") < term
            last[bucket] = term
            got_docs[term.decode()] += n
            got.update({(s, term.decode()): c for s, c in counts.items()})
    assert got == want and got_docs == docs_of


def test_counts_beyond_64_bits_times_the_unit_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(9_000_000_000_000, 70_000_000_000_000, 123_456)], "c long, n long, v long")
    assert df.select(divergence.weight(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * 9_000_000_000_002 // (70_000_000_000_000 + 246_912)


def test_more_sources_than_a_task_holds(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(["pa", "qu", "ro", "su"], k=9)), "l", f"s{i % 40}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(divergence, "CELLS", 100)
    assert sorted(map(tuple, divergence.divergence(df).collect())) == sql_rows(df)
