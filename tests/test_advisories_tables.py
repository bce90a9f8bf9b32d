"""Advisories by blocks of versions against brute force; detectors as table functions; weaknesses in searches and SARIF."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from orewell.functions.versions import BITS, ranges_of, version_number
from orewell.operators import findings as O
from orewell.operators import packages as K
from orewell.operators import table_functions as T
from orewell.operators.reports import sarif


def test_blocks_part_a_range(spark):
    rng = random.Random(3)
    top = 2 ** sum(BITS) - 1
    pairs = [(0, 0), (0, top), (top, top), (5, 4)] + [(a, a + rng.randrange(300)) for a in (rng.randrange(500) for _ in range(60))]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", ranges_of("a", "b").alias("r")).collect()
    for r in got:
        spans = sorted((x["block"] << x["level"], ((x["block"] + 1) << x["level"]) - 1) for x in r.r)
        if r.a > r.b:
            assert spans == []
        else:
            assert spans[0][0] == r.a and spans[-1][1] == r.b
            assert all(q[0] == p[1] + 1 for p, q in zip(spans, spans[1:], strict=False))
            assert len(spans) <= 2 * sum(BITS)


def test_numbers_never_fall_as_versions_rise(spark):
    parts = [0, 1, 5, 262142, 262143, 262144, 524286, 524287, 524288, 33554430, 33554431, 33554432, 2**31 - 1]
    rng = random.Random(1)
    versions = sorted({tuple(rng.choice(parts) for _ in range(3)) for _ in range(800)})
    df = spark.createDataFrame([(v,) for v in versions], "v struct<major:int,minor:int,patch:int>").select("v", version_number(F.col("v")).alias("n"))
    numbers = [r.n for r in df.sort("v").collect()]
    assert numbers == sorted(numbers) and min(numbers) >= 0 and max(numbers) < 2 ** sum(BITS)


def test_advisories_equal_brute_force(spark):
    rng = random.Random(5)
    one = lambda: f"{rng.choice([0, 1, 2, 20240101, 99999999999])}.{rng.randrange(4)}" + (f".{rng.choice([0, 1, 7, 600000])}" if rng.random() < 0.7 else "")
    packs = [(n % 5, "npm", f"p{n % 3}", rng.choice(["^", "", "~"]) + one(), n) for n in range(200)] + [(1, "npm", "p0", None, 900), (1, None, "p0", "1.0.0", 901), (1, "npm", "p0", "latest", 902)]
    advs = [("npm", f"p{n % 3}", n, "high", one(), one()) for n in range(150)] + [("npm", "p0", 700, "low", None, "2.0.0"), ("npm", "p0", 701, "low", "0.0.0", "2.0.0"), ("npm", "p0", 701, "low", "0.0.0", "2.0.0")]
    p = spark.createDataFrame(packs, "scan_id long, ecosystem string, name string, version string, ord long")
    a = spark.createDataFrame(advs, "ecosystem string, name string, advisory_id long, severity string, introduced_in string, fixed_in string")
    got = sorted((r.ord, r.advisory_id) for r in K.with_advisories(p, a).collect())

    def number(v):
        parts = (v or "").lstrip("^~").split(".")
        return tuple(min(int(x), 2**31 - 1) for x in (parts + ["0"])[:3]) if len(parts) > 1 else None

    want = sorted((o, i) for _, e, n, v, o in packs for e2, n2, i, _, lo, hi in advs if e == e2 and n == n2 and None not in (number(v), number(lo), number(hi)) and number(lo) <= number(v) < number(hi))
    assert got == want and len(want) > 100


def test_a_package_with_very_many_advisories(spark):
    a = spark.range(100_000).select(F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"), F.col("id").alias("advisory_id"), F.lit("low").alias("severity"), F.format_string("%d.%d.0", (F.col("id") / 1000).cast("int"), F.col("id") % 1000).alias("introduced_in"), F.format_string("%d.%d.9", (F.col("id") / 1000).cast("int"), F.col("id") % 1000).alias("fixed_in"))
    p = spark.range(20_000).select((F.col("id") % 7).alias("scan_id"), F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"), F.format_string("%d.%d.%d", F.col("id") % 120, F.col("id") % 900, F.col("id") % 12).alias("version"), F.col("id").alias("ord"))
    got = K.with_advisories(p, a).select(F.count("*").alias("n"), F.sum("ord").alias("o"), F.sum("advisory_id").alias("a")).first()
    want = [(n, n % 120 * 1000 + n % 900) for n in range(20_000) if n % 120 < 100 and n % 12 < 9]
    assert tuple(got) == (len(want), sum(n for n, _ in want), sum(i for _, i in want))


def test_a_detector_called_from_sql(spark):
    def todo(path, content):
        for no, line in enumerate(content.split("\n"), 1):
            if "TODO" in line:
                yield "user.todo", "low", 0.5, "incomplete-implementations", 5, no, 1

    spark.createDataFrame([(1, "a.ts", "x\nTODO one\nTODO"), (1, "b.ts", ""), (2, "c.ts", None), (2, None, "TODO")], "scan_id long, path string, content string").createOrReplaceTempView("some_files")
    rows = spark.sql(T.found_by(T.register_detector(spark, "find_todo", todo), "some_files")).collect()
    assert sorted((r.scan_id, r.path, r.line, r.rule_id) for r in rows) == [(1, "a.ts", 2, "user.todo"), (1, "a.ts", 3, "user.todo")]

    def broken(path, content):
        raise ValueError("no")

    with pytest.raises(PythonException):
        spark.sql(T.found_by(T.register_detector(spark, "find_nothing", broken), "some_files")).collect()


def test_weaknesses_reach_searches_and_sarif(spark):
    row = "raw_id long, scan_id long, rule_id string, category string, severity string, title string, path string, start_line int, other_places array<struct<path:string,start_line:int>>, id string, validation string"
    f = spark.createDataFrame([(1, 1, "sec.sql-injection", "security", "info", "t", "a.ts", 3, [], "x", "likely"), (2, 1, "bug.empty-catch", "reliability", "low", "u", "b.ts", None, [], "y", "likely")], row)
    assert [r.raw_id for r in f.where(O.FindingQuery("cwe-89").column(O.haystack())).collect()] == [1]
    run = json.loads(sarif(f).first().document)["runs"][0]
    assert run["tool"]["driver"]["rules"] == [
        {"id": "sec.sql-injection", "name": "secSqlInjection", "shortDescription": {"text": "t"}, "defaultConfiguration": {"level": "none"}, "properties": {"tags": ["security", "CWE-89", "owasp"], "security-severity": "1.0", "cwe": "CWE-89", "owasp": "A03:2021 Injection"}},
        {"id": "bug.empty-catch", "name": "bugEmptyCatch", "shortDescription": {"text": "u"}, "defaultConfiguration": {"level": "note"}, "properties": {"tags": ["reliability"], "security-severity": "3.0"}},
    ]
    assert [r["ruleIndex"] for r in run["results"]] == [0, 1]
