"""What the steps of an audit do once for each file, and that cheaper looks at a text see the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from orewell.functions import code as C
from orewell.operators import imports as I
from orewell.operators import literals
from orewell.operators.search import Rule, search
from orewell.operators.structure import parameters
from orewell.plans.audit import duplicate_blocks
from orewell.plans.files import CREDENTIALS

TEXT = "x = 1\n\n  // said\n\t# said\n\xa0\n a\r\n　*\n /x\n//"


def files(spark, content: str):
    return spark.createDataFrame([(1, "a.ts", content, "TypeScript", False)], "scan_id long, path string, content string, language string, is_test boolean")


def test_a_file_is_taken_apart_once(spark):
    f = files(spark, TEXT)
    for rows in (duplicate_blocks(f), I.code_lines(f), I.code_lines(f, 3)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_long_files_name_nothing_and_make_no_blocks(spark):
    line = "export const value = other;\n"
    assert I.code_lines(files(spark, line * 19_998)).count() == 19_999 and I.code_lines(files(spark, line * 19_999)).count() == 0
    block = "\n".join(f"const value{i} = other;" for i in "abcdef") + "\n"
    assert duplicate_blocks(files(spark, block * 2)).count() == 1
    assert duplicate_blocks(files(spark, block * 2), max_lines=12).count() == 0


def test_lines_counted_in_the_text_are_the_significant_ones(spark):
    f = files(spark, TEXT)
    got = f.select(C.significant_lines(F.col("content")).alias("n"), F.size(F.filter(F.split("content", "\n"), C.significant)).alias("m")).first()
    assert got.n == got.m == 3


def test_every_window_with_a_literal_meets_a_joined_rule(spark):
    rule = Rule("r", r"open\s*\(\s*\w+\s*\)", join_lines=3)
    got = search(files(spark, "a\nopen\n(\nx)\nopen(y)\nb"), [rule], skip=())
    assert sorted((r.line, r.match) for r in got.collect()) == [(2, "open\n(\nx)"), (5, "open(y)")]


def test_parameters_inside_brackets_are_walked(spark):
    headers = ["f()", "f( , )", "f(a, b) (c)", "f(a, [b, c])", "f(a = (1, 2), c):", "f(a", "f", "f(\ta)"]
    got = [r.n for r in spark.createDataFrame([(h,) for h in headers], "h string").select(parameters(F.col("h")).alias("n")).collect()]
    assert got == [0, 0, 2, 2, 2, 1, 0, 1]


def test_texts_with_credentials_hold_their_literals(spark):
    held = ["sk_live_" + "a" * 16, "SG." + "a" * 16 + "." + "b" * 16, "db://u:p@h", "AKIA" + "A" * 16, "gho_" + "a" * 20, "-----BEGIN PRIVATE KEY-----", "xoxb-" + "1" * 10, 'k = "' + "a" * 20 + '"']
    patterns = [p for _, p in CREDENTIALS]
    rows = spark.createDataFrame([(x,) for x in [*held, "none"]], "t string")
    found = reduce(lambda a, b: a | b, [F.col("t").rlike(p) for p in patterns])
    assert [r.t for r in rows.where(found).collect()] == [r.t for r in rows.where(literals.holds_literal(F.col("t"), *patterns)).collect()] == held
