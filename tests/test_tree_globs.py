"""Source trees with links, ignore rules as a table, and functions of deeply nested files."""

from __future__ import annotations

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from orewell.functions.paths import glob_pattern, glob_to_regex
from orewell.operators import structure as S
from orewell.operators import suppress as X
from orewell.sources.tree import TreeSource


def test_a_tree_with_link_loops_reads_each_file_once(spark, tmp_path):
    for name, data in {"one/src/a.ts": b"let a;\n", "one/src/deep/er/b.ts": b"x", "one/c.bin": b"a\0b", "two/d.md": b"", "two/big.ts": b"y" * 100, "top.md": b"\xff!"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path, tmp_path / "one/src/deep/loop")
    os.symlink(tmp_path / "two", tmp_path / "linked")
    os.symlink(tmp_path / "two/d.md", tmp_path / "one/link.md")
    os.symlink(tmp_path / "nowhere", tmp_path / "one/broken")
    os.mkfifo(tmp_path / "one/pipe")
    spark.dataSource.register(TreeSource)
    for levels in (0, 1, 2, 9):
        got = spark.read.format("source_tree").option("maxBytes", 50).option("levels", levels).load(str(tmp_path)).collect()
        assert sorted((r.scan_id, r.path, r.size, r.content) for r in got if r.content is not None) == [("one", "src/a.ts", 7, "let a;\n"), ("one", "src/deep/er/b.ts", 1, "x"), ("top.md", "", 2, "�!"), ("two", "d.md", 0, "")]
        assert [(r.scan_id, r.path) for r in got if r.content is None] == [("one", "c.bin")]


GLOBS = ["*.py", "src/db/", "/src/db/f1*", "**/f2.ts", "/tests/**/f*.ts", "f?.ts", "src/**", "*", "**", "a**/b", "**/db/**", "src/*/f3.ts", "/", "***/f1.py", "src", "/f1.ts", "file*", "file1.*", "+x (1).ts", "src/**/file?.ts", "db/f1.ts", "*.test.ts", "//src//", "é*.ts"]


def paths() -> list[str]:
    folders = ["", "src/", "src/db/", "tests/", "tests/a/b/", "db/", "ab/", "a/x/b/", "src/src/db/deep/"]
    names = ["f1.ts", "f2.ts", "f3.ts", "f1.py", "file1.ts", "file12.ts", "b", "src", "x.test.ts", "+x (1).ts", "é1.ts", "f.py/inner.go"]
    return [f + n for f in folders for n in names]


def test_glob_columns_equal_the_function(spark):
    rows = spark.createDataFrame([(g, p) for g in GLOBS for p in paths()], "glob string, path string")
    got = rows.select("glob", "path", F.rlike("path", glob_pattern(F.col("glob"))).alias("hit"), F.array_contains(X.path_keys(F.col("path")), X.glob_key(F.col("glob"))).alias("met"), X.glob_key(F.col("glob")).alias("key")).collect()
    for r in got:
        assert r.hit == bool(re.search(glob_to_regex(r.glob), r.path)), r
        assert r.met or not r.hit, r  # no match is lost by the keys
    fixed = [r for r in got if r.key != "any:"]  # a glob without a fixed part meets every path of its scan
    assert {r.glob for r in got} - {r.glob for r in fixed} == {"*", "**", "a**/b", "***/f1.py"}
    assert sum(r.met for r in fixed) < len(fixed) / 3


def test_ignore_rules_as_a_table_equal_a_walk_over_all_rules(spark):
    r = random.Random(3)
    rules = [(scan, n, r.choice(GLOBS), r.choice([[], ["sec."], ["bug.*", "sec.eval"]]), r.random() < 0.4) for scan in (1, 2) for n in range(12)] + [(None, 0, "**", [], False)]
    findings = [(scan, p, rule) for scan in (1, 2, 3, None) for p in paths() for rule in ("sec.eval", "bug.catch", "ai.todo")] + [(1, None, "sec.eval")]
    got = X.by_globs(spark.createDataFrame(findings, "scan_id long, path string, rule_id string"), spark.createDataFrame(rules, "scan_id long, no int, glob string, scopes array<string>, negated boolean")).collect()
    assert len(got) == len(findings)

    def expected(scan, path, rule):
        out = False
        for s, _, glob, scopes, negated in rules:
            fits = not scopes or any(rule == x or x[-1] == "." and rule.startswith(x) or x[-1] == "*" and rule.startswith(x[:-1]) for x in scopes)
            if scan is not None and path is not None and s == scan and fits and re.search(glob_to_regex(glob), path):
                out = not negated
        return out

    assert [x for x in got if x.suppressed != expected(x.scan_id, x.path, x.rule_id)] == []
    assert 0 < sum(x.suppressed for x in got) < len(got)


def test_a_hundred_thousand_rules_meet_few_paths(spark):
    rules = spark.range(100_000).select(F.lit(1).cast("long").alias("scan_id"), F.col("id").cast("int").alias("no"), F.concat(F.lit("/src/f"), F.col("id").cast("string"), F.lit(".ts")).alias("glob"), F.array().cast("array<string>").alias("scopes"), (F.col("id") % 2 == 0).alias("negated"))
    findings = spark.range(20_000).select(F.lit(1).cast("long").alias("scan_id"), F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".ts")).alias("path"), F.lit("sec.eval").alias("rule_id"))
    assert X.by_globs(findings, rules).where("suppressed").count() == 10_000


def test_paths_meet_few_rules_however_many_names_begin_alike(spark):
    n = 3_000
    rows = spark.range(n).select(F.concat(F.lit("src/workers/f"), (F.col("id") + 1_000_000).cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("f"), (F.col("id") + 1_000_000).cast("string"), F.lit(".*")).alias("a"), F.concat(F.lit("**/workers/f"), F.substring((F.col("id") + 1_000_000).cast("string"), 1, 6), F.lit("*")).alias("b"))
    globs = rows.select(F.explode(F.array("a", "b")).alias("glob")).distinct().select(X.glob_key(F.col("glob")).alias("key"))
    assert rows.select(F.explode(X.path_keys(F.col("path"))).alias("key")).join(globs, "key").count() <= 4 * n
    # of rules with one glob and the same scopes the last decides, and the order among others stays
    rules = [("**/f1*", "", False), ("**/f1*", "sec.", True), ("**/f1*", "", True), ("**/f1*", "sec.", False), ("**/f1?.ts", "", True)]
    table = spark.createDataFrame([(1, i, g, [s] if s else [], x) for i, (g, s, x) in enumerate(rules)], "scan_id long, no int, glob string, scopes array<string>, negated boolean")
    found = spark.createDataFrame([(1, f"a/{p}", r) for p in ("f1.ts", "f12.ts", "f123.ts") for r in ("sec.eval", "bug.catch")], "scan_id long, path string, rule_id string")
    assert {(r.path, r.rule_id): r.suppressed for r in X.by_globs(found, table).collect()} == {(f"a/{p}", r): r == "sec.eval" and p != "f12.ts" for p in ("f1.ts", "f12.ts", "f123.ts") for r in ("sec.eval", "bug.catch")}


JS = """function outer(a) { // {
  if (a) { return '}'; }
  const inner = () => {
    return a ? 1 : 2;
  };
}
const one = () => { return 1; };
const open = async (x) => {
  while (x) {
"""


def test_functions_end_where_their_braces_do():
    assert [f[:5] for f in S.brace_spans(JS.split("\n"))] == [("outer", 1, 6, 3, 2), ("open", 8, 10, 2, 2)]
    assert [f[:3] for f in S.brace_spans(["function a()", "{", "}", "function b() {", *["x"] * 600, "}"])] == [("a", 1, 3), ("b", 4, 503)]
    assert list(S.brace_spans(["function a() {}", "", "}"])) == [] and list(S.brace_spans([])) == []


PYTHON = """class A:
    def f(self):
        if self:
            def g():
                return 1 if self else 2

        return g

    async def h(self): return 1
def k():
    pass
"""


def test_functions_end_where_their_indentation_does():
    assert [f[:5] for f in S.python_spans(PYTHON.split("\n"))] == [("f", 2, 8, 3, 3), ("g", 4, 6, 2, 1), ("k", 10, 12, 1, 1)]


@pytest.mark.parametrize("n", [7_000])
def test_deep_nests_take_one_pass(n):
    lines = [" " * i + f"def f{i}():" for i in range(n)] + [" " * n + "pass"]
    began = time.time()
    found = S.python_spans(lines)
    assert len(found) == n and all(f[2] == n + 1 for f in found) and time.time() - began < 20
