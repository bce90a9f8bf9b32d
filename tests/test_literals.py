"""Required literals of patterns: what they promise, and that a search with them finds what one without them finds."""

from __future__ import annotations

import random
import re

import pytest

from orewell.operators import search as S
from orewell.operators.literals import required_literals
from orewell.operators.rules import SHIPPED

CASES = [
    (r"createHash\s*\(", {"createhash"}), (r"(?i)(?:foo|ba[rz])\d+", {"foo", "bar", "baz"}), (r"a?bcd+", {"bc"}), (r"(?:x|y)*", None), (r"\w+", None), (r"(?!never)\bonly\b", {"only"}),
    (r"ab|\d", None), (r"(?:long|longer)", {"long"}), (r"(\w+)\1", None), (r"(?:abc){2,3}", {"abc"}), (r"(?<name>unbalanced", None), (r"x{0}yz", {"yz"}),
]


@pytest.mark.parametrize("pattern,want", CASES)
def test_literals(pattern, want):
    got = required_literals(pattern)
    assert (set(got) if got else None) == want


@pytest.mark.parametrize("rule", SHIPPED, ids=lambda r: r.id)
def test_each_match_of_a_shipped_rule_holds_one(rule):
    held = required_literals(rule.pattern)
    assert held
    r, parts = random.Random(1), re.findall(r"[A-Za-z_.]{2,}|\W", rule.pattern.replace("\\", ""))
    pattern = re.compile(rule.pattern, re.M)
    for _ in range(300):
        for m in pattern.finditer("".join(r.choice(parts) for _ in range(12))):
            assert any(x in m[0].lower() for x in held)


def test_a_search_with_literals_equals_one_without(spark, monkeypatch):
    r = random.Random(2)
    bits = ["eval(x)", "EVAL (", "const a = 'it''s'", "fetch(url)", "timeout", "for (const x of y) {", "await db.find(x)", "yaml.load(", "catch (e) { }", "JSON.parse(s)", "try {", "// TODO: x", "é", "", "console.log(1)", "pickle.loads (b)", "redirect(req.query.a)"]
    rows = [(i % 3, f"src/api/f{i}.ts", "TypeScript", "\n".join(r.choice(bits) for _ in range(r.randrange(25))), False, False, False) for i in range(60)] + [(0, "src/api/null.ts", "TypeScript", None, False, False, False)]
    files = spark.createDataFrame(rows, "scan_id long, path string, language string, content string, is_vendor boolean, is_generated boolean, is_test boolean")
    rows = lambda: sorted(map(tuple, S.search(files, SHIPPED).collect()))
    with_literals = rows()
    monkeypatch.setattr(S, "required_literals", lambda pattern: None)
    assert with_literals == rows() and len({x[0] for x in with_literals}) >= 8


def test_patterns_with_quotes_and_backslashes(spark):
    files = spark.createDataFrame([(1, "a.py", "python", "it's a \\ line\n\"two\"\n'a'\n'b'", False, False, False)], "scan_id long, path string, language string, content string, is_vendor boolean, is_generated boolean, is_test boolean")
    got = S.search(files, [S.Rule("q", r"t's"), S.Rule("b", r"\\ l"), S.Rule("j", r"'a'\n'b'", join_lines=2), S.Rule("d", r'"two"', exclude=r"\\")])
    assert sorted((x.rule_id, x.line, x.column, x.match) for x in got.collect()) == [("b", 1, 8, "\\ l"), ("d", 2, 1, '"two"'), ("j", 3, 1, "'a'\n'b'"), ("q", 1, 2, "t's")]
