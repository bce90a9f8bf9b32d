"""Blocks beyond the listed ones, long files and long lines count in what is measured of a scan, as in the SQL."""

from __future__ import annotations

import duckdb

from orewell.operators import imports as I
from orewell.operators import structure as S
from orewell.plans import audit
from orewell.plans.audit import LISTED, copied_blocks, duplicate_blocks
from orewell.plans.registry import ORACLE_SQL, VIEWS, Tables

SF = "/root/testdata/sf0.001"


def word(n: int) -> str:
    """Letters only, as numbers are all the same to a block."""
    return "".join("abcdefghij"[int(d)] for d in f"{n:05d}")


def block(n: int) -> str:
    return "".join(f"  const {word(n)}{line} = other;\n" for line in "abcdef")


def by_both(spark, query, code: list[tuple]) -> tuple[list[dict], list[dict]]:
    """Rows of a query over written code (scan_id, path, content), and those of its SQL."""
    t = Tables(spark, SF)
    t.v_code = spark.createDataFrame([(s, i, p, c) for i, (s, p, c) in enumerate(code)], "scan_id long, doc_id long, path string, content string")
    got = [r.asDict() for r in query(t).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE written (scan_id BIGINT, doc_id BIGINT, path VARCHAR, content VARCHAR)")
    con.executemany("INSERT INTO written VALUES (?, ?, ?, ?)", [(s, i, p, c) for i, (s, p, c) in enumerate(code)])
    found = con.execute(ORACLE_SQL[query.__name__].replace(VIEWS["v_code"], "SELECT * FROM written"))
    names = [c[0] for c in found.description]
    order = lambda rows: sorted(rows, key=lambda r: [str(r[k]) for k in sorted(r)])
    return order(got), order([dict(zip(names, r, strict=True)) for r in found.fetchall()])


def wrapped(name: str, body: str) -> str:
    return f"export async function {name}(a) {{\n{body}}}\n"


def test_the_share_of_repeated_lines_is_that_of_all_blocks(spark):
    many, long = "".join(block(n) for n in range(LISTED + 20)), "".join(block(n) for n in range(1100))
    code = [(1, "src/a.ts", wrapped("one", "x;\n") + many), (1, "src/b.ts", wrapped("two", "x;\n") + many), (2, "src/a.ts", wrapped("one", "x;\n") + long), (2, "src/b.ts", wrapped("two", "x;\n") + long)]
    got, want = by_both(spark, audit.agg_metrics, code)
    assert got == want
    assert {r["scan_id"]: r["duplication"] for r in got} == {1: round(360 / (2 * 363), 6), 2: round(6600 / (2 * 6603), 6)}


def test_lists_of_blocks_end_where_their_sql_ends(spark):
    f = spark.createDataFrame([(1, p, "".join(block(n) for n in range(LISTED + 20))) for p in ("a.ts", "b.ts")], "scan_id long, path string, content string")
    assert copied_blocks(f).count() == duplicate_blocks(f).count() == LISTED + 20
    assert sorted(r.place for r in duplicate_blocks(f, top=LISTED).collect()) == list(range(1, LISTED + 1))


def test_imports_and_exports_of_long_files_and_lines_count(spark):
    late = "x;\n" * 20_500 + "import { used } from './b';\nimport { " + ", ".join(f"other{i}" for i in range(60)) + ", far } from './b';\n"
    code = [(1, "src/a.ts", late + "export const last = 1;\n"), (1, "src/b.ts", "export const used = 1;\nexport const far = 2;\nexport const idle = 3;\n")]
    f = spark.createDataFrame([(*r, "TypeScript") for r in code], "scan_id long, path string, content string, language string")
    refs, found = I.imports(f), I.exports(f)
    assert sorted((r.line_no, len(r.symbols)) for r in refs.collect()) == [(20_501, 1), (20_502, 61)]
    for rows in (refs, found):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(content") == 1
    got, _ = by_both(spark, audit.agg_metrics, code)
    assert [r["dead_code_count"] for r in got] == [2]


def test_functions_of_any_length_in_files_of_any_length(spark):
    long = wrapped("tall", "  step(a);\n" * 900 + "  if (a && b) { a = b; }\n" * 10)
    wide = "export async function wide(" + ", ".join(f"argument{i}" for i in range(60)) + ") {\n  x;\n}\n"
    nested = "export async function nested({ " + ", ".join(f"part{i}" for i in range(80)) + " }, other) {\n  x;\n}\n"
    late = "\n" * 8_500
    rows = [("a.ts", long + wide, "TypeScript"), ("b.ts", late + wrapped("last", "  if (a) { b(); }\n") + nested, "TypeScript"), ("c.py", late + "def last(a):\n    if a:\n        b()\n", "Python")]
    got = {(r.path, r.name): r for r in S.function_spans(spark.createDataFrame([(1, *r) for r in rows], "scan_id long, path string, content string, language string")).collect()}
    assert set(got) == {("a.ts", "tall"), ("a.ts", "wide"), ("b.ts", "last"), ("b.ts", "nested"), ("c.py", "last")}
    tall = got["a.ts", "tall"]
    assert (tall.start_line, tall.end_line, tall.complexity, tall.max_nesting) == (1, 912, 21, 2)
    assert (got["a.ts", "wide"].start_line, got["a.ts", "wide"].parameters, got["b.ts", "nested"].parameters) == (913, 60, 2)
    assert (got["b.ts", "last"].start_line, got["c.py", "last"].start_line, got["c.py", "last"].complexity) == (8_501, 8_501, 2)


def test_a_block_ends_where_a_plain_walk_ends():
    lines = (["go(a) {", "  if (a) { b(); }", "} else {"] * 300 + ["}"] * 3 + ["const f = (x) => x", "one() { two(); }", "function q() {"]) * 3
    found, n = [], 0
    while n < len(lines):
        if (name := S._named(lines[n])) and name not in S.NO_NAMES:
            depth = started = end = deepest = 0
            for end in range(n, len(lines)):
                for c in S.counted(lines[end])[0]:
                    depth += 1 if c == "{" else -1
                    started, deepest = started or c == "{", max(deepest, depth)
                if started and depth <= 0:
                    break
            if end > n:
                found.append((name, n + 1, end + 1, deepest))
                n = end
        n += 1
    got = [(x[0], x[1], x[2], x[4]) for x in S.brace_spans(lines)]
    assert got == found and max(x[2] - x[1] for x in got) > 500


def test_findings_of_long_functions_and_files_and_of_all_blocks_equal_the_sql(spark):
    tall = wrapped("tall", "  // said\n" * 600 + "  if (a && b) { a = b; }\n" * 10)
    wide = "export async function wide(" + ", ".join(f"argument{i}" for i in range(60)) + ") {\n  x;\n}\n"
    late = "\n" * 8_500 + wrapped("last", "  if (a && b) { a = b; }\n" * 16)
    many = "".join(block(n) for n in range(LISTED + 10))
    code = [(1, "src/a.ts", tall + wide), (1, "src/b.ts", late), (2, "src/a.ts", many), (2, "src/b.ts", many), *((2, f"src/f{i}.ts", "x;\n" * 750) for i in range(12))]
    got, want = by_both(spark, audit.det_maint, code)
    assert got == want
    assert {(r["scan_id"], r["rule_id"], r["path"], r["line"]) for r in got if r["rule_id"] != "maint.duplication" or r["scan_id"] == 2} == {
        (1, "maint.high-complexity", "src/a.ts", 1), (1, "maint.high-complexity", "src/b.ts", 8_501), (1, "maint.wide-signature", "src/a.ts", 613), (2, "maint.duplication", "src/a.ts", None),
    }
