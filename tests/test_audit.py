"""Rules, functions, imports, suppressions, signals and detectors on hand-written code."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orewell.functions import paths as P
from orewell.operators import detect as D
from orewell.operators import graph as G
from orewell.operators import imports as I
from orewell.operators import rules as R
from orewell.operators import structure as S
from orewell.operators import suppress as X
from orewell.operators import validate as V
from orewell.operators.search import search
from orewell.streaming import events as E

API, PY = "src/api/x.ts", "src/api/x.py"
#: For each rule: path, code that it reports, code that it doesn't.
CASES = {
    "sec.sql-injection": (API, "db.query(`SELECT * FROM t WHERE id = ${id}`)", "db.query('SELECT * FROM t WHERE id = $1', [id])"),
    "sec.command-injection": (API, "execSync(`rm ${name}`)", "execSync('ls')"),
    "sec.eval-usage": (API, "const x = eval(code);", "const x = safeEval(code);"),
    "sec.ssrf": (API, "await fetch(req.query.url);", "await fetch(BASE);"),
    "sec.path-traversal": (API, "fs.readFile(req.params.name)", "fs.readFile(basename(req.params.name))"),
    "sec.xss-dangerous-html": (API, "el.innerHTML = x;", "el.innerHTML = DOMPurify.sanitize(x);"),
    "sec.weak-hash": (API, "createHash('md5')", "createHash('sha256')"),
    "sec.insecure-random": (API, "const token = Math.random();", "const row = Math.random();"),
    "sec.jwt-unverified": (API, "jwt.decode(t)", "jwt.verify(t, key)"),
    "sec.tls-verification-disabled": (API, "{ rejectUnauthorized: false }", "{ rejectUnauthorized: true }"),
    "sec.cors-wildcard": (API, "cors({ origin: '*' })", "cors({ origin: SITE })"),
    "sec.insecure-cookie": (API, "{ httpOnly: false }", "{ httpOnly: true }"),
    "sec.open-redirect": (API, "res.redirect(req.query.next)", "res.redirect('/home')"),
    "sec.unsafe-deserialization": (PY, "pickle.loads(data)", "yaml.load(f, Loader=SafeLoader)"),
    "sec.debug-enabled": (PY, "DEBUG = True", "DEBUG = False"),
    "sec.mass-assignment": (API, "User.create(req.body)", "User.create(parsed)"),
    "sec.unvalidated-input": (API, "const n = req.body;", "const n = z.object({}).parse(req.body);"),
    "bug.empty-catch": (API, "try { a(); } catch (e) { }", "try { a(); } catch (e) { log(e); }"),
    "bug.unhandled-json-parse": (API, "const x = JSON.parse(s);", "try { x = JSON.parse(s); } catch (e) { log(e); }"),
    "bug.missing-timeout": (API, "const r = await fetch(BASE);", "const r = await fetch(BASE, { signal: AbortSignal.timeout(9) });"),
    "bug.floating-money": ("src/billing/x.ts", "const t = price * count;", "const t = cents.plus(count);"),
    "bug.unchecked-array-index": (API, "const n = rows[0].name;", "const n = rows[0]?.name;"),
    "bug.await-in-loop-no-error": (API, "for (const x of xs) { await go(x); }", "for (const x of xs) { go(x); }"),
    "bug.process-exit": (API, "process.exit(1);", "throw new Error('x');"),
    "bug.missing-await": (API, "  repo.save(x);", "  await repo.save(x);"),
    "bug.bare-except": (PY, "try:\n    a()\nexcept:\n    b()", "try:\n    a()\nexcept ValueError:\n    b()"),
    "perf.n-plus-one": (API, "for (const x of xs) {\n  const y = await db.user.findUnique({ id });\n}", "for (const x of xs) {\n  const y = known[x];\n}"),
    "perf.sync-io-in-handler": (API, "readFileSync(p)", "await readFile(p)"),
    "perf.unbounded-query": (API, "db.user.findMany()", "db.user.findMany({ take: 5 })"),
    "perf.nested-linear-search": (API, "xs.forEach((x) => {\n  ys.find((y) => y === x);\n});", "xs.forEach((x) => {\n  seen.has(x);\n});"),
    "perf.barrel-import": (API, "import * as d from 'date-fns'", "import { add } from 'date-fns'"),
    "perf.missing-react-memo-key": ("src/ui/x.tsx", "<Row key={index} />", "<Row key={row.id} />"),
    "ai.placeholder-implementation": (API, "throw new Error('not implemented')", "throw new Error('no user')"),
    "ai.todo-implement": (API, "// TODO: later", "// done"),
    "ai.redundant-wrapper": (API, "function get(id) { return load(id); }", "function get(id) { return load(id, 1); }"),
    "ai.inconsistent-error-shape": (API, "if (a) { throw new Error('x'); }\nreturn { error: 'x' };", "return { error: 'x' };"),
    "ai.console-logging": (API, "console.log(x)", "logger.info(x)"),
    "ai.magic-config": (API, "const u = 'http://localhost:3000/a';", "const u = env.BASE;"),
}


def files(spark, rows, scan=1):
    f = spark.createDataFrame([(scan, p, c) for p, c in rows], "scan_id long, path string, content string")
    f = f.withColumn("language", P.language(F.col("path")))
    return f.withColumns(P.flags(F.col("path"), F.col("language")))


def test_every_rule_has_a_case():
    assert set(CASES) == {r.id for r in R.SHIPPED}


def test_each_rule_reports_its_case_and_not_the_other(spark):
    rows = []
    for n, (rule, (path, hit, miss)) in enumerate(CASES.items()):
        rows += [(2 * n, path, hit), (2 * n + 1, path, miss)]
    f = spark.createDataFrame(rows, "scan_id long, path string, content string").withColumn("language", P.language(F.col("path")))
    f = f.withColumns(P.flags(F.col("path"), F.col("language")))
    found = {(r.scan_id, r.rule_id) for r in search(f, R.SHIPPED).select("scan_id", "rule_id").distinct().collect()}
    assert [r for n, r in enumerate(CASES) if (2 * n, r) not in found] == []
    assert [r for n, r in enumerate(CASES) if (2 * n + 1, r) in found] == []


def test_rules_skip_tests_vendored_and_generated_files_and_cap_a_file(spark):
    code = "eval(a); eval(b); eval(c)\neval(d); eval(e)\n"
    f = files(spark, [("src/a.ts", code), ("src/a.test.ts", code), ("node_modules/x/a.ts", code), ("src/a.min.js", code)])
    hits = search(f, R.SECURITY).collect()
    assert [(h.path, h.line, h.column) for h in sorted(hits, key=lambda h: (h.line, h.column))] == [("src/a.ts", 1, 1), ("src/a.ts", 1, 10), ("src/a.ts", 1, 19), ("src/a.ts", 2, 1)]


JS = """export async function one(a, { b, c }, d = [1, 2]) {
  if (a && b) { return "}"; } // }
  for (const x of c) {
    while (x) { if (x) { y(); } }
  }
}
const two = (x) => {
  return x ? 1 : 2;
};
function short() { return 1; }
class K {
  go(a) {
    try { a(); } catch (e) { }
  }
}
"""
PYTHON = """def outer(a, b):
    if a:
        return b

    def inner():
        for x in a:
            pass
async def last(): return 1
x = 1
"""


def test_functions_of_both_families(spark):
    got = {r.name: r for r in S.function_spans(files(spark, [("a.ts", JS), ("b.py", PYTHON), ("c.ts", "x\n" * 9000)])).collect()}
    assert set(got) == {"one", "two", "go", "outer", "inner"}
    assert (got["one"].start_line, got["one"].end_line, got["one"].complexity, got["one"].max_nesting, got["one"].parameters) == (1, 6, 6, 4, 3)
    assert (got["two"].start_line, got["two"].end_line, got["two"].complexity, got["two"].parameters) == (7, 9, 2, 1)
    assert (got["outer"].start_line, got["outer"].end_line, got["outer"].complexity, got["outer"].max_nesting, got["outer"].parameters) == (1, 7, 3, 3, 2)
    assert (got["inner"].start_line, got["inner"].end_line, got["inner"].complexity) == (5, 7, 2)


def test_imports_resolve_in_order(spark):
    code = "import { a as b, type C } from './m'\nimport x from '../lib'\nimport y from '@/util'\nimport 'react'\nconst { q } = require('./gone')\nexport * from './m.js'\nimport z from './e'\n"
    f = files(spark, [("src/app/x.ts", code), ("src/app/m.ts", ""), ("src/app/m.js", ""), ("src/lib/index.tsx", ""), ("src/util.ts", ""), ("app/util.ts", ""), ("p/a.py", "from .b import f, g\nimport os\n"), ("p/b.py", "def f(): pass\n"), ("src/app/e/index.js", ""), ("src/app/e.vue", "")])
    got = {(r.path, r.line_no): (r.specifier, r.kind, r.resolved, tuple(r.symbols)) for r in I.resolve(I.imports(f), f.select("scan_id", "path")).collect()}
    assert got == {
        ("src/app/x.ts", 1): ("./m", "relative", "src/app/m.ts", ("a", "C")),
        ("src/app/x.ts", 2): ("../lib", "relative", "src/lib/index.tsx", ("x",)),
        ("src/app/x.ts", 3): ("@/util", "alias", "src/util.ts", ("y",)),
        ("src/app/x.ts", 4): ("react", "external", None, ()),
        ("src/app/x.ts", 5): ("./gone", "relative", None, ("q",)),
        ("src/app/x.ts", 6): ("./m.js", "relative", "src/app/m.js", ()),
        ("src/app/x.ts", 7): ("./e", "relative", "src/app/e.vue", ("z",)),
        ("p/a.py", 1): (".b", "relative", "p/b.py", ("f", "g")),
        ("p/a.py", 2): ("os", "external", None, ()),
    }


def test_unused_exports_leave_out_files_of_many_exports_that_nothing_imports(spark):
    many = "".join(f"export const m{i} = 1\n" for i in range(4))
    f = files(spark, [("src/a.ts", "import { used } from './b'\n"), ("src/b.ts", "export const used = 1\nexport const idle = 2\n"), ("src/c.ts", many), ("src/d.ts", "export { p, q as r }\n"), ("src/page.ts", "export const page = 1\n")])
    entry = F.col("path").endswith("page.ts")
    got = {(r.path, r.symbol) for r in I.unused_exports(I.exports(f), I.resolve(I.imports(f), f.select("scan_id", "path")), entry).collect()}
    assert got == {("src/b.ts", "idle"), ("src/d.ts", "p"), ("src/d.ts", "q")}


def test_cycles_in_scans_and_by_rounds_are_the_same(spark):
    rows = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (1, "d", "e"), (1, "e", "d"), (1, "f", "a"), (2, "a", "b"), (2, "b", "b"), (3, "x", "y"), (3, "y", "x")]
    edges = spark.createDataFrame(rows, "scan_id long, src string, dst string")
    want = {(1, "a", "a"), (1, "a", "b"), (1, "a", "c"), (1, "d", "d"), (1, "d", "e"), (3, "x", "x"), (3, "x", "y")}
    assert {tuple(r) for r in D.scan_cycles(edges).collect()} == want
    assert {tuple(r) for r in D.scan_cycles(edges, local=0).select("scan_id", "cycle", "path").collect()} == want


def test_reachable_in_scans_and_by_rounds_are_the_same(spark):
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(12)] + [(1, "z", "y"), (2, "n0", "n1")], "scan_id long, src string, dst string")
    modules = spark.createDataFrame([(1, f"n{i}", i == 2) for i in range(13)] + [(1, "y", False), (1, "z", False), (2, "n0", False), (2, "n1", True)], "scan_id long, path string, is_entry boolean")
    want = {(1, f"n{i}") for i in range(2, 13)} | {(2, "n1")}
    assert {tuple(r) for r in G.scan_reachable(modules, edges).collect()} == want
    assert {tuple(r) for r in G.scan_reachable(modules, edges, local=0).collect()} == want


def test_comments_suppress_by_file_line_and_next_line(spark):
    code = "// audit-disable-next-line sec.eval-usage\na\nb // audit-disable-line\nc // audit-disable-line perf.*, bug.\nd\n"
    f = files(spark, [("a.ts", code), ("b.ts", "x\n// audit-disable-file sec.\n")])
    rows = [("a.ts", 2, "sec.eval-usage"), ("a.ts", 2, "sec.ssrf"), ("a.ts", 3, "any.rule"), ("a.ts", 4, "perf.x"), ("a.ts", 4, "bug.y"), ("a.ts", 4, "sec.z"), ("a.ts", 5, "sec.eval-usage"), ("b.ts", 1, "sec.q"), ("b.ts", 1, "ai.q")]
    found = spark.createDataFrame([(1, *r) for r in rows], "scan_id long, path string, line int, rule_id string")
    got = {(r.path, r.line, r.rule_id): r.suppressed for r in X.by_comment(found, X.directives(f)).collect()}
    assert [got[r] for r in rows] == [True, False, True, True, True, False, False, True, False]


def test_ignore_files_and_globs(spark):
    f = spark.createDataFrame([(1, "# c\n\n src/ \n!src/a.ts  sec.eval-usage perf.*\n/docs/**/x?.md\n")], "scan_id long, content string")
    assert [(r.glob, r.scopes, r.negated) for r in X.parse_ignore(f, ["scan_id"]).orderBy("no").collect()] == [("src/", [], False), ("src/a.ts", ["sec.eval-usage", "perf.*"], True), ("/docs/**/x?.md", [], False)]
    hit = lambda glob, path: spark.range(1).select(F.lit(path).rlike(P.glob_to_regex(glob))).first()[0]
    assert hit("src/", "src") and hit("src/", "a/src/b") and hit("*.py", "a/b.py") and hit("/docs/**/x?.md", "docs/a/b/x1.md") and not hit("/src", "a/src")


def test_signals_for_and_against(spark):
    rows = [("package.json", '{"knex": 1}'), (".gitignore", ".env\n"), ("src/a.ts", 'q(`${t} WHERE a = $1`)\nimport { z } from "zod"\n'), ("src/a.test.ts", "x\n"), ("src/far.ts", "y\n"), ("config/.env.example", "K=1\n"), ("src/s.ts", "import dompurify\nfunction isAllowedHost() {}\njwt.verify(a)\n")]
    f = files(spark, rows)
    cases = [("sec.sql-injection", "src/a.ts", 1), ("sec.ssrf", "src/a.ts", 1), ("sec.unvalidated-input", "src/a.ts", 1), ("sec.secret.key", "config/.env.example", 1), ("sec.xss-dangerous-html", "src/far.ts", 1), ("sec.jwt-unverified", "src/a.ts", 1), ("bug.empty-catch", "src/a.test.ts", 1), ("arch.x", "src/a.ts", None), ("dep.known-vulnerability", "package.json", None)]
    found = spark.createDataFrame([(1, r, p, n, 0.7) for r, p, n in cases], "scan_id long, rule_id string, path string, line int, confidence double")
    p = V.placed(found, f).withColumn("reachable", F.col("path") == "src/a.ts")
    dep = F.col("rule_id").startswith("dep.")
    got = {r.rule_id: r for r in V.summed(V.signals(p, F.lit(1), F.col("reachable"), F.lit(False), F.when(dep, F.lit(0)), dep)).collect()}
    labels = lambda rule: [s.label for s in got[rule].signals]
    assert labels("sec.sql-injection") == ["reachable from an entry point", "parameter placeholders present", "orm available"] and got["sec.sql-injection"].dismissed
    assert labels("sec.ssrf") == ["reachable from an entry point", "host-validation helper exists"]
    assert labels("sec.unvalidated-input") == ["reachable from an entry point", "validation library present"]
    assert labels("sec.secret.key") == ["not reachable from an entry point", "ignored but still tracked", "template file"]
    assert labels("sec.xss-dangerous-html") == ["not reachable from an entry point", "sanitiser available"]
    assert labels("sec.jwt-unverified") == ["reachable from an entry point", "verification exists elsewhere"]
    assert labels("bug.empty-catch") == ["not reachable from an entry point", "test-only code"]
    assert labels("arch.x") == ["reachable from an entry point", "no line-level evidence"]
    assert labels("dep.known-vulnerability") == ["no import site found", "development dependency"]


def test_oversized_files_and_large_modules(spark):
    top = spark.createDataFrame([(1, "a.ts", 1600, 1), (1, "b.ts", 900, 2), (1, "c.ts", 700, 3)], "scan_id long, path string, loc long, place int")
    assert [(r.path, r.severity) for r in D.oversized(top).orderBy("path").collect()] == [("a.ts", "medium"), ("b.ts", "low")]
    sizes = spark.createDataFrame([(1, "a.ts", 1600, 12), (1, "b.ts", 501, 20), (1, "c.ts", 500, 20), (1, "d.ts", 900, 11)], "scan_id long, path string, loc long, n_exports long")
    assert [(r.path, r.severity) for r in D.large_modules(sizes).orderBy("path").collect()] == [("a.ts", "high"), ("b.ts", "medium")]


@pytest.mark.parametrize("terminal", ["scan_complete", "scan_failed"])
def test_the_stream_ends_with_the_terminal_event_as_the_batch_does(spark, tmp_path, terminal):
    rows = [(s, n, terminal if (s, n) in ((1, 4), (1, 6)) else "log", 0, 0.5) for s in (1, 2) for n in range(1, 9)]
    log = spark.createDataFrame(rows, E.EVENT)
    log.repartition(3).write.json(str(tmp_path / "in"))
    raw = spark.readStream.schema(E.EVENT).option("maxFilesPerTrigger", 100).json(str(tmp_path / "in"))
    q = E.until_terminal_stream(raw).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.scan_id, r.seq) for r in spark.read.schema(E.EVENT).parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.scan_id, r.seq) for r in E.until_terminal(log).collect()} == {(1, n) for n in range(1, 5)} | {(2, n) for n in range(1, 9)}


def test_steps_of_one_query_read_written_code(spark, monkeypatch):
    from orewell.plans import audit, reports
    from orewell.plans.registry import Tables

    made = []
    monkeypatch.setattr(Tables, "v_code", property(lambda t: made.append(1) or t.__getattr__("v_code")), raising=False)
    for query in (audit.agg_metrics, audit.det_maint, reports.val_debate):
        made.clear()
        plan = query(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
        assert made == [1] and "documents" not in plan and "regexp_replace(substr" not in plan
