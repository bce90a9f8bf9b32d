"""A whole audit in one call: written trees, and each step against the detectors taken alone."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from orewell.operators import detect as D
from orewell.operators import rules as R
from orewell.plans.registry import QUERIES, Tables
from orewell.plans.structure import _code
from orewell.plans.whole import AGENTS, audit

SF = "/root/testdata/sf0.001"
FILES = {
    "src/api/users.ts": "import { find } from '../db/users';\nexport async function list(req) {\n  return db.query(`SELECT * FROM t WHERE id = ${req.query.id}`);\n}\n",
    "src/api/hash.ts": "const h = createHash('md5'); // audit-disable-line sec.weak-hash\n",
    "src/legacy/old.ts": "el.innerHTML = x;\n",
    "src/lib/a.ts": "import { b } from './b';\nexport const a = 1;\n",
    "src/lib/b.ts": "import { a } from './a';\nexport const b = 1;\n",
    "src/lib/keys.ts": 'const k = "sk_live_abcdefghijklmnop1234";\n',
    "src/lib/gone.ts": "import { x } from './missing';\n",
    "src/auth/login.ts": "export const login = 1;\n",
    "tests/a.test.ts": "it.skip('later', run);\n",
    "package.json": json.dumps({"dependencies": {"lodash": "4.0.0", "express": "*"}, "devDependencies": {"jest": "1.0.0"}}),
    ".auditignore": "# old code\nsrc/legacy/**\n",
}


def trees(spark):
    rows = [(1, p, c) for p, c in FILES.items()] + [(2, "readme.md", "hello"), (2, "blob", None), (None, "x.ts", "eval(x);"), (3, None, "eval(x);")]
    files = spark.createDataFrame(rows, "scan_id long, path string, content string")
    advisories = spark.createDataFrame([(7, "npm", "lodash", "0.0.0", "4.17.21", "high")], "advisory_id long, ecosystem string, name string, introduced_in string, fixed_in string, severity string")
    return files, advisories


def test_a_tree_from_files_to_report(spark):
    files, advisories = trees(spark)
    own = {"mine": ("security", lambda f: D.finding(f.where("path = 'src/api/users.ts'"), "sec.sql-injection", "critical", 0.6, "unparameterised-queries", 10, F.col("path"), F.lit(4)))}
    a = audit(files, advisories, detectors=own | {"other": ("reliability", lambda f: D.finding(f.where("path = 'src/api/users.ts'"), "sec.sql-injection", "low", 0.6, "unparameterised-queries", 10, F.col("path"), F.lit(3)))})
    got = {(r.rule_id, r.path): r for r in a.findings.where("scan_id = 1").collect()}
    rules = {k[0] for k in got}
    assert {"sec.sql-injection", "sec.weak-hash", "sec.xss-dangerous-html", "sec.secret.stripe-live-key", "ai.unresolved-import", "arch.circular-dependency", "test.untested-critical-path", "test.skipped", "test.no-ci", "dep.known-vulnerability", "dep.unpinned-version", "dep.missing-lockfile"} <= rules
    assert got["sec.weak-hash", "src/api/hash.ts"].suppressed and got["sec.xss-dangerous-html", "src/legacy/old.ts"].suppressed
    assert {k for k, r in got.items() if r.suppressed} == {("sec.weak-hash", "src/api/hash.ts"), ("sec.xss-dangerous-html", "src/legacy/old.ts")}
    sql = got["sec.sql-injection", "src/api/users.ts"]
    assert sql.n_raw == 3 and sql.detected_by == [0, 1] and sql.severity == "critical"
    assert "independent corroboration" in [s.label for s in sql.signals]
    assert not any("independent corroboration" in [s.label for s in r.signals] for k, r in got.items() if len(r.detected_by) == 1)
    vulnerable = got["dep.known-vulnerability", "package.json"]
    assert vulnerable.validation == "likely" and [s.label for s in vulnerable.signals] == ["no import site found"]
    report = {r.scan_id: r for r in a.report().collect()}
    assert set(report) == {1, 2}
    assert report[1].suppressed == 2 and report[1].merged == len(got) and report[1].raw == a.raw.where("scan_id = 1").count()
    assert report[1].live == sum(r.validation != "dismissed" and not r.suppressed for r in got.values())
    assert report[2].raw == 0 and report[2].headline.startswith("No high-confidence")
    assert report[1].overall < report[2].overall
    phases = {r.theme: r.findings for r in a.phases().where("scan_id = 1").collect()}
    assert sum(phases.values()) == report[1].live and phases["dependencies"] == 3


def test_the_audit_finds_what_each_detector_finds(spark):
    t = Tables(spark, SF)
    a = audit(t.v_code)
    raw = {(r.scan_id, r.rule_id): r.n for r in a.raw.groupBy("scan_id", "rule_id").agg(F.count("*").alias("n")).collect()}
    names = ("det_security", "det_reliability", "det_patterns", "det_perf", "det_maint", "det_repeated", "det_unresolved", "det_unused_exports", "det_layers", "det_cycles", "det_tests_critical", "det_tests_skipped", "det_tests_ci")
    want = {}
    for name in names:
        for r in QUERIES[name](spark, SF).groupBy("scan_id", "rule_id").agg(F.count("*").alias("n")).collect():
            want[r.scan_id, r.rule_id] = want.get((r.scan_id, r.rule_id), 0) + r.n
    assert {k: n for k, n in raw.items() if not k[1].startswith("sec.secret") and k[1] != "arch.god-module"} == want
    assert a.raw.where(~F.col("category").isin(*AGENTS) | F.col("agent_ord").isNull()).count() == 0
    assert a.raw.count() == a.findings.agg(F.sum("n_raw")).first()[0]
    assert a.category_scores().count() == 8 * _code(t).select("scan_id").distinct().count()
    assert len({r.id for r in R.SHIPPED}) == len(R.SHIPPED)


def test_an_empty_table(spark):
    a = audit(spark.createDataFrame([], "scan_id long, path string, content string"))
    assert a.report().collect() == [] and a.findings.collect() == []


def test_the_module_can_be_imported_first():
    subprocess.run([sys.executable, "-c", "import orewell.plans.whole"], check=True, cwd=Path(__file__).parents[1], timeout=60)
