"""Registered queries of the code-audit operators: callables over the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views that bind the operators to the driver's tables; the same text in both engines but for what ``_spark`` changes.
VIEWS = {
    "v_files": """SELECT source AS scan_id, doc_id,
        CASE doc_id % 8 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'src/components/' WHEN 2 THEN 'src/db/' WHEN 3 THEN 'tests/' WHEN 4 THEN 'docs/' WHEN 5 THEN 'node_modules/x/' WHEN 6 THEN 'src/lib/' ELSE 'src/workers/' END
        || CASE doc_id % 11 WHEN 3 THEN 'd' || CAST(doc_id AS STRING) || '/Dockerfile' WHEN 4 THEN 'd' || CAST(doc_id AS STRING) || '/package' WHEN 5 THEN 'd' || CAST(doc_id AS STRING) || '/app.test' ELSE 'f' || CAST(doc_id AS STRING) END
        || CASE WHEN doc_id % 11 = 3 THEN '' ELSE CASE doc_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.md' ELSE '.json' END END AS path,
        text AS content, n_chars AS size FROM documents""",
    "v_code": """SELECT scan_id, doc_id, dir || 'f' || id || ext AS path, CASE WHEN ext = '.py' THEN py ELSE js END AS content FROM (
        SELECT *, 'from .f' || p || ' import run' || p || nl || 'import os' || nl || 'def run' || id || '(' || args || '):' || nl || '    # ' || note || nl || repeat('    if a and b:' || nl || '        a = b' || nl, CAST(doc_id % 13 AS INT))
            || repeat('    step(a)' || nl, CAST(doc_id * 7 % 131 AS INT)) || '    for x in a:' || nl || '        while x:' || nl || '            b()' || nl || 'class Thing' || id || ':' || nl || '    pass' || nl AS py,
            'import { run' || p || ' } from ''./f' || p || ''';' || nl || CASE WHEN doc_id % 3 = 0 THEN 'import { run' || k2 || ' } from ''@/db/f' || k2 || ''';' || nl ELSE '' END
            || CASE WHEN doc_id % 14 = 7 THEN 'import { run' || k5 || ' } from ''../lib/f' || k5 || ''';' || nl WHEN doc_id % 14 = 12 THEN 'import { run' || k0 || ' } from ''../app/f' || k0 || ''';' || nl ELSE '' END
            || CASE WHEN doc_id % 5 = 0 THEN 'import lodash from ''lodash'';' || nl ELSE '' END || nl || 'export async function run' || id || '(' || args || ') {' || nl || '  // ' || note || nl || repeat('  if (a && b) { a = b; }' || nl, CAST(doc_id % 13 AS INT))
            || repeat('  step(a);' || nl, CAST(doc_id * 7 % 131 AS INT)) || CASE WHEN doc_id % 4 = 0 THEN '  for (const x of a) { while (x) { if (x) { switch (x) { case 1: { b(); } } } } }' || nl ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN '  await step(a);' || nl ELSE '' END || '}' || nl
            || 'export const helper' || id || ' = (x) => {' || nl || '  return x ? 1 : 2;' || nl
            || CASE doc_id % 10 WHEN 1 THEN '  const h = createHash(''md5'');' || nl WHEN 2 THEN '  el.innerHTML = x;' || nl WHEN 3 THEN '  const agent = { rejectUnauthorized: false };' || nl WHEN 4 THEN '  eval(x);' || nl WHEN 5 THEN '  try { x(); } catch (e) { }' || nl
                WHEN 6 THEN '  el.innerHTML = y; // audit-disable-line sec.*, perf.n-plus-one' || nl WHEN 7 THEN '  // audit-disable-next-line sec.eval-usage' || nl || '  eval(x);' || nl WHEN 8 THEN '  // audit-disable-file ai.' || nl || '  console.log(x);' || nl ELSE '' END || '}' || nl || CASE WHEN doc_id % 21 = 4 THEN 'it.skip(''later'', run);' || nl ELSE '' END AS js
        FROM (SELECT CAST(floor(doc_id / 40.0) AS BIGINT) AS scan_id, doc_id, CAST(doc_id AS STRING) AS id, CAST(CASE WHEN doc_id < 7 THEN doc_id + 1000003 ELSE doc_id - 7 END AS STRING) AS p, CAST(doc_id - doc_id % 7 AS STRING) AS k0, CAST(doc_id - doc_id % 7 + 2 AS STRING) AS k2, CAST(doc_id - doc_id % 7 + 5 AS STRING) AS k5, chr(10) AS nl,
            CASE WHEN doc_id % 80 = 13 THEN '.github/workflows/' ELSE CASE doc_id % 7 WHEN 0 THEN 'src/app/' WHEN 1 THEN 'src/components/' WHEN 2 THEN 'src/db/' WHEN 3 THEN 'src/auth/' WHEN 4 THEN 'tests/' WHEN 5 THEN 'src/lib/' ELSE 'src/domain/' END END AS dir,
            CASE WHEN doc_id % 9 = 2 THEN '.py' WHEN doc_id % 7 = 4 THEN '.test.ts' ELSE '.ts' END AS ext, CASE WHEN doc_id % 8 = 0 THEN '' ELSE substr('a, b, c, d, e, f, g, h', 1, CAST(3 * (doc_id % 8) - 2 AS INT)) END AS args,
            regexp_replace(substr(coalesce(text, ''), 1, 40), '[^A-Za-z ]', '', 'g') AS note FROM documents) x) y""",
    "v_raw_findings": """SELECT event_id AS raw_id, user_id AS scan_id, event_id % 8 AS agent_ord,
        CASE event_id % 6 WHEN 0 THEN 'sec.sql-injection' WHEN 1 THEN 'sec.eval-usage' WHEN 2 THEN 'bug.empty-catch' WHEN 3 THEN 'perf.n-plus-one' WHEN 4 THEN 'ai.console-logging' ELSE 'arch.layer-violation' END AS rule_id,
        'finding ' || CAST(event_id % 6 AS STRING) || ' ' || event_type AS title,
        CASE event_id % 8 WHEN 0 THEN 'security' WHEN 1 THEN 'reliability' WHEN 2 THEN 'architecture' WHEN 3 THEN 'testing' WHEN 4 THEN 'dependencies' WHEN 5 THEN 'performance' WHEN 6 THEN 'ai-code' ELSE 'maintainability' END AS category,
        CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END AS severity,
        CAST(0.30 AS DOUBLE) + (event_id % 13) * CAST(0.05 AS DOUBLE) AS confidence,
        CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'likely' WHEN 2 THEN 'potential' ELSE 'dismissed' END AS validation,
        'src/m' || CAST(event_id % 20 AS STRING) || '.ts' AS path, CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INT) AS start_line,
        10 + (event_id % 6) * 10 AS effort_minutes,
        CASE event_id % 12 WHEN 0 THEN 'unvalidated-redirects' WHEN 1 THEN 'missing-null-checks' WHEN 2 THEN 'bundle-weight' ELSE 'cause-' || CAST(event_id % 12 AS STRING) END AS root_cause FROM events""",
    "v_scans": """SELECT o_orderkey AS scan_id, 'ws' || CAST(o_custkey % 5 AS STRING) AS workspace_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'Org/Repo-' ELSE 'org/repo-' END || CAST(o_custkey % 60 AS STRING) AS repo_slug,
        CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'analyzing' ELSE 'failed' END AS state,
        CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) % 101 END AS score,
        o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS finished_at FROM orders""",
    "v_scan_findings": """SELECT l_orderkey AS scan_id, l_linenumber AS finding_no,
        CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'critical' WHEN 'AO' THEN 'high' WHEN 'RF' THEN 'low' WHEN 'RO' THEN 'info' ELSE 'medium' END AS severity,
        CASE WHEN l_linenumber % 4 = 0 THEN 'dismissed' ELSE 'likely' END AS validation, 'p' || CAST(l_partkey % 50 AS STRING) AS issue FROM lineitem""",
    "v_modules": """SELECT p_partkey AS node,
        CASE p_partkey % 5 WHEN 0 THEN 'src/app/' WHEN 1 THEN 'src/components/' WHEN 2 THEN 'src/db/' WHEN 3 THEN 'src/domain/' ELSE 'src/http/' END || 'm' || CAST(p_partkey AS STRING) || '.ts' AS path,
        p_partkey % 97 = 0 AS is_entry, p_size * 40 AS loc, p_partkey % 19 AS n_exports FROM part""",
    "v_edges": """SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM part WHERE p_partkey % 3 <> 0
        UNION SELECT p_partkey AS src, p_partkey - 1 AS dst FROM part WHERE p_partkey % 10 <> 0""",
    "v_packages": """SELECT p_partkey % 20 AS scan_id, CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, lower(p_type) || CAST(p_partkey % 40 AS STRING) AS name,
        CASE p_partkey % 3 WHEN 0 THEN '^' WHEN 1 THEN '~' ELSE '' END || CAST(CAST(floor(p_size / 10.0) AS INT) AS STRING) || '.' || CAST(p_size % 10 AS STRING)
        || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.' || CAST(p_partkey % 7 AS STRING) END AS version, p_partkey % 4 = 0 AS dev, p_partkey AS ord FROM part""",
    "v_advisories": """SELECT s_suppkey AS advisory_id, CASE WHEN s_suppkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem,
        CASE s_suppkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'small' ELSE 'standard' END || CAST(s_suppkey % 40 AS STRING) AS name,
        CAST(s_suppkey % 3 AS STRING) || '.0.0' AS introduced_in, CAST(s_suppkey % 3 + 2 AS STRING) || '.5.1' AS fixed_in,
        CASE s_suppkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity FROM supplier""",
    "v_scan_events": """SELECT user_id AS scan_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts AS at, event_id,
        CASE event_type WHEN 'error' THEN 'agent_error' WHEN 'purchase' THEN 'agent_finding' WHEN 'signup' THEN 'agent_started' WHEN 'click' THEN 'agent_progress' ELSE 'log' END AS type,
        event_id % 8 AS agent_ord, value / 500.0 AS progress FROM events""",
}
TABLES = ("documents", "events", "orders", "lineitem", "part", "supplier", "customer", "nation", "region", "pages", "benchmark", "labels", "conversations", "embeddings")


class Tables:
    """The driver's tables and the views over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name].replace(", 'g')", ")").replace("{", "{{").replace("}", "}}")
            used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", text)]
            return self.spark.sql(re.sub(rf"\bFROM ({'|'.join(used)})\b", r"FROM {\1}", text), **{t: table(self.spark, self.sf_dir, t) for t in used})
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def query(sql: str | None = None):
    """Register a function of Tables under its name, with the SQL that gives the same rows; views are added to the SQL as it names them."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
            views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
            body = sql.strip()
            rest = re.match(r"WITH (RECURSIVE )?", body)
            head = f"WITH {rest[1] or ''}" if rest else "WITH "
            ORACLE_SQL[f.__name__] = f"{head}{views}{', ' + body[rest.end():] if rest else ' ' + body}" if used else body
        return f

    return add


def _load() -> None:
    from . import audit, files, findings, graphs, history, packages, reports, rule_cases, streams, structure, whole  # noqa: F401  each registers its queries


_load()
