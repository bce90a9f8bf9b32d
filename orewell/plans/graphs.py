"""Queries over module graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import Tables, query

LAYERS = [("ui-to-data", "^src/components/", "^src/db/"), ("domain-to-http", "^src/domain/", "^src/http/"), ("data-to-app", "^src/db/", "^src/app/")]


@query("SELECT node, count(DISTINCT src) AS importers FROM v_modules LEFT JOIN v_edges ON dst = node AND src <> dst GROUP BY node")
def join_imported_by(t: Tables) -> DataFrame:
    return G.imported_by(t.v_modules, t.v_edges)


@query("SELECT src, dst FROM v_edges WHERE dst NOT IN (SELECT node FROM v_modules)")
def join_dangling(t: Tables) -> DataFrame:
    return G.dangling(t.v_modules, t.v_edges)


@query(f"""SELECT src, dst, r.rule FROM v_edges JOIN v_modules a ON src = a.node JOIN v_modules b ON dst = b.node
    JOIN (VALUES {', '.join(map(str, LAYERS))}) r(rule, x, y) ON regexp_matches(a.path, x) AND regexp_matches(b.path, y)""")
def join_layer_violation(t: Tables) -> DataFrame:
    return G.layer_violations(t.v_modules, t.v_edges, LAYERS)


@query("""WITH RECURSIVE w(node) AS (SELECT node FROM v_modules WHERE is_entry UNION SELECT dst FROM w JOIN v_edges ON src = w.node JOIN v_modules m ON m.node = dst) SELECT node FROM w""")
def grf_reachable(t: Tables) -> DataFrame:
    return G.reachable(t.v_modules, t.v_edges).select("node")


COMPONENTS = [("interface", "^src/(app|components)/"), ("data", "^src/db/"), ("domain", "^src/(domain|m1)")]
COMP = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN '{n}'" for n, p in COMPONENTS) + " ELSE 'other' END"


@query("SELECT node, count(DISTINCT a.src) AS n_in, count(DISTINCT b.dst) AS n_out FROM v_modules LEFT JOIN v_edges a ON a.dst = node AND a.src <> node LEFT JOIN v_edges b ON b.src = node AND b.dst <> node GROUP BY node")
def grf_degree(t: Tables) -> DataFrame:
    return G.degrees(t.v_modules, t.v_edges)


@query("SELECT node, loc, n_exports, CASE WHEN loc > 1000 THEN 'high' ELSE 'medium' END AS severity FROM v_modules WHERE loc > 500 AND n_exports >= 12 ORDER BY loc DESC, node LIMIT 4")
def grf_god_modules(t: Tables) -> DataFrame:
    return G.large_modules(t.v_modules)


@query(f"SELECT node, {COMP.format('path')} AS component FROM v_modules")
def grf_component(t: Tables) -> DataFrame:
    return t.v_modules.select("node", G.component(F.col("path"), COMPONENTS).alias("component"))


@query(f"""SELECT {COMP.format('a.path')} AS "from", {COMP.format('b.path')} AS "to", count(*) AS weight FROM v_edges JOIN v_modules a ON src = a.node JOIN v_modules b ON dst = b.node WHERE {COMP.format('a.path')} <> {COMP.format('b.path')} GROUP BY 1, 2""")
def grf_collapse(t: Tables) -> DataFrame:
    return G.collapse(t.v_modules, t.v_edges, COMPONENTS)


@query(f"""SELECT component, findings, CASE o WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS worst FROM (SELECT {COMP.format('path')} AS component, count(*) AS findings,
    min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) AS o FROM v_raw_findings WHERE validation <> 'dismissed' GROUP BY 1)""")
def grf_risk(t: Tables) -> DataFrame:
    return G.component_risk(t.v_raw_findings, COMPONENTS)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM v_edges WHERE src <> dst), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
    SELECT node, cycle FROM (SELECT x.a AS node, min(x.b) AS cycle, count(*) AS n FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) WHERE n > 1""")
def grf_cycles(t: Tables) -> DataFrame:
    return G.cycles(t.v_edges)
