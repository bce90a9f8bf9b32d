"""Queries over code: functions, imports, the module graph, suppressions in comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import imports as I
from ..operators import structure as S
from ..session import staged
from .files import ENTRIES, EXT, FLAGS, LANG, any_of
from .registry import Tables, query

CODE = "f AS (SELECT scan_id, path, content, language, " + ", ".join(f"{v} AS {k}" for k, v in FLAGS.items()) + f" FROM (SELECT *, {LANG} AS language FROM v_code))"
LINES = "l AS (SELECT scan_id, path, language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f)"
# Code of v_code closes each function with a brace or a class of its own, so SQL finds ends by the next such line.
_DECIDES = r"len(regexp_extract_all(regexp_replace(line, '(//|#).*$', ''), '\b(?:if|for|while|case|catch|switch)\b|&&|\|\|| \? '))"
SPANS = rf"""h AS (SELECT *, regexp_extract(line, '^(?:export async function|export const|def) (\w+)', 1) AS name,
        (SELECT min(e.line_no) FROM l e WHERE e.scan_id = l.scan_id AND e.path = l.path AND e.line_no > l.line_no AND (e.line = '}}' OR starts_with(e.line, 'class '))) AS stop FROM l WHERE regexp_matches(line, '^(?:export async function|export const|def) \w+')),
    s AS (SELECT h.scan_id, h.path, h.language, h.name, h.line AS header, h.line_no AS start_line, any_value(CASE WHEN h.language = 'Python' THEN stop - 1 ELSE stop END) AS end_line,
        CAST(1 + sum({_DECIDES.replace('line', 'b.line')}) AS INT) AS complexity,
        CAST(max(CASE WHEN h.language = 'Python' THEN length(b.line) - length(ltrim(b.line)) - 0 ELSE 0 END) // 4 AS INT) AS py_nesting,
        CAST(1 + max(CASE WHEN b.line_no = h.line_no OR contains(b.line, '//') AND NOT contains(b.line, '{{') THEN 0 WHEN contains(b.line, 'catch') THEN 1 ELSE length(b.line) - length(replace(b.line, '{{', '')) END) AS INT) AS js_nesting
        FROM h JOIN l b ON b.scan_id = h.scan_id AND b.path = h.path AND b.line_no BETWEEN h.line_no AND CASE WHEN h.language = 'Python' THEN stop - 1 ELSE stop END GROUP BY ALL),
    p AS (SELECT scan_id, path, language, name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, CAST(end_line - start_line + 1 AS INT) AS lines, complexity, CASE WHEN language = 'Python' THEN py_nesting ELSE js_nesting END AS max_nesting,
        CAST(CASE WHEN regexp_matches(header, '\(\s*\)') THEN 0 ELSE 1 + length(header) - length(replace(header, ',', '')) END AS INT) AS parameters FROM s)"""
FUNCTIONS = f"WITH {CODE}, {LINES}, {SPANS}"
COLUMNS = ("scan_id", "path", "name", "start_line", "end_line", "lines", "complexity", "max_nesting", "parameters")


def _shared(t: Tables) -> Tables:
    """``t`` with its code written once: for queries whose steps read it several times, as v_code makes each file anew for every step that reads it."""
    code, tasks = _code(t), 3 * t.spark.sparkContext.defaultParallelism
    # A small table of texts is few tasks, and files that are written stay whole tasks for every step after.
    t.written_code = staged(code.repartition(tasks, "scan_id", "path") if t.documents.rdd.getNumPartitions() < tasks else code)
    return t


def _code(t: Tables) -> DataFrame:
    if "written_code" in vars(t):
        return t.written_code
    f = t.v_code.withColumn("language", P.language(F.col("path")))
    return f.withColumns(P.flags(F.col("path"), F.col("language")))


@query(f"{FUNCTIONS} SELECT {', '.join(COLUMNS)} FROM p WHERE language <> 'Python'")
def fn_brace(t: Tables) -> DataFrame:
    return S.function_spans(_code(t).where("language <> 'Python'"))


@query(f"{FUNCTIONS} SELECT {', '.join(COLUMNS)} FROM p WHERE language = 'Python'")
def fn_python(t: Tables) -> DataFrame:
    return S.function_spans(_code(t).where("language = 'Python'"))


@query(rf"WITH {CODE}, {LINES} SELECT path, CAST(line_no AS INT) AS line_no, CAST(CASE WHEN regexp_matches(line, '\(\s*\)') OR NOT contains(line, '(') THEN 0 ELSE 1 + length(regexp_extract(line, '\(([^()]*)\)', 1)) - length(replace(regexp_extract(line, '\(([^()]*)\)', 1), ',', '')) END AS INT) AS parameters FROM l WHERE regexp_matches(line, '^(export|def) ')")
def fn_params(t: Tables) -> DataFrame:
    rows = I.code_lines(_code(t)).where(F.col("line").rlike("^(export|def) "))
    return rows.select("path", "line_no", S.parameters(F.col("line")).alias("parameters"))


@query(f"{FUNCTIONS} SELECT scan_id, count(*) AS functions, round(avg(complexity), 1) AS avg_complexity, max(complexity) AS max_complexity FROM p GROUP BY scan_id")
def agg_complexity(t: Tables) -> DataFrame:
    return S.complexity(S.function_spans(_code(t)))


_KINDS = (("complex", "complexity >= 15", "complexity", 5), ("long", "lines >= 120 AND complexity < 15", "lines", 3), ("wide", "parameters >= 6", "0", 2), ("deep", "max_nesting >= 5 AND complexity >= 18", "complexity", 3))
_NOTABLE = " UNION ALL ".join(f"SELECT * FROM (SELECT *, '{k}' AS kind, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY {by} DESC, path, start_line) AS INT) AS place FROM p WHERE {test}) WHERE place <= {top}" for k, test, by, top in _KINDS)


@query(f"{FUNCTIONS} SELECT {', '.join(COLUMNS)}, kind, place FROM ({_NOTABLE})")
def top_functions(t: Tables) -> DataFrame:
    return S.notable(S.function_spans(_code(t)))


# Imports and the module graph

_JS = r"""regexp_extract(line, '^import (?:.* from )?''([^'']+)''', 1)"""
_PY = r"""regexp_extract(line, '^(?:from ([\w.]+) import|import )', 1) || regexp_extract(line, '^import ([\w.]+)', 1)"""
REFS = rf"""i AS (SELECT *, CASE WHEN starts_with(specifier, '.') THEN 'relative' WHEN language <> 'Python' AND starts_with(specifier, '@/') THEN 'alias' ELSE 'external' END AS kind FROM (
    SELECT scan_id, path, language, line_no, CASE WHEN language = 'Python' THEN {_PY} ELSE {_JS} END AS specifier,
        CASE WHEN language = 'Python' THEN regexp_extract(line, 'import (run\S*)', 1) ELSE coalesce(nullif(regexp_extract(line, '\{{ (\S+) \}}', 1), ''), regexp_extract(line, '^import (\w+) from', 1)) END AS symbol
    FROM l WHERE CASE WHEN language = 'Python' THEN regexp_matches(line, '^(from|import) ') ELSE regexp_matches(line, '^import ') END))"""
# One '..' at most, and never beyond the root, in v_code.
NEAR = r"""CASE kind WHEN 'alias' THEN 'src/' || substr(specifier, 3) WHEN 'relative' THEN CASE WHEN starts_with(specifier, '../') THEN regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/?[^/]*$', '/') || substr(specifier, 4)
    ELSE regexp_replace(path, '[^/]*$', '') || regexp_replace(specifier, '^\./|^\.', '') END END"""
RESOLVED = f"""n AS (SELECT *, {NEAR} AS near FROM i), c AS (SELECT n.scan_id, n.path, n.line_no, arg_min(f.path, e.rank) AS resolved FROM n CROSS JOIN (VALUES ('', 0), ('.ts', 1), ('.py', 21)) e(ext, rank) JOIN f ON f.scan_id = n.scan_id AND f.path = n.near || e.ext AND (kind = 'relative' OR e.rank < 20) GROUP BY ALL),
    r AS (SELECT i.*, c.resolved FROM i LEFT JOIN c ON c.scan_id = i.scan_id AND c.path = i.path AND c.line_no = i.line_no)"""
GRAPH = f"WITH {CODE}, {LINES}, {REFS}, {RESOLVED}"


def _resolved(t: Tables) -> DataFrame:
    f = _code(t)
    return I.resolve(I.imports(f), f.select("scan_id", "path"))


@query(f"WITH {CODE}, {LINES}, {REFS} SELECT scan_id, path, CAST(line_no AS INT) AS line_no, specifier, kind, symbol FROM i")
def grf_imports(t: Tables) -> DataFrame:
    return I.imports(_code(t)).select("scan_id", "path", "line_no", "specifier", "kind", F.array_join("symbols", ",").alias("symbol"))


@query(rf"WITH {CODE}, {LINES} SELECT scan_id, path, regexp_extract(line, '^(?:export (?:async )?(?:function|const)|def|class) (\w+)', 1) AS symbol, CAST(line_no AS INT) AS line_no FROM l WHERE CASE WHEN language = 'Python' THEN regexp_matches(line, '^(def|class) ') ELSE regexp_matches(line, '^export ') END")
def grf_exports(t: Tables) -> DataFrame:
    return I.exports(_code(t)).select("scan_id", "path", "symbol", "line_no")


@query(f"{GRAPH} SELECT scan_id, path, CAST(line_no AS INT) AS line_no, specifier, resolved FROM r WHERE kind = 'relative'")
def join_import_resolve(t: Tables) -> DataFrame:
    return _resolved(t).where("kind = 'relative'").select("scan_id", "path", "line_no", "specifier", "resolved")


@query(f"{GRAPH} SELECT scan_id, path, CAST(line_no AS INT) AS line_no, specifier, resolved FROM r WHERE kind = 'alias'")
def join_import_alias(t: Tables) -> DataFrame:
    return _resolved(t).where("kind = 'alias'").select("scan_id", "path", "line_no", "specifier", "resolved")


@query(f"WITH {CODE}, {LINES}, {REFS} SELECT path, specifier, {NEAR} AS near FROM i WHERE kind = 'relative'")
def join_normalize_path(t: Tables) -> DataFrame:
    refs = I.imports(_code(t)).where("kind = 'relative'")
    dotted = F.when(F.col("language") == "Python", F.regexp_replace("specifier", r"\.", "/")).otherwise(F.col("specifier"))
    return refs.select("path", "specifier", I.normalize_path(F.concat_ws("/", I.folder(F.col("path")), dotted)).alias("near"))


@query(f"""{GRAPH} SELECT f.scan_id, f.path, (SELECT count(DISTINCT resolved) FROM r WHERE r.scan_id = f.scan_id AND r.path = f.path) AS n_out, (SELECT count(DISTINCT r.path) FROM r WHERE r.scan_id = f.scan_id AND r.resolved = f.path) AS n_in FROM f WHERE is_code""")
def grf_build(t: Tables) -> DataFrame:
    """The modules of each scan with the number of those they import and are imported by."""
    f = _code(t).where("is_code and not is_vendor and not is_generated")
    edges = I.module_edges(I.resolve(I.imports(f), f.select("scan_id", "path")))
    ends = edges.select("scan_id", F.explode(F.array(F.struct(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("scan_id", "e.*")
    degree = ends.groupBy("scan_id", "path").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return f.select("scan_id", "path").join(degree, ["scan_id", "path"], "left").select("scan_id", "path", F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"), F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"))


UNUSED = f"""x AS (SELECT scan_id, path, regexp_extract(line, '^(?:export (?:async )?(?:function|const)|def|class) (\\w+)', 1) AS symbol, CAST(line_no AS INT) AS line_no FROM l WHERE CASE WHEN language = 'Python' THEN regexp_matches(line, '^(def|class) ') ELSE regexp_matches(line, '^export ') END),
    u AS (SELECT * FROM x WHERE NOT {any_of(ENTRIES, 'path')} AND NOT EXISTS (SELECT 1 FROM r WHERE r.scan_id = x.scan_id AND r.resolved = x.path AND r.symbol = x.symbol))"""


def _unused(t: Tables) -> DataFrame:
    f = _code(t)
    return I.unused_exports(I.exports(f), I.resolve(I.imports(f), f.select("scan_id", "path")), P.matches(F.col("path"), ENTRIES))


@query(f"{GRAPH}, {UNUSED} SELECT scan_id, path, symbol, line_no FROM u")
def join_unused_exports(t: Tables) -> DataFrame:
    """No file of v_code has more than three exports, so the SQL can do without that rule; a test has it."""
    return _unused(t)


@query(f"{GRAPH}, w AS (SELECT DISTINCT scan_id, specifier AS package, path FROM r WHERE kind = 'external'), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id, package ORDER BY path) AS INT) AS place FROM w) SELECT * FROM o WHERE place <= 6")
def join_usage(t: Tables) -> DataFrame:
    """Files that import a package, at most six of a scan; the package is the first part of the name, two with a scope."""
    from pyspark.sql import Window

    head = F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    used = I.imports(_code(t)).where("kind = 'external'").select("scan_id", head.alias("package"), "path").distinct()
    return used.withColumn("place", F.row_number().over(Window.partitionBy("scan_id", "package").orderBy("path"))).where("place <= 6")
