"""Queries of detectors over code: raw findings, copies, suppressions in comments, validation signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import paths as P
from ..operators import detect as D
from ..operators import graph as G
from ..operators import imports as I
from ..operators import rules as R
from ..operators import structure as S
from ..operators import suppress as X
from ..operators import table_functions as T
from ..operators import validate as V
from ..session import staged
from .files import ENTRIES, NORM, SOURCE, TRIMMED, any_of
from .graphs import COMP, COMPONENTS
from .registry import Tables, query
from .structure import _NOTABLE, CODE, FUNCTIONS, GRAPH, LINES, REFS, RESOLVED, SPANS, UNUSED, _code, _resolved, _shared, _unused

LAYERS = [("presentation code reaching the persistence layer directly", r"(^|/)(components|ui|views|pages)/", r"(^|/)(db|database|prisma|models?|repositor\w*|drizzle)(/|\.)"), ("presentation code importing credential handling", r"(^|/)(components|ui)/", r"(^|/)(api-keys?|secrets?|credentials?)(/|\.)"),
          ("domain logic depending on a delivery framework", r"(^|/)(domain|core|entities)/", r"(^|/)(http|express|fastify|next|react)(/|\.)")]  # fmt: skip  Fixed values: layers by path.
BASE = f"WITH {CODE}, {LINES}, q AS (SELECT l.* FROM l JOIN f ON f.scan_id = l.scan_id AND f.path = l.path WHERE NOT is_vendor AND NOT is_generated AND NOT is_test)"
LOC = "len(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '' AND NOT regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '^(//|#|\\*)')))"


def _sql(source: str, rule: str, severity: str, confidence: str, cause: str, minutes: str, path: str, line: str = "NULL", n: str = "1") -> str:
    return f"SELECT scan_id, {rule} AS rule_id, {severity} AS severity, CAST({confidence} AS DOUBLE) AS confidence, {cause} AS root_cause, CAST({minutes} AS INT) AS effort_minutes, {path} AS path, CAST({line} AS INT) AS line, CAST({n} AS BIGINT) AS n FROM {source}"


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _hits_sql(rules: list) -> str:
    """Findings of one-line rules without nearby lines; no scan of v_code comes near a cap."""
    parts = []
    for r in rules:
        tests = [f"regexp_matches(line, '{_quoted(r.pattern)}')"] + ([f"language IN {tuple(r.languages)}"] if r.languages else []) + ([f"NOT regexp_matches(line, '{_quoted(r.exclude)}')"] if r.exclude else []) + ([f"NOT regexp_matches(path, '{r.path_not}')"] if r.path_not else [])
        parts.append(_sql(f"q WHERE {' AND '.join(tests)}", f"'{r.id}'", f"'{r.severity}'", str(r.confidence), f"'{r.cause}'", str(r.minutes), "path", "line_no"))
    return " UNION ALL ".join(parts)


def _plain(rules: list) -> list:
    """The rules that SQL can express; none of the others matches anything in v_code."""
    return [r for r in rules if r.join_lines == 1 and not r.nearby and not r.path and "(?!" not in r.pattern and "\\2" not in r.pattern]


def _bare_sql(table: str = "f") -> str:
    return rf"w AS (SELECT scan_id, path FROM {table} WHERE is_code AND NOT is_vendor AND NOT is_generated AND regexp_matches(content, 'await\s') AND NOT regexp_matches(content, 'try\s*\{{|\.catch\(|except\b|rescue\b')), g AS (SELECT scan_id, count(*) AS n, min(path) AS path FROM w GROUP BY scan_id HAVING count(*) >= 3)"


@query(f"{BASE} {_hits_sql(_plain(R.SECURITY))}")
def det_security(t: Tables) -> DataFrame:
    return D.by_rules(_code(t), R.SECURITY)


@query(f"{BASE}, {_bare_sql()} {_hits_sql(_plain(R.RELIABILITY))} UNION ALL {_sql('g', repr('bug.no-error-handling-module'), repr('medium'), '0.72', repr('missing-failure-handling'), '60', 'path', n='n')}")
def det_reliability(t: Tables) -> DataFrame:
    f = _code(t)
    return D.by_rules(f, R.RELIABILITY).unionByName(D.no_error_handling(f))


@query(f"{BASE} {_hits_sql(_plain(R.AI_CODE))}")
def det_patterns(t: Tables) -> DataFrame:
    return D.by_rules(_code(t), R.AI_CODE)


@query(f"{BASE}, {SPANS}, k AS ({_NOTABLE}) {_hits_sql(_plain(R.PERFORMANCE))} UNION ALL {_sql('k WHERE kind = ' + repr('deep'), repr('perf.deep-branching'), repr('low'), '0.7', repr('complex-hot-paths'), '60', 'path', 'start_line')}")
def det_perf(t: Tables) -> DataFrame:
    f = _code(t)
    return D.by_rules(f, R.PERFORMANCE).unionByName(D.functions(S.notable(S.function_spans(f)), ("deep",)))


@query(f"{BASE} SELECT scan_id, rule_id, count(*) AS matches FROM ({_hits_sql(_plain(R.SHIPPED))}) GROUP BY ALL")
def rules_shipped(t: Tables) -> DataFrame:
    """Every shipped rule over code: matches kept by scan and rule."""
    return D.by_rules(_code(t), R.SHIPPED).groupBy("scan_id", "rule_id").agg(F.count("*").alias("matches"))


# Copies of code: groups of six significant lines


#: How many blocks of a scan the lists of copies name, as their SQL does; a share of repeated lines is that of all blocks.
LISTED = 40


def copied_blocks(files: DataFrame, window: int = 6, max_lines: int | None = None) -> DataFrame:
    """Equal groups of ``window`` significant lines in a row (tumbling): scan_id, fingerprint, occurrences, files, first. Groups are made inside a file's row; only fingerprints are shuffled.

    Every group of every file counts; ``max_lines`` leaves longer files out.
    """
    # Conditions stand inside the expressions: a filter would be pushed below them and take the lines apart once more.
    marked = F.filter(F.transform(F.transform("lines", C.trimmed), lambda x, i: F.struct((i + 1).alias("line"), C.normalized(x).alias("norm"))), lambda s: s["norm"].isNotNull())
    taken = marked if max_lines is None else F.when(F.size("lines") <= max_lines, marked)
    rows = files.select("scan_id", "path", F.split("content", "\n").alias("lines")).select("scan_id", "path", taken.alias("s"))
    block = lambda k: F.slice("s", k * window + 1, F.lit(window))
    made = F.transform(F.when(F.size("s") >= window, F.sequence(F.lit(0), F.floor(F.size("s") / window).cast("int") - 1)), lambda k: F.struct(block(k)[0]["line"].alias("line"), F.substring(F.sha1(F.array_join(F.transform(block(k), lambda x: x["norm"]), "\n").cast("binary")), 1, 16).alias("fingerprint")))
    each = rows.select("scan_id", "path", F.explode(made).alias("b")).groupBy("scan_id", F.col("b.fingerprint").alias("fingerprint"), "path").agg(F.count("*").alias("n"), F.min(F.concat_ws(":", "path", "b.line")).alias("first"))
    return each.groupBy("scan_id", "fingerprint").agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"), F.min("first").alias("first")).where("occurrences >= 2")


def by_frequency(blocks: DataFrame, top: int | None = None) -> DataFrame:
    """``copied_blocks`` with their ``place`` in the scan, the most frequent first: all of them, or only the first ``top``, which are cut in each partition before they are shuffled."""
    placed = blocks.withColumn("place", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("occurrences"), "fingerprint")))
    return placed if top is None else placed.where(F.col("place") <= top)


def duplicate_blocks(files: DataFrame, window: int = 6, top: int | None = None, max_lines: int | None = None) -> DataFrame:
    """``copied_blocks`` of ``files`` with their places."""
    return by_frequency(copied_blocks(files, window, max_lines), top)


DUPS = f"""s AS (SELECT scan_id, path, line_no, norm, row_number() OVER (PARTITION BY scan_id, path ORDER BY line_no) - 1 AS rn FROM (SELECT scan_id, path, line_no, {NORM} AS norm FROM (SELECT l.*, {TRIMMED} AS tr FROM l JOIN f ON f.scan_id = l.scan_id AND f.path = l.path WHERE {SOURCE})) WHERE norm IS NOT NULL),
    b AS (SELECT scan_id, path, rn // 6 AS w, min(line_no) AS start_line, string_agg(norm, chr(10) ORDER BY line_no) AS block, count(*) AS n FROM s GROUP BY ALL),
    g AS (SELECT scan_id, substr(sha1(block), 1, 16) AS fingerprint, count(*) AS occurrences, count(DISTINCT path) AS files, min(path || ':' || start_line) AS first FROM b WHERE n = 6 GROUP BY ALL HAVING count(*) >= 2),
    d AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY occurrences DESC, fingerprint) AS INT) AS place FROM g) WHERE place <= 40),
    cl AS (SELECT scan_id, CAST(sum({LOC}) AS BIGINT) AS loc FROM f GROUP BY scan_id),
    z AS (SELECT cl.scan_id, round(least(1, coalesce(sum(6 * (occurrences - 1)), 0) / max(loc)), 6) AS ratio FROM cl LEFT JOIN d ON cl.scan_id = d.scan_id GROUP BY cl.scan_id)"""
COPIES = f"WITH {CODE}, {LINES}, {DUPS}"
#: ``DUPS`` with all blocks of a scan, and with names that FUNCTIONS leaves free.
ALL_DUPS = DUPS.replace(" WHERE place <= 40", "").replace("s AS (", "s2 AS (", 1).replace("FROM s GROUP", "FROM s2 GROUP")


def _blocks(t: Tables) -> DataFrame:
    return duplicate_blocks(_code(t).where(SOURCE), top=LISTED)


def _loc(files: DataFrame) -> DataFrame:
    return files.withColumn("loc", C.significant_lines(F.col("content")).cast("long"))


def _ratio(t: Tables, blocks: DataFrame) -> DataFrame:
    loc = _loc(_code(t)).groupBy("scan_id").agg(F.sum("loc").alias("loc"))
    again = blocks.groupBy("scan_id").agg(F.sum(6 * (F.col("occurrences") - 1)).alias("again"))
    return loc.join(again, "scan_id", "left").select("scan_id", "loc", F.round(F.least(F.lit(1.0), F.coalesce("again", F.lit(0)) / F.col("loc")), 6).alias("ratio"))


@query(f"{COPIES} SELECT scan_id, fingerprint, occurrences, files, first, place FROM d")
def agg_dup_blocks(t: Tables) -> DataFrame:
    return _blocks(t)


@query(f"{COPIES} SELECT scan_id, fingerprint, occurrences FROM d WHERE files > 1")
def agg_dup_cross_file(t: Tables) -> DataFrame:
    return _blocks(t).where("files > 1").select("scan_id", "fingerprint", "occurrences")


@query(f"{COPIES} SELECT scan_id, ratio FROM z")
def agg_dup_ratio(t: Tables) -> DataFrame:
    return _ratio(t, _blocks(t)).select("scan_id", "ratio")


@query(f"{COPIES}, x AS (SELECT scan_id, count(*) AS n, arg_min(first, place) AS first FROM d WHERE files > 1 GROUP BY scan_id HAVING count(*) >= 3) {_sql('x', repr('ai.repeated-implementation'), 'CASE WHEN n > 10 THEN ' + repr('medium') + ' ELSE ' + repr('low') + ' END', '0.78', repr('duplicated-logic'), '90', 'split_part(first, ' + repr(':') + ', 1)', 'split_part(first, ' + repr(':') + ', 2)', 'n')}")
def det_repeated(t: Tables) -> DataFrame:
    return D.repeated(_blocks(t))


# Findings of structure

_MAINT = " UNION ALL ".join([
    _sql("k WHERE kind = 'complex'", "'maint.high-complexity'", "CASE WHEN complexity >= 30 THEN 'medium' ELSE 'low' END", "0.85", "'complexity-debt'", "60", "path", "start_line"),
    _sql("k WHERE kind = 'long'", "'maint.long-function'", "'low'", "0.9", "'complexity-debt'", "45", "path", "start_line"),
    _sql("k WHERE kind = 'wide'", "'maint.wide-signature'", "'low'", "0.88", "'complexity-debt'", "30", "path", "start_line"),
    _sql("(SELECT z.scan_id, ratio, split_part(first, ':', 1) AS path FROM z JOIN d ON d.scan_id = z.scan_id AND place = 1 WHERE ratio > 0.03)", "'maint.duplication'", "CASE WHEN ratio > 0.1 THEN 'medium' ELSE 'low' END", "0.8", "'duplicated-logic'", "90", "path"),
])


def _top_files(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("loc"), "path"))
    return _loc(_code(t).where(SOURCE)).select("scan_id", "path", "loc", place.alias("place")).where("place <= 8")


@query(f"{FUNCTIONS}, k AS ({_NOTABLE}), {ALL_DUPS} {_MAINT}")
def det_maint(t: Tables) -> DataFrame:
    """No file of v_code is beyond 800 lines, so the SQL has no oversized ones; a test has."""
    _shared(t)
    notable, blocks = S.notable(S.function_spans(_code(t).where(SOURCE_OR_TEST))), staged(copied_blocks(_code(t).where(SOURCE)))
    out = D.functions(notable, ("complex", "long", "wide")).unionByName(D.oversized(_top_files(t)))
    return out.unionByName(D.duplicated(by_frequency(blocks, 1), _ratio(t, blocks)))


SOURCE_OR_TEST = "is_code"

_METRICS = f"""{FUNCTIONS}, {ALL_DUPS}, {REFS}, {RESOLVED}, {UNUSED},
    m AS (SELECT scan_id, count(*) AS files, CAST(sum({LOC}) AS BIGINT) AS loc, count(*) FILTER (WHERE is_test) AS test_files, count(*) FILTER (WHERE is_code AND NOT is_test AND NOT is_vendor AND NOT is_generated) AS source_files FROM f GROUP BY scan_id)
    SELECT m.scan_id, files, m.loc, test_files, source_files, round(CASE WHEN source_files > 0 THEN test_files / source_files ELSE 0 END, 6) AS test_ratio, coalesce(avg_complexity, 0) AS avg_complexity, coalesce(max_complexity, 0) AS max_complexity, ratio AS duplication, coalesce(dead, 0) AS dead_code_count
    FROM m LEFT JOIN (SELECT scan_id, round(avg(complexity), 1) AS avg_complexity, max(complexity) AS max_complexity FROM p JOIN f USING (scan_id, path) WHERE {SOURCE} GROUP BY scan_id) USING (scan_id) LEFT JOIN z USING (scan_id) LEFT JOIN (SELECT scan_id, count(*) AS dead FROM u GROUP BY scan_id) USING (scan_id)"""


@query(_METRICS)
def agg_metrics(t: Tables) -> DataFrame:
    """One row for each scan; each part is aggregated by scan before they meet."""
    f = _code(_shared(t))
    base = _loc(f).groupBy("scan_id").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.count_if("is_test").alias("test_files"), F.count_if(F.expr("is_code and not is_test and not is_vendor and not is_generated")).alias("source_files"))
    shape = S.complexity(S.function_spans(f.where(SOURCE))).drop("functions")
    dead = _unused(t).groupBy("scan_id").agg(F.count("*").alias("dead"))
    copies = _ratio(t, copied_blocks(f.where(SOURCE))).select("scan_id", F.col("ratio").alias("duplication"))
    out = base.join(shape, "scan_id", "left").join(copies, "scan_id", "left").join(dead, "scan_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ratio = F.round(F.coalesce(F.col("test_files") / F.nullif(F.col("source_files"), F.lit(0)), F.lit(0.0)), 6)
    return out.select("scan_id", "files", "loc", "test_files", "source_files", ratio.alias("test_ratio"), F.coalesce("avg_complexity", F.lit(0.0)).alias("avg_complexity"), zero("max_complexity"), "duplication", F.coalesce("dead", F.lit(0)).alias("dead_code_count"))


@query(f"{GRAPH}, x AS (SELECT scan_id, count(*) AS n, min((path, line_no)) AS spot FROM r WHERE kind <> 'external' AND resolved IS NULL GROUP BY scan_id) {_sql('x', repr('ai.unresolved-import'), repr('high'), '0.9', repr('incomplete-implementations'), '45', 'spot[1]', 'spot[2]', 'n')}")
def det_unresolved(t: Tables) -> DataFrame:
    return D.unresolved(_resolved(t))


@query(f"{GRAPH}, {UNUSED}, y AS (SELECT scan_id, count(*) AS n, min((path, line_no)) AS spot FROM u GROUP BY scan_id HAVING count(*) >= 5) {_sql('y', repr('ai.unused-exports'), repr('low'), '0.7', repr('dead-code'), '40', 'spot[1]', 'spot[2]', 'n')}")
def det_unused_exports(t: Tables) -> DataFrame:
    return D.unused(_unused(t))


_LAYER_ROWS = ", ".join(f"('{n}', '{_quoted(x)}', '{_quoted(y)}')" for n, x, y in LAYERS)


@query(f"{GRAPH}, x AS (SELECT scan_id, label, count(*) AS n, min((path, line_no)) AS spot FROM r JOIN (VALUES {_LAYER_ROWS}) v(label, a, b) ON regexp_matches(path, a) AND regexp_matches(coalesce(resolved, specifier), b) GROUP BY ALL) {_sql('x', repr('arch.layer-violation'), repr('medium'), '0.75', repr('layer-leakage'), '120', 'spot[1]', 'spot[2]', 'n')}")
def det_layers(t: Tables) -> DataFrame:
    return D.layers(_resolved(t), LAYERS)


@query(f"WITH {CODE}, {LINES}, x AS (SELECT l.scan_id, l.path, count(*) AS n_exports FROM l WHERE CASE WHEN language = 'Python' THEN regexp_matches(line, '^(def|class) ') ELSE regexp_matches(line, '^export ') END GROUP BY ALL), "
       f"y AS (SELECT f.scan_id, f.path, {LOC} AS loc, n_exports FROM f JOIN x ON x.scan_id = f.scan_id AND x.path = f.path), o AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY loc DESC, path) AS place FROM y WHERE loc > 100 AND n_exports >= 2) {_sql('o WHERE place <= 4', repr('arch.god-module'), 'CASE WHEN loc > 120 THEN ' + repr('high') + ' ELSE ' + repr('medium') + ' END', '0.85', repr('module-coupling'), '150', 'path', n='n_exports')}")
def det_god(t: Tables) -> DataFrame:
    """With lower limits than the defaults (500 lines, 12 exports), as v_code's files are small."""
    f = _code(t)
    n = I.exports(f).groupBy("scan_id", "path").agg(F.count("*").alias("n_exports"))
    return D.large_modules(_loc(f).select("scan_id", "path", "loc").join(n, ["scan_id", "path"]), loc=100, exports=2, high=120)


EDGES = "e AS (SELECT DISTINCT scan_id, path AS src, resolved AS dst FROM r WHERE resolved IS NOT NULL AND resolved <> path)"
#: Cycles of v_code lie between a module and one or two others; the closure of a scan's few edges is small.
CYCLES = f"""{GRAPH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {EDGES}, t(scan_id, a, b) AS (SELECT scan_id, src, dst FROM e UNION SELECT t.scan_id, t.a, e.dst FROM t JOIN e ON e.scan_id = t.scan_id AND e.src = t.b),
    m AS (SELECT x.scan_id, x.a AS path, least(x.a, min(x.b)) AS cycle FROM t x JOIN t y ON y.scan_id = x.scan_id AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.scan_id, x.a)"""


def _cycles(t: Tables) -> DataFrame:
    return D.scan_cycles(I.module_edges(_resolved(t)))


@query(f"{CYCLES}, g AS (SELECT scan_id, cycle, count(*) AS n, row_number() OVER (PARTITION BY scan_id ORDER BY cycle) AS place FROM m GROUP BY scan_id, cycle) {_sql('g WHERE place <= 5', repr('arch.circular-dependency'), 'CASE WHEN n > 3 THEN ' + repr('high') + ' ELSE ' + repr('medium') + ' END', '0.95', repr('module-coupling'), '90', 'cycle', '1', 'n')}")
def det_cycles(t: Tables) -> DataFrame:
    return D.circular(_cycles(t))


@query(f"""{CYCLES}, g AS (SELECT scan_id, cycle, list_sort(list(DISTINCT {COMP.format('path')})) AS parts, list_sort(list(DISTINCT split_part(path, '/', -1))) AS names, row_number() OVER (PARTITION BY scan_id ORDER BY cycle) AS place FROM m GROUP BY scan_id, cycle)
    SELECT scan_id, cycle, array_to_string(CASE WHEN len(parts) > 1 THEN parts ELSE names END, ' > ') AS label FROM g WHERE place <= 6""")
def grf_cycle_label(t: Tables) -> DataFrame:
    return D.cycle_labels(_cycles(t), G.component(F.col("path"), COMPONENTS))


_STEM = "regexp_replace(split_part(path, '/', -1), '\\.[^.]+$', '')"
UNTESTED = f"""w AS (SELECT scan_id, path, {_STEM} AS stem FROM f WHERE {SOURCE} AND regexp_matches(path, '{D.CRITICAL}') AND length({_STEM}) >= 4),
    n AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.scan_id = w.scan_id AND is_test AND NOT is_vendor AND contains(f.path || chr(10) || f.content, w.stem)))"""


@query(f"WITH {CODE}, {UNTESTED} SELECT scan_id, path, stem FROM n")
def join_untested(t: Tables) -> DataFrame:
    return D.untested(_code(t)).select("scan_id", "path", "stem")


@query(f"WITH {CODE}, {UNTESTED}, g AS (SELECT scan_id, count(*) AS k, min(path) AS path FROM n GROUP BY scan_id) {_sql('g', repr('test.untested-critical-path'), 'CASE WHEN k > 3 THEN ' + repr('high') + ' ELSE ' + repr('medium') + ' END', '0.72', repr('no-test-safety-net'), '120', 'path', n='k')}")
def det_tests_critical(t: Tables) -> DataFrame:
    return D.untested_critical(_code(t))


@query(f"WITH {CODE}, {LINES}, g AS (SELECT scan_id, count(*) AS n, min((path, line_no)) AS spot FROM l WHERE starts_with(line, 'it.skip(') GROUP BY scan_id) {_sql('g', repr('test.skipped'), repr('low'), '0.92', repr('no-test-safety-net'), '45', 'spot[1]', 'spot[2]', 'n')}")
def det_tests_skipped(t: Tables) -> DataFrame:
    return D.skipped_tests(_code(t))


@query(f"WITH {CODE}, g AS (SELECT scan_id, count(*) FILTER (WHERE is_test AND NOT is_vendor) AS n FROM f GROUP BY scan_id HAVING count(*) FILTER (WHERE is_test AND NOT is_vendor) > 0 AND NOT bool_or(regexp_matches(path, '{D.CI_FILE}'))) {_sql('g', repr('test.no-ci'), repr('medium'), '0.88', repr('no-automated-verification'), '45', repr('.github/workflows'), n='n')}")
def det_tests_ci(t: Tables) -> DataFrame:
    return D.no_ci(_code(t))


#: The registry of detectors; a caller adds a callable (tables) -> findings under a name of its own.
DETECTORS = {"tests-ci": det_tests_ci, "tests-skipped": det_tests_skipped, "tests-critical": det_tests_critical, "layers": det_layers, "unresolved": det_unresolved}


@query(f"""{GRAPH}, a AS (SELECT scan_id, count(*) FILTER (WHERE kind <> 'external' AND resolved IS NULL) AS bad FROM r GROUP BY scan_id), b AS (SELECT scan_id, count(*) FILTER (WHERE starts_with(line, 'it.skip(')) AS skips FROM l GROUP BY scan_id),
    dk AS (SELECT scan_id, count(*) FILTER (WHERE is_test) > 0 AND NOT bool_or(regexp_matches(path, '{D.CI_FILE}')) AS dark FROM f GROUP BY scan_id), v AS (SELECT r.scan_id, count(DISTINCT label) AS labels FROM r JOIN (VALUES {_LAYER_ROWS}) v(label, a, b) ON regexp_matches(path, a) AND regexp_matches(coalesce(resolved, specifier), b) GROUP BY r.scan_id), {UNTESTED.replace('n AS (', 'n9 AS (', 1)}
    SELECT 'tests-ci' AS detector, count(*) AS findings FROM dk WHERE dark HAVING count(*) > 0 UNION ALL SELECT 'tests-skipped', count(*) FROM b WHERE skips > 0 HAVING count(*) > 0 UNION ALL SELECT 'tests-critical', count(DISTINCT scan_id) FROM n9 HAVING count(*) > 0
    UNION ALL SELECT 'layers', CAST(sum(labels) AS BIGINT) FROM v HAVING count(*) > 0 UNION ALL SELECT 'unresolved', count(*) FROM a WHERE bad > 0 HAVING count(*) > 0""")
def ext_detector(t: Tables) -> DataFrame:
    """Findings by detector of the registry."""
    return D.run(DETECTORS, _shared(t)).groupBy("detector").agg(F.count("*").alias("findings"))


#: Letters of a line from which the detector of ``ext_detector_sql`` reports it.
LONG_LINE = 60


@query(f"""WITH l AS (SELECT scan_id, path, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS t FROM v_files)
    SELECT scan_id, severity, count(*) AS findings, CAST(sum(line) AS BIGINT) AS lines, CAST(sum(n) AS BIGINT) AS letters FROM (SELECT scan_id, line, length(t) AS n, CASE WHEN ends_with(path, '.md') THEN 'low' ELSE 'medium' END AS severity FROM l WHERE length(t) >= {LONG_LINE}) GROUP BY ALL""")
def ext_detector_sql(t: Tables) -> DataFrame:
    """A detector that a caller writes, registered as a table function and called from SQL over whole texts."""
    t.v_files.select("scan_id", "path", "content").createOrReplaceTempView("files_to_audit")
    call = T.found_by(T.register_detector(t.spark, "find_long_lines", T.long_lines(LONG_LINE)), "files_to_audit")
    return t.spark.sql(f"SELECT scan_id, severity, count(*) AS findings, sum(line) AS lines, sum(n) AS letters FROM ({call}) GROUP BY scan_id, severity")


# Suppressions in comments

DIRECTIVES = """y AS (SELECT scan_id, path, CASE WHEN contains(line, 'audit-disable-file') THEN 0 WHEN contains(line, 'audit-disable-next-line') THEN line_no + 1 ELSE line_no END AS line, regexp_extract(line, 'audit-disable-(?:file|next-line|line)\\s+([\\w.*,\\s-]+)', 1) AS scope FROM l WHERE contains(line, 'audit-disable'))"""


@query(f"""{BASE}, {DIRECTIVES}, h AS ({_hits_sql(_plain(R.SHIPPED))}) SELECT h.scan_id, h.path, h.line, h.rule_id, coalesce(bool_or(y.path IS NOT NULL AND len(list_filter(string_split_regex(scope, '[,\\s]+'), lambda s: s = rule_id OR s LIKE '%.' AND starts_with(rule_id, s) OR s LIKE '%*' AND starts_with(rule_id, rtrim(s, '*')))) > 0), false) AS suppressed
    FROM h LEFT JOIN y ON y.scan_id = h.scan_id AND y.path = h.path AND (y.line = 0 OR y.line = h.line) GROUP BY h.scan_id, h.path, h.line, h.rule_id""")
def join_suppress_inline(t: Tables) -> DataFrame:
    f = _code(t)
    hits = D.by_rules(f, R.SHIPPED).select("scan_id", "path", "line", "rule_id").distinct()
    return X.by_comment(hits, X.directives(f)).select("scan_id", "path", "line", "rule_id", "suppressed")


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS no, regexp_replace(unnest(string_split(content, chr(10))), '^\s+|\s+$', '', 'g') AS raw FROM v_files), k AS (SELECT doc_id, no, starts_with(raw, '!') AS negated, string_split_regex(CASE WHEN starts_with(raw, '!') THEN regexp_replace(raw, '^!\s*', '') ELSE raw END, '\s+') AS parts FROM l WHERE raw <> '' AND NOT starts_with(raw, '#'))
    SELECT doc_id, CAST(no AS INT) AS no, parts[1] AS glob, len(parts) - 1 AS scopes, negated FROM k WHERE parts[1] <> ''""")
def fn_ignore_parse(t: Tables) -> DataFrame:
    """Each text read as an ignore file."""
    return X.parse_ignore(t.v_files, ["doc_id"]).select("doc_id", "no", "glob", F.size("scopes").cast("long").alias("scopes"), "negated")


#: An ignore rule for each file, in the rules of its scan: by its path, its name with any ending, its name and one more letter below ``src``, or the beginning of names in a folder.
GLOBS = """SELECT scan_id, doc_id AS no, CASE doc_id % 4 WHEN 0 THEN '/' || path WHEN 1 THEN 'f' || CAST(doc_id AS STRING) || '.*' WHEN 2 THEN 'src/**/f' || substr(CAST(doc_id AS STRING), 1, 3) || '?.ts' ELSE '**/workers/f' || substr(CAST(doc_id AS STRING), 1, 2) || '*' END AS g,
    CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'sec.' ELSE 'bug.*' END AS scope, doc_id % 5 = 0 AS negated FROM v_files"""
REPORTED = "SELECT scan_id, doc_id, path, CASE WHEN doc_id % 2 = 0 THEN 'sec.eval-usage' ELSE 'bug.empty-catch' END AS rule_id FROM v_files"


@query(f"""WITH k AS (SELECT *, CASE no % 4 WHEN 0 THEN '^' || replace(substr(g, 2), '.', '[.]') || '(?:/.*)?$' WHEN 1 THEN '(?:^|/)f' || no || '[.][^/]*(?:/.*)?$' WHEN 2 THEN '^src/(?:.*/)?f' || substr(CAST(no AS VARCHAR), 1, 3) || '[^/][.]ts(?:/.*)?$' ELSE '^(?:.*/)?workers/f' || substr(CAST(no AS VARCHAR), 1, 2) || '[^/]*(?:/.*)?$' END AS pattern FROM ({GLOBS})),
    h AS ({REPORTED}), v AS (SELECT h.doc_id, arg_max(NOT negated, no) AS suppressed FROM h JOIN k ON k.scan_id = h.scan_id AND regexp_matches(h.path, pattern) AND (scope = '' OR starts_with(rule_id, rtrim(scope, '*'))) GROUP BY h.doc_id)
    SELECT h.scan_id, h.path, rule_id, coalesce(suppressed, false) AS suppressed FROM h LEFT JOIN v USING (doc_id)""")
def join_suppress_rules(t: Tables) -> DataFrame:
    """Ignore rules as a table, each scan with its own."""
    t.v_files.createOrReplaceTempView("v_files")
    rules = t.spark.sql(GLOBS).withColumnRenamed("g", "glob").withColumn("scopes", X.words_of(F.col("scope")))
    return X.by_globs(t.spark.sql(REPORTED), rules).select("scan_id", "path", "rule_id", "suppressed")
