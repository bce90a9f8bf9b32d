"""Regular-expression rules over lines: a rule is a row of data, and one pass over the lines runs all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .literals import required_literals

SPAN_CHARS, PER_FILE, PER_SCAN = 2000, 4, 40
#: From this length on the patterns' engine skips ahead in a search for a literal.
SKIPS = 4


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches a line or ``join_lines`` lines joined; caps come before ``exclude`` and ``nearby``."""

    id: str
    pattern: str
    category: str = "security"
    severity: str = "medium"
    confidence: float = 0.7
    cause: str = "cause"
    minutes: int = 30
    languages: tuple[str, ...] = ()
    path: str | None = None
    path_not: str | None = None
    exclude: str | None = None
    join_lines: int = 1
    nearby: tuple[str, int, int, bool] | None = None  # pattern, lines before, lines after, must it be there
    per_scan: int = PER_SCAN


def files_with_lines(files: DataFrame) -> DataFrame:
    """``files`` (scan_id, path, content, ...) with ``lines``."""
    return files.withColumn("lines", F.split(F.coalesce("content", F.lit("")), "\n"))


def lines(files: DataFrame) -> DataFrame:
    """scan_id, path, line_no (from 1), line."""
    return files.select("scan_id", "path", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("scan_id", "path", (F.col("i") + 1).alias("line_no"), "line")


#: Flags of files that no rule looks into, unless it says so.
SKIPPED = ("is_vendor", "is_generated", "is_test")
HIT = "array<struct<rule:int,line:int,column:int,match:string,text:string,keep:boolean>>"


def search(files: DataFrame, rules: list[Rule], per_file: int = PER_FILE, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Matches of all rules: rule_id, scan_id, path, line, column, text (the lines matched), match.

    Each rule's required literals are looked for once in a file's content, in lower case; only files that some rule may match are taken apart into lines, and of them only the lines
    that hold one of a rule's literals (for joined lines, the windows that such a line is in) meet its pattern.
    A file's matches are found, capped and tested (exclude, nearby) inside its own row, where its lines are one array; only matches leave it. Files with a flag of ``skip``
    are left out. The cap of a scan counts matches before exclude and nearby; ranks need small keys only, and Spark cuts them in each partition before the shuffle.
    A match that several windows of joined lines see counts once, at its first window.
    """
    f = files
    for flag in skip:
        f = f.where(f"not {flag}")
    some = " OR ".join(f"({_may_match(r, 'low')})" for r in rules)
    f = f.where(F.expr(f"transform(array(lower(coalesce(content, ''))), low -> {some})[0]"))  # lowered once for all rules
    f = files_with_lines(f).withColumn("lowered", F.lower(F.coalesce("content", F.lit("")))).withColumn("lowered_lines", F.split("lowered", "\n"))
    hits = [F.expr(_hits(k, r, per_file)) for k, r in enumerate(rules)]
    out = f.select("scan_id", "path", F.explode(F.flatten(F.array(*hits))).alias("m")).select("scan_id", "path", "m.*")
    caps = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (k, r.per_scan)])
    ids = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (k, r.id)])
    place = F.row_number().over(Window.partitionBy("scan_id", "rule").orderBy("path", "line", "column"))
    ranked = out.withColumn("n", place).where(F.col("n") <= max(r.per_scan for r in rules)).where((F.col("n") <= caps[F.col("rule")]) & F.col("keep"))
    return ranked.select(ids[F.col("rule")].alias("rule_id"), "scan_id", "path", "line", "column", "text", "match")


def quoted(s: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _holds(text: str, literals: tuple[str, ...], whole: bool = False) -> str:
    """SQL text: one of the literals is in the text. In ``whole`` files longer literals are looked for as patterns, whose engine skips ahead by a literal's length where ``contains`` tries every place."""
    return " OR ".join(f"{text} RLIKE {quoted(f'{chr(92)}Q{x}{chr(92)}E')}" if whole and len(x) >= SKIPS else f"contains({text}, {quoted(x)})" for x in literals)


def _may_match(r: Rule, lowered: str) -> str:
    """SQL text: what a file needs for a rule to match, by its language, path and content in lower case."""
    ok = ([f"language IN ({', '.join(map(quoted, r.languages))})"] if r.languages else []) + ([f"path RLIKE {quoted(r.path)}"] if r.path else []) + ([f"NOT path RLIKE {quoted(r.path_not)}"] if r.path_not else [])
    for pattern in (r.pattern, *(r.nearby[:1] if r.nearby and r.nearby[3] else ())):
        if held := required_literals(pattern):
            ok.append(f"({_holds(lowered, held, whole=True)})")
    return " AND ".join(ok) or "true"


def _hits(k: int, r: Rule, per_file: int) -> str:
    """The first ``per_file`` matches of rule number ``k`` in one file, as SQL text: it is parsed in one call, where thousands of column objects take seconds to build."""
    p, many = quoted(r.pattern), r.join_lines > 1
    newlines = lambda s: f"(length({s}) - length(replace({s}, '\\n', '')))"
    # Of match n in the text t, which begins at line i (from 0): p, its place from 1.
    sizes = lambda x, n: f"aggregate(slice({x}, 1, {n}), 0, (s, g) -> s + length(g))"
    place = f"1 + {sizes(f'split(t, {p}, {per_file + 1})', 'n + 1')} + {sizes(f'regexp_extract_all(t, {p}, 0)', 'n')}"
    before = "substring(t, 1, x.p - 1)"
    line, column = (f"i + 1 + {newlines(before)}", f"length(substring_index(concat('\\n', {before}), '\\n', -1)) + 1") if many else ("i + 1", "x.p")
    placed = f"transform(slice(regexp_extract_all(t, {p}, 0), 1, {per_file}), (m, n) -> named_struct('match', m, 'p', {place}))"
    found = f"transform({placed}, x -> named_struct('line', CAST({line} AS INT), 'column', CAST({column} AS INT), 'match', x.match))"
    none = "CAST(array() AS array<struct<line:int,column:int,match:string>>)"
    one = f"CASE WHEN length(t) <= {SPAN_CHARS * r.join_lines} AND t RLIKE {p} THEN {found} ELSE {none} END"
    text = f"array_join(slice(lines, i + 1, {r.join_lines}), '\\n')" if many else "get(lines, i)"
    starts = "sequence(0, size(lines) - 1)"
    if (held := required_literals(r.pattern)) and not any("\n" in x for x in held):
        starts = f"filter(transform(lowered_lines, (l, i) -> CASE WHEN {_holds('l', held)} THEN i END), i -> i IS NOT NULL)"
        if many:
            starts = f"array_distinct(flatten(transform({starts}, i -> sequence(greatest(i - {r.join_lines - 1}, 0), i))))"
    each = f"transform({starts}, i -> transform(array({text}), t -> {one})[0])"
    all_found = f"array_distinct(flatten({each}))" if many else f"flatten({each})"
    keep = [f"NOT text RLIKE {quoted(r.exclude)}"] if r.exclude else []
    if r.nearby:
        pattern, up, down, must = r.nearby
        first = f"greatest(m.line - {up}, 1)"
        keep.append(f"{'' if must else 'NOT '}array_join(slice(lines, {first}, m.line + {down} - {first} + 1), '\\n') RLIKE {quoted(pattern)}")
    hit = f"named_struct('rule', {k}, 'line', m.line, 'column', m.column, 'match', m.match, 'text', text, 'keep', {' AND '.join(keep) or 'true'})"
    tested = f"transform(slice({all_found}, 1, {per_file}), m -> transform(array(array_join(slice(lines, m.line, {newlines('m.match')} + 1), ' ')), text -> {hit})[0])"
    return f"CASE WHEN {_may_match(r, 'lowered')} THEN {tested} ELSE CAST(array() AS {HIT}) END"
