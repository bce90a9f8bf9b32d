"""Imports of source files, resolved against the files of their scan, and the module graph they make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .literals import holds_literal

# Extensions in the order in which they are tried, and the roots of an alias.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte")
ROOTS = ("src/", "app/", "lib/", "")
# Forms of imports and exports.
JS_IMPORT = r"""^\s*import\s+(?:type\s+)?(?:([\w*\s{},$]+?)\s+from\s+)?['"]([^'"]+)['"]|^\s*(?:const|let|var)\s+([\w{},:\s$]+)\s*=\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)|^\s*export\s+(?:\*|\{[^}]*\})\s+from\s+['"]([^'"]+)['"]"""
PY_IMPORT = r"^\s*(?:from\s+([\w.]+)\s+import\s+([\w*,\s()]+)|import\s+([\w.]+))"
JS_EXPORT = r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:(?:const|let|var|function|class|interface|type|enum)\s+(\w+)|\{\s*([^}]+)\s*\})"
PY_EXPORT = r"^\s*(?:def|class)\s+(\w+)"
MAX_LINE, MAX_LINES = 400, 20_000


def normalize_path(path: Column) -> Column:
    """Without empty parts and ``.``, and with each ``..`` taking back the part before it."""
    back = lambda out: F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
    step = lambda out, p: F.when(p.isin("", "."), out).when(p == "..", back(out)).otherwise(F.concat(out, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def names_in(clause: Column) -> Column:
    """The names of an import or export clause: those in braces if there are any, before ``as``."""
    braced = F.nullif(F.regexp_extract(clause, r"\{([^}]*)\}", 1), F.lit(""))
    parts = F.split(F.coalesce(braced, clause, F.lit("")), ",")
    clean = lambda p: F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.trim(p), r"\s+as\s+"), 1), r"^\s*\*\s*", ""), r"^\s*type\s+", "")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(clean(p), r"[\s]+$|^[\s]+", ""))), lambda s: s.rlike(r"^[\w$]+$"))


def _first(text: Column, pattern: str, *groups: int) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups])


def code_lines(files: DataFrame, first: int | None = None, whole: bool = False) -> DataFrame:
    """scan_id, path, language, line_no, line of code files, at most ``first`` lines of each; files of MAX_LINES lines and lines over MAX_LINE characters name nothing, unless the files are taken ``whole``."""
    split = files.select("scan_id", "path", "language", F.split("content", "\n").alias("lines"))
    taken = F.size("lines") > 0 if whole else F.size("lines") < MAX_LINES
    lines = F.when(taken, F.slice("lines", 1, first) if first else F.col("lines"))  # no filter, which would be pushed below the split and repeat it
    kept = split.select("scan_id", "path", "language", F.posexplode(lines).alias("i", "line"))
    return (kept if whole else kept.where(F.length("line") <= MAX_LINE)).select("scan_id", "path", "language", (F.col("i") + 1).alias("line_no"), "line")


def imports(files: DataFrame) -> DataFrame:
    """scan_id, path, line_no, specifier, symbols, kind (relative, alias or external) of the imports in whole files."""
    l, python = F.col("line"), F.col("language") == "Python"
    rows = code_lines(files, whole=True).where(holds_literal(l, JS_IMPORT, PY_IMPORT)).where(F.when(python, l.rlike(PY_IMPORT)).otherwise(l.rlike(JS_IMPORT)))
    specifier = F.when(python, _first(l, PY_IMPORT, 1, 3)).otherwise(_first(l, JS_IMPORT, 2, 4, 5))
    clause = F.when(python, _first(l, PY_IMPORT, 2)).otherwise(_first(l, JS_IMPORT, 1, 3))
    kind = F.when(F.col("specifier").startswith("."), "relative").when(~python & F.col("specifier").rlike("^[@~]/"), "alias").otherwise("external")
    rows = rows.select("scan_id", "path", "language", "line_no", specifier.alias("specifier"), names_in(clause).alias("symbols")).where("specifier is not null")
    return rows.withColumn("kind", kind)


def exports(files: DataFrame) -> DataFrame:
    """scan_id, path, symbol, line_no of what a file exports; public functions and classes in Python."""
    l, python = F.col("line"), F.col("language") == "Python"
    js = F.when(F.regexp_extract(l, JS_EXPORT, 1) != "", F.array(F.regexp_extract(l, JS_EXPORT, 1))).otherwise(names_in(_first(l, JS_EXPORT, 2)))
    py = F.filter(F.array(F.regexp_extract(l, PY_EXPORT, 1)), lambda s: (s != "") & ~s.startswith("_"))
    rows = code_lines(files, whole=True).where(holds_literal(l, JS_EXPORT, PY_EXPORT)).where(F.when(python, l.rlike(PY_EXPORT)).otherwise(l.rlike(JS_EXPORT)))
    named = rows.select("scan_id", "path", "line_no", F.explode(F.when(python, py).otherwise(js)).alias("symbol"))
    return named.groupBy("scan_id", "path", "symbol").agg(F.max("line_no").alias("line_no"))


def module_keys(paths: DataFrame) -> DataFrame:
    """scan_id, key, target, rank, alias_rank: what an import of a file may be called, and in which order such names are tried.

    A file answers to its path, to its path without a known extension, and to its folder if it is the folder's index. So an import is looked up by an
    equi-join on one name, in place of one name for each extension.
    """
    p = F.col("path")
    key = lambda name, rank, alias: F.struct(name.alias("key"), F.lit(rank).alias("rank"), F.lit(alias).alias("alias_rank"))
    n = len(EXTENSIONS)
    out = [key(p, 0, 0)]
    for i, e in enumerate(EXTENSIONS):
        out.append(F.when(p.endswith(e), key(F.substring(p, F.lit(1), F.length(p) - len(e)), 1 + i, 1 + 2 * i)))
        out.append(F.when(p.endswith(f"/index{e}"), key(F.substring(p, F.lit(1), F.length(p) - len(e) - 6), 1 + n + i, 2 + 2 * i)))
    for i, e in enumerate((".py", "/__init__.py")):
        out.append(F.when(p.endswith(e), key(F.substring(p, F.lit(1), F.length(p) - len(e)), 1 + 2 * n + i, None)))
    return paths.select("scan_id", p.alias("target"), F.explode(F.array_compact(F.array(*out))).alias("k")).select("scan_id", "target", "k.*")


def resolve(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """``refs`` (scan_id, path, specifier, kind, ...) with ``resolved``, the file of the scan that is meant; null for external ones and for those that nothing answers to."""
    s = F.col("specifier")
    dotted = F.when(F.col("language") == "Python", F.regexp_replace(s, r"\.", "/")).otherwise(s)
    near = normalize_path(F.concat_ws("/", folder(F.col("path")), dotted))
    bare = F.regexp_replace(s, "^[@~]/", "")
    tries = F.when(F.col("kind") == "relative", F.array(F.struct(F.lit(0).alias("root"), near.alias("key")))).when(F.col("kind") == "alias", F.array(*[F.struct(F.lit(i + 1).alias("root"), F.concat(F.lit(r), bare).alias("key")) for i, r in enumerate(ROOTS)]))
    asked = refs.select("scan_id", "path", "line_no", F.explode(tries).alias("t")).select("scan_id", "path", "line_no", "t.*").distinct()
    order = F.when(F.col("root") == 0, F.col("rank")).otherwise(100 * F.col("root") + F.col("alias_rank"))
    found = asked.join(module_keys(paths), ["scan_id", "key"]).withColumn("order", order).where("order is not null")
    best = found.groupBy("scan_id", "path", "line_no").agg(F.min_by("target", "order").alias("resolved"))
    return refs.join(best, ["scan_id", "path", "line_no"], "left")


def module_edges(resolved: DataFrame) -> DataFrame:
    """scan_id, src, dst: one row for each pair of files."""
    return resolved.where("resolved is not null").select("scan_id", F.col("path").alias("src"), F.col("resolved").alias("dst")).distinct()


def unused_exports(exported: DataFrame, resolved: DataFrame, entry: Column) -> DataFrame:
    """Exports that no import names: scan_id, path, symbol, line_no. Entry points (``entry``) are left out, as are files of more than three exports that nothing imports."""
    known = resolved.where("resolved is not null")
    used = known.select("scan_id", F.col("resolved").alias("path"), F.explode("symbols").alias("symbol")).distinct()
    imported = known.select("scan_id", F.col("resolved").alias("path")).distinct().withColumn("imported", F.lit(True))
    sizes = exported.groupBy("scan_id", "path").agg(F.count("*").alias("n"))
    open_ = exported.where(~entry).join(used, ["scan_id", "path", "symbol"], "left_anti").join(sizes, ["scan_id", "path"]).join(imported, ["scan_id", "path"], "left")
    return open_.where("imported or n <= 3").select("scan_id", "path", "symbol", "line_no")


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])
