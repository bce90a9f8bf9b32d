"""Suppressions: comments in source lines, and ignore files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_pattern, in_scope

#: The word that begins a directive: ``audit-disable-next-line sec.*, bug.empty-catch``.
WORD = "audit"
#: What a directive covers: the whole file (line 0), the next line, its own line; the first that a line holds counts.
KINDS = (("file", None), ("next-line", 1), ("line", 0))


def words_of(scope: Column) -> Column:
    return F.filter(F.split(scope, r"[,\s]+"), lambda x: x != "")


def directives(files: DataFrame, word: str = WORD) -> DataFrame:
    """scan_id, path, line (0: the file), scopes of ``files`` (scan_id, path, content); of several for one line the last counts. An empty scope means every rule."""
    l, covers, scopes = F.col("text"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for kind, step in reversed(KINDS):
        pattern = rf"{word}-disable-{kind}(?:\s+([\w.*,\s-]+))?"
        covers = F.when(l.rlike(pattern), F.lit(0) if step is None else F.col("i") + 1 + step).otherwise(covers)
        scopes = F.when(l.rlike(pattern), F.regexp_extract(l, pattern, 1)).otherwise(scopes)
    rows = files.where(F.contains("content", F.lit(f"{word}-disable"))).select("scan_id", "path", F.posexplode(F.split("content", "\n")).alias("i", "text")).where(F.contains("text", F.lit(f"{word}-disable")))
    rows = rows.select("scan_id", "path", "i", covers.cast("int").alias("line"), words_of(scopes).alias("scopes")).where("line is not null")
    return rows.groupBy("scan_id", "path", "line").agg(F.max_by("scopes", "i").alias("scopes"))


def by_comment(findings: DataFrame, found: DataFrame) -> DataFrame:
    """``findings`` (scan_id, path, line, rule_id, ...) with ``suppressed``: a directive for the file or for the line names the rule. Two equi-joins."""
    whole = found.where("line = 0").select("scan_id", "path", F.col("scopes").alias("of_file"))
    own = found.where("line > 0").select("scan_id", "path", "line", F.col("scopes").alias("of_line"))
    hit = lambda c: F.coalesce(F.col(c).isNotNull() & in_scope(F.col("rule_id"), F.col(c)), F.lit(False))
    return findings.join(whole, ["scan_id", "path"], "left").join(own, ["scan_id", "path", "line"], "left").withColumn("suppressed", hit("of_file") | hit("of_line")).drop("of_file", "of_line")


def parse_ignore(files: DataFrame, key: list[str]) -> DataFrame:
    """Ignore files (``key``, content) to their rules: no (from 0), glob, scopes, negated. Blank lines and comments are none."""
    rows = files.select(*key, F.posexplode(F.split("content", "\n")).alias("no", "raw")).withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    rows = rows.where((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    negated = F.col("raw").startswith("!")
    parts = F.split(F.when(negated, F.regexp_replace("raw", r"^!\s*", "")).otherwise(F.col("raw")), r"\s+")
    return rows.select(*key, "no", parts[0].alias("glob"), F.slice(parts, 2, F.size(parts)).alias("scopes"), negated.alias("negated")).where("glob <> ''")


#: Letters of a name's fixed beginning that are looked up: the most of these that a glob has. From ``SURE`` on a beginning says more than a folder.
BEGINNINGS, SURE = (*range(2, 17), 20, 24, 32), 4


def _slashless(glob: Column) -> Column:
    return F.regexp_replace(glob, "^/+|/+$", "")


def glob_key(glob: Column) -> Column:
    """A fixed part that every path has which the glob matches, as ``kind:text``: the whole path, a name in it, a name's beginning (its kind holds its length), a leading folder, a name's ending; ``any:`` if there is none."""
    parts = F.split(_slashless(glob), "/")
    wild = lambda s: s.rlike("[*?]")
    last, anchored = F.element_at(parts, -1), F.contains(F.regexp_replace(glob, "/+$", ""), F.lit("/"))
    first_wild = F.array_position(F.transform(parts, wild), True)
    names = F.filter(parts, lambda s: ~wild(s))
    begins = F.regexp_extract(last, r"^[^*?]*", 0)
    ends = F.regexp_extract(last, r"\.([^.*?]+)$", 1)
    key = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    most = lambda b: F.coalesce(*[F.when(F.length(b) >= n, F.lit(n)) for n in reversed(BEGINNINGS)])
    begin = F.transform(F.array(F.struct(begins.alias("b"), most(begins).alias("n"))), lambda x: F.concat(F.lit("begin"), x["n"].cast("string"), F.lit(":"), F.substr(x["b"], F.lit(1), x["n"])))[0]
    return (
        F.when(F.exists(parts, lambda s: F.contains(s, F.lit("**")) & (s != "**")), F.lit("any:"))  # two stars inside a name may stand for parts of several
        .when(anchored & (first_wild == 0), key("at", _slashless(glob)))
        .when(~wild(last), key("name", last))
        .when(F.length(begins) >= SURE, begin)
        .when(anchored & (first_wild > 1), key("at", F.array_join(F.slice(parts, 1, F.greatest(first_wild - 1, F.lit(0)).cast("int")), "/")))
        .when(begin.isNotNull(), begin)
        .when(ends != "", key("end", ends))
        .when(F.size(names) > 0, key("name", names[0]))
        .otherwise(F.lit("any:"))
    )


def path_keys(path: Column) -> Column:
    """All keys under which a glob that matches the path may stand."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("at:"), F.array_join(F.slice(parts, 1, n), "/")))
    names = F.transform(parts, lambda s: F.concat(F.lit("name:"), s))
    begin = lambda n: F.transform(F.filter(parts, lambda s: F.length(s) >= n), lambda s: F.concat(F.lit(f"begin{n}:"), F.substring(s, 1, n)))
    ends = F.transform(F.filter(parts, lambda s: F.contains(s, F.lit("."))), lambda s: F.concat(F.lit("end:"), F.substring_index(s, ".", -1)))
    return F.array_distinct(F.concat(folders, names, *map(begin, BEGINNINGS), ends, F.array(F.lit("any:"))))


def by_globs(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``findings`` (scan_id, path, rule_id, ...) with ``suppressed`` by ``rules`` (scan_id, no, glob, scopes, negated): of a scan's rules that match path and rule the last decides, and a negated one brings back.

    Of a scan's rules with one glob and the same scopes only the last can decide. Each different path meets only the rules of its scan that share a fixed part with it, in an equi-join; then patterns
    and scopes are tested. Findings without a scan or a path are not suppressed.
    """
    last = rules.groupBy("scan_id", "glob", "scopes").agg(F.max_by("negated", "no").alias("negated"), F.max("no").alias("no"))
    keyed = last.select("scan_id", "no", "scopes", "negated", glob_pattern(F.col("glob")).alias("pattern"), glob_key(F.col("glob")).alias("key"))
    kind = lambda key: F.substring_index(key, ":", 1)
    kinds = keyed.agg(F.collect_set(kind(F.col("key"))).alias("kinds"))  # a handful, whatever the rules
    asked = F.filter(path_keys(F.col("path")), lambda k: F.array_contains("kinds", kind(k)))
    paths = findings.select("scan_id", "path").distinct().crossJoin(F.broadcast(kinds)).select("scan_id", "path", F.explode(asked).alias("key"))
    met = paths.join(keyed, ["scan_id", "key"]).where(F.rlike("path", F.col("pattern"))).select("scan_id", "path", "no", "scopes", "negated")
    own = findings.select("scan_id", "path", "rule_id").distinct().join(met, ["scan_id", "path"]).where(in_scope(F.col("rule_id"), F.col("scopes")))
    verdict = own.groupBy("scan_id", "path", "rule_id").agg((~F.max_by("negated", "no")).alias("suppressed"))
    return findings.join(verdict, ["scan_id", "path", "rule_id"], "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))
