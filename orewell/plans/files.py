"""Queries over files and lines: sources, path classes, rules, secrets, duplicates, per-scan statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import paths as P
from ..functions.urls import repository
from ..operators.search import Rule, lines, search
from ..sources.files import taken
from .registry import Tables, query

#: A rule table for prose, as the driver's texts hold no code.
TEXT_RULES = [
    Rule("txt.licence", r"[Ll]icen[sc]e", "dependencies", "low", 0.6, "licence", 10),
    Rule("txt.mail", r"[a-z0-9.]+@[a-z0-9.]+", "security", "medium", 0.7, "personal-data", 20, exclude=r"noreply|Contact", per_scan=25),
    Rule("txt.token", r'token = "[0-9a-f]{40}"', "security", "critical", 0.9, "secret", 40),
    Rule("txt.number", r"[0-9]{4,}", "ai-code", "low", 0.5, "magic", 15, path_not=r"^docs/", nearby=(r"[Ll]icen[sc]e|@", 2, 2, False)),
]


def one(pattern: str, text: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def any_of(patterns: tuple[str, ...], text: str) -> str:
    return "(" + " OR ".join(one(p, text) for p in patterns) + ")"


BASE = "split_part(path, '/', -1)"
EXT = f"lower(regexp_extract({BASE}, '^.+\\.([^.]*)$', 1))"
LANG = (
    f"CASE lower({BASE}) " + " ".join(f"WHEN '{n}' THEN '{x}'" for n, x in P.NAME_LANGUAGE.items()) + f" ELSE CASE WHEN starts_with(lower({BASE}), 'dockerfile') THEN 'Dockerfile' WHEN starts_with(lower({BASE}), '.env') THEN 'Dotenv' "
    f"ELSE CASE {EXT} " + " ".join(f"WHEN '{n}' THEN '{x}'" for n, x in P.EXT_LANGUAGE.items()) + f" ELSE CASE WHEN {EXT} <> '' THEN upper({EXT}) ELSE 'Other' END END END END"
)
FLAGS = {
    "is_binary": f"{EXT} IN ({', '.join(repr(x) for x in P.BINARY_EXT)})",
    "is_vendor": f"list_has_any(string_split(path, '/'), [{', '.join(repr(x) for x in P.VENDOR)}])",
    "is_test": any_of(P.TEST, "lower(path)"),
    "is_generated": any_of(P.GENERATED, "lower(path)"),
    "is_doc": any_of(P.DOC, "lower(path)"),
    "is_config": any_of(P.CONFIG, f"lower({BASE})"),
    "is_code": f"({LANG}) IN ({', '.join(repr(x) for x in P.CODE_LANGUAGES)})",
}
FILES = "f AS (SELECT scan_id, path, content, size, language, " + ", ".join(f"{v} AS {k}" for k, v in FLAGS.items()) + f" FROM (SELECT *, {LANG} AS language FROM v_files))"
SEARCHED = "l AS (SELECT scan_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f WHERE NOT is_vendor AND NOT is_generated AND NOT is_test)"
LINES = "l AS (SELECT scan_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM v_files)"
SOURCE = "is_code AND NOT is_vendor AND NOT is_generated AND NOT is_test AND NOT is_doc"


def _files(t: Tables) -> DataFrame:
    f = t.v_files.withColumn("language", P.language(F.col("path")))
    return f.withColumns(P.flags(F.col("path"), F.col("language")))


@query(f"SELECT path, {EXT} AS ext FROM v_files")
def src_ext(t: Tables) -> DataFrame:
    return t.v_files.select("path", P.extension(F.col("path")).alias("ext"))


@query(f"SELECT path, {LANG} AS language FROM v_files")
def src_language(t: Tables) -> DataFrame:
    return t.v_files.select("path", P.language(F.col("path")).alias("language"))


@query(f"WITH {FILES} SELECT path, {', '.join(FLAGS)} FROM f")
def src_flags(t: Tables) -> DataFrame:
    return _files(t).select("path", *FLAGS)


@query(f"""WITH {LINES} SELECT scan_id, path, count(*) FILTER (WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' AND NOT regexp_matches(trim(line, ' ' || chr(9) || chr(13)), '^(//|#|\\*)')) AS loc FROM l GROUP BY ALL""")
def src_loc(t: Tables) -> DataFrame:
    found = F.filter(F.split("content", "\n"), C.significant)
    return t.v_files.select("scan_id", "path", F.size(found).cast("long").alias("loc"))


@query(f"WITH {LINES} SELECT scan_id, path, CAST(line_no AS INT) AS line_no, line FROM l")
def src_lines(t: Tables) -> DataFrame:
    return lines(t.v_files)


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY path) AS n, sum(size) OVER (PARTITION BY scan_id ORDER BY path ROWS UNBOUNDED PRECEDING) AS bytes FROM v_files WHERE size <= 9000) "
       "SELECT s.scan_id, count(k.path) AS kept, count(*) - count(k.path) AS skipped, count(k.path) < count(*) AS truncated FROM v_files s LEFT JOIN (SELECT * FROM k WHERE n <= 40 AND bytes <= 60000) k ON s.scan_id = k.scan_id AND s.path = k.path AND s.doc_id = k.doc_id GROUP BY s.scan_id")
def src_caps(t: Tables) -> DataFrame:
    """Limits lower than the defaults, so that they cut."""
    return taken(t.v_files, max_file_bytes=9000, max_files=40, max_bytes=60_000)


MANIFEST = "CASE n " + " ".join(f"WHEN '{n}' THEN '{e}'" for n, e in P.MANIFESTS.items()) + " END"


@query(f"WITH {FILES}, m AS (SELECT scan_id, path, lower({BASE}) AS n FROM f WHERE NOT is_vendor) SELECT scan_id, path, {MANIFEST} AS ecosystem FROM m WHERE {MANIFEST} IS NOT NULL")
def src_manifests(t: Tables) -> DataFrame:
    from ..functions.scores import lookup

    f = _files(t).where("not is_vendor")
    return f.select("scan_id", "path", lookup(F.lower(P.base(F.col("path"))), P.MANIFESTS).alias("ecosystem")).where("ecosystem is not null")


_FORMS = """(SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'https://github.com/' || o || '/r' || i || '/tree/main/src' WHEN 1 THEN 'git@github.com:' || o || '/r' || i || '.git' WHEN 2 THEN o || '/r.' || i WHEN 3 THEN url WHEN 4 THEN 'github.com/settings/x' WHEN 5 THEN 'https://gist.github.com/a/b'
    WHEN 6 THEN 'https://www.github.com/' || o WHEN 7 THEN 'http://github.com/-a-/r' || i ELSE '  ' END AS address, o, i FROM (SELECT page_id, url, coalesce(nullif(regexp_extract(url, '/([a-z]+)/[0-9]+', 1), ''), 'none') AS o, CAST(page_id AS STRING) AS i FROM {pages}) z)"""


@query(f"""SELECT page_id, CASE WHEN page_id % 9 IN (0, 1, 2) THEN o END AS owner, CASE page_id % 9 WHEN 0 THEN 'r' || i WHEN 1 THEN 'r' || i WHEN 2 THEN 'r.' || i END AS name, CASE WHEN page_id % 9 = 0 THEN 'main' END AS ref,
    CASE page_id % 9 WHEN 3 THEN 'not_github' WHEN 4 THEN 'reserved_path' WHEN 5 THEN 'not_a_repository' WHEN 6 THEN 'not_a_repository' WHEN 7 THEN 'invalid_owner' WHEN 8 THEN 'empty' END AS reason FROM {_FORMS.format(pages='pages')}""")
def src_repo_ref(t: Tables) -> DataFrame:
    """References to repositories in every form that people paste, made of the pages' addresses: owner, name and ref, or why it is none."""
    forms = t.spark.sql("SELECT page_id, address FROM " + _FORMS, pages=t.pages)
    return forms.select("page_id", repository(F.col("address")).alias("r")).select("page_id", "r.*")


@query(f"WITH {FILES} SELECT scan_id, path FROM f WHERE {SOURCE}")
def flt_sources(t: Tables) -> DataFrame:
    return _files(t).where(SOURCE).select("scan_id", "path")


@query(f"WITH {FILES} SELECT scan_id, path FROM f WHERE NOT is_vendor AND NOT is_generated AND regexp_matches(content, '[Ll]icen[sc]e')")
def flt_find(t: Tables) -> DataFrame:
    return _files(t).where(~F.col("is_vendor") & ~F.col("is_generated") & F.col("content").rlike("[Ll]icen[sc]e")).select("scan_id", "path")


@query(f"SELECT path, {any_of(P.SERVER, 'lower(path)')} AS is_server, {any_of(P.AUTH, 'lower(path)')} AS is_auth, {any_of(P.DATA_ACCESS, 'lower(path)')} AS is_data_access FROM v_files")
def flt_path_class(t: Tables) -> DataFrame:
    low = F.lower("path")
    return t.v_files.select("path", P.matches(low, P.SERVER).alias("is_server"), P.matches(low, P.AUTH).alias("is_auth"), P.matches(low, P.DATA_ACCESS).alias("is_data_access"))


# Paths of entry points of frameworks.
ENTRIES = (
    r"(^|/)(page|layout|route|template|loading|error|not-found|middleware|default|head|index|main|app|server)\.(tsx?|jsx?)$",
    r"(^|/)(pages|app)/",
    r"(^|/)__init__\.py$",
    r"(^|/)(main|manage|wsgi|asgi|settings|urls)\.py$",
    r"\.config\.(ts|js|mjs)$",
    r"(^|/)(migrations)/",
)


@query(f"SELECT path, {any_of(ENTRIES, 'path')} AS is_entry FROM v_modules")
def flt_framework_entry(t: Tables) -> DataFrame:
    return t.v_modules.select("path", P.matches(F.col("path"), ENTRIES).alias("is_entry"))


def rules_sql(rules: list[Rule]) -> str:
    """CTE h: kept matches of single-line rules."""
    hits = []
    for r in rules:
        p = r.pattern.replace("'", "''")
        where = f" AND NOT regexp_matches(path, '{r.path_not}')" if r.path_not else ""
        hits.append(f"SELECT '{r.id}' AS rule_id, {r.per_scan} AS cap, scan_id, path, line_no, line, regexp_extract_all(line, '{p}') AS ms, string_split_regex(line, '{p}') AS gs FROM l WHERE length(line) <= 2000 AND regexp_matches(line, '{p}'){where}")
    filters = []
    for r in rules:
        if r.exclude:
            filters.append(f"(rule_id <> '{r.id}' OR NOT regexp_matches(line, '{r.exclude}'))")
        if r.nearby:
            pattern, before, after, must = r.nearby
            filters.append(f"(rule_id <> '{r.id}' OR {'' if must else 'NOT '}EXISTS (SELECT 1 FROM l n WHERE n.scan_id = c2.scan_id AND n.path = c2.path AND n.line_no BETWEEN c2.line_no - {before} AND c2.line_no + {after} AND regexp_matches(n.line, '{pattern}')))")
    return f"""{FILES}, {SEARCHED}, a AS ({' UNION ALL '.join(hits)}),
    e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM a),
    c0 AS (SELECT rule_id, cap, scan_id, path, line_no, line, ms[k] AS match, 1 + list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda g: length(g))), 0) AS col FROM e),
    c1 AS (SELECT *, row_number() OVER (PARTITION BY rule_id, scan_id, path ORDER BY line_no, col) AS in_file FROM c0),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY rule_id, scan_id ORDER BY path, line_no, col) AS in_scan FROM c1 WHERE in_file <= 4),
    h AS (SELECT rule_id, scan_id, path, CAST(line_no AS INT) AS line, CAST(col AS INT) AS "column", line AS text, match FROM c2 WHERE in_scan <= cap AND {' AND '.join(filters) or 'true'})"""


@query(f"WITH {rules_sql(TEXT_RULES)} SELECT * FROM h")
def rules_run(t: Tables) -> DataFrame:
    return search(_files(t), TEXT_RULES)


@query(f"WITH {rules_sql(TEXT_RULES[:1])} SELECT * FROM h")
def flt_search(t: Tables) -> DataFrame:
    return search(_files(t), TEXT_RULES[:1])


@query(f"WITH {rules_sql(TEXT_RULES[1:2])} SELECT * FROM h")
def flt_exclude_line(t: Tables) -> DataFrame:
    return search(_files(t), TEXT_RULES[1:2])


@query(f"WITH {rules_sql(TEXT_RULES[3:])} SELECT * FROM h")
def flt_nearby(t: Tables) -> DataFrame:
    return search(_files(t), TEXT_RULES[3:])


@query(f"WITH {rules_sql(TEXT_RULES)} SELECT scan_id, rule_id, count(*) AS matches FROM h GROUP BY ALL")
def rule_match_counts(t: Tables) -> DataFrame:
    return rules_run(t).groupBy("scan_id", "rule_id").agg(F.count("*").alias("matches"))


@query("SELECT scan_id, bool_or(regexp_matches(content, '[Ll]icen[sc]e')) AS has_licence, bool_or(contains(content, '@')) AS has_mail FROM v_files GROUP BY scan_id")
def flt_exists(t: Tables) -> DataFrame:
    return t.v_files.groupBy("scan_id").agg(F.bool_or(F.col("content").rlike("[Ll]icen[sc]e")).alias("has_licence"), F.bool_or(F.contains("content", F.lit("@"))).alias("has_mail"))


@query(f"""WITH {rules_sql(TEXT_RULES[2:3])} SELECT h.scan_id, h.path, h.line, greatest(h.line - 2, 1) AS start_line,
    (SELECT string_agg(l.line, chr(10) ORDER BY line_no) FROM l WHERE l.scan_id = h.scan_id AND l.path = h.path AND line_no BETWEEN h.line - 2 AND h.line + 2) AS snippet FROM h""")
def flt_snippet(t: Tables) -> DataFrame:
    """The lines around a match; files are joined by path, and sliced."""
    hits = search(_files(t), TEXT_RULES[2:3]).select("scan_id", "path", "line")
    f = t.v_files.select("scan_id", "path", F.split("content", "\n").alias("lines"))
    start = F.greatest(F.col("line") - 2, F.lit(1))
    return hits.join(f, ["scan_id", "path"]).select("scan_id", "path", "line", start.alias("start_line"), F.array_join(F.slice("lines", start, F.col("line") + 2 - start + 1), "\n").alias("snippet"))


WIDE = Rule("txt.wide", r"[.]\n[A-Z][a-z]+ [a-z]+", join_lines=2, per_scan=30)


@query(f"""WITH {FILES}, {SEARCHED}, w AS (SELECT *, lead(line) OVER (PARTITION BY scan_id, path ORDER BY line_no) AS next FROM l),
    m AS (SELECT scan_id, path, line_no, line, next, regexp_extract(line || chr(10) || next, '[.]\\n[A-Z][a-z]+ [a-z]+') AS match FROM w WHERE next IS NOT NULL AND length(line) + length(next) + 1 <= 4000),
    c AS (SELECT *, row_number() OVER (PARTITION BY scan_id, path ORDER BY line_no) AS in_file FROM m WHERE match <> ''),
    d AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY path, line_no) AS in_scan FROM c WHERE in_file <= 4)
    SELECT 'txt.wide' AS rule_id, scan_id, path, CAST(line_no AS INT) AS line, CAST(length(line) AS INT) AS "column", line || ' ' || next AS text, match FROM d WHERE in_scan <= 30""")
def flt_search_window(t: Tables) -> DataFrame:
    """A pattern over joined lines."""
    return search(_files(t), [WIDE])


PLACEHOLDER = r"(?i)example|placeholder|changeme|xxxx|your[_-]"
#: Formats of credentials: (kind, pattern, the group that is the value). Assignments are reported if their value is as random as a key.
CREDENTIALS = (
    ("stripe-live-key", r"\b(sk_live_[A-Za-z0-9]{16,})"), ("sendgrid-key", r"\b(SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})"), ("connection-string", r"\b([a-z][a-z0-9+]*://[^:/\s]+:[^@\s]+@[^\s\"']+)"), ("aws-access-key", r"\b(AKIA[A-Z0-9]{16})\b"),
    ("github-token", r"\b(gh[pousr]_[A-Za-z0-9]{20,})"), ("private-key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"), ("slack-token", r"\b(xox[abpr]-[A-Za-z0-9-]{10,})"), ("assignment", r"[A-Za-z_]+ = \"([^\"\s]{20,})\""),
)


def _quote(p: str) -> str:
    return p.replace("'", "''")


@query(f"""WITH m AS ({' UNION ALL '.join(f"SELECT scan_id, path, '{k}' AS kind, unnest(regexp_extract_all(content, '{_quote(p)}', 1)) AS value FROM v_files" for k, p in CREDENTIALS)}), d AS (SELECT *, row_number() OVER () AS rn FROM m),
    c AS (SELECT rn, ch, count(*) AS n FROM (SELECT rn, unnest(string_split(value, '')) AS ch FROM d WHERE kind = 'assignment') GROUP BY ALL), t AS (SELECT rn, sum(n) AS total FROM c GROUP BY rn), h AS (SELECT c.rn, round(-sum(n / total * log2(n / total)), 6) AS bits FROM c JOIN t USING (rn) GROUP BY c.rn)
    SELECT scan_id, path, 'sec.secret.' || kind AS rule_id, substr(value, 1, 4) || '…' || right(value, 4) AS masked, NOT regexp_matches(value, '{PLACEHOLDER}') AS reported FROM d LEFT JOIN h USING (rn) WHERE kind <> 'assignment' OR bits >= 3.5
    UNION ALL SELECT scan_id, path, 'sec.secret.env-committed', '', true FROM v_files WHERE regexp_matches(path, '(^|/)[.]env([.][a-z]+)?$') AND NOT regexp_matches(path, 'example|sample|template')""")
def sec_secret_scan(t: Tables) -> DataFrame:
    """Credentials by vendors' formats and by entropy, and committed environment files: placeholders are marked, values masked (sec_placeholder, sec_mask). One pass over a file's text."""
    from ..operators.findings import mask

    held = lambda kind, pattern: F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    found = F.flatten(F.array(*[held(k, p) for k, p in CREDENTIALS]))
    rows = t.v_files.select("scan_id", "path", F.explode(found).alias("s")).select("scan_id", "path", "s.*").where((F.col("kind") != "assignment") | (F.round(C.entropy(F.col("value")), 6) >= 3.5))
    hits = rows.select("scan_id", "path", F.concat(F.lit("sec.secret."), "kind").alias("rule_id"), mask(F.col("value")).alias("masked"), (~F.col("value").rlike(PLACEHOLDER)).alias("reported"))
    env = t.v_files.where(F.col("path").rlike(r"(^|/)\.env(\.[a-z]+)?$") & ~F.col("path").rlike("example|sample|template"))
    return hits.unionByName(env.select("scan_id", "path", F.lit("sec.secret.env-committed").alias("rule_id"), F.lit("").alias("masked"), F.lit(True).alias("reported")))


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(content, '[A-Za-z_]+ = "([^"]+)"', 1)) AS value FROM v_files), d AS (SELECT doc_id, value, row_number() OVER () AS rn FROM m),
    c AS (SELECT rn, ch, count(*) AS n FROM (SELECT rn, unnest(string_split(value, '')) AS ch FROM d) GROUP BY ALL), t AS (SELECT rn, sum(n) AS total FROM c GROUP BY rn),
    h AS (SELECT c.rn, -sum(n / total * log2(n / total)) AS bits FROM c JOIN t USING (rn) GROUP BY c.rn)
    SELECT doc_id, round(bits, 6) AS bits, bits >= 3.5 AND length(value) >= 20 AS secret_like FROM d JOIN h USING (rn)""")
def sec_entropy(t: Tables) -> DataFrame:
    found = t.v_files.select("doc_id", F.explode(F.regexp_extract_all("content", F.lit('[A-Za-z_]+ = "([^"]+)"'), F.lit(1))).alias("value")).withColumn("bits", C.entropy(F.col("value")))
    return found.select("doc_id", F.round("bits", 6).alias("bits"), ((F.col("bits") >= 3.5) & (F.length("value") >= 20)).alias("secret_like"))


LOG_FORMATS = (r"gh[pousr]_[A-Za-z0-9]{20,}", r"sk_live_[A-Za-z0-9]{16,}", r"AKIA[A-Z0-9]{16}", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", r"[0-9a-f]{40}", r"Bearer [A-Za-z0-9._-]{16,}")


def _log_sql(text: str) -> str:
    for p in LOG_FORMATS:
        text = f"regexp_replace({text}, '{p}', '[redacted]', 'g')"
    return text


@query(f"SELECT doc_id, md5(substr({_log_sql('content')}, 1, 2000)) AS safe FROM v_files")
def sec_log_redact(t: Tables) -> DataFrame:
    """Token formats are masked, and what a log keeps of a text is its first 2000 characters."""
    c = F.col("content")
    for p in LOG_FORMATS:
        c = F.regexp_replace(c, p, "[redacted]")
    return t.v_files.select("doc_id", F.md5(F.substring(c, 1, 2000).cast("binary")).alias("safe"))


LOC = "len(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '' AND NOT regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '^(//|#|\\*)')))"
STAT = f"WITH {FILES}, n AS (SELECT *, {LOC} AS loc FROM f)"


def _sized(t: Tables) -> DataFrame:
    return _files(t).withColumn("loc", F.size(F.filter(F.split("content", "\n"), C.significant)).cast("long"))


@query(f"{STAT} SELECT scan_id, CAST(sum(loc) AS BIGINT) AS loc, count(*) FILTER (WHERE is_test) AS test_files, count(*) FILTER (WHERE is_code AND NOT is_test AND NOT is_vendor AND NOT is_generated) AS source_files FROM n GROUP BY scan_id")
def agg_repo_stats(t: Tables) -> DataFrame:
    return _sized(t).groupBy("scan_id").agg(F.sum("loc").alias("loc"), F.count_if("is_test").alias("test_files"), F.count_if(F.expr("is_code and not is_test and not is_vendor and not is_generated")).alias("source_files"))


@query(f"""{STAT}, g AS (SELECT scan_id, language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM n WHERE NOT is_vendor AND NOT is_generated GROUP BY ALL),
    r AS (SELECT *, round(loc / sum(loc) OVER (PARTITION BY scan_id), 6) AS share, row_number() OVER (PARTITION BY scan_id ORDER BY loc DESC, language) AS place FROM g) SELECT scan_id, language, files, loc, share FROM r WHERE place <= 8""")
def agg_language_stats(t: Tables) -> DataFrame:
    g = _sized(t).where("not is_vendor and not is_generated").groupBy("scan_id", "language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    scan = Window.partitionBy("scan_id")
    g = g.withColumn("share", F.round(F.col("loc") / F.sum("loc").over(scan), 6)).withColumn("place", F.row_number().over(scan.orderBy(F.desc("loc"), "language")))
    return g.where("place <= 8").drop("place")


@query(f"{STAT}, r AS (SELECT scan_id, path, loc, row_number() OVER (PARTITION BY scan_id ORDER BY loc DESC, path) AS place FROM n WHERE {SOURCE}) SELECT scan_id, path, CAST(loc AS BIGINT) AS loc, CAST(place AS INT) AS place FROM r WHERE place <= 8")
def agg_topfiles(t: Tables) -> DataFrame:
    s = _sized(t).where(SOURCE)
    return s.select("scan_id", "path", "loc", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("loc"), "path")).alias("place")).where("place <= 8")


@query("SELECT DISTINCT scan_id, string_split(path, '/')[1] AS dir FROM v_files WHERE contains(path, '/')")
def fn_top_dirs(t: Tables) -> DataFrame:
    return t.v_files.where(F.contains("path", F.lit("/"))).select("scan_id", F.split("path", "/")[0].alias("dir")).distinct()


NORM = r"""CASE WHEN length(tr) >= 12 AND NOT regexp_matches(tr, '^(?:\/\/|#|\*|\/\*)|^(?:import|from|export|package|using)\b|^[{}()\[\];,]+$')
    THEN regexp_replace(regexp_replace(regexp_replace(tr, '\s+', ' ', 'g'), '[''"][^''"]*[''"]', 'S', 'g'), '\b\d+\b', 'N', 'g') END"""
TRIMMED = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"


@query(f"WITH {LINES} SELECT path, CAST(line_no AS INT) AS line_no, {NORM} AS norm FROM (SELECT *, {TRIMMED} AS tr FROM l)")
def fn_normalize_line(t: Tables) -> DataFrame:
    return lines(t.v_files).select("path", "line_no", C.normalize_line(F.col("line")).alias("norm"))


BARE = "line"
for _pattern, _new in ((r"\\.", ""), ("''[^'']*''", "''''"), ('"[^"]*"', '""'), ("`[^`]*`", "``"), ("//.*$", ""), ("#.*$", "")):
    BARE = f"regexp_replace({BARE}, '{_pattern}', '{_new}', 'g')"


@query(f"WITH {LINES} SELECT path, CAST(line_no AS INT) AS line_no, md5({BARE}) AS bare FROM l")
def fn_strip_literals(t: Tables) -> DataFrame:
    return lines(t.v_files).select("path", "line_no", F.md5(C.strip_literals(F.col("line")).cast("binary")).alias("bare"))


@query(r"""SELECT path, len(regexp_extract_all(content, '\b(?:if|else\s+if|elif|for|while|case|catch|except|switch)\b|\?\?|\?\.|&&|\|\||\?')) AS decisions FROM v_files""")
def fn_decisions(t: Tables) -> DataFrame:
    """Prose holds no nullish or optional operators beside comparisons, so the SQL can do without look-around."""
    return t.v_files.select("path", C.decisions(F.col("content")).cast("long").alias("decisions"))


IGNORES = (("src/db/", (), False), ("*.py", ("txt.mail",), False), ("src/db/f1*", (), True), ("/tests/**/f*.ts", ("txt.",), False))


@query(f"""WITH {rules_sql(TEXT_RULES)}, r AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{P.glob_to_regex(g)}', '{s[0] if s else ''}', {str(n).lower()})" for i, (g, s, n) in enumerate(IGNORES))}) v(no, pattern, scope, negated)),
    x AS (SELECT h.rule_id, h.path, h.line, h."column", arg_max(NOT negated, no) AS suppressed FROM h JOIN r ON regexp_matches(h.path, pattern) AND (scope = '' OR rule_id = scope OR scope LIKE '%.' AND starts_with(rule_id, scope)) GROUP BY ALL)
    SELECT h.rule_id, h.path, h.line, h."column", coalesce(suppressed, false) AS suppressed FROM h LEFT JOIN x USING (rule_id, path, line, "column")""")
def join_suppress_glob(t: Tables) -> DataFrame:
    """Ignore rules over findings: the last rule that matches path and scope decides, and a negated one brings back. The rules are a few columns, no join."""
    hits = rules_run(t)
    verdict = F.lit(False)
    for glob, scopes, negated in IGNORES:
        hit = F.col("path").rlike(P.glob_to_regex(glob)) & P.in_scope(F.col("rule_id"), F.array(*map(F.lit, scopes)).cast("array<string>"))
        verdict = F.when(hit, F.lit(not negated)).otherwise(verdict)
    return hits.select("rule_id", "path", "line", "column", verdict.alias("suppressed"))


@query(f"WITH {FILES}, s AS (SELECT scan_id, count(*) FILTER (WHERE is_test) AS tests, count(*) FILTER (WHERE {SOURCE}) AS sources FROM f GROUP BY scan_id) "
       "SELECT scan_id, CASE WHEN tests = 0 AND sources > 5 THEN 'test.none' WHEN tests < 0.15 * sources AND sources > 15 THEN 'test.thin-coverage' END AS rule_id, tests, sources FROM s")
def det_tests(t: Tables) -> DataFrame:
    """det_tests_none and det_tests_thin."""
    s = _files(t).groupBy("scan_id").agg(F.count_if("is_test").alias("tests"), F.count_if(F.expr(SOURCE)).alias("sources"))
    rule = F.when((F.col("tests") == 0) & (F.col("sources") > 5), "test.none").when((F.col("tests") < 0.15 * F.col("sources")) & (F.col("sources") > 15), "test.thin-coverage")
    return s.select("scan_id", rule.alias("rule_id"), "tests", "sources")


