"""Queries over files that hold, for every shipped rule, code that it reports or code that it nearly reports, between whole texts as comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import rules as R
from ..operators.search import SPAN_CHARS, Rule, search
from .registry import VIEWS, Tables, query

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


def _text(s: str) -> str:
    """SQL text; a dollar sign and a brace apart, as Spark would take them for a variable."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("${", "$' || '{") + "'"


def _pick(i: int) -> str:
    """Item ``i`` of the case that a document's number stands for."""
    return "CASE doc_id % " + str(len(CASES)) + "".join(f" WHEN {k} THEN {_text(c[i])}" for k, c in enumerate(CASES.values())) + " END"


#: Documents 0 to 2 n - 1 of each scan are the n cases, first as reported code, then as the other; ``mark`` begins a comment.
VIEWS["v_rule_files"] = f"""SELECT scan_id, doc_id, replace(spot, '/x.', '/x' || CAST(doc_id AS STRING) || '.') AS path, language, mark || replace(text, chr(10), chr(10) || mark) || chr(10) || code || chr(10) || mark || substr(text, 1, 80) AS content FROM (
    SELECT CAST(floor(doc_id / {2 * len(CASES)}.0) AS BIGINT) AS scan_id, doc_id, coalesce(text, '') AS text, spot, code, CASE WHEN spot LIKE '%.py' THEN 'Python' ELSE 'TypeScript' END AS language, CASE WHEN spot LIKE '%.py' THEN '# ' ELSE '// ' END AS mark
    FROM (SELECT doc_id, text, {_pick(0)} AS spot, CASE WHEN doc_id % {2 * len(CASES)} < {len(CASES)} THEN {_pick(1)} ELSE {_pick(2)} END AS code FROM documents) x) y"""

#: What SQL's engine lacks: a look ahead, a back reference. The pattern without it, and what has to hold of a match besides.
OTHERWISE = {
    "sec.unsafe-deserialization": (r"pickle\.loads?\s*\(|yaml\.load\s*\(|marshal\.loads\s*\(|unserialize\s*\(", r"NOT regexp_matches(t, 'yaml\.load\s*\([^)]*SafeLoader')"),
    "ai.redundant-wrapper": (r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)\s*\{\s*return\s+(?:await\s+)?\w+\(\s*([^()]*?)\s*\)\s*;?\s*\}", "regexp_extract(t, {p}, 2) = regexp_extract(t, {p}, 3)"),
}


def _rule_sql(r: Rule) -> str:
    """Files in which the rule keeps a match; the first match of each window of lines is looked at."""
    pattern, also = OTHERWISE.get(r.id, (r.pattern, None))
    p, q = _text(pattern), lambda x: "'" + x.replace("'", "''") + "'"
    tests = [f"length(t) <= {SPAN_CHARS * r.join_lines}", f"regexp_matches(t, {p})"] + ([f"language IN ({', '.join(map(q, r.languages))})"] if r.languages else [])
    tests += ([f"regexp_matches(path, {q(r.path)})"] if r.path else []) + ([f"NOT regexp_matches(path, {q(r.path_not)})"] if r.path_not else []) + ([also.format(p=p)] if also else [])
    window = f"array_to_string(ls[i:i + {r.join_lines - 1}], chr(10))"
    lines_in = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"
    keep = ["true"] + ([f"NOT regexp_matches(array_to_string(ls[spot:spot + {lines_in('m')}], ' '), {q(r.exclude)})"] if r.exclude else [])
    if r.nearby:
        near, up, down, must = r.nearby
        keep.append(f"{'' if must else 'NOT '}regexp_matches(array_to_string(ls[greatest(spot - {up}, 1):spot + {down}], chr(10)), {q(near)})")
    found = f"SELECT *, i + {lines_in('left(t, strpos(t, m) - 1)')} AS spot FROM (SELECT *, regexp_extract(t, {p}) AS m FROM (SELECT *, {window} AS t FROM w) WHERE {' AND '.join(tests)})"
    return f"SELECT scan_id, path, '{r.id}' AS rule_id FROM ({found}) WHERE {' AND '.join(keep)}"


@query(f"WITH f AS (SELECT scan_id, path, language, string_split(content, chr(10)) AS ls FROM v_rule_files), w AS (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM f) " + " UNION ".join(map(_rule_sql, R.SHIPPED)))
def rules_cases(t: Tables) -> DataFrame:
    """Every shipped rule, with its joined lines, nearby lines, path and exclusions, over files of which half hold what one of them reports."""
    f = t.v_rule_files.withColumn("language", P.language(F.col("path")))
    return search(f.withColumns(P.flags(F.col("path"), F.col("language"))), R.SHIPPED).select("scan_id", "path", "rule_id").distinct()
