"""The shipped rules. Each is a row of the rule table that ``search`` runs; their patterns, levels and caps are fixed values."""

from __future__ import annotations

from pyspark.sql import Column

from ..functions.paths import BACKEND, JS, PYTHON
from ..functions.scores import lookup
from .search import Rule

# Fixed values from here on.
USER_INPUT = r"\b(req\.(body|query|params|headers|cookies)|request\.(body|query|args|form|GET|POST|json)|ctx\.request|searchParams|params\.|formData|event\.body|input\.|userInput|user_input)\b"

SECURITY = [
    Rule("sec.sql-injection", r"""(?i)(?:query|execute|exec|raw|rawQuery|queryRaw|executeRaw)\s*\(\s*(?:`[^`]*\$\{|['"][^'"]*['"]\s*\+|f['"])""", "security", "critical", 0.78, "unparameterised-queries", 40, BACKEND, exclude=r"(?i)\$\d|\?\s*[,)]|:\w+\s*[,)]|prepared|placeholder", join_lines=3),
    Rule("sec.command-injection", r"""(?:child_process\.)?(?:exec|execSync|spawn|spawnSync)\s*\(\s*[`'"][^`'"]*(?:\$\{|['"]\s*\+)|os\.system\s*\(\s*f?['"]|subprocess\.[a-z]+\([^)]*shell\s*=\s*True""", "security", "critical", 0.8, "unsafe-shell-usage", 45, BACKEND, join_lines=3),
    Rule("sec.eval-usage", r"""\b(?:eval|new\s+Function|vm\.runInNewContext)\s*\(|\bexec\s*\(\s*f?['"]""", "security", "high", 0.72, "unsafe-dynamic-execution", 60, (*JS, *PYTHON), exclude=r"eslint|\/\/|#\s|safeEval"),
    Rule("sec.ssrf", r"(?:fetch|axios(?:\.(?:get|post|put|delete|request))?|got|request|urllib\.request\.urlopen|requests\.(?:get|post))\s*\(\s*(?:req\.|request\.|params|url|target|endpoint|body\.|query\.)", "security", "high", 0.66, "unvalidated-outbound-requests", 50, BACKEND, path_not=r"\.test\.|\.spec\.", exclude=r"(?i)allowlist|allowList|whitelist|isAllowedHost|URL_ALLOWLIST", join_lines=2),
    Rule("sec.path-traversal", r"(?:readFile|readFileSync|createReadStream|sendFile|open|unlink|writeFile)\s*\(\s*(?:path\.join\s*\(\s*)?[^)]*(?:req\.|request\.|params\.|query\.|body\.)", "security", "high", 0.7, "unvalidated-filesystem-paths", 35, BACKEND, exclude=r"(?i)basename|sanitiz|normalize.*startsWith|resolve.*startsWith", join_lines=2),
    Rule("sec.xss-dangerous-html", r"dangerouslySetInnerHTML|\.innerHTML\s*=|v-html\s*=|\.outerHTML\s*=", "security", "high", 0.68, "unescaped-output", 30, JS, exclude=r"(?i)DOMPurify|sanitize|sanitiz"),
    Rule("sec.weak-hash", r"""(?i)createHash\s*\(\s*['"](?:md5|sha1)['"]|hashlib\.(?:md5|sha1)\s*\(|MessageDigest\.getInstance\s*\(\s*"(?:MD5|SHA-?1)\"""", "security", "medium", 0.88, "weak-cryptography", 25, BACKEND),
    Rule("sec.insecure-random", r"(?i)(?:token|secret|nonce|otp|reset|session|apiKey|api_key|password)[^=\n]{0,30}=\s*[^\n]*Math\.random\s*\(|random\.(?:random|randint|choice)\s*\([^)]*\)\s*(?:#[^\n]*)?$", "security", "high", 0.74, "weak-cryptography", 20, BACKEND),
    Rule("sec.jwt-unverified", r"""(?i)jwt\.decode\s*\(|verify\s*:\s*false|algorithms\s*:\s*\[\s*['"]none['"]|verify_signature['"]?\s*:\s*False|options\s*=\s*\{\s*['"]verify_signature['"]\s*:\s*False""", "security", "critical", 0.84, "auth-trust-boundary", 40, BACKEND, exclude=r"(?i)jwt\.decode\([^)]*verify\s*=\s*True"),
    Rule("sec.tls-verification-disabled", r"""rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0|verify\s*=\s*False|InsecureSkipVerify\s*:\s*true""", "security", "high", 0.92, "weak-transport-security", 30, BACKEND),
    Rule("sec.cors-wildcard", r"""Access-Control-Allow-Origin['"]?\s*[,:]\s*['"]\*|origin\s*:\s*true|cors\s*\(\s*\{\s*origin\s*:\s*['"]\*""", "security", "medium", 0.8, "permissive-configuration", 20),
    Rule("sec.insecure-cookie", r"""(?i)httpOnly\s*:\s*false|secure\s*:\s*false|sameSite\s*:\s*['"]none['"]""", "security", "medium", 0.75, "permissive-configuration", 15),
    Rule("sec.open-redirect", r"redirect\s*\(\s*(?:req\.(?:query|body|params)|request\.(?:args|form)|params\.)", "security", "medium", 0.72, "unvalidated-redirects", 20, BACKEND, exclude=r"""startsWith\s*\(\s*['"]\/"""),
    Rule("sec.unsafe-deserialization", r"pickle\.loads?\s*\(|yaml\.load\s*\((?![^)]*SafeLoader)|marshal\.loads\s*\(|unserialize\s*\(", "security", "critical", 0.86, "unsafe-dynamic-execution", 45, join_lines=2),
    Rule("sec.debug-enabled", r"""DEBUG\s*[:=]\s*(?:True|true|1)\b|app\.run\s*\([^)]*debug\s*=\s*True|NODE_ENV\s*=\s*['"]?development""", "security", "medium", 0.8, "permissive-configuration", 15, path_not=r"(?i)\.test\.|\.spec\.|example|sample"),
    Rule("sec.mass-assignment", r"(?:create|update|updateOne|findOneAndUpdate|save|insert|bulkCreate)\s*\(\s*\{?\s*(?:data\s*:\s*)?(?:req\.body|request\.(?:json|form|data)|body)\s*[,)}]", "security", "high", 0.7, "missing-input-validation", 35, BACKEND, join_lines=2),
    Rule("sec.unvalidated-input", USER_INPUT, "security", "medium", 0.55, "missing-input-validation", 25, BACKEND, path=r"(?i)(^|\/)(api|routes?|controllers?|handlers?)(\/|$)|\/route\.(ts|js)$", nearby=(r"(?i)\b(zod|z\.object|yup|joi|valibot|superstruct|pydantic|BaseModel|schema\.parse|safeParse|validate\()", 25, 25, False), per_scan=25),
]
RELIABILITY = [
    Rule("bug.empty-catch", r"catch\s*(?:\([^)]*\))?\s*\{\s*\}|except[^:]*:\s*pass\b|catch\s*\{\s*\/\/|rescue\s*$", "reliability", "medium", 0.86, "silent-failure-handling", 20),
    Rule("bug.unhandled-json-parse", r"JSON\.parse\s*\(", "reliability", "medium", 0.7, "missing-input-validation", 15, JS, nearby=(r"try\s*\{|\.catch\(|safeParse|tryParse", 6, 2, False)),
    Rule("bug.missing-timeout", r"\b(?:await\s+)?(?:fetch|axios\.(?:get|post|put|delete)|got|requests\.(?:get|post|put))\s*\(", "reliability", "medium", 0.62, "missing-failure-handling", 20, BACKEND, nearby=(r"(?i)timeout|AbortSignal|AbortController|signal\s*:|deadline", 4, 8, False), per_scan=20),
    Rule("bug.floating-money", r"(?i)\b(?:price|amount|total|subtotal|balance|cost|fee|tax)\w*\s*[*+\-/]\s*\w+|parseFloat\s*\(\s*[^)]*(?:price|amount|total)", "reliability", "high", 0.6, "money-precision", 90, path=r"(?i)(payment|billing|checkout|order|invoice|cart|price)"),
    Rule("bug.unchecked-array-index", r"(?:\bfind\s*\([^)]*\)|\bfilter\s*\([^)]*\)|rows|results|items)\s*\[\s*0\s*\]\s*\.", "reliability", "medium", 0.55, "missing-null-checks", 10, JS, exclude=r"\?\.|\?\?|if\s*\("),
    Rule("bug.await-in-loop-no-error", r"for\s*\([^)]*\)\s*\{[^}]*await\s", "reliability", "medium", 0.55, "missing-failure-handling", 25, JS, nearby=(r"try\s*\{|allSettled|\.catch\(", 3, 12, False), per_scan=15),
    Rule("bug.process-exit", r"process\.exit\s*\(|sys\.exit\s*\(|os\._exit\s*\(", "reliability", "medium", 0.82, "missing-failure-handling", 20, path_not=r"(?i:(^|\/)(bin|scripts?|cli|cmd|tools)(\/|$))|main\.(ts|js|py|go)$"),
    Rule("bug.missing-await", r"^\s*(?:this\.)?\w+(?:\.\w+)*\.(?:save|update|create|delete|insert|send|publish|emit|write|commit|flush)\s*\([^)]*\)\s*;?\s*$", "reliability", "medium", 0.58, "silent-failure-handling", 10, JS, exclude=r"await|return|\.then|\.catch|void\s|=\s", per_scan=20),
    Rule("bug.bare-except", r"^\s*except\s*:\s*$|except\s+Exception\s*:\s*$", "reliability", "medium", 0.85, "silent-failure-handling", 15, PYTHON),
]
PERFORMANCE = [
    Rule("perf.n-plus-one", r"(?:for\s*\(|forEach\s*\(|\.map\s*\(\s*async|while\s*\()[^\n]*$", "performance", "high", 0.72, "n-plus-one-access", 60, BACKEND, nearby=(r"await\s+(?:\w+\.)*(?:findUnique|findFirst|findOne|findById|find|query|select|get|fetchOne|execute)\s*\(", 0, 6, True), per_scan=20),
    Rule("perf.sync-io-in-handler", r"\b(?:readFileSync|writeFileSync|readdirSync|existsSync|execSync)\s*\(", "performance", "medium", 0.78, "blocking-event-loop", 25, JS, path=r"(?i:(^|\/)(api|routes?|controllers?|handlers?|server|middleware)(\/|$))|\/route\.(ts|js)$"),
    Rule("perf.unbounded-query", r"""(?i)findMany\s*\(\s*\)|\.find\s*\(\s*\{?\s*\}?\s*\)|SELECT\s+\*\s+FROM\s+\w+\s*(?:;|['"`])""", "performance", "medium", 0.6, "unbounded-data-access", 30, BACKEND, exclude=r"(?i)take|limit|first|LIMIT|\.count", join_lines=2),
    Rule("perf.nested-linear-search", r"(?:for\s*\(|\.forEach\s*\(|\.map\s*\()[^\n]*$", "performance", "medium", 0.65, "quadratic-algorithms", 30, JS, nearby=(r"\.(?:find|filter|includes|indexOf|some)\s*\(", 0, 4, True), per_scan=15),
    Rule("perf.barrel-import", r"""import\s+(?:\*\s+as\s+\w+|_|moment)\s+from\s+['"](?:lodash|moment|rxjs|date-fns|@aws-sdk\/client-\w+)['"]""", "performance", "low", 0.8, "bundle-weight", 15, JS),
    Rule("perf.missing-react-memo-key", r"key\s*=\s*\{\s*(?:index|i|idx)\s*\}", "performance", "low", 0.82, "react-reconciliation", 10, JS),
]
AI_CODE = [
    Rule("ai.placeholder-implementation", r"""(?i)throw new Error\s*\(\s*['"](?:not implemented|unimplemented|todo)""", "ai-code", "high", 0.88, "incomplete-implementations", 60),
    Rule("ai.todo-implement", r"(?:\/\/|#|\*)\s*(?:TODO|FIXME|HACK|XXX)\b[:\s]", "ai-code", "low", 0.9, "incomplete-implementations", 20, path_not=r"(?i)\.(md|mdx|txt)$", per_scan=30),
    Rule("ai.redundant-wrapper", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)\s*\{\s*return\s+(?:await\s+)?\w+\(\s*\2\s*\)\s*;?\s*\}", "ai-code", "low", 0.7, "unnecessary-indirection", 15, JS),
    Rule("ai.inconsistent-error-shape", r"return\s*\{\s*(?:error|success)\s*:", "ai-code", "medium", 0.55, "inconsistent-error-contract", 45, JS, nearby=(r"throw new", 30, 30, True), per_scan=15),
    Rule("ai.console-logging", r"console\.(?:log|debug|info)\s*\(", "ai-code", "low", 0.85, "no-logging-strategy", 30, JS, path_not=r"(scripts?|bin|cli|tools)\/", per_scan=25),
    Rule("ai.magic-config", r"""https?:\/\/(?:localhost|127\.0\.0\.1|\w+\.(?:com|io|dev|net))[^\s'"`)]*""", "ai-code", "low", 0.6, "hardcoded-configuration", 20, path_not=r"(?i)(test|spec|example|readme|doc)", exclude=r"(?i)(?:@|https?:\/\/(?:github|cwe\.mitre|owasp|developer\.mozilla|www\.w3))", per_scan=20),
]
SHIPPED = [*SECURITY, *RELIABILITY, *PERFORMANCE, *AI_CODE]

# The weakness that a rule reports (CWE) and its class (OWASP top ten), if it has one.
INJECTION, ACCESS, CONFIGURATION = "A03:2021 Injection", "A01:2021 Broken Access Control", "A05:2021 Security Misconfiguration"
WEAKNESSES: dict[str, tuple[str, str | None]] = {
    "sec.sql-injection": ("CWE-89", INJECTION),
    "sec.command-injection": ("CWE-78", INJECTION),
    "sec.eval-usage": ("CWE-95", INJECTION),
    "sec.ssrf": ("CWE-918", "A10:2021 Server-Side Request Forgery"),
    "sec.path-traversal": ("CWE-22", ACCESS),
    "sec.xss-dangerous-html": ("CWE-79", INJECTION),
    "sec.weak-hash": ("CWE-327", None),
    "sec.insecure-random": ("CWE-338", None),
    "sec.jwt-unverified": ("CWE-347", "A07:2021 Identification and Authentication Failures"),
    "sec.tls-verification-disabled": ("CWE-295", None),
    "sec.cors-wildcard": ("CWE-942", CONFIGURATION),
    "sec.insecure-cookie": ("CWE-1004", None),
    "sec.open-redirect": ("CWE-601", None),
    "sec.unsafe-deserialization": ("CWE-502", "A08:2021 Software and Data Integrity Failures"),
    "sec.debug-enabled": ("CWE-489", CONFIGURATION),
    "sec.mass-assignment": ("CWE-915", ACCESS),
    "sec.unvalidated-input": ("CWE-20", None),
    "dep.known-vulnerability": ("CWE-1395", "A06:2021 Vulnerable and Outdated Components"),
}


def cwe(rule_id: Column) -> Column:
    return lookup(rule_id, {r: w for r, (w, _) in WEAKNESSES.items()})


def owasp(rule_id: Column) -> Column:
    return lookup(rule_id, {r: c for r, (_, c) in WEAKNESSES.items() if c})
