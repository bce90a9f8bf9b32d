"""Column helpers for file paths: names, languages, classes, globs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import lookup

# Languages by extension and by file name, source languages, vendored folders, manifests.
EXT_LANGUAGE = {
    "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "py": "Python", "pyi": "Python", "rb": "Ruby", "go": "Go", "rs": "Rust", "java": "Java", "kt": "Kotlin", "kts": "Kotlin", "swift": "Swift", "c": "C", "h": "C",
    "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "cs": "C#", "php": "PHP", "scala": "Scala", "ex": "Elixir", "exs": "Elixir", "erl": "Erlang", "clj": "Clojure",
    "dart": "Dart", "lua": "Lua", "sh": "Shell", "bash": "Shell", "zsh": "Shell", "ps1": "PowerShell", "sql": "SQL", "graphql": "GraphQL", "gql": "GraphQL",
    "proto": "Protocol Buffers", "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "SCSS", "sass": "Sass", "less": "Less", "vue": "Vue", "svelte": "Svelte",
    "astro": "Astro", "json": "JSON", "jsonc": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "ini": "INI", "xml": "XML", "md": "Markdown", "mdx": "MDX",
    "rst": "reStructuredText", "tf": "HCL", "hcl": "HCL", "dockerfile": "Dockerfile", "gradle": "Gradle", "make": "Makefile", "prisma": "Prisma", "env": "Dotenv",
}
NAME_LANGUAGE = {
    "dockerfile": "Dockerfile", "makefile": "Makefile", "rakefile": "Ruby", "gemfile": "Ruby", "procfile": "Procfile", "cargo.lock": "TOML", "go.mod": "Go Module", "go.sum": "Go Module",
}
CODE_LANGUAGES = (
    "TypeScript", "JavaScript", "Python", "Ruby", "Go", "Rust", "Java", "Kotlin", "Swift", "C", "C++", "C#", "PHP", "Scala", "Elixir", "Dart", "Vue", "Svelte", "Astro", "SQL", "Shell",
)
JS = ("TypeScript", "JavaScript", "Vue", "Svelte", "Astro")
PYTHON = ("Python",)
BACKEND = (*JS, *PYTHON, "Go", "Ruby", "Java", "PHP", "C#")
BINARY_EXT = (
    "png", "jpg", "jpeg", "gif", "webp", "avif", "ico", "bmp", "tiff", "svgz", "pdf", "zip", "gz", "tar", "bz2", "xz", "7z", "rar", "jar", "war", "mp3", "mp4", "mov", "avi", "webm",
    "wav", "flac", "ogg", "woff", "woff2", "ttf", "otf", "eot", "so", "dylib", "dll", "exe", "bin", "wasm", "class", "pyc", "o", "a", "db", "sqlite", "sqlite3", "parquet", "avro",
)
VENDOR = (
    "node_modules", "vendor", "third_party", "thirdparty", "bower_components", ".venv", "venv", "site-packages", "dist", "build", "out", ".next", ".nuxt", "target", "bin", "obj", "coverage",
    "__pycache__", ".git", ".yarn", "Pods",
)
MANIFESTS = {
    "package.json": "npm", "requirements.txt": "pypi", "pyproject.toml": "pypi", "pipfile": "pypi", "go.mod": "go", "cargo.toml": "cargo", "gemfile": "rubygems", "composer.json": "other",
    "pom.xml": "maven", "build.gradle": "maven",
}
# Patterns of path classes, on lower-case paths.
TEST = (r"(^|/)(tests?|__tests__|spec|specs|e2e|cypress|playwright)(/|$)", r"\.(test|spec)\.[a-z]+$", r"(^|/)test_[^/]+\.py$", r"_test\.(go|py|rb|ts|js)$")
GENERATED = (
    r"\.(min|bundle)\.(js|css)$",
    r"\.(d\.ts)$",
    r"(^|/)(generated|__generated__|gen)(/|$)",
    r"\.(pb|_pb2)\.(go|py|ts|js)$",
    r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|gemfile\.lock|composer\.lock|cargo\.lock)$",
)
DOC = (r"\.(md|mdx|rst|txt|adoc)$", r"(^|/)docs?(/|$)")
CONFIG = (r"\.(json|ya?ml|toml|ini|conf|config|properties)$", r"^\.env", r"^(dockerfile|docker-compose|makefile|procfile)", r"\.(tf|hcl)$")
SERVER = (r"(^|/)(api|routes?|controllers?|handlers?|server|endpoints?|views|resolvers?)(/|$)", r"/route\.(ts|js)$")
AUTH = (r"(auth|login|session|token|permission|role|acl|guard|middleware)",)
DATA_ACCESS = (r"(repositor|model|dao|db|database|prisma|query|store|persistence)",)


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower case, without the dot; empty for names without one and for dotfiles."""
    return F.lower(F.regexp_extract(base(path), r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    name, ext = F.lower(base(path)), extension(path)
    by_ext = F.coalesce(F.create_map(*[F.lit(x) for kv in EXT_LANGUAGE.items() for x in kv])[ext], F.when(ext != "", F.upper(ext)).otherwise("Other"))
    return F.coalesce(lookup(name, NAME_LANGUAGE), F.when(name.startswith("dockerfile"), "Dockerfile").when(name.startswith(".env"), "Dotenv").otherwise(by_ext))


def flags(path: Column, lang: Column) -> dict[str, Column]:
    """is_binary, is_vendor, is_test, is_generated, is_doc, is_config, is_code."""
    low = F.lower(path)
    return {
        "is_binary": extension(path).isin(*BINARY_EXT),
        "is_vendor": F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR))),
        "is_test": matches(low, TEST),
        "is_generated": matches(low, GENERATED),
        "is_doc": matches(low, DOC),
        "is_config": matches(F.lower(base(path)), CONFIG),
        "is_code": lang.isin(*CODE_LANGUAGES),
    }


def glob_to_regex(glob: str) -> str:
    """An ignore-file glob as an anchored pattern: a leading slash or an inner one anchors it; it means a file, or a folder and its content."""
    anchored = "/" in glob.rstrip("/")
    body, i = "", 0
    g = glob.strip("/")
    while i < len(g):
        if g.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            body, i = body + ".*", i + 2
        else:
            c = g[i]
            body, i = body + {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_/-" else f"\\{c}"), i + 1
    return ("^" if anchored else "(?:^|/)") + body + "(?:/.*)?$"


def glob_pattern(glob: Column) -> Column:
    """``glob_to_regex`` for a column of globs. Wildcards are marked by control characters while all else is quoted."""
    body = F.regexp_replace(F.regexp_replace(glob, "^/+|/+$", ""), r"\*\*(/?)", "\u0001$1")
    body = F.translate(F.replace(body, F.lit("\u0001/"), F.lit("\u0002")), "*?", "\u0003\u0004")
    body = F.regexp_replace(body, r"([^\p{L}\p{N}_/\-\x01-\x04])", r"\\$1")
    for mark, means in (("\u0001", ".*"), ("\u0002", "(?:.*/)?"), ("\u0003", "[^/]*"), ("\u0004", "[^/]")):
        body = F.replace(body, F.lit(mark), F.lit(means))
    anchored = F.contains(F.regexp_replace(glob, "/+$", ""), F.lit("/"))
    return F.concat(F.when(anchored, "^").otherwise("(?:^|/)"), body, F.lit("(?:/.*)?$"))


def in_scope(rule_id: Column, scopes: Column) -> Column:
    """A scope names a rule, or a prefix of rules if it ends in a dot or a star; no scope means every rule."""
    prefix = lambda s: (s.endswith("*") & rule_id.startswith(F.regexp_replace(s, r"\*$", ""))) | (s.endswith(".") & rule_id.startswith(s))
    return (F.size(scopes) == 0) | F.exists(scopes, lambda s: (rule_id == s) | prefix(s))
