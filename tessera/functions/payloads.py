"""What a path, a payload or a command is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders and names that a path policy keeps out.
GENERATED = ("node_modules", "vendor", "dist", "build", "coverage", ".next", ".nuxt", ".venv", "venv", "__pycache__")
SENSITIVE_NAMES = (".env", ".env.local", ".env.production", "id_rsa", "id_ed25519", "credentials.json", "service-account.json", ".npmrc", ".pypirc")
SENSITIVE_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".keystore")
ENV_TEMPLATES = (".env.example", ".env.sample", ".env.template", ".env.dist")
# Names that matter first, folders of sources, and folders that matter last.
ENTRY_NAMES = ("__init__.py", "__main__.py", "main.py", "app.py", "cli.py", "index.ts", "index.js", "index.tsx", "main.go", "main.rs", "lib.rs", "mod.rs", "README.md", "CLAUDE.md")
SOURCE_DIRS = ("src", "lib", "app", "pkg", "internal", "core")
LOW_VALUE_DIRS = ("tests", "test", "spec", "specs", "__tests__", "examples", "example", "docs", "doc", "fixtures", "migrations", "benchmarks", "bench", "scripts")
# Line forms of payload kinds.
LOG_LINE = r"(?im)^(?:\[[^\]]+\]\s*)?(?:\d{4}-\d{2}-\d{2}(?:[T ][^\s]+)?\s+)?(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b"
DIAGNOSTIC = r"(?i)\b(?:error|failed|failure|traceback|assertionerror|exception|panic)\b"
DIFF_HEAD = r"(?m)^diff --git .+\n"
SEARCH_LINE = r"^(?:[^:\n]+:\d+(?::\d+)?:|https?://\S+)"
YAML_LINE = r"(?m)^[A-Za-z0-9_.-]+\s*:\s*\S"
INI_LINE = r"(?m)^\[[^\]]+\]\s*$"
SOURCE_LINE = r"^\s*(?:def |class |async def |function |interface |type |enum |func |fn |public |private |protected |export |import |from |package )"
HTML_TAG = r"(?i)<(?:html|body|div|table|form|button|a|input|main|section)\b"


def _any(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.concat(parts, F.array(F.lit(""))), F.array(*[F.lit(x) for x in names]))


def path_decision(path: Column, symlink: Column | None = None) -> Column:
    """allowed, generated-or-vendor, sensitive-path, symlink or outside-root."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    sensitive = name.startswith(".env") | name.isin(*SENSITIVE_NAMES)
    for s in SENSITIVE_SUFFIXES:
        sensitive = sensitive | name.endswith(s)
    # how deep each prefix of the path is below the root: .. leads up
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, p: _down(a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1), a["least"]))
    return (
        F.when(depth["least"] < 0, "outside-root")
        .when(F.lit(False) if symlink is None else F.coalesce(symlink, F.lit(False)), "symlink")
        .when(_any(parts, GENERATED), "generated-or-vendor")
        .when(name.isin(*ENV_TEMPLATES), "allowed")
        .when(sensitive, "sensitive-path")
        .otherwise("allowed")
    )


def _down(at: Column, least: Column) -> Column:
    return F.struct(at.alias("at"), F.least(at, least).alias("least"))


def file_priority(path: Column) -> Column:
    """0 for entry points, 1 for sources, 3 for tests, fixtures and the like, 2 for the rest."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    low = _any(F.slice(parts, F.lit(1), F.size(parts) - 1), LOW_VALUE_DIRS)
    test = name.startswith("test_") | name.rlike(r"(_test\.py|\.test\.ts|\.spec\.ts)$")
    return F.when(low | test, 3).when(name.isin(*ENTRY_NAMES), 0).when(F.get(parts, F.lit(0)).isin(*SOURCE_DIRS) | ((F.size(parts) > 1) & (F.get(parts, F.lit(0)) == ".")), 1).otherwise(2)


def content_kind(text: Column) -> Column:
    """empty, json, diff, html, markdown-table, delimited-table, log, search-results, source, configuration or text; the first that fits.

    Whole texts count; tables look at their first 100 or 80 lines, search results at 40 and sources at 160, as their rules say.
    A source is a text with three lines that open a definition or an import and no diagnostic: nothing is parsed.
    """
    t = F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    full = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: x.rlike(r"\S"))
    count = lambda a, test: F.size(F.filter(a, test))
    n = F.size(full)
    bars = count(F.slice(full, 1, 100), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)

    def delimited(mark: str) -> Column:
        plain = F.transform(F.slice(full, 1, 80), lambda x: F.regexp_replace(x, '"[^"]*"', ""))
        widths = F.transform(plain, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))
        return (F.size(widths) >= 4) & (F.array_min(widths) >= 1) & (F.array_min(widths) == F.array_max(widths))

    sources = count(F.slice(full, 1, 160), lambda x: x.rlike(SOURCE_LINE))
    return (
        F.when(t == "", "empty")
        .when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), "json")
        .when(text.rlike(DIFF_HEAD) & F.contains(text, F.lit("@@")), "diff")
        .when(text.rlike(HTML_TAG), "html")
        .when((n >= 4) & (bars >= F.greatest(F.lit(3), F.floor(F.least(n, F.lit(100)) * 0.7))), "markdown-table")
        .when(delimited(",") | delimited("\t") | delimited(";"), "delimited-table")
        .when(text.rlike(LOG_LINE), "log")
        .when(count(F.slice(full, 1, 40), lambda x: x.rlike(SEARCH_LINE)) >= 3, "search-results")
        .when((sources >= 3) & ~text.rlike(DIAGNOSTIC), "source")
        .when(text.rlike(INI_LINE) | text.rlike(YAML_LINE), "configuration")
        .otherwise("text")
    )


def redact_command(command: Column, limit: int = 320) -> Column:
    """White space folded; values of secret-like keys, flags, authorisation headers and URL credentials replaced; then cut to the limit."""
    out = F.trim(F.regexp_replace(command, r"\s+", " "))
    out = F.regexp_replace(out, r"(?i)((?:password|passwd|token|secret|api[_-]?key)\s*[=:]\s*)(\S+)", "$1<redacted>")
    out = F.regexp_replace(out, r"(?i)(--(?:password|passwd|token|secret|api[-_]?key|authorization)\s+)(\S+)", "$1<redacted>")
    out = F.regexp_replace(out, r"(?i)(authorization\s*:\s*(?:bearer\s+)?)(\S+)", "$1<redacted>")
    out = F.regexp_replace(out, r"(https?://[^:/\s]+:)[^@/\s]+@", "$1<redacted>@")
    return F.substring(out, 1, limit)


def prometheus(name: str, labels: dict[str, Column], value: Column) -> Column:
    """One line of the text exposition format."""
    pairs = [F.concat(F.lit(f'{k}="'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"')) for k, v in labels.items()]
    return F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), value.cast("string"))
