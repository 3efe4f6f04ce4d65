"""Scalar text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tokeniser's stop words and aliases.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "code", "do", "for", "from", "how", "i", "if", "in", "into", "is", "it",
    "me", "of", "on", "or", "our", "please", "project", "the", "this", "to", "use", "we", "with", "you", "your", "fix", "implement",
    "add", "build", "create",
)
ALIASES = {"outline": "skeleton", "structural": "skeleton"}
# Line and secret patterns.
ERROR_HINTS = "(?i)(error|exception|fail|failed|fatal|panic|traceback|assert|expected|received)"
CRITICAL = r"(?i)(Traceback|AssertionError|\b(?:ERROR|FAILED|FATAL|PANIC)\b|Caused by:|(?:^|\s)[\w./\\-]+\.(?:py|pyi|ts|tsx|js|jsx|go|rs|java|cs|rb|php):\d+)"
STRONG_FAILURE = r"(?im)(^\s*(?:FAIL|FAILED|ERROR|FATAL|PANIC)\b|Traceback \(most recent call last\)|\b(?:AssertionError|Exception|RuntimeError|TypeError|ValueError)\b)"
SECRETS = (
    ("private-key", r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("aws-access-key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("github-token", r"\bgh[opusr]_[A-Za-z0-9_]{30,}\b"),
    ("generic-secret", r"""(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[:=]\s*['"][^'"\n]{8,}['"]"""),
)
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
# Characters a token, by file suffix.
TOKEN_RATIOS = {
    ".py": 3.1, ".go": 3.3, ".rs": 3.3, ".c": 3.3, ".cpp": 3.3, ".java": 3.6, ".cs": 3.6, ".js": 3.8, ".ts": 3.8, ".json": 2.4,
    ".yaml": 2.9, ".toml": 2.9, ".md": 3.5, ".txt": 3.0,
}
PROSE_RATIO, CODE_RATIO = 3.5, 3.3
# What a prompt asks for; the first class that matches wins.
OUTPUT_TASKS = (
    ("debugging", r"(?i)\b(debug|bug|bugs|error|errors|exception|traceback|failing|failure|regression|broken|crash|crashes|not working|doesn't work|does not work)\b"),
    ("review", r"(?i)\b(review|audit|code review|pull request|merge request|pr|mr|inspect changes|review diff|assessment)\b"),
    ("coding", r"(?i)\b(implement|implementation|build|create|add|remove|rename|refactor|migrate|patch|write code|modify|update code|change code|feature|integrate|integration)\b"),
    ("planning", r"(?i)\b(plan|planning|roadmap|architecture|architectural|strategy|proposal|design approach|technical design|system design)\b"),
    ("explanation", r"(?i)(^|\b)(explain|why|what is|what are|how does|how do|difference between|meaning of|teach me|walk me through)\b"),
)
TERSE = r"(?i)\b(brief|briefly|concise|concisely|short answer|keep it short|terse)\b"
DETAILED = r"(?i)\b(detailed|in detail|deep dive|comprehensive|thorough|step by step|step-by-step|full explanation|full report)\b"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Lines of a text with CRLF and CR as LF; a last empty line is dropped."""
    plain = F.regexp_replace(text, "\r\n?", "\n")
    return let(F.split(plain, "\n"), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def _stem(t: Column) -> Column:
    """The further form of a term, or null: -ize, -ing, -ed, -s, in this order of preference."""
    cut = lambda n: t.substr(F.lit(1), F.length(t) - n)
    last = lambda s: F.right(s, F.lit(1))
    single = lambda s: F.when((F.length(s) > 2) & (last(s) == F.substring(s, -2, 1)), s.substr(F.lit(1), F.length(s) - 1)).otherwise(s)
    with_e = lambda s, ends: F.when(last(s).isin(*ends), F.concat(s, F.lit("e"))).otherwise(s)
    return (
        F.when(t.endswith("ize") & (F.length(t) > 6), cut(3))
        .when(t.endswith("ing") & (F.length(t) > 6), with_e(single(cut(3)), "c"))
        .when(t.endswith("ed") & (F.length(t) > 5), with_e(cut(2), "sgcv"))
        .when(t.endswith("s") & (F.length(t) > 4), cut(1))
    )


def _spaced(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "_-/", "   "), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z][A-Z])(?=[A-Z][a-z])", " ")


def _raw_terms(text: Column) -> Column:
    words = F.regexp_extract_all(_spaced(text), F.lit("[A-Za-z0-9_$]+"), F.lit(0))
    return F.transform(words, _trimmed)


def _trimmed(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit("_$"))


def _forms(t: Column) -> Column:
    """A term with its alias and its stem behind it."""
    return F.array_compact(F.array(t, F.when(t.isin(*ALIASES), F.lit("skeleton")), _stem(t)))


def _searched(t: Column) -> Column:
    return (F.length(t) >= 2) & ~t.isin(*STOP_WORDS)


def terms(text: Column) -> Column:
    """Search terms of a text in order: identifiers split, stop words gone, aliases and stems put behind their term."""
    return F.flatten(F.transform(F.filter(_raw_terms(text), _searched), _forms))


def exploded_terms(df: DataFrame, keys: list[str], columns: dict[str, tuple[Column, int]]) -> DataFrame:
    """keys, term, w: a row for each search term of each column (text and weight). Words are exploded first, so what is done to
    each of them is compiled."""
    words = lambda text: F.regexp_extract_all(_spaced(text), F.lit("[A-Za-z0-9_$]+"), F.lit(0))
    parts = F.array(*[F.struct(words(text).alias("words"), F.lit(weight).alias("w")) for text, weight in columns.values()])
    each = df.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.w", F.explode("p.words").alias("word"))
    own = each.select(*keys, "w", _trimmed(F.col("word")).alias("word")).where(_searched(F.col("word")))
    return own.select(*keys, F.explode(_forms(F.col("word"))).alias("term"), "w")


def identifier_terms(text: Column) -> Column:
    return F.filter(_raw_terms(text), lambda t: F.length(t) >= 2)


def identifier_tokens(text: Column) -> Column:
    """Distinct lower-case identifiers of over two characters, sorted."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) > 2), F.lower)))


def char_ngrams(token: Column, n: int = 3) -> Column:
    if n <= 0:
        raise ValueError("n must be positive")
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.length(padded) < n, F.array(padded)).otherwise(grams)


def estimate_tokens(text: Column, ratio: Column | float = PROSE_RATIO) -> Column:
    ratio = ratio if isinstance(ratio, Column) else F.lit(ratio)
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / ratio))).cast("long")


def ratio_for(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in TOKEN_RATIOS.items() for x in kv])
    return F.coalesce(table[suffix], F.lit(CODE_RATIO))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def redact_secrets(text: Column) -> Column:
    """struct(text, labels): secrets replaced, and the kinds that were found."""
    out, labels = text, []
    for label, pattern in SECRETS:
        labels.append(F.when(out.rlike(pattern), F.lit(label)))
        out = F.regexp_replace(out, pattern, f"[REDACTED:{label}]")
    return F.struct(out.alias("text"), F.filter(F.array(*labels), lambda x: x.isNotNull()).alias("labels"))


def fingerprint(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), 256)


def recovery_handle(text: Column) -> Column:
    return F.concat(F.lit("tsr_"), F.substring(F.sha2(text, 256), 1, 32))


def classify_task(prompt: Column) -> Column:
    text = F.trim(F.regexp_replace(prompt, r"\s+", " "))
    out = F.when(text == "", F.lit(None).cast("string"))
    for name, pattern in OUTPUT_TASKS[:-1]:
        out = out.when(text.rlike(pattern), name)
    name, pattern = OUTPUT_TASKS[-1]
    return out.when(text.rlike(pattern) | text.endswith("?"), name)


def explicit_mode(prompt: Column) -> Column:
    return F.when(prompt.rlike(DETAILED), "detailed").when(prompt.rlike(TERSE), "terse")


def detect_failure(text: Column, exit_code: Column | None = None) -> Column:
    found = strip_ansi(text).rlike(STRONG_FAILURE)
    return found if exit_code is None else F.coalesce(exit_code != 0, found)


def evidence_category(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.endswith(".sql") | p.contains("migrations/") | p.contains("/drizzle/") | p.startswith("drizzle/"), "database")
        .when(p.contains(".github/workflows/"), "ci")
        .when(p.contains("test") | p.contains("spec"), "tests")
        .when(p.rlike(r"\.(json|yaml|yml|toml|env\.example|env\.sample)$"), "config")
        .otherwise("source")
    )


def normalized_command(command: Column) -> Column:
    return F.trim(F.regexp_replace(command, r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, either is empty or a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


# Runs of blank lines and long hexadecimal runs that ``preprocess`` shortens.
BLANK_RUN, HEX_BLOB = r"\n{3,}", r"\b[0-9a-fA-F]{96,}\b"


def preprocess(text: Column) -> Column:
    """A text without terminal codes, with LF line ends, single blank lines, shortened hexadecimal runs and folded repeated lines;
    JSON without white space between its parts, where that is shorter. Never longer than the text."""
    plain = F.regexp_replace(F.regexp_replace(strip_ansi(text), "\r\n?", "\n"), BLANK_RUN, "\n\n")
    blobs = F.regexp_extract_all(plain, F.lit(HEX_BLOB), F.lit(0))
    short = F.aggregate(F.array_distinct(blobs), plain, lambda acc, m: F.replace(acc, m, F.concat(F.substring(m, 1, 12), F.lit("…("), F.length(m).cast("string"), F.lit(" hex)"))))

    def out(s: Column) -> Column:
        core = F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))
        packed = let(core, lambda c: F.when(c.rlike(r"(?s)^[\[{].*[\]}]$"), F.to_json(F.try_parse_json(c))))
        return let(packed, lambda p: F.when(p.isNotNull() & (F.length(p) + 1 < F.length(s)), F.concat(p, F.lit("\n"))).otherwise(collapse_repeats(s)))

    return let(let(short, out), lambda s: F.when(F.length(s) <= F.length(text), s).otherwise(text))


def collapse_repeats(text: Column, minimum: int = 3) -> Column:
    """Runs of equal non-blank lines as the line and a count, where that is shorter.

    Runs are found by where they start in the text's own lines, so the work grows with the lines.
    """

    def run(line: Column, n: Column) -> Column:
        short = F.array(line, F.concat(F.lit("[previous line repeated "), (n - 1).cast("string"), F.lit(" more times]")))
        return F.when((n >= minimum) & (F.trim(line) != ""), short).otherwise(F.array_repeat(line, n))

    def folded(a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.flatten(F.transform(s, lambda p, j: run(F.get(a, p), F.coalesce(F.get(s, j + 1), F.size(a)) - p))))

    return let(F.array_join(let(F.split(text, "\n"), folded), "\n"), lambda s: F.when(F.length(s) < F.length(text), s).otherwise(text))
