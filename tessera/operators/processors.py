"""Compaction of command output by processors: one line filter with a table of rules, and a few forms of their own.

A row's processor is the first that fits its command; everything then happens within the row's own text, as expressions over its
lines, so nothing is shuffled. A result is never longer than the text it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import CRITICAL, ERROR_HINTS, let, lines, preprocess

# Name, priority, commands, lines that are evidence, label, whether failed output is taken, least limit of lines,
# whether all matching lines stay.
LINE_FILTERS = (
    ("js-test", 20, r"\b(jest|vitest|npm\s+test|pnpm\s+test|yarn\s+test)\b", r"(FAIL|PASS|✕|×|Error|Expected|Received|Tests:|Test Suites:|Snapshots:)", "test", True, 40, False),
    ("git-show", 25, r"^\s*git\b.*\bshow\b", r"^(?:commit |Author:|Date:|diff --git |index |--- |\+\+\+ |@@|[+-](?:[^+-]|$))", "git show", False, 120, True),
    ("git-branch", 26, r"^\s*git\s+branch\b", r".+", "git branch", False, 80, False),
    ("git-remote", 27, r"^\s*git\b.*\b(?:push|pull|fetch|remote)\b", r"(?:^From |^To |->|\[new |\[rejected\]|up.to.date|fast-forward|error:|fatal:|warning:)", "git remote", True, 80, False),
    ("docker-build", 32, r"^\s*docker\s+(?:build|buildx\s+build)\b", r"(?:^#\d+\s+\[|\b(?:ERROR|FAILED|CACHED|DONE)\b|error:|warning:|Successfully|exporting)", "docker build", True, 90, False),
    ("docker-ps", 32, r"^\s*docker\s+(?:container\s+)?(?:ps|ls)\b", r".+", "docker ps", False, 70, False),
    ("docker-compose", 32, r"^\s*(?:docker\s+compose|docker-compose)\b", r"(?:\b(?:Created|Started|Running|Healthy|Exited|Stopped|ERROR|Error|failed)\b|^\S+\s+\|)", "docker compose", True, 90, False),
    ("docker-inspect", 32, r"^\s*docker\s+(?:container\s+)?inspect\b", r".+", "docker inspect", False, 90, False),
    ("kubectl-get", 33, r"^\s*kubectl\s+get\b", r".+", "kubectl get", False, 80, False),
    ("kubectl-describe", 33, r"^\s*kubectl\s+describe\b", r"(?:^Name:|^Namespace:|^Status:|^Conditions:|^Events:|\b(?:Warning|Failed|Error|Unhealthy|BackOff|Reason|Message):?\b)", "kubectl describe", True, 100, False),
    ("kubectl-events", 33, r"^\s*kubectl\s+(?:get\s+events|events)\b", r".+", "kubectl events", True, 100, False),
    ("terraform-plan", 33, r"^\s*terraform\s+plan\b", r"(?:^Plan:|^No changes\.|^\s*# |^\s*[+~!-]\s|Error:|Warning:|Changes to Outputs:)", "terraform plan", True, 100, False),
    ("terraform-apply", 33, r"^\s*terraform\s+(?:apply|destroy)\b", r"(?:Apply complete!|Destroy complete!|^\s*# |^\s*[+~!-]\s|Error:|Warning:|: Creating|: Modifying|: Destroying|: Creation complete|: Destruction complete)", "terraform apply", True, 100, False),
    ("helm", 33, r"^\s*helm\b", r"(?:^NAME:|^STATUS:|^REVISION:|^NAMESPACE:|deployed|upgraded|uninstalled|Error:|WARNING:|FAILED)", "helm", True, 90, False),
    ("pulumi", 33, r"^\s*pulumi\b", r"(?:Resources:|Outputs:|Diagnostics:|error:|warning:|\b(?:create|update|delete|replace|same)\b|failed)", "pulumi", True, 100, False),
    ("cargo-build", 34, r"^\s*cargo\s+(?:build|check)\b", r"(?:^error(?:\[E\d+\])?:|^warning:|^\s*-->\s|^\s*= (?:help|note):|Finished|could not compile)", "cargo build", True, 100, False),
    ("cargo-clippy", 34, r"^\s*cargo\s+clippy\b", r"(?:^error(?:\[E\d+\])?:|^warning:|^\s*-->\s|^\s*= (?:help|note):|Finished|could not compile)", "cargo clippy", True, 100, False),
    ("cargo-test", 34, r"^\s*cargo\s+test\b", r"(?:test result:|^test .+ \.\.\. (?:FAILED|ignored)|panicked at|^failures:|^error:|FAILED)", "cargo test", True, 100, False),
    ("maven", 34, r"^\s*(?:\./)?mvnw?\b", r"(?:\[ERROR\]|\[WARNING\]|BUILD (?:SUCCESS|FAILURE)|Tests run:|Failures:|Errors:|Failed to execute goal)", "maven", True, 100, False),
    ("gradle", 34, r"^\s*(?:\./)?gradlew?\b", r"(?:^> Task .+ (?:FAILED|UP-TO-DATE)|BUILD (?:SUCCESSFUL|FAILED)|FAILURE:|\* What went wrong:|error:|warning:)", "gradle", True, 100, False),
    ("ruff", 34, r"^\s*(?:python\s+-m\s+)?ruff\b", r"(?:^.+:\d+:\d+:\s+[A-Z]+\d+\s|^Found \d+ error|^All checks passed)", "ruff", True, 120, False),
    ("eslint", 34, r"^\s*(?:npx\s+|pnpm\s+exec\s+|yarn\s+)?eslint\b", r"(?:^.+\.(?:js|jsx|ts|tsx|vue)$|^\s*\d+:\d+\s+(?:error|warning)\s|✖|problems? \()", "eslint", True, 120, False),
    ("pylint", 34, r"^\s*(?:python\s+-m\s+)?pylint\b", r"(?:^.+:\d+:\d+:\s+[A-Z]\d{4}:|Your code has been rated|rated at)", "pylint", True, 120, False),
    ("tsc", 34, r"^\s*(?:npx\s+|pnpm\s+exec\s+|yarn\s+)?tsc\b", r"(?:^.+\(\d+,\d+\):\s+error\s+TS\d+:|Found \d+ errors?)", "tsc", True, 120, False),
    ("mypy", 34, r"^\s*(?:python\s+-m\s+)?mypy\b", r"(?:^.+:\d+(?::\d+)?:\s+(?:error|note):|Found \d+ errors?|Success: no issues found)", "mypy", True, 120, False),
    ("jq-yq", 34, r"^\s*(?:jq|yq)\b", r".+", "structured query", True, 100, False),
    ("lint", 36, r"\b(ruff|eslint|pylint|clippy)\b", r"(:\d+(?::\d+)?\b|\berror\b|\bwarning\b|\bproblems?\b|\bfound\s+\d+\b|\bE\d{3,4}\b|\bW\d{3,4}\b)", "lint", True, 60, False),
    ("typecheck", 37, r"\b(tsc|mypy|pyright)\b", r"(error\s+TS\d+|:\d+(?::\d+)?\b|\berror:|\bnote:|Found \d+ error|Success: no issues)", "typecheck", True, 60, False),
    ("compiled-test", 38, r"\b(go\s+test|cargo\s+test|dotnet\s+test)\b", r"(--- FAIL:|\bFAIL\b|\bPASS\b|panicked at|\berror\b|test result:|^ok\s|^\?\s|^FAIL\s|Failed!|Passed!|Total tests:|Failed:|Passed:)", "compiled tests", True, 60, False),
    ("build", 39, r"\b(cargo\s+build|go\s+build|gradle|gradlew|mvn|maven|npm\s+run\s+build|pnpm\s+(?:run\s+)?build|yarn\s+build)\b", r"(\berror\b|\bwarning\b|FAILED|BUILD (?:SUCCESS|FAIL)|Finished|:\d+(?::\d+)?\b)", "build", True, 70, False),
    ("package-install", 40, r"\b(npm|pnpm|yarn|bun|pip|pip3|uv)\s+(i|install|ci|sync)\b", r"(ERR!|error|warn|added \d+|removed \d+|audited|packages? in)", "install", True, 40, False),
)
# Processors with a form of their own: name, priority, commands, whether failed output is taken.
OWN_FORMS = (
    ("pytest", 10, r"\b(pytest|py\.test|python\s+-m\s+pytest)\b", True), ("git-diff", 24, r"^\s*git\b.*\bdiff\b", False), ("git-log", 30, r"\bgit\s+log\b", False), ("git-status", 31, r"\bgit\s+status\b", False),
    ("go-build", 34, r"^\s*go\s+build\b", True), ("go-test", 34, r"^\s*go\s+test\b", True), ("search", 35, r"(^|[;&|]\s*|\b)(rg|grep|find)\b", True), ("container-log", 41, r"\b(docker\s+logs|kubectl\s+logs)\b", False),
)
# Lines of patches and of Go's tools, and what git says of a file.
PATCH_LINE = r"^(?:diff --git |@@ |@@@ |\+(?:[^+]|$|\+(?:[^+]|$))|-(?:[^-]|$|-(?:[^-]|$))|new file mode |deleted file mode |old mode |new mode |similarity index |rename from |rename to |copy from |copy to |Binary files |GIT binary patch|\\ No newline at end of file)"
GO_LINES = {
    "go-build": r"(?:\.go:\d+(?::\d+)?:|undefined:|cannot use|syntax error|too many arguments|not enough arguments|invalid operation|link:)",
    "go-test": r"(?:\.go:\d+(?::\d+)?:|^--- FAIL:|^panic:|^FAIL\s+\S+|undefined:|cannot use|syntax error)",
}
STATUS_CODES = {
    "modified": "M", "new file": "A", "deleted": "D", "renamed": "R", "copied": "C", "typechange": "T", "both modified": "UU", "both added": "AA", "both deleted": "DD",
    "added by us": "AU", "added by them": "UA", "deleted by us": "DU", "deleted by them": "UD",
}
MAX_ERRORS, MAX_RECOVERED = 40, 20


def ignoring_case(pattern: str) -> str:
    return "(?i)" + pattern


def route(command: Column, failed: Column) -> Column:
    """The first processor by priority and name whose commands match; failed output skips those that don't take it."""
    rules = [(p, n, c, h) for n, p, c, _, _, h, _, _ in LINE_FILTERS] + [(p, n, c, h) for n, p, c, h in OWN_FORMS]
    out = F.when(F.lit(False), F.lit(""))
    for _, name, pattern, handles in sorted(rules):
        fits = command.rlike(ignoring_case(pattern))
        out = out.when(fits if handles else fits & ~F.coalesce(failed, F.lit(False)), name)
    return out.otherwise("generic")


def _text(rows: Column) -> Column:
    return F.concat(F.array_join(rows, "\n"), F.lit("\n"))


def _ended(text: Column) -> Column:
    return F.when(text.endswith("\n") | (text == ""), text).otherwise(F.concat(text, F.lit("\n")))


def _shorter(candidate: Column, text: Column) -> Column:
    return F.when(F.octet_length(candidate) < F.octet_length(text), candidate).otherwise(text)


def filter_text(text: Column, max_lines: int, keep_tail: int) -> Column:
    """The head, distinct error lines between, and the tail of a text of more than ``max_lines`` lines; never longer than the text."""

    def of(a: Column) -> Column:
        n = F.size(a)
        tail = F.greatest(F.lit(0), F.least(F.lit(min(keep_tail, max_lines - 1)), n - 1))
        hits = F.size(F.filter(a, lambda x: x.rlike(ERROR_HINTS)))
        head = F.greatest(F.lit(0), F.least(F.greatest(F.lit(10), max_lines - tail - F.least(hits, F.lit(30))), n - tail))
        middle = F.filter(F.slice(a, head + 1, F.greatest(n - tail - head, F.lit(0))), lambda x: x.rlike(ERROR_HINTS))
        first = lambda m: F.filter(m, lambda x, i: F.array_position(F.transform(m, lambda y: F.trim(y)), F.trim(x)) == i + 1)
        extra = F.slice(first(middle), 1, MAX_ERRORS)
        omitted = n - head - tail - F.size(extra)
        note = F.concat(F.lit("[filtered: "), n.cast("string"), F.lit(" lines → showing head/errors/tail; "), omitted.cast("string"), F.lit(" omitted]"))
        none = F.array().cast("array<string>")
        rows = F.concat(
            F.array(note), F.slice(a, 1, head), F.when(F.size(extra) > 0, F.concat(F.array(F.lit("--- matching errors ---")), extra)).otherwise(none),
            F.when(tail > 0, F.concat(F.array(F.lit("--- tail ---")), F.slice(a, n - tail + 1, tail))).otherwise(none),
        )
        out = _text(rows)
        return F.when((n <= max_lines) | (omitted <= 0), _ended(text)).otherwise(F.when(F.length(out) < F.length(text), out).otherwise(_ended(text)))

    return let(lines(text), of)


def _noted(label: Column | str, n: Column, kept: Column) -> Column:
    """Kept lines under a note of how many were left out."""
    label = F.lit(label) if isinstance(label, str) else label
    return _text(F.concat(F.array(F.concat(F.lit("[filtered "), label, F.lit(": "), n.cast("string"), F.lit(" lines → "), F.size(kept).cast("string"), F.lit(" kept, "), (n - F.size(kept)).cast("string"), F.lit(" omitted]"))), kept))


def line_filtered(text: Column, pattern: Column, label: Column, limit: Column, fallback: Column) -> Column:
    """The lines that match a pattern, as many as the limit says, where that leaves something out and is shorter; else the fallback."""

    def of(a: Column) -> Column:
        kept = F.slice(F.filter(a, lambda x: F.regexp_like(x, pattern)), F.lit(1), limit)
        return let(kept, lambda k: let(_noted(label, F.size(a), k), lambda c: F.when((F.size(k) > 0) & (F.size(k) < F.size(a)) & (F.octet_length(c) < F.octet_length(text)), c).otherwise(fallback)))

    return let(lines(text), of)


def _pytest(text: Column, failed: Column) -> Column:
    block = lambda rx: F.trim(F.regexp_replace(F.regexp_extract(text, rx, 0), r"^\s+|\s+$", ""))
    failures = block(r"(?im)^=+ FAILURES =+[\s\S]*?(?=^=+ (?:short test summary|warnings summary)|\z)")
    summary = block(r"(?im)^=+ short test summary info =+[\s\S]*?(?=^=+ |\z)")
    counts = F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?im)^=+ .*\d+ (?:passed|failed|error).* =+\s*$"), F.lit(0)), F.lit(-1)), F.lit(""))
    parts = F.filter(F.array(failures, summary, F.trim(F.regexp_replace(counts, r"\s+$", ""))), lambda x: x != "")
    out = F.concat(F.lit("[filtered pytest: "), F.size(lines(text)).cast("string"), F.lit(" lines → failures/summary]\n"), F.array_join(parts, "\n\n"), F.lit("\n"))
    return F.when((F.size(parts) > 0) & (F.length(out) < F.length(text)), out)


def _go(text: Column, pattern: str) -> Column:
    a = lines(text)
    found = F.filter(a, lambda x: x.rlike(pattern))
    packages = F.filter(a, lambda x: x.startswith("# "))
    kept = F.array_distinct(F.when(F.size(packages) > 1, F.concat(packages, found)).otherwise(found))
    return F.when(F.size(found) > 0, _shorter(_text(kept), text)).otherwise(text)


def _search(text: Column, limit: int) -> Column:
    a = lines(text)
    kept = F.slice(F.array_distinct(a), 1, limit)
    note = F.concat(F.lit("[filtered search: "), F.size(a).cast("string"), F.lit(" lines → "), F.size(kept).cast("string"), F.lit(" unique hits, "), (F.size(a) - F.size(kept)).cast("string"), F.lit(" omitted]"))
    return F.when(F.size(a) > F.size(kept), _shorter(_text(F.concat(F.array(note), kept)), text)).otherwise(_ended(text))


def _git_log(text: Column, command: Column, limit: int) -> Column:
    """A line for each commit: eight digits of its id, its refs, its subject and, with --stat, what it changed."""
    a = lines(text)
    blocks = F.filter(F.split(_ended(text), r"(?m)^(?=commit )"), lambda b: b.startswith("commit "))

    def row(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        refs = F.regexp_replace(F.replace(F.regexp_extract(head, r"^commit \S+ \((.*)\)\s*$", 1), F.lit("HEAD -> "), F.lit("HEAD>")), r"\s*,\s*", ",")
        # a merge of lines before the subject, file lines and sums are passed over
        subject = F.coalesce(F.try_element_at(F.transform(F.filter(F.split(b, "\n"), lambda x: x.rlike(r"^(?: {4}|\t)\s*\S") & ~x.rlike(r"^.+\s+\|\s+\d+") & ~F.trim(x).rlike(r"^(?:Author:|Date:|Merge:)")), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), F.lit(1)), F.lit(""))
        sums = lambda rx: F.coalesce(F.regexp_extract(b, rx, 1).try_cast("int"), F.lit(0))
        files, more, less = sums(r"(?m)^ *(\d+) files? changed"), sums(r"(\d+) insertions?\(\+\)"), sums(r"(\d+) deletions?\(-\)")
        stat = F.array_join(F.array_compact(F.array(F.when(files > 1, F.concat(files.cast("string"), F.lit("f"))), F.when(more > 0, F.concat(F.lit("+"), more.cast("string"))), F.when(less > 0, F.concat(F.lit("-"), less.cast("string"))))), " ")
        out = F.concat(F.substring(F.regexp_extract(head, r"^commit (\S+)", 1), 1, 8), F.when(refs != "", F.concat(F.lit(" ["), refs, F.lit("]"))).otherwise(""), F.when(subject != "", F.concat(F.lit(" "), subject)).otherwise(""))
        return F.concat(out, F.when(command.rlike(r"(?:^|\s)--stat(?:\s|$)") & (stat != ""), F.concat(F.lit(" ["), stat, F.lit("]"))).otherwise(""))

    older = lambda n: F.when(n > 0, F.array(F.concat(F.lit("... "), n.cast("string"), F.lit(" older commits omitted")))).otherwise(F.array().cast("array<string>"))
    full = let(blocks, lambda b: _text(F.concat(F.transform(F.slice(b, 1, limit), row), older(F.size(b) - limit))))
    short = _text(F.concat(F.slice(a, 1, 25), older(F.size(a) - 25)))
    one_line = (F.size(a) > 40) & (F.size(F.filter(a, lambda x: x.rlike(r"(?i)^[0-9a-f]{4,40}\s+\S"))) >= F.size(a) * 0.8)
    return F.when(F.size(blocks) > 0, _shorter(full, text)).when(one_line & (F.octet_length(short) < F.octet_length(text)), short).otherwise(filter_text(text, limit, 10))


def _git_status(text: Column, limit: int) -> Column:
    """Branch lines and changed paths with their state, by one fold over the lines that carries the section."""
    none = F.array().cast("array<string>")
    names = "|".join(sorted(STATUS_CODES, key=len, reverse=True))
    codes = F.create_map(*[F.lit(x) for kv in STATUS_CODES.items() for x in kv])
    sections = {"Changes to be committed:": "staged", "Changes not staged for commit:": "unstaged", "Untracked files:": "untracked", "Unmerged paths:": "unmerged"}

    def step(acc: Column, x: Column) -> Column:
        s = F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))
        put = lambda heads, changes, section: F.struct(heads.alias("heads"), changes.alias("changes"), section.alias("section"))
        add = lambda row: put(acc["heads"], F.concat(acc["changes"], F.array(row)), acc["section"])
        name, path = F.regexp_extract(s, rf"^({names}):", 1), F.trim(F.regexp_replace(s, r"^[^:]*:\s*", ""))
        code = codes[name]
        state = F.when(F.length(code) == 2, F.concat(code, F.lit(" "), path)).when(acc["section"] == "staged", F.concat(F.lit("S "), name, F.lit(": "), path)).when(acc["section"] == "unstaged", F.concat(F.lit("U "), name, F.lit(": "), path)).otherwise(F.concat(name, F.lit(": "), path))
        out = F.when(s == "", acc).when(s.rlike(r"^(?:On branch|Your branch|HEAD detached|## |nothing to commit|no changes added)"), put(F.concat(acc["heads"], F.array(s)), acc["changes"], acc["section"]))
        for head, section in sections.items():
            out = out.when(s.startswith(head), put(acc["heads"], acc["changes"], F.lit(section)))
        out = out.when(s.startswith("("), acc).when(~x.rlike(r"^(?:\t| {3})") & x.rlike(r"^[ MADRCUT?!]{1,2}\s+.+$"), add(F.concat(F.regexp_extract(x, r"^([ MADRCUT?!]{1,2})\s+(.+)$", 1), F.lit(" "), F.trim(F.regexp_extract(x, r"^([ MADRCUT?!]{1,2})\s+(.+)$", 2)))))
        return out.when(name != "", add(state)).when((acc["section"] == "untracked") & x.rlike(r"^\s"), add(F.concat(F.lit("? "), s))).otherwise(acc)

    def rows(acc: Column) -> Column:
        over = F.size(acc["changes"]) - limit
        return F.concat(acc["heads"], F.slice(acc["changes"], 1, limit), F.when(over > 0, F.array(F.concat(F.lit("... "), over.cast("string"), F.lit(" paths omitted")))).otherwise(none))

    start = F.struct(none.alias("heads"), none.alias("changes"), F.lit("").alias("section"))
    found = F.aggregate(lines(text), start, step, rows)
    return let(found, lambda r: F.when(F.size(r) == 0, filter_text(text, limit, 10)).otherwise(_shorter(_text(r), text)))


def recovered(original: Column, candidate: Column) -> Column:
    """The candidate with the critical lines it lost put behind it, or the original where that would not be shorter."""
    present = F.transform(lines(candidate), lambda x: F.trim(x))
    critical = F.slice(F.array_distinct(F.filter(lines(original), lambda x: x.rlike(CRITICAL) & (F.trim(x) != ""))), 1, MAX_RECOVERED)
    missing = let(present, lambda p: F.filter(critical, lambda x: ~F.array_contains(p, F.trim(x))))
    whole = lambda m: F.concat(F.regexp_replace(candidate, r"\n+$", ""), F.lit("\n\n[recovered critical diagnostics]\n"), _text(m))
    return let(missing, lambda m: F.when(F.size(m) == 0, candidate).otherwise(let(whole(m), lambda w: _shorter(w, original))))


def compressed(outputs: DataFrame, command: str = "command", text: str = "text", failed: str = "failed", max_lines: int = 80, keep_tail: int = 20, min_reduction: float = 0.0) -> DataFrame:
    """outputs with ``processor``, ``result`` and ``changed``: each output by its processor, critical lines put back, and the text
    itself where that is not shorter by ``min_reduction``. A null text stays null."""
    own = outputs.withColumn("processor", route(F.col(command), F.col(failed))).withColumn("_p", preprocess(F.col(text)))
    p, raw = F.col("_p"), F.col(text)
    spec = F.create_map(*[x for n, _, _, rx, label, _, least, every in LINE_FILTERS for x in (F.lit(n), F.struct(F.lit(ignoring_case(rx)).alias("rx"), F.lit(label).alias("label"), F.lit((1 << 30) if every else max(least, max_lines)).alias("limit")))])
    own = own.withColumn("_s", spec[F.col("processor")])
    of = F.col("processor")
    result = (
        F.when(of == "pytest", F.coalesce(_pytest(raw, F.col(failed)), F.when(F.col(failed), raw).otherwise(filter_text(p, max_lines, keep_tail))))
        .when(of == "git-diff", let(F.filter(lines(p), lambda x: x.rlike(PATCH_LINE)), lambda k: F.when(p.rlike(r"(?m)^diff --git ") & (F.size(k) > 0), _shorter(_text(k), raw)).otherwise(p)))
        .when(of == "go-build", _go(p, GO_LINES["go-build"]))
        .when(of == "go-test", _go(p, GO_LINES["go-test"]))
        .when(of == "git-log", _git_log(p, F.col(command), max(20, max_lines)))
        .when(of == "git-status", _git_status(p, max(40, max_lines)))
        .when(of == "search", F.when(F.col(command).rlike(r"\s(?:-[A-Za-z]*[ABC]\d*|--(?:after-context|before-context|context))\b"), raw).otherwise(_search(p, max(25, max_lines))))
        .when((of == "js-test") & F.col(failed) & raw.rlike(r"(?m)^\s+at\s+|^\s*[+-]\s+.+$"), raw)
        .when(of == "container-log", filter_text(p, max_lines, max(keep_tail, 20)))
        .when(F.col("_s").isNotNull(), line_filtered(p, F.col("_s.rx"), F.col("_s.label"), F.col("_s.limit"), filter_text(p, max_lines, max(keep_tail, 12))))
        .otherwise(filter_text(p, max_lines, keep_tail))
    )
    own = own.withColumn("_r", result).withColumn("_r", F.when(raw.rlike(r"(?m)^diff --git ") | raw.rlike(r"^\s*[\[{]"), F.col("_r")).otherwise(recovered(raw, F.col("_r"))))
    small = (F.octet_length("_r") < F.octet_length(text)) & (1 - F.octet_length("_r") / F.octet_length(text) >= min_reduction)
    own = own.withColumn("result", F.when(small, F.col("_r")).otherwise(raw)).withColumn("changed", F.coalesce(small, F.lit(False)))
    return own.drop("_p", "_s", "_r")
