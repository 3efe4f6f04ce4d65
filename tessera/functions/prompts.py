"""What prompts and commands say: command families, decisions, risk and the capability that a task needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.payloads import redact_command
from tessera.functions.text import let, terms

# Words before a command, and commands whose first argument belongs to their family.
WRAPPERS = ("sudo", "env", "command", "time")
WITH_SUBCOMMAND = ("git", "cargo", "go", "docker", "kubectl", "gh", "pytest", "ruff", "uv", "pip", "pip3", "npx")
# What makes a sentence a decision, and a prompt risky.
DECISION = r"(?i)\b(?:use|prefer|choose|keep|avoid|do not|don't|must|should|instead|decision\s*:|remember\s+that|stick\s+with)\b"
HIGH_RISK = r"(?i)\b(security|secure|vulnerability|auth(?:entication|orization)?|permission|cryptograph|encrypt|payment|billing|production|incident|outage|data[ -]?loss|destructive|database[ -]?migration|schema[ -]?migration|distributed|concurren|race[ -]?condition|deadlock|memory[ -]?corruption|release|deploy(?:ment)?|infrastructure|terraform|kubernetes)\b"
CAPABILITIES = ("fast", "balanced", "deep")


def command_signature(command: Column) -> Column:
    """The family of a command without values: assignments and wrappers gone, the program's name, and for some programs what they run."""
    quoted = F.regexp_extract_all(command, F.lit(r"""(?:[^\s"']|"[^"]*"|'[^']*')+"""), F.lit(0))
    parts = F.transform(quoted, lambda p: F.regexp_replace(p, r"""["']""", ""))
    after = lambda a, skip: let(F.filter(F.transform(a, lambda p, i: F.when(~skip(p), i)), lambda i: i.isNotNull()), lambda at: F.when(F.size(at) == 0, F.array().cast("array<string>")).otherwise(F.slice(a, F.get(at, F.lit(0)) + 1, F.size(a))))
    name = lambda p: F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1)
    at = lambda a, i: F.get(a, F.lit(i))

    def family(a: Column) -> Column:
        first = name(at(a, 0))
        return (
            F.when(F.size(a) == 0, "unknown")
            .when(first.isin("python", "python3") & (F.size(a) >= 3) & (at(a, 1) == "-m"), F.concat_ws(" ", first, F.lit("-m"), name(at(a, 2))))
            .when(first.isin("npm", "pnpm", "yarn", "bun") & (F.size(a) >= 3) & (at(a, 1) == "run"), F.concat_ws(" ", first, F.lit("run"), at(a, 2)))
            .when(first.isin(*WITH_SUBCOMMAND), F.concat_ws(" ", first, at(a, 1)))
            .otherwise(first)
        )

    plain = after(parts, lambda p: F.contains(p, F.lit("=")) & ~p.startswith("./") & ~p.startswith("/"))
    return let(let(plain, lambda a: after(a, lambda p: p.isin(*WRAPPERS))), family)


def decision_summaries(prompt: Column, limit: int = 3) -> Column:
    """The first distinct sentences that state a decision, redacted and cut to 240 characters."""
    sentences = F.filter(F.transform(F.split(prompt, r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: (s != "") & s.rlike(DECISION))
    return F.slice(F.array_distinct(F.filter(F.transform(sentences, lambda s: redact_command(s, 240)), lambda s: s != "")), 1, limit)


def risk(prompt: Column) -> Column:
    """struct(level, words): high with the distinct risky words in order, eight at most, or normal."""
    words = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(prompt, F.lit(HIGH_RISK), F.lit(1)), F.lower)))
    return let(words, lambda w: F.struct(F.when(F.size(w) > 0, "high").otherwise("normal").alias("level"), F.slice(w, 1, 8).alias("words")))


def minimum_capability(task: Column, tier: Column, risk_level: Column, conservative: bool = True) -> Column:
    """fast, balanced or deep: what a task of a tier and risk needs at least."""
    change, hard = task.isin("coding", "planning", "debugging", "review"), tier.isin("complex", "extended")
    needs = F.greatest(
        F.when(task.isin("debugging", "review"), 2).otherwise(1),
        F.when(change, F.when(tier == "extended", 3).when(tier == "complex", 2).otherwise(1)).when(hard, 2).otherwise(1),
        F.when(F.lit(conservative) & (risk_level == "high"), F.when(hard, 3).otherwise(2)).otherwise(1),
    )
    return F.get(F.array(*[F.lit(c) for c in CAPABILITIES]), needs - 1)


def query_views(query: Column, most: int = 3, clause_terms: int = 5, long_terms: int = 18) -> Column:
    """The query with single spaces, then its best clauses: five distinct terms and 24 characters or more, most terms first, then
    the longest, then the first. A long query without one has its first and last 60 % of words. At most ``most`` views, told apart
    without case; none for an empty query."""
    plain = lambda t: F.btrim(F.regexp_replace(t, r"(?U)\s+", " "))
    new = lambda seen, v: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(v)), seen).otherwise(F.concat(seen, F.array(v)))

    def views(whole: Column) -> Column:
        marked = F.transform(F.split(query, r"\n+|(?<=[.!?;])(?U:\s+)"), lambda x, i: F.struct((-F.size(F.array_distinct(terms(plain(x))))).alias("n"), (-F.length(plain(x))).alias("size"), i.alias("i"), plain(x).alias("view")))
        clauses = F.array_sort(F.filter(marked, lambda c: (c["n"] <= -clause_terms) & (c["size"] <= -24)))
        with_clauses = F.aggregate(clauses, F.array(whole), lambda seen, c: new(seen, c["view"]))
        words = F.split(whole, " ")
        width = F.greatest(F.lit(12), F.ceil(F.size(words) * 0.6)).cast("int")
        ends = F.array(F.array_join(F.slice(words, F.lit(1), width), " "), F.array_join(F.slice(words, -width, width), " "))
        windows = F.when((F.size(terms(whole)) >= long_terms) & (width < F.size(words)), F.aggregate(ends, F.array(whole), new)).otherwise(F.array(whole))
        several = let(with_clauses, lambda v: F.when(F.size(v) > 1, v).otherwise(windows))
        found = F.when(F.size(F.array_distinct(terms(whole))) < clause_terms, F.array(whole)).otherwise(several)
        return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.slice(found, 1, most))

    return let(plain(F.coalesce(query, F.lit(""))), views)
