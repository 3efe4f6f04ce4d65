"""Line-level compaction: every operator explodes lines, keeps their position and works within one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ERROR_HINTS, let, lines


def exploded(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, i (from 0), line."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))


def matching_lines(df: DataFrame, key: str, pattern: str, limit: int, text: str = "text") -> DataFrame:
    """Distinct lines that match, in order of first occurrence, ``limit`` at most for each text (the feature's own bound)."""
    # within a text: no shuffle
    hits = F.array_distinct(F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern)))
    return df.select(key, F.posexplode(F.slice(hits, 1, limit)).alias("i", "line"))


def keep_matching(df: DataFrame, key: str, pattern: str, limit: int, text: str = "text") -> DataFrame:
    """key, n_lines and kept (characters with line ends) of texts that their matching lines make shorter."""
    hits = F.slice(F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern)), 1, limit)
    own = df.select(key, F.length(text).alias("n"), hits.alias("hits")).where(F.size("hits") > 0)
    kept = F.aggregate("hits", F.lit(0), lambda s, x: s + F.length(x) + 1).cast("long")
    return own.select(key, "n", F.size("hits").cast("long").alias("n_lines"), kept.alias("kept")).where("kept < n").drop("n")


def line_range(df: DataFrame, key: str, offset: int, limit: int, text: str = "text") -> DataFrame:
    """Lines ``offset`` to ``offset + limit`` of each text, by position (from 0)."""
    own = df.select(key, F.split(text, "\n").alias("a")).where(F.size("a") > offset)
    own = own.select(key, F.posexplode(F.slice("a", offset + 1, limit)).alias("i", "line"))
    return own.select(key, (F.col("i") + offset).cast("long").alias("line_no"), "line")


def head_errors_tail(df: DataFrame, key: str, max_lines: int = 80, keep_tail: int = 20, max_errors: int = 40, text: str = "text") -> DataFrame:
    """key, i, line, part: the first lines, distinct error lines between, and the last lines of each text.

    The head shrinks by the number of error lines, at most 30, and never below 10.
    """
    # within each text's own array of lines, each step bound once, so that none is computed again for every line: nothing is shuffled

    def picked(rows: Column) -> Column:
        told = lambda part: F.filter(rows, lambda r: r["part"] == part)
        first = lambda e, t: F.transform(F.slice(F.array_distinct(t), 1, max_errors), lambda k: F.element_at(e, F.array_position(t, k).cast("int")))
        errors = let(told("error"), lambda e: let(F.transform(e, lambda r: F.trim(r["line"])), lambda t: first(e, t)))
        return F.concat(told("head"), errors, told("tail"))

    def of(a: Column) -> Column:
        n = F.size(a)
        tail = F.greatest(F.lit(0), F.least(F.lit(keep_tail), n - 1))
        hits = F.size(F.filter(a, lambda x: x.rlike(ERROR_HINTS)))
        head = F.greatest(F.lit(0), F.least(F.greatest(F.lit(10), F.lit(max_lines - keep_tail) - F.least(hits, F.lit(30))), n - tail))
        part = lambda x, i, h: F.when((n <= max_lines) | (i < h), "head").when(i >= n - tail, "tail").when(x.rlike(ERROR_HINTS), "error")
        rows = lambda h: F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("line"), part(x, i, h).alias("part"))), lambda r: r["part"].isNotNull())
        return let(head, lambda h: let(rows(h), picked))

    own = df.select(key, F.explode_outer(let(F.split(text, "\n"), of)).alias("r")).where("r is not null")  # outer, as all would run again in a filter
    return own.select(key, F.col("r.i").cast("long").alias("i"), "r.line", "r.part")


def collapsed_runs(df: DataFrame, key: str, minimum: int = 3, text: str = "text") -> DataFrame:
    """Runs of equal lines: key, start (from 0), line, n, for runs of ``minimum`` non-blank lines or more."""
    rows = exploded(df, key, text)
    w = Window.partitionBy(key).orderBy("i")
    flagged = rows.withColumn("new", F.when(F.lag("line").over(w) == F.col("line"), 0).otherwise(1))
    runs = flagged.withColumn("run", F.sum("new").over(w)).groupBy(key, "run").agg(F.min("i").alias("start"), F.first("line").alias("line"), F.count("*").alias("n"))
    return runs.where((F.col("n") >= minimum) & (F.trim("line") != "")).select(key, F.col("start").cast("long").alias("start"), "line", "n")


def ranked_windows(text: Column, words: Column, size: int = 80, overlap: int = 20, top: int = 8) -> Column:
    """Windows of lines (structs score, start_at, end_at, from 1) of a text by what they hold of the words: twice each word's count, 8
    at most, and 5 where it is declared; the first window has 0.25 more. Best first; without any hit the first, middle and last."""

    def of(a: Column) -> Column:
        n = F.size(a)
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), n - overlap), F.lit(size - overlap))
        spans = F.transform(steps, lambda s: F.struct(s.alias("start_at"), F.least(n, s + size - 1).alias("end_at")))

        def scored(w: Column) -> Column:
            def body(b: Column) -> Column:
                def part(acc: Column, t: Column) -> Column:
                    count = ((F.length(b) - F.length(F.replace(b, t, F.lit("")))) / F.length(t)).cast("int")
                    declared = F.regexp_like(b, F.concat(F.lit(r"\b(?:class|def|function|async\s+function|interface|type|const|let|var)\s+"), F.regexp_replace(t, r"([^A-Za-z0-9_])", r"\\\\$1"), F.lit(r"\b")))
                    return acc + F.least(count, F.lit(8)) * 2.0 + F.when((count > 0) & declared, 5.0).otherwise(0.0)

                return F.aggregate(words, F.when(w["start_at"] == 1, 0.25).otherwise(0.0), part)

            text_of = F.lower(F.array_join(F.slice(a, w["start_at"], w["end_at"] - w["start_at"] + 1), "\n"))
            return F.struct((-let(text_of, body)).alias("less"), w["start_at"].alias("start_at"), w["end_at"].alias("end_at"))

        out = lambda x: F.struct((-x["less"]).alias("score"), x["start_at"].alias("start_at"), x["end_at"].alias("end_at"))

        def chosen(r: Column) -> Column:
            hits = F.slice(F.array_sort(F.filter(r, lambda x: x["less"] < 0)), 1, top)
            spread = F.array(F.get(r, F.lit(0)), F.get(r, F.floor(F.size(r) / 2).cast("int")), F.element_at(r, -1))
            return F.transform(F.when((F.size(hits) > 0) & (F.size(words) > 0), hits).otherwise(F.array_distinct(spread)), out)

        return F.when(n > 0, let(F.transform(spans, scored), chosen)).otherwise(F.array().cast("array<struct<score:double,start_at:int,end_at:int>>"))

    return let(lines(text), of)


def compressed_log(text: Column, words: Column, critical: str = r"(?i)(error|exception|fail|fatal|panic|traceback|assert|caused by)", max_lines: int = 80, edge: int = 12) -> Column:
    """The first and last lines of a log and, between them, the first critical lines and lines with one of the words, ``max_lines`` in all."""

    def of(a: Column) -> Column:
        n = F.size(a)
        low = F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        inside = lambda r: (r["i"] >= edge) & (r["i"] < n - edge)
        told = lambda r: r["x"].rlike(critical) | F.exists(words, lambda w: F.contains(F.lower(r["x"]), w))
        room = F.greatest(F.lit(0), max_lines - F.least(n, F.lit(2 * edge)))
        middle = F.slice(F.filter(low, lambda r: inside(r) & told(r)), F.lit(1), room)
        rows = F.slice(F.concat(F.slice(a, 1, edge), F.transform(middle, lambda r: r["x"]), F.slice(a, F.greatest(F.lit(edge), n - edge) + 1, edge)), 1, max_lines)
        note = F.concat(F.lit("[log: "), n.cast("string"), F.lit(" lines -> "), F.size(rows).cast("string"), F.lit(" retained]"))
        return F.when(n <= max_lines, text).otherwise(F.concat(F.array_join(F.concat(F.array(note), rows), "\n"), F.lit("\n")))

    return let(lines(text), of)


def distinct_hits(hits: Column, most: int = 3, overlap: float = 0.70) -> Column:
    """Of hits (structs with start_at and end_at, best first) those that overlap no kept one by that share of the shorter, ``most`` at most."""
    from tessera.operators.intervals import overlap_ratio

    near = lambda a, b: overlap_ratio(a["start_at"], a["end_at"] + 1, b["start_at"], b["end_at"] + 1) >= overlap
    none = F.slice(hits, 1, 0)
    return F.aggregate(hits, none, lambda acc, h: F.when((F.size(acc) < most) & ~F.exists(acc, lambda k: near(k, h)), F.concat(acc, F.array(h))).otherwise(acc))


def route_processors(outputs: DataFrame, processors: DataFrame, command: str, failed: str) -> DataFrame:
    """outputs with ``processor``: the first matching processor of each row, by priority and name, or generic.

    processors: name, priority, command_regex, handles_failure, a small table by definition; it becomes one expression, so rows
    stay where they are. A failed output skips those that don't handle failure.
    """
    limit = 1000
    rows = processors.select("priority", "name", "command_regex", "handles_failure").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("the processors are a dimension of some dozens of rows")
    chosen = F.when(F.lit(False), F.lit(""))
    for r in sorted(rows):
        chosen = chosen.when(F.col(command).rlike(r["command_regex"]) & (F.lit(r["handles_failure"]) | ~F.coalesce(F.col(failed), F.lit(False))), r["name"])
    return outputs.withColumn("processor", chosen.otherwise("generic"))
