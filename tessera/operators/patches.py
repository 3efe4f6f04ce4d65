"""Unified diffs as rows: hunks, changed lines of both sides, changed symbols, and a review of each patch.

A line belongs to a hunk as long as the lengths in the hunk's header are not used up, so text that looks like a header is
told from one. Null and empty patches have no lines; a hunk that is cut short ends with its patch; repeated patches of one
id are one patch read twice, so ids should be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import evidence_category, let, lines
from tessera.operators.intervals import merge_windows, points_in_intervals

#: Forms of a diff's lines.
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
HEADER = r"^(?:diff --git |index |--- |\+\+\+ |@@ |new file mode |deleted file mode |rename (?:from|to) |similarity index |Binary files )"


def patch_lines(patches: DataFrame, key: str = "patch_id", text: str = "text") -> DataFrame:
    """key, path, old_path, status (A, D, R or M), hunk, kind (+, - or a space), old_line, new_line, line: the lines of all hunks.

    A line that was added has no old_line, one that was removed no new_line; ``path`` is that of the new side, or of the old one where the file is gone.
    """
    in_order = Window.partitionBy(key).orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    raw = patches.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    number = lambda i, empty: F.when(F.regexp_extract("line", HUNK, i) == "", empty).otherwise(F.regexp_extract("line", HUNK, i).cast("long"))
    is_hunk = F.col("line").rlike(HUNK)
    head = F.when(is_hunk, F.struct(number(1, F.lit(0)).alias("old"), number(2, F.lit(1)).alias("old_n"), number(3, F.lit(0)).alias("new"), number(4, F.lit(1)).alias("new_n")))
    own = raw.withColumn("hunk", F.sum(is_hunk.cast("long")).over(so_far)).withColumn("head", F.last(head, True).over(so_far)).withColumn("is_hunk", is_hunk)
    kind = F.substring("line", 1, 1)
    kind = F.when(kind == "", " ").otherwise(kind)  # editors strip the blank of an empty context line
    before = Window.partitionBy(key, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    used = lambda *kinds: F.coalesce(F.sum(F.when(~F.col("is_hunk") & F.col("kind").isin(*kinds), 1).otherwise(0)).over(before), F.lit(0))
    own = own.withColumn("kind", kind).withColumn("o", used(" ", "-")).withColumn("n", used(" ", "+"))
    inside = (F.col("hunk") > 0) & ~F.col("is_hunk") & ((F.col("o") < F.col("head.old_n")) | (F.col("n") < F.col("head.new_n")) | (F.col("kind") == "\\"))
    own = own.withColumn("inside", inside)
    # what the headers say, from the last one in front; each file begins with its own "diff" or "---" line
    said = lambda pattern: F.when(~F.col("inside") & F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))
    starts = (~F.col("inside") & F.col("line").startswith("diff --git ")).cast("int")
    own = own.withColumn("file", F.sum(starts).over(so_far))
    lone = (~F.col("inside") & F.col("line").startswith("--- ") & (F.lag(F.col("inside")).over(in_order) | (F.col("pos") == 0))).cast("int")
    own = own.withColumn("file", F.struct("file", F.sum(lone).over(so_far).alias("lone")))
    whole = Window.partitionBy(key, "file")
    first = lambda c: F.first(c, True).over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    path = lambda c: F.when(c != "/dev/null", F.regexp_replace(c, r"^[ab]/", ""))
    new, old = first(said(r"^\+\+\+ ([^\t]*)")), first(said(r"^--- ([^\t]*)"))
    to, fro = first(said("^rename to (.*)")), first(said("^rename from (.*)"))
    own = own.withColumn("new_path", F.coalesce(path(new), to)).withColumn("old_path", F.coalesce(path(old), fro))
    status = F.when(first(said("^(new) file mode ")).isNotNull() | (old == "/dev/null"), "A").when(first(said("^(deleted) file mode ")).isNotNull() | (new == "/dev/null"), "D").when(to.isNotNull(), "R").otherwise("M")
    own = own.withColumn("status", status).where(F.col("inside") & F.col("kind").isin(" ", "+", "-"))
    old_line = F.when(F.col("kind") != "+", F.col("head.old") + F.col("o"))
    new_line = F.when(F.col("kind") != "-", F.col("head.new") + F.col("n"))
    return own.select(key, F.coalesce("new_path", "old_path").alias("path"), "old_path", "status", "hunk", "kind", old_line.cast("long").alias("old_line"), new_line.cast("long").alias("new_line"), F.substring("line", F.lit(2), F.length("line")).alias("line"))


def changed_ranges(changed: DataFrame, key: str = "patch_id") -> DataFrame:
    """key, path, side (old or new), start_at, end_at: runs of changed lines."""
    new = changed.where("kind = '+'").select(key, "path", F.lit("new").alias("side"), F.col("new_line").alias("start_at"), F.col("new_line").alias("end_at"))
    old = changed.where("kind = '-'").select(key, F.coalesce("old_path", "path").alias("path"), F.lit("old").alias("side"), F.col("old_line").alias("start_at"), F.col("old_line").alias("end_at"))
    return merge_windows(new.unionByName(old), [key, "path", "side"])


def changed_symbols(changed: DataFrame, symbols: DataFrame, keys: list[str], side: str = "new", key: str = "patch_id") -> DataFrame:
    """key, path, name: the symbols (keys, path, name, start_line, end_line) with a line that was added (side new) or removed (old).

    A file that is changed without a line of this side, as by a pure deletion, counts with all of its symbols.
    """
    kind, at = ("+", "new_line") if side == "new" else ("-", "old_line")
    path = F.col("path") if side == "new" else F.coalesce("old_path", "path")
    own = changed.select(*{key: 1, **dict.fromkeys(keys, 1)}, path.alias("path"), F.when(F.col("kind") == kind, F.col(at)).alias("at"))
    hit = points_in_intervals(own.where("at is not null").distinct(), symbols, [*keys, "path"], "at", "start_line", "end_line").select(key, "path", "name")
    bare = own.groupBy(*{key: 1, **dict.fromkeys(keys, 1)}, "path").agg(F.max("at").alias("at")).where("at is null")
    return hit.unionByName(bare.join(symbols, [*keys, "path"]).select(key, "path", "name")).distinct()


def signature_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, symbol, change (changed, removed, added) of symbols (keys, path, parent, name, signature)."""
    named = lambda df, c: df.select(*keys, "path", F.concat_ws(".", F.when(F.col("parent") != "", F.col("parent")), "name").alias("symbol"), F.coalesce("signature", F.lit("")).alias(c)).dropDuplicates([*keys, "path", "symbol"])
    both = named(old, "was").join(named(new, "now"), [*keys, "path", "symbol"], "full_outer")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return both.select(*keys, "path", "symbol", change.alias("change")).where("change is not null")


def review(changed: DataFrame, signatures: DataFrame | None = None, key: str = "patch_id") -> DataFrame:
    """One row a patch: files, added, removed, tests_changed, source_changed, api_changes, and warnings in a fixed order."""
    is_test = F.lower("path").rlike("test|spec")
    each = changed.groupBy(key).agg(
        F.countDistinct("path").alias("files"), F.count_if(F.col("kind") == "+").alias("added"), F.count_if(F.col("kind") == "-").alias("removed"),
        F.coalesce(F.bool_or(is_test), F.lit(False)).alias("tests_changed"), F.coalesce(F.bool_or(~is_test & (evidence_category(F.col("path")) == "source")), F.lit(False)).alias("source_changed"),
    )
    if signatures is None:
        each = each.withColumn("api_changes", F.lit(0).cast("long"))
    else:
        api = signatures.where(F.col("change") != "added").groupBy(key).agg(F.count("*").alias("api_changes"))
        each = each.join(api, key, "left").withColumn("api_changes", F.coalesce("api_changes", F.lit(0).cast("long")))
    told = [F.when(F.col("api_changes") > 0, "public-api-change"), F.when(F.col("source_changed") & ~F.col("tests_changed"), "tests-not-changed")]
    return each.withColumn("warnings", F.array_compact(F.array(*told)))


def without_context(text: Column) -> Column:
    """A diff with each run of unchanged lines as one line that counts them; the diff itself where that is not shorter."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit(0).alias("gap"))
    mark = lambda acc: F.when(acc["gap"] > 0, F.array(F.concat(F.lit(" ... "), acc["gap"].cast("string"), F.lit(" unchanged lines omitted ...")))).otherwise(none)

    def step(acc: Column, line: Column) -> Column:
        kept = line.rlike(HEADER) | line.rlike(r"^[+-]|^\\ No newline")
        return F.when(kept, F.struct(F.concat(acc["out"], mark(acc), F.array(line)).alias("out"), F.lit(0).alias("gap"))).otherwise(F.struct(acc["out"].alias("out"), (acc["gap"] + 1).alias("gap")))

    whole = F.concat(F.array_join(F.aggregate(lines(text), start, step, lambda acc: F.concat(acc["out"], mark(acc))), "\n"), F.lit("\n"))
    return let(whole, lambda w: F.when(F.length(w) < F.length(text), w).otherwise(text))
