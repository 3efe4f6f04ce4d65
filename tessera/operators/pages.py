"""Web pages as visible lines, and the lines of a page that a query is about.

``visible_lines`` reads tags from left to right with a stack: what is inside a hidden or noise element gives no line, void
elements open nothing, an end tag closes the element opened last. ``focused`` is a plan over the lines of all pages: lines
with rare terms of the query and their neighbours first, then headings and landmarks, then controls, within a number of
lines a page.

Null and empty pages have no lines; pages without a query, or whose query matches nothing, give their first lines.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What elements and roles are.
INTERACTIVE_TAGS = {"a", "button", "input", "select", "option", "textarea", "form", "label", "summary"}
STRUCTURAL_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "main", "nav", "dialog", "table"}
NOISE_TAGS = {"script", "style", "noscript", "svg", "path", "meta", "link", "template"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INTERACTIVE_ROLES = {"button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "menuitem", "option", "tab", "treeitem", "slider", "spinbutton"}
STRUCTURAL_ROLES = {"heading", "alert", "dialog", "navigation", "main", "form", "table", "row", "cell", "list", "listitem", "tabpanel"}
SHOWN_ATTRIBUTES = ("id", "name", "type", "role", "href", "value", "placeholder", "aria-label", "aria-expanded", "aria-selected", "aria-checked", "title", "alt")
QUERY_WORD = "[A-Za-z0-9_./:@-]{2,}"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']?)|[\"'])*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}


def _attributes(text: str) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        out[name.lower()] = entities.unescape(value) if value else None
    return out


def page_lines(page: str) -> list[tuple[str, bool, bool]]:
    """The lines of a page: text, interactive, structural."""
    lines: list[tuple[str, bool, bool]] = []
    opened: list[bool] = []  # for each open element, whether it hides what is inside
    hiding = at = 0

    def add(line: str, interactive: bool = False, structural: bool = False) -> None:
        line = " ".join(line.split())
        if line and (not lines or lines[-1][0] != line):
            lines.append((line, interactive, structural))

    while at < len(page):
        token = _TOKEN.search(page, at)
        text = page[at : token.start() if token else len(page)]
        if not hiding:
            for part in re.split("(<)", text):  # a sign that begins no tag stands for itself
                add(entities.unescape(part))
        if token is None:
            break
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["close"]:
            if opened:
                hiding -= opened.pop()
            continue
        attributes = _attributes(token["attrs"])
        style = (attributes.get("style") or "").replace(" ", "").lower()
        hidden = tag in NOISE_TAGS or "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        closed = token["attrs"].endswith("/")
        if not hidden and not hiding:
            role = (attributes.get("role") or "").lower()
            interactive, structural = tag in INTERACTIVE_TAGS or role in INTERACTIVE_ROLES, tag in STRUCTURAL_TAGS or role in STRUCTURAL_ROLES
            if interactive or structural:
                add("<" + " ".join([tag, *(f"{k}={attributes[k]!r}" for k in SHOWN_ATTRIBUTES if attributes.get(k))]) + ">", interactive, structural)
        if tag not in VOID_TAGS and not closed:
            opened.append(hidden)
            hiding += hidden
            if tag in _RAW:  # what is inside is no markup
                end = _RAW[tag].search(page, at)
                at = end.start() if end else len(page)
    return lines


def visible_lines(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """key, idx, line, interactive, structural for all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lines = page_lines(b.column(1)[i].as_py() or "")
                if lines:
                    text, interactive, structural = zip(*lines)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(lines), b.column(0).type), pa.array(range(len(lines)), pa.int64()), pa.array(text), pa.array(interactive), pa.array(structural)], names=[key, "idx", "line", "interactive", "structural"])

    return pages.select(key, page).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, idx long, line string, interactive boolean, structural boolean")


def query_words(query: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(QUERY_WORD), F.lit(0)), F.lower))


def focused(lines: DataFrame, queries: DataFrame, max_lines: int = 40, key: str = "page_id") -> DataFrame:
    """The lines of each page to show, with ``hits`` (the query's words in the line), for queries (key, query), one a page."""
    if max_lines <= 0:
        raise ValueError("max_lines must be positive")
    budget = max(4, min(max_lines // 3, 24))
    limit = max(1, max_lines - budget)
    page = Window.partitionBy(key)
    asked = queries.select(key, query_words(F.col("query")).alias("words"))
    none = F.array().cast("array<string>")
    own = lines.join(asked, key, "left").withColumn("words", F.coalesce("words", none)).withColumn("low", F.lower("line"))
    own = own.withColumn("hits", F.filter("words", lambda w: F.contains(F.col("low"), w))).withColumn("n", F.count("*").over(page)).drop("low")
    # how many lines of its page each word is in: at most as many rows as the queries have words
    rare = own.select(key, F.explode("hits").alias("w")).groupBy(key, "w").agg(F.count("*").alias("c")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "c"))).alias("often"))
    own = own.join(rare, key, "left")
    score = F.aggregate("hits", F.lit(0.0), lambda a, w: a + 1.0 / F.element_at("often", w)) + F.greatest(F.lit(0), F.size("hits") - 1)
    scored = own.where(F.size("hits") > 0).withColumn("r", F.row_number().over(page.orderBy(F.desc(F.round(score, 9)), "idx")))
    around = scored.where(F.col("r") <= limit).select(key, "n", "r", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("off"), "idx").select(key, "n", "r", "off", (F.col("idx") + F.col("off")).alias("idx"))
    around = around.where((F.col("idx") >= 0) & (F.col("idx") < F.col("n"))).groupBy(key, "idx").agg(F.min(F.struct("r", "off")).alias("o"))
    near = around.withColumn("f", F.row_number().over(page.orderBy("o"))).where(F.col("f") <= limit).select(key, "idx", F.lit(1).alias("focus"))
    all_ = own.join(near, [key, "idx"], "left").withColumn("focus", F.coalesce("focus", F.lit(0)))
    in_order = page.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.sum(c).over(page)
    all_ = all_.withColumn("n_focus", count("focus")).withColumn("any_hit", F.col("often").isNotNull())
    more = F.when(F.col("structural") & (F.col("focus") == 0), 1).otherwise(0)
    all_ = all_.withColumn("s", more).withColumn("s", F.when(F.sum("s").over(in_order) <= F.least(F.lit(budget), F.lit(max_lines) - F.col("n_focus")), F.col("s")).otherwise(0)).withColumn("n_s", count("s"))
    more = F.when(F.col("interactive") & (F.col("focus") + F.col("s") == 0), 1).otherwise(0)
    all_ = all_.withColumn("i", more).withColumn("i", F.when(F.sum("i").over(in_order) <= F.least(F.lit(budget) - F.col("n_s"), F.lit(max_lines) - F.col("n_focus") - F.col("n_s")), F.col("i")).otherwise(0))
    all_ = all_.withColumn("chosen", F.col("focus") + F.col("s") + F.col("i")).withColumn("n_chosen", count("chosen"))
    # without a match the page's first lines fill up; with one, at most six of them
    filled = F.col("n_chosen") + F.sum(1 - F.col("chosen")).over(page.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    first = (F.col("idx") < max_lines) & ((F.col("idx") == 0) | (F.coalesce(filled, F.col("n_chosen")) < max_lines))
    lead = F.col("idx") < F.least(F.lit(6), F.lit(max_lines) - F.col("n_chosen"))
    shown = all_.withColumn("lead", F.when(F.col("any_hit"), lead).otherwise(first)).where((F.col("chosen") == 1) | F.col("lead"))
    return shown.withColumn("at", F.row_number().over(page.orderBy("idx"))).where(F.col("at") <= max_lines).select(key, "idx", "line", "interactive", "structural", "hits")
