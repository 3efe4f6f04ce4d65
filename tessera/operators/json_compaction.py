"""Nested JSON made smaller: long arrays keep their ends and their anomalies, or what a query is about, with counts of what went.

Both forms give valid JSON and are taken only where they are shorter than the text. ``bounded`` keeps every object; an array
of more than 12 items keeps its first five, its last four, and every item that tells of trouble, with the number of items
left out in each gap; it goes five levels deep. ``focused_on`` also bounds objects: of more than 16 fields those with a
word of the query or a known important name stay, then the first eight; of arrays of more than ten items up to six: those
with important fields, those with a word of the query, and the first three; below four levels only sizes stay.

Null texts stay null; text that is no JSON stays as it is; equal samples are shown once; numbers keep Python's form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.json import STATE_NAMES, STATES, TROUBLE

OMITTED, FIELDS, ABOUT = "_omitted_items", "_omitted_fields", "_compacted"
EMPTY = (None, False, "", [], {})


def anomalous(item: Any) -> bool:
    """Whether an object has a field named for trouble with something in it, or a state that is bad."""
    if not isinstance(item, dict):
        return False
    named = (v for k, v in item.items() if any(t in k.lower() for t in TROUBLE.split("|")))
    return any(v not in EMPTY for v in named) or any(k.lower() in STATE_NAMES and str(v).lower() in STATES for k, v in item.items())


def bounded(value: Any, depth: int = 0) -> Any:
    if depth >= 5 or not isinstance(value, (list, dict)):
        return value
    if isinstance(value, dict):
        return {k: bounded(v, depth + 1) for k, v in value.items()}
    n = len(value)
    if n <= 12:
        return [bounded(v, depth + 1) for v in value]
    out, gap = [], 0
    for i, v in enumerate(value):
        if i >= 5 and i < n - 4 and not anomalous(v):
            gap += 1
            continue
        if gap:
            out.append({OMITTED: gap})
            gap = 0
        out.append(bounded(v, depth + 1))
    return out


def focused_on(value: Any, words: list[str], important: frozenset[str] = frozenset(), depth: int = 0) -> Any:
    about = lambda v: bool(words) and any(w in json.dumps(v, ensure_ascii=False).lower() for w in words)
    below = lambda v: focused_on(v, words, important, depth + 1)
    if not isinstance(value, (list, dict)):
        return value
    if depth >= 4:
        learned = {k: v for k, v in value.items() if k in important} if isinstance(value, dict) else {}
        size = {"type": type(value).__name__, "items": len(value)}
        return {ABOUT: size | ({"learned_fields": len(learned)} if learned else {}), **learned}
    if isinstance(value, dict):
        keep = list(value)
        if len(keep) > 16:
            wanted = [k for k, v in value.items() if k in important or any(w in k.lower() for w in words) or about(v)]
            chosen = set(list(dict.fromkeys([*wanted, *keep[:8]]))[:16])
            keep = [k for k in keep if k in chosen]
        return {k: below(value[k]) for k in keep} | ({FIELDS: len(value) - len(keep)} if len(keep) < len(value) else {})
    if len(value) <= 10:
        return [below(v) for v in value]
    learned = [v for v in value if isinstance(v, dict) and any(k in important and x not in EMPTY for k, x in v.items())][:4]
    hits = [v for v in value if about(v)][:6]
    shown: list[Any] = []
    for v in [*learned, *hits, *value[:3]]:
        if v not in shown and len(shown) < 6:
            shown.append(v)
    if not learned and not hits and len(shown) < 6:
        shown.append(value[-1])
    return {ABOUT: {"type": "list", "items": len(value), "shown": len(shown), "focused": bool(hits)}, "items": [below(v) for v in shown]}


def compacted(payloads: DataFrame, text: str = "text", words: str | None = None, important: frozenset[str] = frozenset()) -> DataFrame:
    """payloads with ``result`` and ``changed``: by ``bounded``, or by ``focused_on`` where ``words`` names an array column of lower-case words."""
    kept = [c for c in payloads.columns if c not in ("result", "changed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            results = []
            asked = b.column(kept.index(words)).to_pylist() if words else [None] * b.num_rows
            for t, w in zip(b.column(kept.index(text)).to_pylist(), asked):
                results.append(t)
                if t is None:
                    continue
                try:
                    value = json.loads(t)
                    small = bounded(value) if words is None else focused_on(value, w or [], important)
                    made = json.dumps(small, ensure_ascii=False, separators=(",", ":"))
                except (ValueError, RecursionError):
                    continue
                if len(made) < len(t):
                    results[-1] = made
            before = b.column(kept.index(text)).to_pylist()
            changed = [r != t for r, t in zip(results, before)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results, pa.string()), pa.array(changed, pa.bool_())], names=[*kept, "result", "changed"])

    own = payloads.select(*[F.col(f"`{c}`") for c in kept])
    from pyspark.sql import types as T

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("result", T.StringType()), T.StructField("changed", T.BooleanType())]))
