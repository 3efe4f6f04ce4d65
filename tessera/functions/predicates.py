"""Predicates built from plain values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ignoring_case(text: Column, what: str) -> Column:
    """LIKE over what was typed, its wildcards taken literally."""
    safe = what.replace("!", "!!").replace("%", "!%").replace("_", "!_")
    return F.ilike(text, F.lit(f"%{safe}%"), F.lit("!"))


def conjunction(wanted: dict[str, object]) -> Column:
    """column = value, or column IN values, for each entry; no entry: true."""
    each = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in wanted.items()]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def leaks(query: Column, forbidden: list[str]) -> Column:
    """Whether a query holds one of the identifiers that it must not name."""
    return F.exists(F.array(*[F.lit(x.lower()) for x in forbidden]), lambda x: F.contains(F.lower(query), x))
