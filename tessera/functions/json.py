"""JSON pointers and structural paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def select_pointer(json: Column, pointer: str) -> Column:
    """What an RFC 6901 pointer selects, as text; null where it leads nowhere."""
    if pointer == "":
        return json
    if not pointer.startswith("/"):
        raise ValueError("a pointer is empty or begins with /")
    path = "$"
    for part in pointer[1:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        path += f"[{part}]" if part.isdigit() else f"['{part}']"
    return F.get_json_object(json, path)


def pointer_candidates(pointer: Column) -> Column:
    """A pointer and its ancestors, array positions as *."""
    parts = F.transform(F.filter(F.split(pointer, "/"), lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]+$"), "*").otherwise(x))
    each = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))
    return F.element_at(F.transform(F.array(parts), lambda p: F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(each(p))), 1)


def field_paths(json: Column) -> Column:
    """The top-level fields of an object."""
    return F.json_object_keys(json)


# Words of a name and values of a state that tell of trouble.
TROUBLE = "error|exception|warning|failure|failed"
STATE_NAMES = ("status", "state", "level", "severity")
STATES = ("error", "failed", "failure", "fatal", "critical", "warning", "warn")


def canonical_json(json: Column) -> Column:
    """Compact JSON with the names of every object in order; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(json))


def json_anomaly(json: Column) -> Column:
    """Whether an object has a field named for trouble with something in it, or a state that is bad; false for all else."""
    fields = F.map_entries(F.from_json(json, "map<string, variant>"))

    def bad(e: Column) -> Column:
        name, raw = F.lower(e["key"]), F.coalesce(F.to_json(e["value"]), F.lit("null"))
        empty = raw.isin("null", "false", '""', "[]", "{}") | raw.rlike(r"^-?0(\.0*)?([eE].*)?$")
        return (name.rlike(TROUBLE) & ~empty) | (name.isin(*STATE_NAMES) & F.lower(F.btrim(raw, F.lit('"'))).isin(*STATES))

    return F.coalesce(F.exists(fields, bad), F.lit(False))
