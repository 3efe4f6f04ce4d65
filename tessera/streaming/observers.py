"""Observers of ordered events with keyed state: one fold for batches and streams.

A fold takes a key's events one by one in order of time and id, keeps a small state, and gives rows. In a batch the events
are sorted within partitions and folded as they pass, so no key is held in memory. In a stream the events wait in a list
state until the watermark has passed them, then a timer hands them to the same fold in the same order: a stream gives the
rows of the batch whatever its micro-batches are, late rows within the watermark included; rows behind it are dropped, as
in any stream. A key that is idle for longer than ``ttl`` starts anew, and its state is removed by a timer.

Null keys are a key of their own in a batch and in a stream; events without a time are left out; ties of time and id
follow the event's content, so repeated rows have a defined order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """What an observer does: ``schema`` of its rows (without the key), a first state (JSON), and a step."""

    schema: str = ""

    def start(self) -> dict:
        return {}

    def step(self, state: dict, event: dict) -> list[tuple]:
        raise NotImplementedError


def _folded(fold: Fold, state: dict | None, at: int, event: str, ttl: int | None) -> tuple[dict, list[tuple]]:
    """The state after an event (``last`` is its time) and the rows that it gives."""
    if state is None or (ttl is not None and at - state["last"] > ttl):
        state = {"own": fold.start()}
    rows = fold.step(state["own"], json.loads(event))
    state["last"] = at
    return state, rows


def observe(events: DataFrame, fold: Fold, key: str, ts: str, id_column: str, event: dict[str, Column], ttl_seconds: float | None = None, delay: str = "1 hour") -> DataFrame:
    """key and the fold's rows for a batch or a stream. ``event`` names what the fold sees; a stream is late by up to ``delay``."""
    ttl = None if ttl_seconds is None else int(ttl_seconds * 1e6)
    own = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(id_column).cast("long").alias("id"), F.to_json(F.struct(*[c.alias(n) for n, c in event.items()])).alias("event"))
    key_type = dict(own.dtypes)["key"]
    out = f"{key} {key_type}, {fold.schema}"
    if events.isStreaming:
        waiting = own.withWatermark("ts", delay).groupBy("key")
        return waiting.transformWithStateInPandas(statefulProcessor=_Ordered(fold, ttl, [f.name for f in StructType.fromDDL(out)]), outputStructType=StructType.fromDDL(out), outputMode="append", timeMode="eventtime")
    columns = StructType.fromDDL(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(columns)
        state, now, first = None, None, True
        for b in batches:
            rows = []
            for k, at, e in zip(*(b.column(c).to_pylist() for c in ("key", "at", "event"))):
                if first or k != now:
                    state, now, first = None, k, False
                state, made = _folded(fold, state, at, e, ttl)
                rows += [(k, *r) for r in made]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return own.select("key", "at", "id", "event").repartition("key").sortWithinPartitions("key", "at", "id", "event").mapInArrow(run, out)


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, ttl: int | None, names: list[str]):
        self.fold, self.ttl, self.names = fold, ttl, names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, event string")
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(a), None if i is None or i != i else int(i), e) for frame in rows for a, i, e in zip(frame["at"], frame["id"], frame["event"])]
        self.waiting.appendList(new)
        self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= passed), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
        later = [tuple(r) for r in rows if r[0] > passed]
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        made: list[tuple] = []
        for at, _, event in due:
            state, out = _folded(self.fold, state, at, event, self.ttl)
            made += out
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if later:
            self.handle.registerTimer(-(-min(r[0] for r in later) // 1000))
        if state is not None:
            if self.ttl is not None and not later and state["last"] + self.ttl <= passed:
                self.state.clear()
            else:
                self.state.update((json.dumps(state),))
                if self.ttl is not None:
                    self.handle.registerTimer(-(-(state["last"] + self.ttl) // 1000))
        if made:
            yield pd.DataFrame([(key[0], *r) for r in made], columns=self.names)

    def close(self) -> None:
        pass


@dataclass
class Waste(Fold):
    """Tool calls (turn, command, output, failed, edit, id): signals of waste, each told once a turn, from a bounded working state.

    repeat: three of the last ten calls have this command and turn; retry: three of the last six failures have this command,
    turn and output (which isn't empty); cascade: the twelfth or a later call of a turn without an edit.
    """

    commands: int = 10
    failures: int = 6
    repeat: int = 3
    cascade: int = 12
    schema: str = "turn long, signal string, about string, event_id long"

    def start(self) -> dict:
        return {"turn": None, "calls": 0, "edits": 0, "commands": [], "failures": [], "told": []}

    def step(self, state: dict, e: dict) -> list[tuple]:
        turn, command, output = e.get("turn"), e.get("command"), e.get("output") or ""
        if state["turn"] != turn:
            state.update(turn=turn, calls=0, edits=0, told=[])
        state["calls"] += 1
        state["edits"] += bool(e.get("edit"))
        state["commands"] = [*state["commands"], [turn, command]][-self.commands :]
        found = []
        if state["commands"].count([turn, command]) >= self.repeat:
            found.append(("repeat", command))
        if e.get("failed"):
            state["failures"] = [*state["failures"], [turn, command, output]][-self.failures :]
            if output and state["failures"].count([turn, command, output]) >= self.repeat:
                found.append(("retry", f"{command}:{e.get('output_hash', '')}"))
        if state["calls"] >= self.cascade and not state["edits"]:
            found.append(("cascade", ""))
        new = [f for f in found if list(f) not in state["told"]]
        state["told"] += [list(f) for f in new]
        return [(turn, signal, about, e.get("id")) for signal, about in new]


@dataclass
class PrefixReuse(Fold):
    """Requests (elements, id): exact where the elements are those before, extended where they begin with those, else miss."""

    schema: str = "event_id long, reuse string, reused long"

    def step(self, state: dict, e: dict) -> list[tuple]:
        now, before = e.get("elements") or [], state.get("before")
        shared = 0
        for a, b in zip(before or [], now):
            if a != b:
                break
            shared += 1
        kind = "miss" if before is None else "exact" if before == now else "extended" if before and shared == len(before) else "miss"
        state["before"] = now
        return [(e.get("id"), kind, shared)]


@dataclass
class Diagnostics(Fold):
    """Snapshots (stream, found, id): what came, went and stayed against the snapshot before of the same stream, if that had anything."""

    schema: str = "event_id long, added string, resolved string, remaining string"

    def step(self, state: dict, e: dict) -> list[tuple]:
        name, now = str(e.get("stream")), set(e.get("found") or [])
        before = set(state.get(name, []))
        state[name] = sorted(now)
        if not before:
            return []
        return [(e.get("id"), *(",".join(sorted(s)) for s in (now - before, before - now, now & before)))]


@dataclass
class Turns(Fold):
    """Turns (kind start, usage or finish; message, tokens): what was used between a start and its finish.

    Usage reported again for a message counts once, with its largest figure; usage without a message counts each time. A start
    before a finish drops what is open, as a new checkpoint does; a finish or usage without a start gives nothing.
    """

    schema: str = "start_id long, finish_id long, calls long, tokens long"

    def step(self, state: dict, e: dict) -> list[tuple]:
        kind = e.get("kind")
        if kind == "start":
            state.update(start=e.get("id"), seen={}, n=0)
        elif "start" not in state:
            return []
        elif kind == "usage":
            message = e.get("message")
            if message is None:
                state["n"] += 1
                message = f"\0{state['n']}"
            state["seen"][str(message)] = max(state["seen"].get(str(message), 0), e.get("tokens") or 0, 0)
        elif kind == "finish":
            row = (state["start"], e.get("id"), len(state["seen"]), sum(state["seen"].values()))
            state.clear()
            return [row]
        return []
