"""State machines over what happens to a key in order of time: circuits, rate limits, reservations, sessions, cached answers, compaction.

A machine is a start state and a step. In batch (`in_order`) rows are dealt by key and sorted, and a task steps through them with one state at a
time, so a key of any size is read in constant memory; as streams (streaming.live.running) the same steps run with the state that Spark keeps
for each key. Times are microseconds in a column `at`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SECOND = 1_000_000


class Machine(NamedTuple):
    """start: the state of a key not seen; step: (state, row) -> (state, values of out); expires: when a state may be forgotten, if ever."""

    start: tuple
    step: Callable[[tuple, dict], tuple[tuple, tuple]]
    state: str
    out: str
    expires: Callable[[tuple], int] | None = None


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Machine) -> DataFrame:
    """rows with the columns that the machine adds."""
    fields = StructType.fromDDL(machine.out).fields

    def go(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        key, state = None, machine.start
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    key, state = now, machine.start
                state, added = machine.step(state, row)
                out.append(added)
            added = [pa.array([o[i] for o in out], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *(f.name for f in fields)])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(go, StructType([*rows.schema.fields, *fields]))


def circuit(threshold: int, reset_seconds: int) -> Machine:
    """Rows: at, failed. `threshold` failures in a row open a target's circuit; its calls are then not made until reset_seconds
    have gone by. The next one is a probe (half_open): one more failure opens it again, a success closes it."""

    def step(state, row):
        failures, opened = state
        if opened >= 0 and row["at"] - opened < reset_seconds * SECOND:
            return state, ("open",)
        said = "closed" if opened < 0 else "half_open"
        failures = threshold - 1 if opened >= 0 else failures
        if not row["failed"]:
            return (0, -1), (said,)
        return (failures + 1, row["at"] if failures + 1 >= threshold else -1), (said,)

    return Machine((0, -1), step, "failures int, opened long", "circuit string")


def two_level_limit(minute_limit: int, hour_limit: int) -> Machine:
    """Rows: at. Calls count before they are compared; what the minute rejects does not count in the hour."""

    def step(state, row):
        minute, in_minute, hour, in_hour = state
        second = row["at"] // SECOND
        in_minute = in_minute + 1 if minute == second // 60 else 1
        in_hour = in_hour if hour == second // 3600 else 0
        if in_minute > minute_limit:
            return (second // 60, in_minute, second // 3600, in_hour), ("minute", 60 - second % 60)
        in_hour += 1
        said = ("hour", 3600 - second % 3600) if in_hour > hour_limit else ("ok", 0)
        return (second // 60, in_minute, second // 3600, in_hour), said

    return Machine((-1, 0, -1, 0), step, "minute long, in_minute int, hour long, in_hour int", "verdict string, retry_after long", lambda s: (s[2] + 1) * 3600 * SECOND)


def reservation(ttl_seconds: int) -> Machine:
    """Rows: at, command (reserve, complete, release). A message is reserved once; it may be completed while it is known, or
    released, after which it can be reserved again; either way it is forgotten after ttl_seconds."""

    def step(state, row):
        status, until = state
        known = status != "" and row["at"] < until
        later = row["at"] + ttl_seconds * SECOND
        if row["command"] == "reserve":
            return (state, (f"duplicate_{status}",)) if known else (("in_progress", later), ("acquired",))
        if row["command"] == "complete":
            return (("complete", later), ("completed",)) if known else (state, ("unknown",))
        return ("", -1), ("released" if known else "unknown",)

    return Machine(("", -1), step, "status string, until long", "result string", lambda s: s[1])


def session(ttl_seconds: int) -> Machine:
    """Rows: at, command (create, load, append, delete). Loading and appending refresh a session's time to live; appending to one
    that is gone fails."""

    def step(state, row):
        turns, until = state
        alive = turns >= 0 and row["at"] < until
        later = row["at"] + ttl_seconds * SECOND
        if row["command"] == "create":
            return (0, later), ("created", 0)
        if row["command"] == "delete":
            return (-1, -1), ("deleted" if alive else "missing", None)
        if not alive:
            return (-1, -1), ("missing" if row["command"] == "load" else "unavailable", None)
        turns += row["command"] == "append"
        return (turns, later), ("loaded" if row["command"] == "load" else "appended", turns)

    return Machine((-1, -1), step, "turns int, until long", "result string, turns int", lambda s: s[1])


def answer_cache(ttl_seconds: int) -> Machine:
    """Rows: at, command (lookup, write, any other: neither), valid (whether a cached answer still stands against today's evidence)."""

    def step(state, row):
        (written,) = state
        if row["command"] == "write":
            return (row["at"],), ("written", row["at"])
        if row["command"] != "lookup":
            return state, ("bypass", None)
        if written < 0 or row["at"] - written >= ttl_seconds * SECOND:
            return state, ("miss", None)
        return state, ("hit" if row["valid"] else "invalid", written)

    return Machine((-1,), step, "written long", "cache_status string, written long", lambda s: s[0] + ttl_seconds * SECOND)


def compaction(after: int = 10, most: int = 24, text_size: int = 500, summary_size: int = 4000) -> Machine:
    """Rows: role, text. Beyond `after` turns all but the last ones are dropped, and what the user said in them goes into the summary."""
    keep = max(4, after // 2)

    def step(state, row):
        roles, texts, summary = list(state[0]), list(state[1]), state[2]
        roles.append(row["role"])
        texts.append(row["text"] or "")
        if len(roles) > after:
            said = [f"- {t[:text_size]}" for r, t in zip(roles[:-keep], texts[:-keep]) if r == "user"]
            summary = "\n".join(x for x in (summary, *said) if x)[-summary_size:]
            roles, texts = roles[-keep:], texts[-keep:]
        roles, texts = roles[-most:], texts[-most:]
        return (roles, texts, summary), (len(roles), summary)

    return Machine(([], [], ""), step, "roles array<string>, texts array<string>, summary string", "kept int, summary string")
