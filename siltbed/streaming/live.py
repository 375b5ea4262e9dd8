"""Structured Streaming: counters, rate limits, sessions, idempotency and issue counters over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from siltbed.operators.machines import Machine
from siltbed.sources.shared import new_dir


def event_stream(spark: SparkSession, folder: str, schema, files_at_once: int | None = 1) -> DataFrame:
    """files_at_once None: all files that there are, in one trigger."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files_at_once) if files_at_once else stream).parquet(folder)


def _bounded(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if late else events


def counters(events: DataFrame, *labels: str, value: str) -> DataFrame:
    """Running sums; write with output mode update or complete."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))


def per_window(events: DataFrame, key: str, ts: str, width: str, late: str | None, limit: int) -> DataFrame:
    """Calls of each key in fixed windows, and how many are over the limit.

    Append mode gives the windows that the watermark has closed, and drops later events; with late None no event
    is dropped and no window left open: write that in complete mode.
    """
    calls = _bounded(events, ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("calls"))
    return calls.select(key, F.col("window.start").alias("start"), "calls", F.greatest(F.col("calls") - limit, F.lit(0)).alias("rejected"))


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str | None) -> DataFrame:
    """Sessions that end after `gap` without an event; late and modes as in per_window."""
    grouped = _bounded(events, ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def first_seen(events: DataFrame, keys: list[str], columns: str) -> DataFrame:
    """Idempotency: whether a message is the first of its key; later ones are duplicates whatever batch they come in.

    State is one flag for each key that was ever seen.
    """

    def mark(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.exists
        for frame in frames:
            fresh = [False] * len(frame)
            if len(frame) and not known:
                fresh[0], known = True, True
            yield frame.assign(first=fresh)
        state.update((True,))

    return events.groupBy(*keys).applyInPandasWithState(mark, f"{columns}, first boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def running(rows: DataFrame, keys: list[str], order: list[str], machine: Machine, late: str | None = None, ts: str = "ts") -> DataFrame:
    """A machine as a stream: rows with what it adds, its state kept for each key across batches.

    Rows of one batch are stepped through in order, so batches have to follow each other in time. With `late`, a watermark on the column ts, a
    state that has expired is removed once the watermark has passed its time, in a batch that need not touch its key.
    """
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(machine.out).fields])
    timed = late is not None and machine.expires is not None

    def go(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else machine.start
        frame = pd.concat(list(frames)).sort_values(order)
        out = []
        for row in frame.to_dict("records"):
            now, added = machine.step(now, row)
            out.append((*row.values(), *added))
        state.update(now)
        if timed:
            state.setTimeoutTimestamp(max(machine.expires(now) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=schema.names, dtype=object)

    kind = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return (rows.withWatermark(ts, late) if timed else rows).groupBy(*keys).applyInPandasWithState(go, schema, machine.state, "append", kind)


def failure_counts(reports: DataFrame, most: int = 20) -> DataFrame:
    """reports: session, turn, issue_key. Consecutive reports of one issue in each session, across batches."""

    def count(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        issue, n = state.get if state.exists else (None, 0)
        frame = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, name in zip(frame["turn"], frame["issue_key"]):
            n = min(most, n + 1) if name == issue else 1
            issue = name
            out.append((key[0], turn, name, n))
        state.update((issue, n))
        yield pd.DataFrame(out, columns=["session", "turn", "issue_key", "failure_count"])

    return reports.groupBy("session").applyInPandasWithState(count, "session long, turn long, issue_key string, failure_count int", "issue string, n int", "append", GroupStateTimeout.NoTimeout)


def replayed(stream: DataFrame, mode: str) -> DataFrame:
    """The result of all that a stream has now, written by its tasks as Parquet into the shared folder and read from there.

    In complete mode each trigger replaces the result; in append mode it adds to it, a trigger that runs again replacing its own part.
    """
    spark = stream.sparkSession
    out = new_dir(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/part={0 if mode == 'complete' else number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)
