"""State machines step by step, and as streams over several batches."""

import pytest
from pyspark.sql import functions as F

from siltbed.operators import machines as M
from siltbed.streaming import live

S = M.SECOND


def steps(machine, *rows):
    state, out = machine.start, []
    for row in rows:
        state, added = machine.step(state, row)
        out.append(added if len(added) > 1 else added[0])
    return out


def call(second, failed):
    return {"at": second * S, "failed": failed}


def test_circuit_opens_probes_and_closes():
    fail, good = (lambda s: call(s, True)), (lambda s: call(s, False))
    assert steps(M.circuit(2, 10), fail(0), fail(1), good(5), good(11), fail(12), fail(13), good(14)) == ["closed", "closed", "open", "half_open", "closed", "closed", "open"]
    assert steps(M.circuit(2, 10), fail(0), fail(1), fail(11), good(12), good(21)) == ["closed", "closed", "half_open", "open", "half_open"]


def command(second, name, **more):
    return {"at": second * S, "command": name} | more


def test_reservation_life_cycle():
    rows = [command(*x) for x in ((0, "complete"), (1, "reserve"), (2, "reserve"), (3, "complete"), (4, "reserve"), (5, "release"), (6, "release"), (7, "reserve"), (20, "reserve"))]
    assert steps(M.reservation(10), *rows) == ["unknown", "acquired", "duplicate_in_progress", "completed", "duplicate_complete", "released", "unknown", "acquired", "acquired"]


def test_session_slides_and_is_deleted():
    rows = [command(*x) for x in ((0, "load"), (1, "create"), (9, "load"), (18, "append"), (28, "append"), (29, "create"), (30, "append"), (31, "delete"), (32, "append"))]
    got = steps(M.session(10), *rows)
    assert got == [("missing", None), ("created", 0), ("loaded", 0), ("appended", 1), ("unavailable", None), ("created", 0), ("appended", 1), ("deleted", None), ("unavailable", None)]


def test_cache_stands_until_its_time_or_its_evidence_goes():
    rows = [command(0, "lookup", valid=True), command(1, "write", valid=True), command(2, "lookup", valid=True), command(3, "lookup", valid=False), command(4, "other", valid=True), command(11, "lookup", valid=True)]
    assert [x[0] for x in steps(M.answer_cache(10), *rows)] == ["miss", "written", "hit", "invalid", "bypass", "miss"]


def test_compaction_keeps_the_last_and_says_what_went():
    rows = [{"role": r, "text": t} for r, t in (("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", None), ("user", "e"))]
    assert steps(M.compaction(4, 12), *rows) == [(1, ""), (2, ""), (3, ""), (4, ""), (4, "- a")]


def test_limit_counts_the_hour_only_for_what_the_minute_passed():
    got = steps(M.two_level_limit(1, 2), *(call(s, False) for s in (0, 1, 60, 61, 120, 3600)))
    assert got == [("ok", 0), ("minute", 59), ("ok", 0), ("minute", 59), ("hour", 3480), ("ok", 0)]


@pytest.fixture
def batches(spark, tmp_path):
    """Three files, read one at a time: seconds, users and commands."""
    files = [[(0, 1, "create"), (1, 1, "append"), (2, 2, "create")], [(8, 1, "append"), (9, 2, "load")], [(40, 1, "load"), (41, 3, "create"), (41, 2, "append")], [(100, 3, "load")]]
    for k, rows in enumerate(files):
        rows = [(s, u, c, (s + 1_000_000) * S) for s, u, c in rows]
        frame = spark.createDataFrame(rows, "s long, user long, command string, at long").withColumn("ts", F.timestamp_micros("at"))
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema("s long, user long, command string, at long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


@pytest.mark.parametrize("late", [None, "1 second"])
def test_sessions_expire_across_batches(batches, late):
    out = live.replayed(live.running(batches, ["user"], ["at"], M.session(10), late), "append").collect()
    got = {(r.user, r.s): (r.result, r.turns) for r in out}
    assert got == {(1, 0): ("created", 0), (1, 1): ("appended", 1), (2, 2): ("created", 0), (1, 8): ("appended", 2), (2, 9): ("loaded", 0), (1, 40): ("missing", None), (3, 41): ("created", 0), (2, 41): ("unavailable", None), (3, 100): ("missing", None)}


def test_expired_state_is_removed(batches, spark, tmp_path):
    """With a watermark the store forgets users whose sessions are over."""
    rows = live.running(batches, ["user"], ["at"], M.session(10), "1 second")
    run = rows.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/check").format("noop").trigger(availableNow=True).start()
    run.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    assert kept[-1] < 3


def test_a_key_goes_on_from_batch_to_batch(spark):
    """In order of time one task steps through a key, whatever files it came from."""
    rows = [(k, 1, k * S, True) for k in range(6)] + [(k, 2, k * S, k % 2 == 0) for k in range(6)]
    frame = spark.createDataFrame(rows, "id long, user long, at long, failed boolean").repartition(5)
    out = {(r.user, r.id): r.circuit for r in M.in_order(frame, ["user"], ["at"], M.circuit(3, 100)).collect()}
    assert [out[1, k] for k in range(6)] == ["closed"] * 3 + ["open"] * 3 and {out[2, k] for k in range(6)} == {"closed"}
    assert M.in_order(frame.limit(0), ["user"], ["at"], M.circuit(3, 100)).count() == 0
