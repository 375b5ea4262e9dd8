import pytest
from pyspark.sql import functions as F

from siltbed.plans import batch
from siltbed.streaming import live

FOLDER = "/root/testdata/sf0.001"


def run(df, mode):
    return live.replayed(df, mode)


@pytest.fixture
def messages(spark, tmp_path):
    for k, rows in enumerate([[(1, 1, "a"), (1, 2, "a"), (2, 1, "x")], [(1, 3, "b"), (1, 4, "b"), (2, 2, "x")]]):
        spark.createDataFrame(rows, "session long, turn long, issue_key string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema("session long, turn long, issue_key string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_failure_counts_run_across_batches(messages):
    out = {(r.session, r.turn): r.failure_count for r in run(live.failure_counts(messages), "append").collect()}
    assert out == {(1, 1): 1, (1, 2): 2, (1, 3): 1, (1, 4): 2, (2, 1): 1, (2, 2): 2}


def test_first_seen_across_batches(messages):
    out = run(live.first_seen(messages, ["session", "issue_key"], "session long, turn long, issue_key string"), "append")
    assert out.where("first").count() == 3 and out.count() == 6


@pytest.fixture(params=["one file", "unsorted files"])
def folder(request, spark, tmp_path):
    if request.param == "one file":
        return FOLDER
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(6, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_replayed_windows_are_all_of_the_batch(spark, folder):
    streamed = sorted((r.user_id, r.start, r.calls, r.rejected) for r in batch.stream_rate_limit(spark, folder).collect())
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    whole = events.groupBy("user_id", F.window("ts", "1 hour").alias("w")).count().select("user_id", F.unix_micros("w.start").alias("start"), "count").collect()
    assert streamed == sorted((r.user_id, r.start, r["count"], max(r["count"] - 1, 0)) for r in whole)


def test_replayed_sessions_are_all_of_the_batch(spark, folder):
    streamed = batch.stream_sessions(spark, folder).select("user_id", "started", F.col("ended") - 7_200_000_000, "events")
    whole = batch.session_windows(spark, folder).select("user_id", "started", "ended", "events")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, whole.collect()))
