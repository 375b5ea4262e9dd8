"""Rate limits, idempotency, circuit breakers and failover over logs of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds)


def retry_after(ts: Column, seconds: int) -> Column:
    return seconds - F.unix_seconds(ts.cast("timestamp")) % seconds


def limited(calls: DataFrame, key: str, ts: str, order: str, minute_limit: int, hour_limit: int) -> DataFrame:
    """Every call with its verdict: ok, minute or hour, and the seconds to wait.

    Rejected calls count in the window that rejects them; a call that the minute rejects is not
    counted in the hour. Partitions are a key's minute and a key's hour, not a key.
    """
    minute = calls.withColumn("minute", bucket(F.col(ts), 60)).withColumn("in_minute", F.row_number().over(W.partitionBy(key, "minute").orderBy(ts, order)))
    passed = (F.col("in_minute") <= minute_limit).cast("int")
    hour = minute.withColumn("hour", bucket(F.col(ts), 3600)).withColumn("passed", passed)
    in_hour = F.sum("passed").over(W.partitionBy(key, "hour").orderBy(ts, order).rowsBetween(W.unboundedPreceding, 0))
    judged = hour.withColumn("in_hour", in_hour)
    verdict = F.when(F.col("passed") == 0, "minute").when(F.col("in_hour") > hour_limit, "hour").otherwise("ok")
    wait = F.when(F.col("passed") == 0, retry_after(F.col(ts), 60)).when(F.col("in_hour") > hour_limit, retry_after(F.col(ts), 3600)).otherwise(0)
    return judged.select(*calls.columns, verdict.alias("verdict"), wait.alias("retry_after"))


def first_messages(messages: DataFrame, *keys: str, order: list) -> DataFrame:
    """The first message of each key: later ones are duplicates."""
    return messages.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("k = 1").drop("k")


def failure_runs(calls: DataFrame, key: str, order: list, failed: Column, threshold: int) -> DataFrame:
    """Runs of consecutive failed calls of each key, with whether they open its circuit."""
    by_time = W.partitionBy(key).orderBy(*order)
    marked = calls.withColumn("failed", failed).withColumn("run", F.sum((~F.col("failed")).cast("int")).over(by_time.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.where("failed").groupBy(key, "run").agg(F.count(F.lit(1)).alias("failures"))
    return runs.select(key, "run", "failures", (F.col("failures") >= threshold).alias("opens"))


def first_success(attempts: DataFrame, request: str, target: str, place: str, succeeded: Column) -> DataFrame:
    """The target in order that first answers each request; null if none does."""
    return attempts.groupBy(request).agg(F.min_by(F.when(succeeded, F.col(target)), F.when(succeeded, F.col(place))).alias("target"), F.count(F.lit(1)).alias("attempts"))


def failover_class(status: Column) -> Column:
    """What a provider's HTTP status means for the caller."""
    return (
        F.when(status.isin(401, 403), "authentication")
        .when(status == 408, "timeout")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "unavailable")
        .when(status >= 400, "bad_request")
        .otherwise("ok")
    )
