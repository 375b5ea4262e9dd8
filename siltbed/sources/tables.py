"""Tables by name below a folder, and small sizes that may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast after it has been counted.
FEW = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, marked for broadcast if it has no more than `most` rows; otherwise Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
