"""What the operators share: words, row keys and tables cut from their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.sources.shared import clear_scratch, remove, scratch_dir  # noqa: F401  operators take them from here

#: A word is a run of anything but space and the ASCII controls 9 to 13.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """array<string> of the text's words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    """64-bit hash of a text; 0 for null. With doc_id it names a row, so equal rows share a name."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text)).cast("long")


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As cut, with the path of what was written, which the caller may remove."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: a lost executor costs no recomputation."""
    return cut_at(df, name)[0]


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if it has no more than `most` rows by count; else the join is left to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
