"""The folder that driver and executors share, for what streams and versions write."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As spark.checkpoint.dir names it; only a single local process may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siltbed.scratch", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siltbed-")
        spark.conf.set("siltbed.scratch", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """Where this application writes what is not its result."""
    return f"{shared_dir(spark)}/siltbed-{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application has written there: call it once results have been written."""
    remove(spark, scratch_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, however often it is used."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
