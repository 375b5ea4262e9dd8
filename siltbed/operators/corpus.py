"""Corpus identity, versions and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.functions.text import short_hash
from siltbed.functions.vectors import is_valid


def identities(docs: DataFrame, path: Column) -> DataFrame:
    """Stable id of the path and hash of the content."""
    return docs.select("doc_id", short_hash(path).alias("stable_id"), F.sha2("text", 256).alias("content_hash"))


def occurrences(chunks: DataFrame, group: str, content: str, order: str) -> DataFrame:
    """Number (from 0) of each repetition of equal content within its group."""
    return chunks.withColumn("occurrence", F.row_number().over(W.partitionBy(group, content).orderBy(order)) - 1)


def manifest(docs: DataFrame, path: str, content_hash: str, piece_bytes: int = 1 << 20) -> DataFrame:
    """One row: SHA-256 of all (path, hash) joined in path-component order, and the number of documents.

    Ranges of the order are sorted and joined in parallel, into pieces of piece_bytes. SHA-256 is sequential, so one
    task reads all pieces in their order, each once, and holds one batch of a few: as many rows as there are pieces.
    """

    def join(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, k, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([n], pa.int64())], ["part", "k", "piece", "n"])
        for batch in batches:
            for v in batch.column(0).to_pylist():
                n += 1
                if v is None:
                    continue
                held.append(v)
                size += len(v)
                if size >= piece_bytes:
                    yield row()
                    k, held, size, n = k + 1, [], 0, 0
        if n:
            yield row()

    def digest(batches):
        import hashlib

        import pyarrow as pa

        h, n, some = hashlib.sha256(), 0, False
        for batch in batches:
            for piece, count in zip(batch.column(2), batch.column(3).to_pylist()):
                h.update(piece.as_buffer())
                n, some = n + count, True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()]), pa.array([n], pa.int64())], ["manifest_hash", "documents"])

    ordered = docs.select(F.split(F.col(path), "/").alias("at"), F.concat(F.col(path), F.col(content_hash)).cast("binary").alias("v"))
    pieces = ordered.repartitionByRange("at", "v").sortWithinPartitions("at", "v").select("v").mapInArrow(join, "part long, k long, piece binary, n long")
    return pieces.repartition(1).sortWithinPartitions("part", "k").mapInArrow(digest, "manifest_hash string, documents long")


def pending(chunks: DataFrame, embeddings: DataFrame, key: str, vector_key: str) -> DataFrame:
    """Chunks without an embedding."""
    return chunks.join(embeddings.select(F.col(vector_key).alias(key)), key, "left_anti")


def batches(chunks: DataFrame, order: str, size: int) -> DataFrame:
    """Number of the batch (from 0) and place within it, in order, without one sorted task: ranges are counted first."""
    ranged = chunks.repartitionByRange(order).withColumn("range", F.spark_partition_id())
    counts = ranged.groupBy("range").count().select("range", (F.sum("count").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    placed = ranged.withColumn("k", F.row_number().over(W.partitionBy("range").orderBy(order)) - 1).join(counts, "range")
    place = F.col("k") + F.coalesce("before", F.lit(0))
    return placed.select(*chunks.columns, F.floor(place / size).cast("long").alias("batch"), (place % size).cast("long").alias("place"))


def invalid_vectors(embeddings: DataFrame, dimension: int) -> DataFrame:
    return embeddings.where(~is_valid(F.col("embedding"), dimension))


def activate(versions: DataFrame, chunks: DataFrame, version: str, at: str) -> DataFrame:
    """Versions after an attempt to activate one: refused (reason in `refused`) while one of its chunks has no embedding."""
    missing = chunks.where((F.col("version_id") == version) & F.col("embedding").isNull()).agg(F.max(F.lit("missing embeddings")).alias("refused"))
    tried = versions.withColumn("refused", missing.scalar())
    ok = F.col("refused").isNull()
    chosen = F.col("id") == version
    status = F.when(ok & chosen, "active").when(ok & (F.col("status") == "active"), "indexed").otherwise(F.col("status"))
    active = F.when(ok & chosen, F.lit(at)).when(ok, F.lit(None)).otherwise(F.col("activated_at"))
    return tried.select("id", status.alias("status"), active.alias("activated_at"), "refused")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
