"""A corpus in versions, as Parquet below one folder of the shared storage.

documents, chunks and embeddings lie in a folder for each version; what happens to versions is a log of small files,
each of which one write makes visible at once: registered, progress, embedded, activated, deleted. A version's state
follows from the log, so activating one retires the one before in the same write. Embeddings are added in batches,
keyed by chunk: a batch that comes again adds nothing, and what is pending is an anti join.

One job at a time registers or activates; readers may go on meanwhile.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.functions.vectors import is_valid
from siltbed.operators.corpus import manifest, pending
from siltbed.sources import markdown
from siltbed.sources.shared import remove, written
from siltbed.sources.tables import few

LOG = "at long, event string, version_id string, source_commit string, manifest_hash string, model string, dimensions int, stats string"
EMBEDDINGS = "chunk_id string, embedding array<float>"


class Versions:
    """The versions below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _note(self, event: str, version: str, commit=None, manifest=None, model=None, dimensions=None, stats=None) -> None:
        row = self.spark.createDataFrame([(time.time_ns(), event, version, commit, manifest, model, dimensions, stats)], LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def log(self) -> DataFrame:
        if not self._exists(f"{self.folder}/log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def states(self) -> DataFrame:
        """id, source_commit, manifest_hash, status (parsed, embedded, indexed or active), activated_at, model, dimensions, stats.

        One row for each version: the log is small.
        """
        log = self.log()
        active = log.where("event in ('activated', 'deleted')").agg(F.max_by(F.when(F.col("event") == "activated", F.col("version_id")), F.when(F.col("event") == "activated", F.col("at"))).alias("active_id"))
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
        done = lambda event: F.max((F.col("event") == event).cast("int"))
        one = log.groupBy(F.col("version_id").alias("id")).agg(last("source_commit"), last("manifest_hash"), last("model"), last("dimensions"), last("stats"), done("embedded").alias("e"), done("activated").alias("a"), done("deleted").alias("d"), F.max(F.when(F.col("event") == "activated", F.col("at"))).alias("activated_at"))
        one = one.where("d = 0").withColumn("active_id", active.scalar())
        is_active = F.coalesce(F.col("id") == F.col("active_id"), F.lit(False))
        status = F.when(is_active, "active").when(F.col("a") == 1, "indexed").when(F.col("e") == 1, "embedded").otherwise("parsed")
        return one.select("id", "source_commit", "manifest_hash", status.alias("status"), F.when(is_active, F.col("activated_at")).alias("activated_at"), "model", "dimensions", "stats")

    def register(self, documents: DataFrame, chunks: DataFrame, commit: str, manifest: str, model: str, dimensions: int) -> tuple[str, str]:
        """(id, status) of the version of this commit and manifest; a new one is written, an old one resumed.

        documents: stable_id, ...; chunks: chunk_id, document_id, ... A version does not go on with another model or dimension.
        """
        known = self.states().where((F.col("source_commit") == commit) & (F.col("manifest_hash") == manifest)).first()
        if known:
            if known.model != model or known.dimensions != dimensions:
                raise ValueError("this version has embeddings of another model or dimension")
            return known.id, known.status
        version = f"{commit[:12]}-{manifest[:12]}"
        documents.write.mode("overwrite").parquet(f"{self.folder}/documents/{version}")
        chunks.write.mode("overwrite").parquet(f"{self.folder}/chunks/{version}")
        stats = self.spark.sql("select to_json(named_struct('documents', :d, 'chunks', :c)) as s", {"d": self.documents(version).count(), "c": self.chunks(version).count()}).first().s
        self._note("registered", version, commit, manifest, model, dimensions, stats)
        return version, "parsed"

    def documents(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/documents/{version}")

    def chunks(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/chunks/{version}")

    def embeddings(self, version: str) -> DataFrame:
        path = f"{self.folder}/embeddings/{version}"
        return self.spark.read.schema(EMBEDDINGS).parquet(path) if self._exists(path) else self.spark.createDataFrame([], EMBEDDINGS)

    def pending(self, version: str) -> DataFrame:
        """Chunks that have no embedding yet; none of a version that is embedded, indexed or active."""
        state = self.states().where(F.col("id") == version).first()
        if state is None or state.status != "parsed":
            return self.chunks(version).limit(0)
        return pending(self.chunks(version), self.embeddings(version), "chunk_id", "chunk_id")

    def add_embeddings(self, version: str, vectors: DataFrame) -> int:
        """Adds those of vectors (chunk_id, embedding) that the version's chunks still lack; returns how many chunks have one now."""
        size = self.states().where(F.col("id") == version).first().dimensions
        bad = vectors.where(~is_valid(F.col("embedding"), size)).select("chunk_id").first()
        if bad:
            raise ValueError(f"chunk {bad.chunk_id} has no vector of {size} finite numbers")
        first = W.partitionBy("chunk_id").orderBy(F.xxhash64("embedding"))
        fresh = vectors.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).join(self.chunks(version).select("chunk_id"), "chunk_id", "left_semi")
        fresh = fresh.join(self.embeddings(version).select("chunk_id"), "chunk_id", "left_anti").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
        fresh.write.mode("append").parquet(f"{self.folder}/embeddings/{version}")
        return self.embeddings(version).count()

    def note_progress(self, version: str) -> int:
        """Writes how many chunks have an embedding now into the version's stats; returns it."""
        done = self.embeddings(version).count()
        stats = self.states().where(F.col("id") == version).select(F.to_json(F.map_concat(F.map_filter(F.from_json("stats", "map<string,bigint>"), lambda k, _: k != "embedded_chunks"), F.create_map(F.lit("embedded_chunks"), F.lit(done).cast("long")))).alias("s"))
        self._note("progress", version, stats=stats.first().s)
        return done

    def embed_stream(self, version: str, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], checkpoint: str, own: bool = False) -> None:
        """Embeds a stream of chunks (chunk_id, ...) batch by batch, to the end of what there is.

        embed: (chunk_id, ...) -> (chunk_id, embedding). A batch asks only for what the version still lacks and appends it in one write, so one that
        runs again after a failure adds nothing twice; progress is noted after each. own: chunks streams the version's own files, each once. What
        the version lacks is then known from the beginning, as only this stream adds, and a batch's work is in proportion to its rows.
        """
        step = self._batches_of_own(version, embed) if own else None

        def batch(rows: DataFrame, _: int) -> None:
            lacking = rows.join(self.pending(version).select("chunk_id"), "chunk_id", "left_semi")
            if not lacking.isEmpty():
                self.add_embeddings(version, embed(lacking))
            self.note_progress(version)

        run = chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step or batch).trigger(availableNow=True).start()
        run.awaitTermination()

    def _batches_of_own(self, version: str, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None] | None:
        """For foreachBatch over the files of a version that is being embedded; None if its chunks do not have an id of their own each."""
        state = self.states().where(F.col("id") == version).first()
        if state is None or state.status != "parsed" or not self.chunks(version).groupBy("chunk_id").count().where("count > 1").isEmpty():
            return None
        there = self.embeddings(version).select("chunk_id")  # files of now
        stats, done = json.loads(state.stats), there.count()
        resumed = done > 0

        def batch(rows: DataFrame, _: int) -> None:
            nonlocal done
            lacking = rows.join(there, "chunk_id", "left_anti") if resumed else rows
            if not (resumed and lacking.isEmpty()):
                found = embed(lacking).join(lacking.select("chunk_id"), "chunk_id", "left_semi")
                told = F.concat(F.lit("chunk "), "chunk_id", F.lit(f" has no vector of {state.dimensions} finite numbers"))
                good = F.when(is_valid(F.col("embedding"), state.dimensions), F.col("embedding").cast("array<float>")).otherwise(F.raise_error(told))
                first = W.partitionBy("chunk_id").orderBy(F.xxhash64("embedding"))
                seen = Observation()
                fresh = found.select("chunk_id", good.alias("embedding")).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
                fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{self.folder}/embeddings/{version}")
                done += seen.get["n"]
            self._note("progress", version, stats=json.dumps(stats | {"embedded_chunks": done}, separators=(",", ":")))

        return batch

    def ingest(self, files: DataFrame, host: str, embed: Callable[[DataFrame], DataFrame], commit: str, model: str, dimensions: int, files_at_once: int = 64) -> str:
        """From files (path, raw) to the active version, in one call: its id. Failed files refuse it all; a broken run is resumed."""
        documents, chunks = markdown.ingested(files, host, lambda docs: written(docs, "parsed"))  # parsed and redacted once
        markdown.refuse_failures(documents)
        good = documents.where("status = 'ok'")
        manifest_hash = manifest(good, "path", "content_hash").first().manifest_hash
        named = chunks.withColumnRenamed("stable_id", "document_id")
        version, status = self.register(good, named, commit, manifest_hash, model, dimensions)
        if status == "parsed":
            path = f"{self.folder}/chunks/{version}"
            stream = self.spark.readStream.schema(self.chunks(version).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
            self.embed_stream(version, stream, embed, f"{self.folder}/checkpoints/{version}", own=True)
        if status in ("parsed", "embedded"):
            self.finalize(version, activate=True)
        return version

    def finalize(self, version: str, activate: bool = False) -> None:
        """Marks a version as embedded, and active if asked; refused while a chunk lacks its embedding."""
        missing = pending(self.chunks(version), self.embeddings(version), "chunk_id", "chunk_id").count()
        if missing:
            raise ValueError(f"{missing} chunks have no embedding")
        self._note("embedded", version)
        if activate:
            self._note("activated", version)

    def delete(self, version: str) -> None:
        """Deletes a version with its documents, chunks and embeddings; the active one is refused."""
        if self.states().where((F.col("id") == version) & (F.col("status") == "active")).first():
            raise ValueError("this version is active")
        self._note("deleted", version)
        for kind in ("documents", "chunks", "embeddings"):
            remove(self.spark, f"{self.folder}/{kind}/{version}")

    def active_chunks(self) -> DataFrame | None:
        """Chunks of the active version with their document's columns and their embedding, for retrieval; None without one."""
        state = self.states().where("status = 'active'").first()
        if state is None:
            return None
        found = joined_chunks(self.chunks(state.id), self.documents(state.id)).join(self.embeddings(state.id), "chunk_id", "left")
        return found.withColumn("corpus_version", F.lit(state.id)).withColumn("source_commit", F.lit(state.source_commit))


def readiness(versions: DataFrame, chunks: DataFrame, tables: dict[str, DataFrame], wanted: dict[str, list[str]]) -> DataFrame:
    """(check, ready) for each table that is wanted with its columns, for an active version, and for its chunks having embeddings; then all of it.

    versions: id, status; chunks: version_id, embedding.
    """
    spark = versions.sparkSession
    there = [(f"table {name}", name in tables and set(columns) <= set(tables[name].columns)) for name, columns in wanted.items()]
    active = versions.where("status = 'active'").select(F.col("id").alias("version_id"))
    found = active.agg((F.count(F.lit(1)) == 1).alias("ready")).select(F.lit("active version").alias("check"), "ready")
    embedded = chunks.join(few(active), "version_id", "left_semi").agg(((F.count(F.lit(1)) > 0) & (F.count_if(F.col("embedding").isNull()) == 0)).alias("ready")).select(F.lit("embeddings").alias("check"), "ready")
    checks = spark.createDataFrame(there, "check string, ready boolean").union(found).union(embedded)
    return checks.union(checks.agg(F.bool_and("ready").alias("ready")).select(F.lit("all").alias("check"), "ready"))


def joined_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the title and URL of their document."""
    described = documents.select(F.col("stable_id").alias("document_id"), "title", "canonical_url")
    return chunks.join(described, "document_id")


def active_only(chunks: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """The same over tables that hold all versions: chunks (version_id, document_id, ...), documents (version_id, stable_id, ...), versions (id, activated_at, ...)."""
    active = few(versions.where("activated_at is not null").select(F.col("id").alias("version_id")))
    described = documents.join(active, "version_id").select("version_id", F.col("stable_id").alias("document_id"), "title", "canonical_url")
    return chunks.join(active, "version_id").join(described, ["version_id", "document_id"])
