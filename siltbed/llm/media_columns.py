"""Media columns: payloads as 8-bit grey PNG images in tar shards of the shared folder, named by their digest.

Writing is a step of its own. Digests are computed by column functions and counted; payloads whose digest
occurs once are stored by the scan task that has them, of the others one copy of each is combined map-side and
stored after a shuffle on the digest, so no payload is stored twice. Then the manifest, a row for each document
with digest, shard, offset and length, is committed as one Parquet table, and shards that it does not name
(of attempts that were lost or repeated) are removed. Reading works from the manifest alone, by byte ranges: the
image header for the metadata columns, then the member for sizes, digests and features.

Defined cases: a null or empty text is one line of 192 blanks; a null doc_id is kept; equal texts give
equal values in every digest column, and texts that are equal but for blanks of the padding share a payload;
repeated rows give repeated results; an empty table gives no rows and no shards; columns beyond doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import broadcast_if
from siltbed.sources.shared import shared_dir

LINE = 192
DIGESTS_TO_BROADCAST = 500_000
STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
READ = STORED + ", width int, height int, depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _png(payload: bytes) -> bytes:
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + payload[i : i + LINE] for i in range(0, len(payload), LINE))
    head = struct.pack(">IIBBBBB", LINE, len(payload) // LINE, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 5)) + chunk(b"IEND", b"")


def _pixels(image: bytes) -> bytes:
    """Samples of an image that _png wrote: every line has filter 0."""
    import struct
    import zlib

    at, data = 8, []
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        if image[at + 4 : at + 8] == b"IDAT":
            data.append(image[at + 8 : at + 8 + n])
        at += n + 12
    lines = zlib.decompress(b"".join(data))
    return b"".join(lines[i + 1 : i + 1 + LINE] for i in range(0, len(lines), LINE + 1))


def _feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the share of each sixteenth of the range."""
    import numpy as np

    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p, at = counts / counts.sum(), np.arange(256)
    mean = float(p @ at)
    deviation = float(np.sqrt(p @ (at - mean) ** 2))
    entropy = float(-(p[p > 0] @ np.log2(p[p > 0])))
    parts = np.round(p.reshape(16, 16).sum(axis=1) * 255).astype(int)
    return f"{mean:.3f};{deviation:.3f};{entropy:.4f};" + "".join(f"{x:02x}" for x in parts)


def _payload(data):
    """data (binary column) with blanks up to a positive multiple of LINE."""
    n = F.octet_length(data)
    blanks = F.when(n == 0, LINE).otherwise(F.pmod(-n, F.lit(LINE)))
    return F.concat(data, F.repeat(F.lit(" "), blanks.cast("int")).cast("binary"))


def _written(payloads: DataFrame, folder: str, shard_bytes: int) -> DataFrame:
    """payloads: doc_id, n_bytes, digest, payload, each digest once. Stores them in the order they come."""

    def write(batches):
        import tarfile

        import pyarrow as pa
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(f"{folder}/shards")
        files.create_dir(root, recursive=True)
        rows: list = []
        parts: list[bytes] = []
        at = 0

        def flush():
            path = f"{root}/{uuid.uuid4().hex}.tar"
            with files.open_output_stream(path) as out:
                for x in parts:
                    out.write(x)
                out.write(bytes(1024))
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*r[:3], path, *r[3:]) for r in rows)), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()])], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
            rows.clear()
            parts.clear()
            return done

        for batch in batches:
            for doc_id, n_bytes, digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                image = _png(payload.as_py())
                member = tarfile.TarInfo(f"{digest}.png")
                member.size = len(image)
                head = member.tobuf(tarfile.USTAR_FORMAT)
                parts += [head, image, bytes(-len(image) % 512)]
                rows.append((doc_id, n_bytes, digest, at + len(head), len(image)))
                at += len(head) + len(image) + -len(image) % 512
                if at >= shard_bytes:
                    yield flush()
                    at = 0
        if rows:
            yield flush()

    return payloads.mapInArrow(write, STORED)


def sweep(spark: SparkSession, folder: str) -> int:
    """Removes shards that the manifest does not name, from within tasks; returns how many."""
    named = spark.read.parquet(f"{folder}/manifest").select(F.regexp_extract("shard", "[^/]+$", 0).alias("name")).distinct()
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(f"{folder}/shards").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"))

    def drop(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(f"{folder}/shards")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files.delete_file(f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    return there.join(named, "name", "left_anti").mapInArrow(drop, "name string").count()


def store(docs: DataFrame, folder: str, shard_bytes: int = 32 << 20) -> DataFrame:
    """Writes payloads into tar shards and the manifest below folder (a new one), and returns the manifest."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    rows = rows.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), _payload(F.col("data")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    times = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("digest", F.lit(True).alias("again"))
    times.write.parquet(f"{folder}/repeated")
    marked = rows.join(broadcast_if(spark.read.parquet(f"{folder}/repeated"), DIGESTS_TO_BROADCAST), "digest", "left")
    columns = ["doc_id", "n_bytes", "digest"]
    once = _written(marked.where("again is null").select(*columns, "payload"), folder, shard_bytes)
    shared = marked.where("again").groupBy("digest").agg(F.first("payload").alias("payload"))
    _written(shared.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_bytes"), "digest", "payload"), folder, shard_bytes).select("digest", "shard", "offset", "length").write.parquet(f"{folder}/places")
    places = broadcast_if(spark.read.parquet(f"{folder}/places"), DIGESTS_TO_BROADCAST)
    several = marked.where("again").select(*columns).join(places, "digest").select(*columns, "shard", "offset", "length")
    once.union(several).write.parquet(f"{folder}/manifest")
    if spark.read.parquet(f"{folder}/manifest").isEmpty():
        return spark.read.parquet(f"{folder}/manifest")
    sweep(spark, folder)
    return spark.read.parquet(f"{folder}/manifest")


def read_back(stored: DataFrame, folder: str, remember: int = 10_000) -> DataFrame:
    """Metadata from the header's byte range, and digests and features from the member's.

    A task keeps what it has read of the last `remember` payloads, so a payload of very many rows is read about
    once in each task.
    """

    def read(batches):
        import hashlib
        import struct
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder)
        path, handle, seen = None, None, {}
        extra = [("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
        for batch in batches:
            out = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5))):
                found = seen.get((shard, offset))
                if found is None:
                    if shard != path:
                        if handle:
                            handle.close()
                        path, handle = shard, files.open_input_file(shard)
                    width, height, depth = struct.unpack_from(">IIB", handle.read_at(26, offset), 16)
                    image = handle.read_at(length, offset)
                    payload = _pixels(image)
                    found = (width, height, depth, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), _feature(payload))
                    if len(seen) >= remember:
                        seen.clear()
                    seen[shard, offset] = found
                out.append(found)
            new = [pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [[]] * len(extra), extra)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema([*batch.schema, *extra]))

    return stored.select("doc_id", "n_bytes", "digest", "shard", "offset", "length").mapInArrow(read, READ)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores every document's payload and returns its place, its metadata and what was read back."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    return read_back(store(docs, folder), folder)
