"""Versions of a corpus: resuming, refusal, activation, and retrieval that sees the active one only."""

import pytest
from pyspark.sql import functions as F

from siltbed.operators import retrieval, versions


def corpus(spark, word, n=5):
    documents = spark.createDataFrame([(f"d{k}", f"title {k}", f"https://docs.example.com/{k}") for k in range(n)], "stable_id string, title string, canonical_url string")
    chunks = spark.createDataFrame([(f"{word}{k}", f"d{k}", f"{word} text {k}") for k in range(n)], "chunk_id string, document_id string, content string")
    return documents, chunks


def vectors(spark, names, n=2):
    return spark.createDataFrame([(x, [0.5] * n) for x in names], "chunk_id string, embedding array<float>")


def test_two_versions(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/corpus")
    assert store.states().count() == 0 and store.active_chunks() is None
    first, status = store.register(*corpus(spark, "red"), "c" * 40, "m1", "model", 2)
    assert status == "parsed" and store.pending(first).count() == 5
    assert store.add_embeddings(first, vectors(spark, ["red0", "red1", "red1", "other"])) == 2
    # resumed: the same version, and only what is missing; a batch that comes again adds nothing
    assert store.register(*corpus(spark, "red"), "c" * 40, "m1", "model", 2) == (first, "parsed")
    assert sorted(r.chunk_id for r in store.pending(first).collect()) == ["red2", "red3", "red4"]
    assert store.add_embeddings(first, vectors(spark, ["red0", "red1"])) == 2
    with pytest.raises(ValueError, match="another model"):
        store.register(*corpus(spark, "red"), "c" * 40, "m1", "model", 3)
    with pytest.raises(ValueError, match="red2"):
        store.add_embeddings(first, vectors(spark, ["red2"], 3))
    with pytest.raises(ValueError, match="3 chunks"):
        store.finalize(first, activate=True)
    assert store.active_chunks() is None
    assert store.add_embeddings(first, vectors(spark, ["red2", "red3", "red4"])) == 5
    store.finalize(first, activate=True)
    assert store.pending(first).count() == 0
    second, _ = store.register(*corpus(spark, "blue", 3), "d" * 40, "m2", "model", 2)
    assert store.add_embeddings(second, vectors(spark, ["blue0", "blue1", "blue2"])) == 3
    store.finalize(second)
    assert {r.id: r.status for r in store.states().collect()} == {first: "active", second: "embedded"}
    asked = spark.createDataFrame([(1, "blue red text")], "query_id long, query string")
    seen = lambda: {r.chunk_id for r in retrieval.lexical_best(asked, store.active_chunks(), 10).collect()}
    assert seen() == {f"red{k}" for k in range(5)}
    with pytest.raises(ValueError, match="active"):
        store.delete(first)
    store.finalize(second, activate=True)
    assert {r.id: (r.status, r.activated_at is not None) for r in store.states().collect()} == {first: ("indexed", False), second: ("active", True)}
    assert seen() == {f"blue{k}" for k in range(3)}
    row = store.active_chunks().where("chunk_id = 'blue1'").first()
    assert (row.title, row.canonical_url, row.corpus_version, list(row.embedding)) == ("title 1", "https://docs.example.com/1", second, [0.5, 0.5])
    store.delete(first)
    assert [r.id for r in store.states().collect()] == [second]
    assert store.states().select(F.get_json_object("stats", "$.chunks").alias("n")).first().n == "3"


def files(spark, n, broken=False):
    rows = [(f"a/{k}.md", f"Original link: https://docs.example.com/{k}\n# Title {k}\n\ntext of document {k}") for k in range(n)]
    return spark.createDataFrame(rows + [("a/z.md", "no link\n# Title")] * broken, "path string, raw string")


def test_files_become_the_active_version(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/corpus")
    asked = []

    def embed(chunks):
        asked.append(chunks.count())
        return chunks.select("chunk_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))

    with pytest.raises(ValueError, match="a/z.md: missing canonical link"):
        store.ingest(files(spark, 5, broken=True), "docs.example.com", embed, "a" * 40, "model", 2)
    assert store.states().count() == 0 and not asked
    version = store.ingest(files(spark, 5).repartition(5), "docs.example.com", embed, "a" * 40, "model", 2, files_at_once=1)
    assert store.active_chunks().count() == 5 and sum(asked) == 5
    state = store.states().first()
    assert (state.id, state.status) == (version, "active") and '"embedded_chunks":5' in state.stats and '"chunks":5' in state.stats
    assert store.ingest(files(spark, 5), "docs.example.com", embed, "a" * 40, "model", 2) == version and sum(asked) == 5


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    """The stream's checkpoint is lost: all comes again, and only what is lacking is embedded."""
    store = versions.Versions(spark, f"file://{tmp_path}/corpus")
    version, _ = store.register(*corpus(spark, "red", 6), "c" * 40, "m1", "model", 2)
    store.add_embeddings(version, vectors(spark, ["red0", "red4"]))
    asked = []

    def embed(chunks):
        asked.extend(r.chunk_id for r in chunks.collect())
        return chunks.select("chunk_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))

    for k in range(2):
        stream = spark.readStream.schema(store.chunks(version).schema).parquet(f"file://{tmp_path}/corpus/chunks/{version}")
        store.embed_stream(version, stream, embed, f"file://{tmp_path}/checkpoint{k}")
    assert sorted(asked) == ["red1", "red2", "red3", "red5"] and store.embeddings(version).count() == 6
    assert '"embedded_chunks":6' in store.states().first().stats


def test_a_batch_reads_its_own_rows_only(spark, tmp_path, monkeypatch):
    """What is lacking is not looked up in the whole version for each batch; a broken run goes on, repeated ids have one vector, wrong vectors are refused."""
    looked = []
    monkeypatch.setattr(versions.Versions, "pending", lambda self, v, f=versions.Versions.pending: looked.append(v) or f(self, v))
    whole = lambda chunks: chunks.select("chunk_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    store = versions.Versions(spark, f"file://{tmp_path}/corpus")
    calls = []

    def broken(chunks):
        calls.append(1)
        return chunks.select("chunk_id", F.array(*[F.lit(1.0)] * (1 if len(calls) == 3 else 2)).alias("embedding"))

    with pytest.raises(Exception, match="no vector of 2 finite numbers"):
        store.ingest(files(spark, 6).repartition(6), "docs.example.com", broken, "a" * 40, "model", 2, files_at_once=1)
    first = store.states().first().id
    had = store.embeddings(first).count()
    assert 0 < had < 6 and not looked
    assert store.ingest(files(spark, 6).repartition(6), "docs.example.com", whole, "a" * 40, "model", 2, files_at_once=1) == first
    assert store.embeddings(first).count() == 6 and not looked and '"embedded_chunks":6' in store.states().first().stats
    twice = files(spark, 3).unionByName(files(spark, 2)).repartition(4)
    second = store.ingest(twice, "docs.example.com", whole, "b" * 40, "model", 2, files_at_once=1)
    assert store.chunks(second).count() == 5 and store.embeddings(second).count() == 3
