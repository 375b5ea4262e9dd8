import hashlib

from siltbed.operators import corpus


def test_manifest_gathers_no_documents(spark):
    """The digest of the whole, from many small pieces; no collection of documents in the plan."""
    rows = [(f"s{i % 7}/{(i * 7919) % 3000:05d}", f"{i:064x}") for i in range(3000)] + [("s-1/x", "0" * 64), ("s1", "1" * 64), ("s1", "0" * 64)]
    out = corpus.manifest(spark.createDataFrame(rows, "path string, h string").repartition(5), "path", "h", piece_bytes=1000)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    text = "".join(p + h for p, h in sorted(rows, key=lambda r: (r[0].split("/"), r[0] + r[1])))
    assert [tuple(r) for r in out.collect()] == [(hashlib.sha256(text.encode()).hexdigest(), len(rows))]


def test_manifest_counts_documents_without_a_hash(spark):
    rows = [("a/1", "x"), ("a/2", None)]
    out = corpus.manifest(spark.createDataFrame(rows, "path string, h string"), "path", "h")
    assert [tuple(r) for r in out.collect()] == [(hashlib.sha256(b"a/1x").hexdigest(), 2)]
