import corpus_pipeline
import fixtures
from pyspark.sql import functions as F

from siltbed.llm import jaccard_join, quality_classifier, queries, source_mixing
from siltbed.llm.common import text_hash


def test_stages_and_columns(spark, tmp_path):
    fixtures.frame(spark, tmp_path)
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == columns, name
        assert docs.count() > 0, name
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_each_stage_against_its_plain_definition(spark, tmp_path):
    """Nulls, repeated rows, clashing columns: what each stage keeps of its own input, by brute force."""
    from collections import Counter

    from test_operators import line_runs, linked, words

    fixtures.frame(spark, tmp_path)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, stages, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        after = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = docs, before, after
        docs = after
    order = lambda rows: sorted(map(str, rows))
    source, before, after = seen["quality classifier"]
    kept = {(r.doc_id, r.th) for r in quality_classifier.classify(source, labels).where("kept").collect()}
    marked = source.select("*", text_hash(F.col("text")).alias("th")).collect()
    assert order(tuple(r)[:-1] for r in marked if (r.doc_id, r.th) in kept) == order(map(tuple, after.collect()))
    source, before, after = seen["line dedup"]
    texts = line_runs([(r[0], r[1]) for r in before], 3, 25)
    want = [(d, x, *rest[:2], None if x is None else len(x), *rest[3:]) for (d, _, *rest), x in zip(before, texts)]
    assert order(want) == order(map(tuple, after.collect()))
    source, before, after = seen["near duplicates"]
    rows = [r for r in before if r[0] is not None]
    named = sorted(set((r[0], r[1]) for r in rows), key=str)
    assert len({d for d, _ in named}) == len(named)
    keep = {d for d, _, root in linked(named) if d == root}
    left = [tuple(r) for r in after.where("doc_id is not null").collect()]
    assert sorted(r[0] for r in left) == sorted(keep) and set(left) <= set(rows)
    source, before, after = seen["source mixing"]
    times = Counter((r.doc_id, r.text, r.source) for r in after.collect())
    copies = {(r.doc_id, r.row.text, r.row.source): r.copies for r in source_mixing.mix(source, keep=source.columns).collect()}
    assert times == Counter({k: n for k, n in copies.items() if n}) and max(times.values()) <= 2
    source, before, after = seen["packing"]
    pieces = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens")).collect()
    times = Counter(r[0] for r in before)
    assert {r.doc_id: r.n for r in pieces} == {r.doc_id: r.tokens * times[r.doc_id] for r in pieces} and set(times) == {r.doc_id for r in pieces}
    assert all(len(words(r[1])) >= 0 for r in before) and len(stages) == 5


def test_empty_tables(spark, tmp_path):
    fixtures.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay_and_copies_go(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, folder)
    linked = queries.op4_jaccard_join(spark, folder)
    assert kept.count() == linked.select("component_id").distinct().count()
    assert kept.select("text").distinct().count() == kept.count()


def test_only_rows_linked_by_text_go(spark, tmp_path):
    """Null ids that equal documents 2 and 9, near copies without ids, an id with two texts, rows without words."""
    import random

    rnd = random.Random(4)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    two, nine, other, late, alone = (prose() for _ in range(5))
    rows = [(2, two), (9, nine), (None, two), (None, nine), (None, other), (None, other + " more"), (5, late), (5, alone), (7, late), (None, None), (None, ""), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sum(r in ((None, other), (None, other + " more")) for r in kept) == 1
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted((r for r in kept if not (r[1] or "").startswith(other)), key=key) == sorted([(2, two), (9, nine), (5, late), (5, alone), (None, None), (None, ""), (None, "")], key=key)
    of = {r.doc_id: r.component_id for r in jaccard_join.link_documents(docs).where("doc_id is not null").collect()}
    assert of == {2: 2, 9: 9, 5: 5, 7: 5}
