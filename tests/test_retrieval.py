"""The short ways of retrieval against the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.operators import retrieval
from siltbed.plans import batch

FOLDER = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("limit", [3, 30])
def test_lexical_best_is_the_head_of_all_scores(spark, limit):
    rnd = random.Random(limit)
    words = ["redis", "mysql", "کتاب", "ab", "abc", "abcd", "deploy", "log", "x1"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, n)))
    chunks = spark.createDataFrame([(k, text(12)) for k in range(120)] + [(500, ""), (501, "zzzz")], "chunk_id long, content string")
    queries = spark.createDataFrame([(k, text(4)) for k in range(20)] + [(90, "zzz"), (91, "از")], "query_id long, query string")
    columns = ("query_id", "rank", "chunk_id", "lexical_score")
    want = rows(retrieval.ranked(retrieval.lexical_scores(queries, chunks), "lexical_score", limit), *columns)
    assert rows(retrieval.lexical_best(queries, chunks, limit), *columns) == want


def test_vectors_in_blocks(spark):
    """More queries than a block holds, vectors of other sizes, zero vectors, ties."""
    rng = np.random.default_rng(1)
    vector = lambda n=4: [float(x) for x in rng.integers(-2, 3, n)]
    c = [(k, vector(3 if k % 10 == 0 else 4)) for k in range(200)] + [(900, None), (901, [])]
    q = [(k, vector()) for k in range(25)] + [(900, None)]
    chunks = spark.createDataFrame(c, "chunk_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame(q, "query_id long, embedding array<double>")
    got = rows(retrieval.vector_best(queries, chunks, 5, block=10), "query_id", "rank", "chunk_id", "vector_score")
    want = []
    for k, v in q:
        if not v or not any(v):
            continue
        near = [(-round(float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)), 9), i) for i, e in c if e and len(e) == len(v) and any(e)]
        want += [(k, r + 1, i, -s) for r, (s, i) in enumerate(sorted(near)[:5])]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], atol=2e-9)


def test_rewritten_queries_in_persian(spark):
    turns = [(1, 0, "user", "كتاب ۱۲۳ و پستگرس برای برنامه استقرار"), (1, 1, "assistant", "x"), (1, 2, "user", "پس چطور")]
    frame = spark.createDataFrame([(*t, None) for t in turns], "session long, turn long, role string, text string, outcome string")
    flags = spark.createDataFrame([(1, 0, False), (1, 2, True)], "session long, turn long, follow_up boolean")
    from siltbed.operators import sessions

    out = {r.turn: r.query for r in sessions.rewritten_queries(frame, flags).collect()}
    assert out[2] == "پس چطور " + turns[0][3] + " postgresql"


def test_quoting_numbers_as_g(spark):
    from siltbed.operators import metrics

    values = [0.0, 1.0, 12.5, 123456.0, 1234567.0, 0.0001, 0.00001234, -3.25, 999999.5, 1e20, 0.1 + 0.2, 100000.0, 1e6]
    out = spark.createDataFrame([(v,) for v in values], "v double").select("v", metrics.general(F.col("v")).alias("g")).collect()
    assert [r.g for r in out] == [f"{r.v:g}" for r in out]


def test_questions_of_rare_terms(spark):
    """Questions whose terms few chunks hold: the best by filters are those of all pairs, ties and all."""
    import random

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    common = [word() for _ in range(60)]
    texts = [" ".join(rnd.choice(common) for _ in range(rnd.choice([1, 3, 8, 30, 120]))) for _ in range(400)]
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "chunk_id long, content string")
    asked = [(k, " ".join(w[:-1] + rnd.choice("xyz") for w in rnd.choices(common, k=rnd.choice([1, 2, 6, 15])))) for k in range(25)]
    asked += [(100, common[0]), (101, "zzz qqq"), (102, ""), (103, texts[7] + " x")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    columns = ["query_id", "chunk_id", "lexical_score", "rank"]
    got = sorted(map(tuple, retrieval.lexical_best(queries, chunks, 10).select(columns).collect()))
    want = sorted(map(tuple, retrieval.ranked(retrieval.lexical_scores(queries, chunks), "lexical_score", 10).select(columns).collect()))
    assert got == want and len({r[0] for r in got}) > 20


@pytest.mark.parametrize("limit", [None, 4])
def test_lexical_scan_holds_no_pairs_of_a_query_together(spark, limit):
    """Scores come from one pass over the chunks: equal to a plain definition with blocks of queries and many equal chunks, and no shuffle of pairs."""
    rnd = random.Random(5)
    words = ["redis", "mysql", "abc", "abcd", "log", "deploy"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(60)] + ["redis log"] * 40 + [None, "", "--"]
    asked = [(k, " ".join(rnd.sample(words, rnd.randint(1, 3)))) for k in range(9)] + [(20, ""), (21, "zzzz")]
    chunks = spark.createDataFrame([(f"c{k:03}", t) for k, t in enumerate(texts)], "chunk_id string, content string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, query string")
    scores = retrieval.lexical_scores(queries, chunks, limit, block=4)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.split() if w.isalpha() for i in range(len(w) + 1)}
    want = {}
    for q, text in asked:
        pairs = []
        for k, t in enumerate(texts):
            hits = sum((t or "").split().count(w) for w in set(text.split()))
            both, either = len(grams(t or "") & grams(text)), len(grams(t or "") | grams(text))
            if hits or both and both / either > 0.03:
                pairs.append((-round(0.1 * hits + 0.3 * (both / either if both else 0), 9), f"c{k:03}"))
        want[q] = [(c, -s) for s, c in sorted(pairs)[: limit or len(pairs)]]
    got = {q: [] for q, _ in asked}
    for r in (scores if limit is None else retrieval.ranked(scores, "lexical_score", limit)).collect():
        got[r.query_id].append((r.chunk_id, round(r.lexical_score, 9)))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    assert retrieval.lexical_scores(queries.limit(0), chunks, limit).count() == 0


def test_words_of_the_index_are_parted_for_trigrams(spark):
    """One search for words serves terms and trigrams: low lines and Arabic marks part words as the trigrams' own definition has it, whatever the script."""
    from siltbed.functions.text import normalize, search_query, trigrams

    texts = ["a_b__cd _ x1_", "کتاب‌ها می‌شود، دُرُست ۱۲۳", "日本語 текст_и ½ ²x", "ab cd", "__", "a b", "كتاب؟redis", "éa_ًًz"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(["b cd", "کتاب درست", "текст 日本語 ½", "x1 redis"])], "query_id long, query string")
    g, h = chunks.select("chunk_id", trigrams(normalize(F.col("content"))).alias("g")), queries.select("query_id", trigrams(search_query(F.col("query"))).alias("h"))
    both = F.size(F.array_intersect("g", "h"))
    want = rows(g.crossJoin(h).select("query_id", "chunk_id", F.round(both / F.size(F.array_union("g", "h")), 9).alias("similarity")).where("similarity > 0"), "query_id", "chunk_id", "similarity")
    got = rows(retrieval.lexical_scores(queries, chunks).where("similarity > 0").withColumn("similarity", F.round("similarity", 9)), "query_id", "chunk_id", "similarity")
    assert len(got) > 5 and got == [r for r in want if r[2] > 0.03 or r[:2] in {x[:2] for x in got}]


@pytest.mark.parametrize("name", ["lexical_topk", "trigram_similarity", "rrf_fusion", "hybrid_retrieve", "evidence_decision", "eval_recall_mrr"])
def test_texts_stay_where_they_are_read(spark, name):
    """No text of all documents goes through an exchange or a sort, even if nothing is broadcast by its size: it meets the scan or a few chosen ids first."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = getattr(batch, name)(spark, FOLDER)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [k for k, line in enumerate(plan) if "FileScan" in line and "text#" in line and "documents.parquet" in line]
    assert scans
    for k in scans:
        at = depth(plan[k])
        for line in reversed(plan[:k]):
            if depth(line) < at:
                at = depth(line)
                assert "Exchange" not in line and "Sort " not in line, line
                if "MapInArrow" in line or "BroadcastHashJoin" in line:
                    break
