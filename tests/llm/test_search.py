"""Ranked lexical search and whitening against plain definitions."""

import math
import re
from collections import Counter, defaultdict

import fixtures
import numpy as np
import pytest

from siltbed.llm import lexical_search, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, score long, rank int"


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, k):
    found = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = set()
    for item, text in set(items):
        scored = []
        for doc, c, n in found:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1):
            out.add((item, rank, doc, -score))
    return out


@pytest.mark.parametrize("window, block", [(8192, 200_000), (7, 40)])
def test_search(spark, tmp_path, monkeypatch, window, block):
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    docs = fixtures.frame(spark, tmp_path)
    texts = fixtures.texts()
    items = [(i, t, 1, 1) for i, t in enumerate([texts[0][:200], texts[3][-300:], texts[20][:80], "ONE two ΩΩ é İ", "nowhere-to-be-found", "", texts[5]])]
    items += [(None, texts[7][:90], None, None), (9, None, 1, 1), items[0], (50, "a b c", 1, 1)]
    out = lexical_search.search(docs, spark.createDataFrame(items, ITEMS), k=9)
    got = [tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()]
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r[0], r[1]) for r in items], 9)
    assert len(got) == len(set(got)) and set(got) == want
    assert lexical_search.search(fixtures.empty(spark), spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical_search.search(docs, spark.createDataFrame([], ITEMS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, x long, component int"


def test_jacobi_finds_small_eigenvalues():
    rnd = np.random.default_rng(1)
    q = np.linalg.qr(rnd.normal(size=(12, 12)))[0]
    scale = 10.0 ** -np.arange(12)
    a = (q * scale**2) @ q.T
    values, vectors = whitening.jacobi(a)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-15) and np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-13)
    graded = np.diag(scale) @ (np.eye(12) + 0.1 * (rnd.normal(size=(12, 12)) @ rnd.normal(size=(12, 12)).T) / 12) @ np.diag(scale)
    graded = (graded + graded.T) / 2
    values = whitening.jacobi(graded)[0]
    assert np.all(values > 0) and abs(np.log(values).sum() - np.linalg.slogdet(graded / np.outer(scale, scale))[1] - 2 * np.log(scale).sum()) < 1e-9
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_whitening(spark):
    rnd = np.random.default_rng(2)
    v = (rnd.normal(size=(80, 5)) * [3, 2, 1, 0.5, 0.1]).astype(np.float32)
    rows = [(i, [float(c) for c in x], 1, 1, 1) for i, x in enumerate(v)]
    rows += [rows[0], rows[0], (1000, rows[1][1], 1, 1, 1), (None, rows[2][1], 1, 1, 1)]
    bad = [(2000, None, 1, 1, 1), (2001, [1.0, None, 0.0, 0.0, 0.0], 1, 1, 1), (2002, [float("nan")] * 5, 1, 1, 1), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1, 1, 1), (2004, [1.0], 1, 1, 1), (2005, [], 1, 1, 1)]
    out = whitening.whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(3)).collect()
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in r[1]) for r in rows]
    fit = np.array(sorted(set(x)))
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    want = defaultdict(list)
    for r, own in zip(rows, x):
        z = (np.array(own) - total / n) @ vectors / np.sqrt(values)
        for c in range(4):
            want[r[0], c + 1].append((int(((n * np.array(own) - total) ** 2).sum()), z[c]))
    assert len(out) == sum(map(len, want.values())) and {r.n for r in out} == {n}
    sign = {}
    for r in out:
        deviation, z = want[r.vec_id, r.component][0]
        assert r.deviation == deviation
        sign.setdefault(r.component, 1 if abs(r.whitened - z) <= abs(r.whitened + z) else -1)
        if len(want[r.vec_id, r.component]) == 1 or r.vec_id == 0:
            assert abs(r.whitened - sign[r.component] * z) < 1e-9 * max(1, abs(z))
        assert abs(r.explained - values[r.component - 1] / np.trace(np.cov(fit.T, bias=True))) < 1e-9
        assert 0 <= r.identity_error < 1e-9


def test_whitening_of_degenerate_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0], 1, 1, 1)] * 3)).count() == 0  # equal vectors have no variance
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i, 5.0], 1, 1, 1) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and all(abs(r.explained - 1) < 1e-12 for r in line)
    large = whitening.whiten(frame([(i, [3.0e12 * i, 1.0], 1, 1, 1) for i in range(4)])).collect()
    assert any(r.deviation is None for r in large) and all(math.isfinite(r.whitened) for r in large)
