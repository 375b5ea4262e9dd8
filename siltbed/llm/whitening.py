"""Embedding whitening: a centred scatter made by tasks, its eigenvectors by cyclic Jacobi rotations, a small matrix sent back.

Entries become whole numbers first, floor(scale * entry), so that counts, sums and deviations are exact. The fit list has each
distinct vector once; it is written to the shared folder and read for sums, scatter and the final test of the result.
What tasks gather is added up by Spark for each place of the matrix, so d and d * d numbers reach the driver for vectors of d
entries, however many rows or tasks there are. The driver rotates pairs of dimensions in order, sweep after
sweep, until every off-diagonal entry is negligible beside the two diagonal entries that it joins: this test, relative to each
pair, is what makes small eigenvalues accurate.

Defined cases: a null vector, or one with a null, NaN or infinite entry, is dropped; so is one whose length is
not the commonest of the distinct vectors (the longer of equally common ones). Repeated rows are each
returned, and count once in the fit. Components whose eigenvalue is zero to working precision cannot be whitened
and are left out: fewer than `components` come back then, none if all vectors are equal or the table is empty. Of equal eigenvalues
any basis is taken. deviation is null where it exceeds a long. A null vec_id is kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import cut

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vector(vector: Column, scale: int = 256) -> Column:
    """array<long> of floor(scale * entry); null unless all entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def jacobi(matrix, sweeps: int = 60):
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    import numpy as np

    a = np.array(matrix, np.float64)
    d = len(a)
    v, eps = np.eye(d), np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                if abs(a[p, q]) <= eps * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                turn = np.array([[c, t * c], [-t * c, c]])
                apq = a[p, q]
                app, aqq = a[p, p] - t * apq, a[q, q] + t * apq
                a[:, [p, q]] = a[:, [p, q]] @ turn
                a[[p, q]] = a[:, [p, q]].T
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                v[:, [p, q]] = v[:, [p, q]] @ turn
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    return values[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1, 1)


def _matrix(column, d: int):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(fit: DataFrame, d: int, of, kind: str = "double") -> list:
    """Sum over all vectors of what `of` gives for a matrix of them, a flat array."""

    def gather(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["part"])

    parts = fit.mapInArrow(gather, f"part array<{kind}>").select(F.posexplode("part").alias("at", "part"))
    exact = F.sum(F.col("part").cast("decimal(38,0)")) if kind == "long" else F.sum("part")
    found = dict(parts.groupBy("at").agg(exact.alias("total")).collect())
    return [found[k] for k in range(len(found))]


def whiten(embeddings: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each row of (vec_id, embedding) and component: its whitened value, and what the whole fit has found."""
    import numpy as np

    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long"), whole_vector(F.col("embedding"), scale).alias("x")).where("x is not null")
    fit = cut(rows.select("x").distinct(), "fit")
    common = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not common or not common.d:
        return spark.createDataFrame([], OUT)
    d, n = common.d, common.n
    fit = fit.where(F.size("x") == d)
    halves = [int(s) for s in _added(fit, d, lambda x: np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), "long")]
    sums = [(high << 32) + low for high, low in zip(halves[:d], halves[d:])]
    mean = np.array([s / n for s in sums])
    scatter = np.array(_added(fit, d, lambda x: ((x - mean).T @ (x - mean)).ravel())).reshape(d, d)
    values, vectors = jacobi((scatter + scatter.T) / (2 * n))
    trace = float(values.sum())
    k = int((values[:components] > d * np.finfo(np.float64).eps * max(values[0], 0)).sum())
    if not k:
        return spark.createDataFrame([], OUT)
    matrix, explained = vectors[:, :k] / np.sqrt(values[:k]), [float(e) / trace for e in values[:k]]
    middle = np.array(_added(fit, d, lambda x: ((x - mean) @ matrix).sum(axis=0))) / n

    def spread(x):
        z = (x - mean) @ matrix - middle
        return (z.T @ z).ravel()

    error = float(np.abs(np.array(_added(fit, d, spread)).reshape(k, k) / n - np.eye(k)).max())

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            x, m = _matrix(batch.column(1), d), batch.num_rows
            if not m:
                continue
            largest = n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, sums))
            if d * largest * largest < 1 << 62:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)
            else:  # beyond 64 bits: exact Python integers
                exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
                deviation = [v if v < 1 << 63 else None for v in exact]
            of = np.repeat(np.arange(m), k)
            columns = [
                batch.column(0).take(pa.array(of)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(of)),
                pa.array(((x - mean) @ matrix).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(project, OUT)
