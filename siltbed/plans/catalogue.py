"""The query catalogue: every query with, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from siltbed.plans import batch, oracles


def flagship(spark, sf_dir):
    return batch.hybrid_retrieve(spark, sf_dir)


def queries():
    return {name: f for name, f in vars(batch).items() if getattr(f, "is_query", False)}


def oracle_sql():
    return {name: sql for name, sql in vars(oracles).items() if name in queries()}
