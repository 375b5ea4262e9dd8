"""Connected components of an undirected edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import cut_at, remove


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, component): the smallest node reachable, for every node of an edge but the smallest ones.

    Rounds end when the edges no longer change; each round's edges are written to the shared folder, and
    removed once the next round's are.
    """
    spark = edges.sparkSession
    edges, path = cut_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, done = now, path
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least, minima = cut_at(least, "minima")  # a plain table, so that a hot node's edges can be split in the join
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, path = cut_at(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(spark, done)
        remove(spark, minima)
