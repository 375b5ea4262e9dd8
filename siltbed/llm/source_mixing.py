"""Mixing sources to target weights by a splitting tree over block quotas. DataFrame functions only.

A source's target says how many words the mix takes. The source is cut into BLOCKS blocks by hash; whole
passes over all blocks and, in a last pass, the first blocks of a permutation supply the words. The block at
the edge of the last pass is cut again, into PARTS parts of which a permuted prefix is taken, and the part at
the edge is taken up to one document. What a source gives is thus an exact quota of block draws, the edge
block being the last of them.

The quotas are dealt to 2**depth output shards by a splitting tree. A node holds an exact quota for each
source; it sends an exact half of its draws to the left, and how many of these are a source's is
multivariate-hypergeometric: the draws of a node, which have no identity but their source, are put into a
random order and the first half is counted by source. That order is found by counted ranges, never in one
sorted task. A leaf's quota of a source is then filled with the next blocks of the source's permutation, so
the blocks of leaves are disjoint. Within a shard rows stand in hashed order.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; a null
doc_id is kept; an empty table gives no rows; rows that are equal in doc_id, text and source are taken
alike; columns beyond doc_id, text and source are ignored, or returned as they are by mixed_rows, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.llm.common import broadcast_if, count_words, cut, text_hash

BLOCKS, PARTS = 1024, 1024
RANGES = 256
PLAN_TO_BROADCAST = 500_000


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, limit: float) -> DataFrame:
    """(sk, source_size) -> with target: share * all words dealt by weight, none above limit * its size.

    Sources in order of limit * size / weight fill up first; the level at which the rest are filled
    follows from running sums. There is one row for each source here.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("sk") == "", "sk")
    ranked = sizes.select(
        "sk",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("w"),
        (F.col("source_size") * limit).cast("double").alias("most"),
    )
    filling = W.orderBy(F.col("most") / F.col("w"), "sk")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    sums = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("words"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("most_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    )
    level = sums.withColumn("level", (F.col("words") - F.col("most_before")) / (F.col("all_w") - F.col("w_before")))
    full = F.col("level") * F.col("w") >= F.col("most")
    level = level.withColumn("rest_level", F.max(F.when(~full, F.col("level"))).over(everything))
    return level.select("sk", "source_size", F.when(full, F.col("most")).otherwise(F.col("rest_level") * F.col("w")).alias("target"))


def _ranked(draws: DataFrame, order: Column) -> DataFrame:
    """Adds rank (from 0) within the node in the given 64-bit order, and the node's number of draws."""
    draws = draws.withColumn("order", order).withColumn("range", F.shiftrightunsigned(F.col("order"), 64 - RANGES.bit_length() + 1))
    counts = draws.groupBy("node", "range").agg(F.count(F.lit(1)).alias("n"))
    of_node = W.partitionBy("node")
    counts = counts.select(
        "node",
        "range",
        F.coalesce(F.sum("n").over(of_node.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.sum("n").over(of_node).alias("draws"),
    )
    inside = W.partitionBy("node", "range").orderBy("order", "sk", "draw")
    return draws.join(counts, ["node", "range"]).withColumn("rank", F.col("first") + F.row_number().over(inside) - 1).drop("order", "range", "first")


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(sk, quota) -> (sk, shard, quota): the tree's leaves, each with its exact quota of every source.

    A level reads its draws twice, so they are written: else the plan doubles with each level.
    """
    draws = quotas.select("sk", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("draw"), F.lit(0).alias("node"))
    for level in range(depth):
        ranked = _ranked(draws, F.xxhash64(F.lit(seed + level), "sk", "draw", "node"))
        odd = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(2)).cast("int")  # which child an odd node favours
        right = (F.col("rank") >= F.floor((F.col("draws") + odd) / 2)).cast("int")
        draws = cut(ranked.select("sk", "draw", (F.col("node") * 2 + right).alias("node")), f"draws-{level}")
    return draws.groupBy("sk", F.col("node").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))


def _last_pass(units: DataFrame, keys: Sequence[str], unit: str, seed: int) -> DataFrame:
    """units: keys, unit, unit_size, rest. Adds at (place in a permutation, from 1), rest before it, and whole: whether the last pass has all of it."""
    permuted = W.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, unit), unit)
    left = F.col("rest") - (F.sum("unit_size").over(permuted) - F.col("unit_size"))
    return units.withColumn("at", F.row_number().over(permuted)).withColumn("left", left).withColumn("whole", (F.col("unit_size") > 0) & (F.col("left") >= F.col("unit_size")))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, depth: int = 4, seed: int = 20, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, shards, place.

    copies is how often the document is in the mix (0, 1 or 2), taken = copies * size, shards the
    output shard of each copy, place its random position among its shard's rows. keep names columns
    of docs to return in a struct `row`; the sum over a source differs from its target by at most
    half of one document (or of a set of equal rows).
    """
    d = docs.select(
        "doc_id",
        count_words(F.col("text")).alias("size"),
        text_hash(F.col("text")).alias("th"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("sk"),
        *([F.struct(*keep).alias("row")] if keep else []),
    ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "th"))
    d = d.withColumn("block", F.pmod(F.col("h"), F.lit(BLOCKS)).cast("int")).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(PARTS)).cast("int"))
    light = cut(d.select("doc_id", "sk", "block", "part", "h", "size"), "sizes")
    blocks = cut(light.groupBy("sk", "block").agg(F.sum("size").alias("unit_size")), "mix-blocks")
    targets = source_targets(blocks.groupBy("sk").agg(F.sum("unit_size").alias("source_size")), weights, share, limit)
    passes = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).cast("int")
    targets = targets.withColumn("passes", passes).withColumn("rest", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") - F.col("passes") * F.col("source_size")))
    plan = cut(_last_pass(blocks.join(targets, "sk"), ["sk"], "block", seed + 2), "plan")

    # the edge: the block, and in it the part, that the last pass has not whole
    edge = plan.where("not whole and left > 0 and unit_size > 0").groupBy("sk").agg(F.min_by(F.struct("block", "left"), "at").alias("e")).select("sk", F.col("e.block").alias("block"), F.col("e.left").alias("rest"))
    edge = broadcast_if(cut(edge, "edge"), PLAN_TO_BROADCAST)
    of_edge = light.join(edge, ["sk", "block"])
    parts = cut(_last_pass(of_edge.groupBy("sk", "block", "rest", "part").agg(F.sum("size").alias("unit_size")), ["sk"], "part", seed + 3), "parts")
    last = parts.where("not whole and left > 0 and unit_size > 0").groupBy("sk").agg(F.min_by(F.struct("at", "part", "left"), "at").alias("e")).select("sk", F.col("e.at").alias("edge_at"), F.col("e.part").alias("edge_part"), F.col("e.left").alias("left"))
    last = cut(last, "last")
    inside = W.partitionBy("sk").orderBy(F.xxhash64(F.lit(seed + 4), "h"))
    taken = F.sum("n").over(inside) - F.col("n") / 2 <= F.col("left")
    of_part = of_edge.join(broadcast_if(last, PLAN_TO_BROADCAST), "sk").where("part = edge_part").groupBy("sk", "left", "h").agg(F.sum("size").alias("n"))
    upto = of_part.withColumn("taken", taken).where("taken").groupBy("sk").agg(F.max(F.xxhash64(F.lit(seed + 4), "h")).alias("last_h"))
    whole_parts = parts.where("whole").groupBy("sk").agg(F.collect_set("part").alias("whole_parts"))  # PARTS at most
    cuts = edge.select("sk", F.col("block").alias("edge_block")).join(last, "sk", "left").join(upto, "sk", "left").join(whole_parts, "sk", "left").drop("edge_at", "left")
    cuts = cut(cuts, "cuts")

    # quotas, the tree, and the leaves' runs of the sources' block draws
    in_last = F.col("whole") | F.coalesce(F.col("block") == F.col("edge_block"), F.lit(False))
    drawn = plan.join(cuts.select("sk", "edge_block"), "sk", "left").withColumn("in_last", in_last)
    n_blocks = cut(drawn.groupBy("sk").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("passes").alias("n_passes"), F.count_if("in_last").alias("n_last")), "n-blocks")
    quota = (F.col("n_blocks") * F.col("n_passes") + F.col("n_last")).alias("quota")
    leaves = split_quotas(n_blocks.select("sk", quota).where("quota > 0"), depth, seed + 10)
    upto_leaf = F.sum("quota").over(W.partitionBy("sk").orderBy(F.xxhash64(F.lit(seed + 5), "sk", "shard"), "shard"))
    runs = leaves.withColumn("to", upto_leaf).groupBy("sk").agg(F.array_sort(F.collect_list(F.struct("to", "shard"))).alias("runs"))  # one for each shard
    of_source = n_blocks.select("sk", "n_blocks").join(runs, "sk", "left")
    copies = F.col("passes") + F.col("in_last").cast("int")
    nth = lambda c: (c - 1) * F.col("n_blocks") + F.col("at")
    shard_of = lambda c: F.get(F.filter("runs", lambda r: r["to"] >= nth(c)), F.lit(0))["shard"]
    dealt = F.when(copies > 0, F.transform(F.sequence(F.lit(1), copies), shard_of)).otherwise(F.array().cast("array<int>"))
    wanted = drawn.join(of_source, "sk").select("sk", "block", "source_size", "target", "passes", "whole", dealt.alias("dealt"))
    wanted = broadcast_if(cut(wanted, "wanted"), PLAN_TO_BROADCAST)
    cuts = broadcast_if(cuts, PLAN_TO_BROADCAST)

    out = (d if keep else light).join(wanted, ["sk", "block"]).join(cuts, "sk", "left")
    in_part = F.array_contains("whole_parts", F.col("part")) | ((F.col("part") == F.col("edge_part")) & (F.xxhash64(F.lit(seed + 4), "h") <= F.col("last_h")))
    more = F.col("whole") | ((F.col("block") == F.col("edge_block")) & F.coalesce(in_part, F.lit(False)))
    n = F.col("passes") + (F.coalesce(more, F.lit(False)) & (F.col("size") > 0)).cast("int")
    n = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.least(n, F.lit(int(limit)))).otherwise(F.least(F.col("passes"), F.lit(1)))
    out = out.withColumn("copies", n.cast("int"))
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "copies",
        F.slice("dealt", F.lit(1), F.col("copies")).alias("shards"),
        F.xxhash64(F.lit(seed + 6), "h").alias("place"),
        *(["row"] if keep else []),
    )


def mixed_rows(docs: DataFrame, depth: int = 4, **options) -> DataFrame:
    """The mix itself: docs' own columns, a row for each copy. A shard is so many consecutive partitions (and so files), locally shuffled.

    Rows go to a partition of their shard by the hash that is their place there, and stand in order of it, so readers see sources interleaved.
    """
    mixed = mix(docs, keep=docs.columns, depth=depth, **options)
    copies = mixed.select("row", "place", F.posexplode("shards").alias("copy", "shard"))
    shards = 1 << depth
    parts = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)  # of each shard
    dealt = copies.repartitionById(shards * parts, (F.col("shard") * parts + F.pmod("place", F.lit(parts))).cast("int"))
    return dealt.sortWithinPartitions("place", "copy").select("row.*")
