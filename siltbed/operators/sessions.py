"""Conversation state as windows over turns (session, turn, role, text, outcome)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from siltbed.functions.text import ENTITIES, any_marker, literal_array, search_terms
from siltbed.operators.policy import FAILURES, FOLLOW_UPS, TOPICS


def by_turn() -> WindowSpec:
    return W.partitionBy("session").orderBy("turn")


def before() -> WindowSpec:
    return by_turn().rowsBetween(W.unboundedPreceding, -1)


def last_12() -> WindowSpec:
    return by_turn().rowsBetween(-12, -1)


def previous(value: Column, condition: Column) -> Column:
    """The value of the last earlier turn that meets the condition."""
    return F.last(F.when(condition, value), ignorenulls=True).over(before())


def previous_assistant(turns: DataFrame) -> DataFrame:
    said = F.col("role") == "assistant"
    return turns.select("session", "turn", "role", previous(F.col("turn"), said).alias("previous_turn"), previous(F.col("text"), said).alias("previous_text"))


def recent_user_texts() -> Column:
    return F.array_compact(F.collect_list(F.when(F.col("role") == "user", F.col("text"))).over(last_12()))


def follow_ups(turns: DataFrame, topics: Sequence[str] = TOPICS, prefixes: Sequence[str] = FOLLOW_UPS, short: int = 4) -> DataFrame:
    """Whether each user turn continues what was said: after a clarification, or short or begun like one, unless its topics are new."""
    known = literal_array(topics)
    said = turns.withColumn("terms", search_terms(F.col("text"))).withColumn("topics", F.array_intersect("terms", known))
    earlier = said.select(
        "*",
        F.count(F.lit(1)).over(before()).alias("n_before"),
        previous(F.coalesce("outcome", F.lit("")), F.col("role") == "assistant").alias("outcome_before"),
        F.flatten(F.collect_list(F.when(F.col("role") == "user", F.col("topics"))).over(last_12())).alias("recent"),
    )
    plain = F.replace(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), F.lit("ß"), F.lit("ss"))
    begun = F.exists(literal_array(prefixes), lambda p: F.startswith(plain, p))
    changed = (F.size("topics") > 0) & (F.size("recent") > 0) & ~F.arrays_overlap("topics", "recent")
    clarified = F.coalesce(F.startswith("outcome_before", F.lit("clarification:")), F.lit(False))
    flag = (F.col("n_before") > 0) & (clarified | (~changed & ((F.size("terms") <= short) | begun)))
    return earlier.where("role = 'user'").select("session", "turn", flag.alias("follow_up"))


def rewritten_queries(turns: DataFrame, flags: DataFrame, anchors: Sequence[str] = ENTITIES) -> DataFrame:
    """The retrieval query of each user turn: of a follow-up also the last user text of 5 terms or more and up to 4 new anchors.

    Terms are computed for each turn, then gathered over the window.
    """
    said = turns.withColumn("terms", search_terms(F.col("text")))
    user = F.when(F.col("role") == "user", F.struct(F.col("text").alias("t"), "terms"))
    recent = said.withColumn("recent", F.reverse(F.array_compact(F.collect_list(user).over(last_12())))).where("role = 'user'")
    met = recent.join(flags, ["session", "turn"])
    substantive = F.get(F.filter("recent", lambda x: F.size(x["terms"]) >= 5), F.lit(0))["t"]
    found = F.array_except(F.array_intersect(F.flatten(F.transform("recent", lambda x: x["terms"])), literal_array(anchors)), "terms")
    extra = F.nullif(F.array_join(F.slice(found, 1, 4), " "), F.lit(""))
    query = F.substring(F.concat_ws(" ", "text", F.substring(substantive, 1, 500), extra), 1, 800)
    return met.select("session", "turn", F.when(F.col("follow_up") & (F.size("recent") > 0), query).otherwise(F.col("text")).alias("query"))


def after_support(turns: DataFrame, prefixes: Sequence[str] = FOLLOW_UPS, entities: Sequence[str] = ENTITIES) -> DataFrame:
    """Whether each user turn goes on after a hand-over to support: begun like a follow-up and naming no entity."""
    said = turns.withColumn("last_outcome", previous(F.coalesce("outcome", F.lit("")), F.col("role") == "assistant")).where("role = 'user'")
    plain = F.replace(F.lower(F.trim(F.regexp_replace("text", r"[\x09-\x0d\x1c-\x20]+", " "))), F.lit("ß"), F.lit("ss"))
    begun = F.exists(literal_array(prefixes), lambda p: F.startswith(plain, p))
    named = F.arrays_overlap(search_terms(F.col("text")), literal_array(entities))
    return said.select("session", "turn", (F.coalesce(F.col("last_outcome") == "support", F.lit(False)) & ~named & begun).alias("after_support"))


def issue_failures(turns: DataFrame, markers: Sequence[str] = FAILURES, most: int = 20) -> DataFrame:
    """Failure reports with the key of their issue and how many reports of the same issue follow one another."""
    plain = F.replace(F.lower("text"), F.lit("ß"), F.lit("ss"))
    said = turns.withColumn("failed", any_marker(plain, markers))
    issue = previous(F.col("text"), (F.col("role") == "user") & ~F.col("failed"))
    reports = said.withColumn("issue", F.coalesce(issue, "text")).where("role = 'user' and failed")
    keyed = reports.withColumn("issue_key", F.substring(F.sha2("issue", 256), 1, 20))
    run = keyed.withColumn("new", (~F.lag("issue_key").over(by_turn()).eqNullSafe(F.col("issue_key"))).cast("int")).withColumn("run", F.sum("new").over(by_turn()))
    count = F.row_number().over(W.partitionBy("session", "run").orderBy("turn"))
    return run.select("session", "turn", "issue_key", F.least(F.lit(most), count).alias("failure_count"))


def compacted(turns: DataFrame, after: int = 10, most: int = 24, summary_size: int = 4000, text_size: int = 500) -> DataFrame:
    """State of each session after its last turn: summary of the user turns that were dropped, and how many turns are kept."""
    keep = max(4, after // 2)
    placed = turns.select("*", F.count(F.lit(1)).over(W.partitionBy("session")).alias("n"), F.row_number().over(W.partitionBy("session").orderBy(F.desc("turn"))).alias("back"))
    dropped = (F.col("n") > after) & (F.col("back") > keep)
    user = F.when(dropped & (F.col("role") == "user"), F.struct("turn", F.substring("text", 1, text_size).alias("text")))
    out = placed.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(user)), lambda x: x["text"]), "\n").alias("summary"), F.count_if(~dropped).alias("kept"))
    return out.select("session", F.right("summary", F.lit(summary_size)).alias("summary"), F.least("kept", F.lit(most)).alias("kept"))


def context_blocks(turns: DataFrame, most: int) -> DataFrame:
    """Newest turns of each session whose blocks fit in `most` characters, stopping at the first that does not; in order."""
    block = F.concat(F.lit("<TURN role="), "role", F.lit(">\n"), "text", F.lit("\n</TURN>"))
    back = W.partitionBy("session").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    fits = turns.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(back)).where(F.col("used") <= most)
    return fits.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n").alias("context"), F.count(F.lit(1)).alias("turns"))


def sessionized(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of each key: runs of events no more than gap_seconds apart."""
    order = W.partitionBy(key).orderBy(ts)
    apart = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))
    started = F.coalesce((apart >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = events.withColumn("started", started).withColumn("session", F.sum("started").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events"))
