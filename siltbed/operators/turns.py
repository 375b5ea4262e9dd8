"""Whole turns of conversations: what becomes of each user turn, where one turn's outcome is part of the next one's history.

What a turn needs of its history in text (recent questions, their topics, the issue that a report of failure belongs to) comes from
windows over the turns that the session's state still shows. Evidence and answers are found for a turn as it stands and for the
turn rewritten as a follow-up, as only the outcome before it tells which of the two is asked. Then one fold for each
session, an aggregate over its turns in order, goes from outcome to outcome.

A turn that ends in an error is not kept, so it must not be in the history of those after it. That is a fixed point: turns are judged with
nothing dropped, then again without the errors found, until these no longer change. As an outcome depends on earlier turns only, each
round settles at least one more turn of every session, and mostly two rounds do.

A session's turns meet in one row of an aggregate; a question that many sessions ask is looked up in the cache by a pass over its lookups
in order of time, in constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.functions.text import ENTITIES, any_marker, literal_array, search_terms
from siltbed.operators import answers, policy
from siltbed.sources.shared import written


class Words(NamedTuple):
    """Word lists that turns are judged by, beside the policy's own."""

    domain: Sequence[str] = ()
    outside: Sequence[str] = ()
    intents: dict[str, Sequence[str]] | None = None
    failures: Sequence[str] = policy.FAILURES
    topics: Sequence[str] = policy.TOPICS
    prefixes: Sequence[str] = policy.FOLLOW_UPS
    entities: Sequence[str] = ENTITIES


def shown_turns(after: int, most: int) -> tuple[list[int], list[int]]:
    """How many turns the state shows to a session's first, second, ... kept turn: the beginning, and what then repeats.

    Each turn adds two; beyond `after` all but max(4, after // 2) are summarised, and `most` are kept at all.
    """
    sizes, size = [], 0
    while size not in sizes:
        sizes.append(size)
        size += 2
        size = min(max(4, after // 2) if size > after else size, most)
    return sizes[: sizes.index(size)], sizes[sizes.index(size) :]


def described(turns: DataFrame, words: Words) -> DataFrame:
    """User turns (session, turn, ts, text) with what their texts alone tell."""
    plain = F.replace(F.lower(F.trim(F.regexp_replace("text", r"[\x09-\x0d\x1c-\x20]+", " "))), F.lit("ß"), F.lit("ss"))
    said = turns.select("session", "turn", "ts", "text", policy.scope(F.col("text"), words.domain, words.outside, words.intents).alias("scope"), search_terms(F.col("text")).alias("terms"), plain.alias("plain"))
    return said.select(
        "session", "turn", "ts", "text", "scope", "terms",
        any_marker(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")), words.failures).alias("failed"),
        F.array_intersect("terms", literal_array(words.topics)).alias("topics"),
        F.array_intersect("terms", literal_array(words.entities)).alias("entities"),
        F.exists(literal_array(words.prefixes), lambda p: F.startswith("plain", p)).alias("begun"),
        policy.clarification_can_help(F.col("text"), F.col("scope.intent"), words.entities).alias("can_help"),
    )


def with_history(said: DataFrame, after: int, most: int, short: int) -> DataFrame:
    """Adds n_before (kept turns before), query (as a follow-up), continues, and issue_key; said has `kept`."""
    start, cycle = shown_turns(after, most)
    by_turn = W.partitionBy("session").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    d = said.withColumn("n_before", F.coalesce(F.sum(F.col("kept").cast("int")).over(by_turn), F.lit(0)))
    back = W.partitionBy("session").orderBy("n_before").rangeBetween(-max(start + cycle) // 2, -1)
    of_turn = F.when(F.col("kept"), F.struct("turn", "text", "terms", "topics", "entities", "failed"))
    d = d.withColumn("recent", F.reverse(F.array_sort(F.array_compact(F.collect_list(of_turn).over(back)))))  # the latest first
    pick = lambda sizes, k: F.get(F.array(*[F.lit(s) for s in sizes]), k.cast("int"))
    shown = F.when(F.col("n_before") < len(start), pick(start or [0], F.col("n_before"))).otherwise(pick(cycle, (F.col("n_before") - len(start)) % len(cycle)))
    d = d.withColumn("state", F.slice("recent", F.lit(1), F.floor(shown / 2).cast("int"))).withColumn("recent", F.slice("state", 1, 6))  # 12 turns at most
    topics = F.flatten(F.transform("recent", lambda x: x["topics"]))
    changed = (F.size("topics") > 0) & (F.size(topics) > 0) & ~F.arrays_overlap("topics", topics)
    substantive = F.get(F.filter("recent", lambda x: F.size(x["terms"]) >= 5), F.lit(0))["text"]
    found = F.array_except(F.array_distinct(F.flatten(F.transform("recent", lambda x: x["entities"]))), "terms")
    extra = F.nullif(F.array_join(F.slice(found, 1, 4), " "), F.lit(""))
    rewritten = F.substring(F.concat_ws(" ", "text", F.substring(substantive, 1, 500), extra), 1, 800)
    issue = F.coalesce(F.get(F.filter("state", lambda x: ~x["failed"]), F.lit(0))["text"], "text")
    return d.select(
        "session", "turn", "ts", "text", "scope", "n_before",
        F.when(F.size("recent") > 0, rewritten).otherwise(F.col("text")).alias("query"),
        ((F.col("n_before") > 0) & ~changed & ((F.size("terms") <= short) | F.col("begun"))).alias("continues"),
        (F.col("begun") & (F.size("entities") == 0)).alias("goes_on"),
        "can_help",
        F.when(F.col("failed"), F.substring(F.sha2(issue, 256), 1, 20)).alias("issue_key"),
    )


def cached(lookups: DataFrame, ttl_seconds: int) -> DataFrame:
    """(session, turn, cache) of lookups (cache_key, ts, session, turn, writes): hit, or miss.

    A miss that has an answer writes it, and it lives for ttl_seconds: who writes depends on who found something, so a key's lookups are
    gone through in order of time.
    """

    def go(batches):
        import pyarrow as pa

        key, written_at = None, None
        for batch in batches:
            out = []
            for name, at, writes in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4))):
                if name != key:
                    key, written_at = name, None
                hit = written_at is not None and at - written_at < ttl_seconds * 1_000_000
                if writes and not hit:
                    written_at = at
                out.append("hit" if hit else "miss")
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(out, pa.string())], ["session", "turn", "cache"])

    rows = lookups.select("cache_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "session", "turn", "writes")
    return rows.repartition("cache_key").sortWithinPartitions("cache_key", "at", "session", "turn").mapInArrow(go, "session long, turn long, cache string")


def _folded(known: DataFrame, max_input_tokens: int) -> DataFrame:
    """(session, turn, outcome, reason, source, follow_up, failure_count) of every turn, one session after its own past."""

    def step(s, x):
        clarified = F.coalesce(F.startswith(s["prev"], F.lit("clarification:")), F.lit(False))
        same = s["issue"].eqNullSafe(x["issue_key"])
        reports = x["in_scope"] & x["issue_key"].isNotNull()
        failures = F.when(~reports, 0).when(same, F.least(F.lit(20), s["failures"] + 1)).otherwise(1)
        now = F.struct(clarified.alias("clarified"), ((x["n_before"] > 0) & (clarified | x["continues"])).alias("follow_up"), failures.alias("n"))

        def judged(k):
            of = lambda c: F.when(k["follow_up"], x["asked"][c]).otherwise(x["plain"][c])
            said = {
                "in_scope": x["in_scope"], "scope_reason": x["scope_reason"], "failure_count": k["n"], "after_support": x["goes_on"] & s["prev"].eqNullSafe("support"), "sufficient": of("sufficient"), "evidence_reason": of("reason"),
                "clarified": k["clarified"], "follow_up": k["follow_up"], "can_help": x["can_help"], "cache": x["cache"], "input_tokens": of("tokens"), "max_input_tokens": F.lit(max_input_tokens),
                "first": of("first"), "repair": of("repair"), "fallback": of("quotable"),
            }
            return F.struct(x["turn"].alias("turn"), policy.turn_outcome(said).alias("o"), k["follow_up"].alias("follow_up"), k["n"].alias("n"))

        let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  computed once, used often
        done = let(let(now, judged), lambda r: F.struct(r.alias("r"), F.concat(r["o"]["outcome"], F.when(r["o"]["outcome"] == "clarification", F.concat(F.lit(":"), r["o"]["reason"])).otherwise("")).alias("label")))
        return let(done, lambda r: F.struct(
            F.when(r["label"] == "error", s["prev"]).otherwise(r["label"]).alias("prev"),
            F.when(reports, x["issue_key"]).otherwise(s["issue"]).alias("issue"),
            F.when(reports, r["r"]["n"]).otherwise(s["failures"]).alias("failures"),
            F.array_append(s["out"], r["r"]).alias("out"),
        ))

    o = "struct<outcome:string,reason:string,source:string>"
    start = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(None).cast("string").alias("issue"), F.lit(0).alias("failures"), F.array().cast(f"array<struct<turn:bigint,o:{o},follow_up:boolean,n:int>>").alias("out"))
    whole = known.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", *[c for c in known.columns if c not in ("session", "turn")]))).alias("turns"))
    out = whole.select("session", F.explode(F.aggregate("turns", start, step, lambda s: s["out"])).alias("r"))
    return out.select("session", "r.turn", "r.o.*", "r.follow_up", F.col("r.n").alias("failure_count"))


def outcomes(
    turns: DataFrame,
    evidence: Callable[[DataFrame], DataFrame],
    replies: Callable[[DataFrame], DataFrame],
    words: Words = Words(),
    ttl_seconds: int = 900,
    max_input_tokens: int = 12_000,
    after: int = 10,
    most: int = 24,
    short: int = 4,
    locale: str = policy.LOCALE,
) -> DataFrame:
    """A row for each user turn (session, turn, ts, text): outcome, reason, source, follow_up, failure_count, cache and the query that was asked.

    evidence: (query_id, query) -> (query_id, sufficient, reason, chunks: array of ids, versions: array, tokens), for distinct queries. replies: (session,
    turn, variant, text, chunks) -> the same keys with first and repair (raw answers; null where the provider failed) and quotable
    (whether a sentence of the evidence can stand in). turn is unique in its session.
    """
    said = written(described(turns.select(F.col("session").cast("long"), F.col("turn").cast("long"), "ts", "text"), words), "said")
    dropped, n_dropped = None, 0
    while True:
        kept = said.withColumn("kept", F.lit(True)) if dropped is None else said.join(dropped.withColumn("gone", F.lit(True)), ["session", "turn"], "left").withColumn("kept", F.col("gone").isNull()).drop("gone")
        past = written(with_history(kept, after, most, short), "past")
        variant = lambda k, q: past.select("session", "turn", F.lit(k).alias("variant"), "text", F.col(q).alias("query"), F.sha2(q, 256).alias("query_id"))
        both = variant(0, "text").union(variant(1, "query").where(F.col("query") != F.col("text")))
        found = evidence(written(both.select("query_id", "query").distinct(), "asked"))
        met = written(both.join(found, "query_id"), "met")
        replied = replies(met.select("session", "turn", "variant", "text", "chunks"))
        given = written(met.join(replied.select("session", "turn", "variant", "first", "repair", "quotable"), ["session", "turn", "variant"]), "given")
        name = lambda c: F.concat_ws(":", "session", "turn", "variant", F.lit(c)).alias("answer_id")
        raw = given.select(name("first"), F.col("first").alias("raw"), F.col("chunks").alias("allowed")).union(given.select(name("repair"), "repair", "chunks"))
        verdicts = written(answers.validated(raw.where("raw is not null")).select("answer_id", "verdict"), "verdicts")
        for c in ("first", "repair"):
            given = given.withColumn("answer_id", name(c)).join(verdicts, "answer_id", "left").withColumn(c, F.coalesce("verdict", F.lit("failed"))).drop("answer_id", "verdict")
        of = lambda k: F.max(F.when(F.col("variant") == k, F.struct("sufficient", "reason", "tokens", "first", "repair", "quotable", "versions")))
        sides = given.groupBy("session", "turn").agg(of(0).alias("plain"), of(1).alias("asked"))
        known = past.join(sides, ["session", "turn"]).withColumn("asked", F.coalesce("asked", "plain"))
        known = written(known, "known")

        eligible = known.where(F.lit(ttl_seconds > 0) & (F.col("n_before") == 0) & F.col("issue_key").isNull() & F.col("scope.in_scope") & F.col("plain.sufficient"))
        unfit = ~F.col("plain.first").isin("valid", "abstained", "failed")
        writes = (F.col("plain.tokens") <= max_input_tokens) & ((F.col("plain.first") == "valid") | (unfit & (F.col("plain.repair") == "valid")))
        key = answers.cache_key(F.col("text"), F.col("scope.intent"), F.col("plain.versions"), F.lit(locale))
        looked = cached(eligible.select(key.alias("cache_key"), "ts", "session", "turn", writes.alias("writes")), ttl_seconds)
        known = known.join(looked, ["session", "turn"], "left").withColumn("cache", F.coalesce("cache", F.lit("bypass")))
        flat = known.select("session", "turn", "n_before", F.col("scope.in_scope").alias("in_scope"), F.col("scope.reason").alias("scope_reason"), "continues", "goes_on", "can_help", "issue_key", "cache", F.struct(*[F.col(f"plain.{c}") for c in ("sufficient", "reason", "tokens", "first", "repair", "quotable")]).alias("plain"), F.struct(*[F.col(f"asked.{c}") for c in ("sufficient", "reason", "tokens", "first", "repair", "quotable")]).alias("asked"))
        judged = written(_folded(flat, max_input_tokens), "judged")
        errors = written(judged.where("outcome = 'error'").select("session", "turn"), "errors")
        n = errors.count()
        if n == n_dropped and (not n or errors.join(dropped, ["session", "turn"], "left_anti").isEmpty()):
            out = judged.join(past.select("session", "turn", "text", "query"), ["session", "turn"])
            return out.select("session", "turn", "outcome", "reason", "source", "follow_up", "failure_count", F.when(F.col("follow_up"), F.col("query")).otherwise(F.col("text")).alias("query"))
        dropped, n_dropped = errors, n
