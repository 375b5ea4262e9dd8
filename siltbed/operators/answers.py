"""Structured answers: validation, extractive fallback, source cards, event encoding and cache keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.functions.text import ENTITIES, WHITE, any_marker, clean_sentence, literal_array, normalize, overlap, redact, search_terms, snippet, strip
from siltbed.sources.markdown import settled

# Markers of an abstaining answer and of a fact that may be quoted, and the bounds of an answer.
ABSTENTION = ["در evidence ارائه شده", "در evidence", "شاهد کافی", "اطلاعات کافی", "منبع کافی", "منابع کافی", "هیچ توضیحی درباره", "از روی این منابع", "پاسخ قابل اعتماد کافی"]
QUOTABLE = ["پشتیبانی نمی کند", "امکان ندارد", "مجاز نیست", "در دسترس نیست"]
ANSWER = "answer_markdown string, claims array<struct<text:string,source_ids:array<string>>>, suggestions array<string>, outcome string"
POLICY = "grounding-v2-adaptive-audience"
END = "end of the only answer"


def url_allowed(url: Column, host: str) -> Column:
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.lower(F.try_parse_url(url, F.lit("HOST"))) == host), F.lit(False))


def _shape(value: Column, path: str) -> Column:
    """The type of what stands at a path of a JSON value; null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def validated(answers: DataFrame) -> DataFrame:
    """answers: answer_id, raw, allowed (array of source ids). Adds verdict, source_ids and suggestions (at most 3).

    A valid answer is one JSON object, perhaps fenced, with nothing behind it: answer_markdown of 1 to 20,000
    characters, 1 to 30 claims with texts of 1 to 2,000 characters and 1 to 8 sources each, 3 suggestions
    at most, and the outcome `answered`, each of its type.
    """
    fenced = strip(F.regexp_replace(strip(F.col("raw")), rf"(?i)^```(?:json)?[{WHITE}]*|[{WHITE}]*```$", ""))
    read = settled(answers.select("answer_id", "allowed", fenced.alias("said")), "said")
    # as the first of two elements, the text has to be one whole value
    whole = F.from_json(F.concat(F.lit("["), F.col("said"), F.lit(f',"{END}"]')), "array<string>")
    read = settled(read.withColumn("whole", F.when(F.startswith("said", F.lit("{")), whole)), "whole")
    alone = F.coalesce((F.size("whole") == 2) & (F.get("whole", F.lit(1)) == END), F.lit(False))
    read = settled(read.select("answer_id", "allowed", F.when(alone, F.col("said")).alias("said")), "said")
    read = settled(read.withColumn("v", F.try_parse_json("said")).withColumn("a", F.from_json("said", ANSWER, {"mode": "PERMISSIVE"})).drop("said"), "v", "a")
    claims, hints = F.col("a.claims"), F.coalesce("a.suggestions", F.array().cast("array<string>"))
    said = _shape(F.col("v"), "$.claims")
    typed = (
        (_shape(F.col("v"), "$.answer_markdown") == "STRING")
        & (_shape(F.col("v"), "$.outcome") == "STRING")
        & said.rlike(r"^ARRAY<OBJECT<.*\bsource_ids: ARRAY<STRING>") & said.rlike(r"\btext: STRING\b")
        & F.coalesce(_shape(F.col("v"), "$.suggestions").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(True))
    )
    size = lambda x, most: F.coalesce(F.length(x).between(1, most), F.lit(False))
    good_claim = lambda c: size(c["text"], 2000) & F.coalesce(F.size(c["source_ids"]).between(1, 8), F.lit(False)) & ~F.exists(c["source_ids"], lambda x: x.isNull())
    well = (
        typed
        & size(F.col("a.answer_markdown"), 20000)
        & F.size(claims).between(1, 30)
        & F.forall(claims, lambda c: F.coalesce(good_claim(c), F.lit(False)))
        & (F.size(hints) <= 3)
        & ~F.exists(hints, lambda x: x.isNull())
        & (F.col("a.outcome") == "answered")
    )
    cited = F.flatten(F.transform(claims, lambda c: c["source_ids"]))
    text = F.replace(normalize(F.col("a.answer_markdown")), F.lit("ٔ"), F.lit(""))
    verdict = (
        F.when(~F.coalesce(well, F.lit(False)), "invalid")
        .when(F.size(F.array_except(cited, "allowed")) > 0, "unknown_source")
        .when(F.col("a.answer_markdown").rlike(rf"(?i)https?://[^{WHITE}]"), "url")
        .when(any_marker(text, ABSTENTION), "abstained")
        .otherwise("valid")
    )
    kept = F.array_distinct(F.filter(F.transform(hints, strip), lambda x: x != ""))
    judged = settled(read.select("answer_id", "a", verdict.alias("verdict")), "verdict")
    good = F.col("verdict") == "valid"
    return judged.select("answer_id", "verdict", F.when(good, F.array_join(F.array_distinct(cited), ",")).alias("source_ids"), F.when(good, F.array_join(kept, ",")).alias("suggestions"))


def extractive_fallback(queries: DataFrame, evidence: DataFrame, markers: Sequence[str] = QUOTABLE, least: float = 0.35) -> DataFrame:
    """The best sentence of each query's evidence that states a quotable fact and covers the question.

    evidence: query_id, place, chunk_id, title, heading (array), content. What title and headings name counts as
    covered. Ties go to the earlier place, then the earlier sentence.
    """
    named = F.concat_ws(" ", "title", F.array_join("heading", " ")).alias("named")
    parts = evidence.select("query_id", "place", "chunk_id", named, F.posexplode(F.split("content", rf"(?<=[.!؟])[{WHITE}]+|\n+")).alias("k", "raw"))
    said = parts.withColumn("sentence", clean_sentence(F.col("raw"))).where("length(sentence) between 1 and 800")
    said = said.where(any_marker(normalize(F.col("sentence")), markers)).withColumn("terms", F.array_union(search_terms(F.col("named")), search_terms(F.col("sentence"))))
    met = said.join(queries.select("query_id", search_terms(F.col("query")).alias("q")), "query_id").withColumn("e", F.array_intersect("q", literal_array(ENTITIES)))
    good = met.where((F.size(F.array_except("e", "terms")) == 0) & (overlap(F.col("q"), F.col("terms")) >= least))
    scored = good.withColumn("score", F.round(overlap(F.col("q"), F.col("terms")) + overlap(F.col("e"), F.col("terms")), 9))
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "place", "k"))).where("r = 1")
    return best.select("query_id", "chunk_id", "sentence", "score")


def source_card(url: Column, title: Column, heading: Column, content: Column, host: str) -> Column:
    return F.when(url_allowed(url, host), F.struct(title.alias("title"), url.alias("url"), F.array_join(heading, " > ").alias("section"), snippet(content).alias("snippet")))


def cache_key(query: Column, intent: Column, versions: Column, locale: Column) -> Column:
    """Digest of the canonical JSON (keys sorted, no blanks) of a question and what answers it."""
    body = F.to_json(F.struct(F.array_sort(F.array_distinct(versions)).alias("corpus_versions"), intent.alias("intent"), locale.alias("locale"), F.lit(POLICY).alias("policy"), normalize(query).alias("query")))
    return F.concat(F.lit(f"response-cache:{POLICY}:"), F.sha2(body, 256))


def encode_event(kind: Column, payload: Column) -> Column:
    """A server-sent event; nulls of the payload are left out."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def decode_events(bodies: DataFrame, key: str, body: str, schema: str) -> DataFrame:
    """(key, place, event): the data lines of each event of a stream's body."""
    blocks = bodies.select(key, F.posexplode(F.split(body, "\n\n")).alias("place", "block"))
    data = F.regexp_extract("block", r"(?m)^data: (.*)$", 1)
    return blocks.where(data != "").select(key, "place", F.from_json(data, schema).alias("event"))


def stream_parts(events: DataFrame, key: str, broken: str, cut_off: str) -> DataFrame:
    """(key, place, n, part, value): what a reader is shown of each stream of events, in order.

    events: key, place, and event: a struct of type, response_id, text, sources (array<struct<id, url, title>>), suggestions, reason_code,
    usage (struct<model_tier, input_tokens>), finish_reason and message; null where a block was no JSON. A text is opened by its first
    piece and closed by what may follow it; a stream ends at its first end or error, and one that stops before has been cut off. `broken` and
    `cut_off` are what the reader is told then.
    """
    e = lambda c: F.col(f"event.{c}")
    by_place = W.partitionBy(key).orderBy("place")
    before = by_place.rowsBetween(W.unboundedPreceding, -1)
    kind = F.coalesce(e("type"), F.lit("broken"))
    opens = F.when(kind == "text_delta", True).when(kind.isin("sources", "support", "message_end", "error"), False)
    ends = kind.isin("message_end", "error", "broken")
    d = events.select(key, "place", "event", kind.alias("kind"), F.coalesce(F.last(opens, ignorenulls=True).over(before), F.lit(False)).alias("open"), F.coalesce(F.max(ends).over(before), F.lit(False)).alias("over"), F.last(e("response_id"), ignorenulls=True).over(by_place).alias("id"), F.lead("place").over(by_place).isNull().alias("last"), ends.alias("ends"))
    part = lambda name, value=None: F.struct(F.lit(name).alias("part"), (F.lit(None) if value is None else value).cast("string").alias("value"))
    when = lambda condition, *parts: F.when(condition, F.array(*parts)).otherwise(F.array().cast("array<struct<part:string,value:string>>"))
    text_id, closed, done = F.concat(F.lit("text-"), F.coalesce("id", F.lit(""))), lambda c: when(c & F.col("open"), part("text-end", F.concat(F.lit("text-"), F.coalesce("id", F.lit(""))))), part("[DONE]")
    sources = F.coalesce(e("sources"), F.array().cast("array<struct<id:string,url:string,title:string>>"))
    finish = F.when(e("finish_reason").isin("stop", "length"), e("finish_reason")).otherwise("other")
    said = F.coalesce(e("text"), F.lit("")) != ""
    shown = F.concat(
        when(kind == "message_start", part("start", e("response_id"))),
        when((kind == "status") & said, part("data-status", e("text"))),
        when((kind == "text_delta") & ~F.col("open"), part("text-start", text_id)),
        when((kind == "text_delta") & said, part("text-delta", e("text"))),
        closed(kind.isin("sources", "support", "message_end", "error")),
        F.when(kind == "sources", F.transform(sources, lambda s: F.struct(F.lit("source-url").alias("part"), F.concat_ws(" ", s["id"], s["url"], s["title"]).alias("value")))).otherwise(F.array().cast("array<struct<part:string,value:string>>")),
        when(kind == "sources", part("data-sourceDetails", F.size(sources))),
        when(kind == "suggestions", part("data-suggestions", F.array_join(F.coalesce(e("suggestions"), F.array().cast("array<string>")), "|"))),
        when(kind == "support", part("data-support", F.coalesce(e("reason_code"), F.lit("insufficient_evidence")))),
        when((kind == "usage") & e("usage").isNotNull(), part("data-usage", F.concat_ws(" ", e("usage.model_tier"), F.coalesce(e("usage.input_tokens"), F.lit(0)).cast("string")))),
        when(kind == "message_end", part("finish", finish), done),
        when(kind == "error", part("error", F.coalesce(e("message"), F.lit(cut_off))), done),
        when(kind == "broken", part("error", F.lit(broken)), done),
        when(F.col("last") & ~F.col("ends") & (F.coalesce(opens, F.col("open"))), part("text-end", text_id)),
        when(F.col("last") & ~F.col("ends"), part("error", F.lit(cut_off)), done),
    )
    return d.where("not over").select(key, "place", F.posexplode(shown).alias("n", "p")).select(key, "place", "n", "p.part", "p.value")


def prompt(question: Column, intent: Column, sources: Column, context: Column) -> Column:
    """sources: array<struct<id, title, content>>."""
    block = lambda s: F.concat(F.lit("<SOURCE id="), s["id"], F.lit(">\n"), s["title"], F.lit("\n"), s["content"], F.lit("\n</SOURCE>"))
    return F.concat_ws("\n\n", F.array_join(F.transform(sources, block), "\n"), F.concat(F.lit("INTENT: "), intent), F.concat(F.lit("CONTEXT:\n"), F.coalesce(context, F.lit("(empty)"))), F.concat(F.lit("QUESTION:\n"), question))


def message_tokens(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda a, m: a + F.greatest(F.lit(1), F.floor(F.length(m) / 4).cast("int")))


def decode_lines(bodies: DataFrame, key: str, body: str, schema: str) -> DataFrame:
    """(key, place, event) of a provider's stream: its data lines up to [DONE]; lines that are not JSON are left out."""
    lines = bodies.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("place", "line")).where(F.startswith("line", F.lit("data:")))
    data = lines.select(key, "place", strip(F.substring("line", F.lit(6), F.length("line"))).alias("data"))
    done = data.where("data = '[DONE]'").groupBy(key).agg(F.min("place").alias("end"))
    read = data.join(done, key, "left").where("end is null or place < end")
    return read.select(key, "place", F.from_json("data", schema).alias("event")).where("event is not null")


def cited_chunks(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answers: answer_id, source_ids (array, in order). The chunks that are cited, in each answer's order of citation."""
    wanted = answers.select("answer_id", F.posexplode("source_ids").alias("place", "chunk_id"))
    return wanted.join(chunks, "chunk_id")


def paired(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of two tables that have the same place within a key; each side needs as many rows (see unpaired)."""
    place = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    return left.withColumn("place", place).join(right.withColumn("place", place).drop(order), [key, "place"])


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys for which two tables have different numbers of rows."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    met = n(left, "n_left").join(n(right, "n_right"), key, "full").na.fill(0, ["n_left", "n_right"])
    return met.where("n_left <> n_right")


def in_index_order(replies: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """(key, values): a provider's reply put into the order of its own index."""
    return replies.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda x: x[value]).alias("values"))


def total_usage(calls: DataFrame, key: str) -> DataFrame:
    """Sums of the tokens of a first call and its repairs; the provider of the last call that names one."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens")]
    return calls.groupBy(key).agg(*sums, F.max_by(F.nullif("provider", F.lit("")), F.when(F.nullif("provider", F.lit("")).isNotNull(), F.col("attempt"))).alias("provider"))


def support_summary(query: Column, titles: Column, goal: str, looked_at: str) -> Column:
    """Redacted question (500 characters) and the distinct titles of the first three chunks that were looked at."""
    first = F.array_join(F.array_distinct(F.slice(titles, 1, 3)), "، ")
    return F.concat(F.lit(f"{goal}: "), F.substring(redact(query), 1, 500), F.when(first != "", F.concat(F.lit(f"\n{looked_at}: "), first)).otherwise(""))


def cache_hits(lookups: DataFrame, writes: DataFrame, ttl_seconds: int) -> DataFrame:
    """lookups and writes: cache_key, ts. Each lookup with the time of the last write that is not older than the time to live.

    One pass over both sorted by key and time: no join of lookups with writes.
    """
    at = lambda df, kind: df.withColumn("kind", F.lit(kind)).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    both = at(lookups, 1).unionByName(at(writes, 0), allowMissingColumns=True)
    earlier = W.partitionBy("cache_key").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, -1)
    seen = both.withColumn("written", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(earlier)).where("kind = 1")
    fresh = F.coalesce(F.col("at") - F.col("written") < ttl_seconds * 1_000_000, F.lit(False))
    return seen.select(*lookups.columns, F.when(fresh, F.col("written")).alias("written"), F.when(fresh, "hit").otherwise("miss").alias("cache_status"))


def cacheable(text: Column, n_turns: Column, ttl_seconds: int, markers: Sequence[str]) -> Column:
    """Whether an answer may come from the cache: the first question of a session, not a report of failure."""
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.lit(ttl_seconds > 0) & (n_turns == 0) & ~any_marker(plain, markers)
