"""Queries over the tables below a folder. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.functions import text as T
from siltbed.operators import answers, corpus, evaluation, limits, machines, metrics, policy, retrieval, sessions, turns as whole_turns, versions
from siltbed.sources import markdown
from siltbed.sources.shared import written
from siltbed.sources.tables import few, table

HOST = "docs.example.com"
#: English words for the rule classifiers, as the tables hold no Persian text.
EXTRA_DOMAIN, EXTRA_OUTSIDE = ["tion"], ["ther"]
EXTRA_INTENTS = {"troubleshoot": ["error", "eren"], "deploy": ["deploy", "ingand"], "compare": ["better", "anre"]}
EXTRA_FAILURES = ["the ", "de "]


def query(f):
    f.is_query = True
    return f


def texts_of(spark, d) -> DataFrame:
    """Documents as chunks: chunk_id, document_id (source), title (first five words), heading (lang), content."""
    title = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), title.alias("title"), F.col("lang").alias("heading"), F.col("text").alias("content"))


def text_chunks_of(spark, d) -> DataFrame:
    """The same with their embedding, if any. What needs no embedding takes texts_of: this join moves all texts that are asked of it."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return texts_of(spark, d).join(vectors, "chunk_id", "left")


def vectors_of(spark, d) -> DataFrame:
    """(chunk_id, embedding) of the documents: no text is moved."""
    return text_chunks_of(spark, d).select("chunk_id", "embedding")


def asked(spark, d) -> DataFrame:
    """Benchmark items as questions, each with the vector of the same number."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return table(spark, d, "benchmark").join(vectors, "item_id", "left").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding")


def turns(spark, d) -> DataFrame:
    """Conversations as turns; an assistant turn with an odd number asked for clarification."""
    outcome = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "clarification:low_relevance").when(F.col("role") == "assistant", "answered")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text", outcome.alias("outcome"))


# Text


@query
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("normal"))


@query
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"), F.length("text").cast("long").alias("chars"))


@query
def retrieval_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.search_terms(F.col("text")), "|").alias("terms"))


@query
def search_query_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.search_query(F.col("text")).alias("query"), T.or_query(F.col("text")).alias("any_query"))


@query
def term_frequency(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    postings, _ = retrieval.lexical_index(chunks)
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


@query
def text_pieces(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(T.pieces(F.col("text"))).alias("k", "piece"))
    return parts.select("doc_id", F.col("k").cast("long").alias("k"), "piece")


#: The same expression in Spark and in DuckDB: credentials behind each document's text, by its number.
PLANTED = """CASE doc_id % 6 WHEN 0 THEN ' DB_PASSWORD=ab12 MY_TOKEN="x"' WHEN 1 THEN ' authorization: bearer abcdefghijkl.mn' WHEN 2 THEN ' postgres://u:pw' || doc_id || '@h/db'
WHEN 3 THEN ' data:image/png;base64,' || repeat('A', 1100) WHEN 4 THEN ' API_KEY = short redis://:x@h mysql://a:b@c' ELSE '' END"""


@query
def redact_inline(spark, d):
    """Each document's text with credentials behind it, made safe, and what was replaced."""
    text = F.concat("text", F.expr(PLANTED))
    return table(spark, d, "documents").select("doc_id", F.md5(T.redact(text)).alias("safe_hash"), *T.redaction_counts(text))


@query
def redaction_totals(spark, d):
    planted = F.expr(PLANTED)
    counts = table(spark, d, "documents").select("lang", F.concat("text", planted).alias("text")).select("lang", *T.redaction_counts(F.col("text")))
    return counts.groupBy("lang").agg(*[F.sum(c).alias(c) for c in T.REDACTIONS])


@query
def embedding_input_text(spark, d):
    chunks = table(spark, d, "documents").withColumn("title", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")))
    return chunks.select("doc_id", F.sha2(F.concat_ws("\n", F.nullif("title", F.lit("")), "lang", "text"), 256).alias("input_hash"))


# Identity, versions, constraints


@query
def doc_identity(spark, d):
    return corpus.identities(table(spark, d, "documents"), F.concat_ws("/", "source", F.col("doc_id").cast("string")))


@query
def duplicate_occurrence(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    return corpus.occurrences(chunks, "lang", "content_hash", "doc_id").withColumn("occurrence", F.col("occurrence").cast("long"))


@query
def manifest_hash(spark, d):
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.sha2("text", 256).alias("h"))
    return corpus.manifest(docs, "path", "h")


@query
def snapshot_report(spark, d):
    docs = table(spark, d, "documents")
    status = F.when(F.length("text") < 100, "skipped").otherwise("ok")
    return docs.select(status.alias("status"), F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("status") == "ok").alias("documents"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.sum("n").cast("long").alias("chars"))


@query
def pending_embeddings(spark, d):
    return corpus.pending(table(spark, d, "documents"), table(spark, d, "embeddings"), "doc_id", "vec_id").select("doc_id", "source")


@query
def embedding_validation(spark, d):
    vectors = table(spark, d, "embeddings")
    bad = corpus.invalid_vectors(vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding")), 64)
    return bad.select("vec_id")


@query
def embedding_batches(spark, d):
    return corpus.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 16)


@query
def version_activation(spark, d):
    """Languages as versions, the first one active; what becomes of each when English, whose chunks may lack embeddings, and when the last one is tried."""
    first = table(spark, d, "documents").agg(F.min("lang").alias("l"))
    before = table(spark, d, "documents").select(F.col("lang").alias("id")).distinct()
    is_first = F.col("id") == first.scalar()
    before = before.select("id", F.when(is_first, "active").otherwise("embedded").alias("status"), F.when(is_first, "2026-01-01").alias("activated_at"))
    chunks = text_chunks_of(spark, d).select(F.col("heading").alias("version_id"), "chunk_id", "embedding")
    chunks = chunks.where("version_id <> 'es' or embedding is not null").select("version_id", "embedding")  # all that is left of Spanish has one
    tried = lambda name: corpus.activate(before, chunks, name, "2026-02-01").withColumn("tried", F.lit(name))
    return tried("en").union(tried("es"))


@query
def constraint_violations(spark, d):
    docs, labels, orders = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "orders")
    found = [
        ("duplicate document", corpus.duplicate_keys(docs, "doc_id")),
        ("duplicate content", corpus.duplicate_keys(docs, "text")),
        ("label without document", corpus.orphans(labels, docs, "doc_id", "doc_id")),
        ("bad status", orders.where(~F.col("o_orderstatus").isin("O", "F", "P"))),
        ("not positive", docs.where(F.length("text") <= 0)),
    ]
    out = None
    for name, rows in found:
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.union(one)
    return out


@query
def url_allowlist(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), answers.url_allowed(F.col("url"), "ththre.example.com").alias("allowed"))


@query
def url_hosts(spark, d):
    pages = table(spark, d, "pages").select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), F.try_parse_url("url", F.lit("PROTOCOL")).alias("scheme"))
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("scheme") == "https").alias("secure"))


# Markdown


#: The same expression in Spark and in DuckDB: a Markdown file of each document's text as it is, by its number: with a byte order mark, code and a list of
#: links behind it, of another host, by http, without a link, without a title, all behind the list of links, and plain.
MARKDOWN_FILE = """CASE doc_id % 7 WHEN 3 THEN '' ELSE 'Original link: http' || CASE doc_id % 7 WHEN 2 THEN '' ELSE 's' END || '://' || CASE doc_id % 7 WHEN 1 THEN 'other.example.org' ELSE 'docs.example.com' END || '/' || doc_id || chr(10) END
|| CASE doc_id % 7 WHEN 4 THEN '## Sub' WHEN 5 THEN '## All links' ELSE '# Document ' || doc_id END || chr(10) || text || CASE doc_id % 7 WHEN 0 THEN chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || '## All links' || chr(10) || '[z](z)' ELSE '' END"""


@query
def parse_document_inline(spark, d):
    """Documents as files of every kind that a parser takes, skips or refuses, with all of their content."""
    raw = F.concat(F.when(F.col("doc_id") % 7 == 0, "\ufeff").otherwise(""), F.expr(MARKDOWN_FILE))
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.regexp_replace(raw, "^\ufeff", "").alias("raw"))
    return markdown.parse(files, HOST).select("path", "status", "reason", "canonical_url", "title", "content")


@query
def parse_units_inline(spark, d):
    """Units by kind of every document behind a heading and before a section of code, without its hash signs and fences."""
    text = F.regexp_replace("text", "[#`~]", "")
    content = F.concat(F.lit("# Title\n\n"), text, F.lit("\n\n## Code\n\n```py\nx = 1\n```"))
    units = markdown.with_units(table(spark, d, "documents").select("doc_id", content.alias("content"))).select("doc_id", F.explode("units").alias("u"))
    return units.groupBy("doc_id", F.col("u.kind").alias("kind"), F.array_join("u.heading_path", " > ").alias("heading"), "u.code_language").agg(F.count(F.lit(1)).alias("units"))


@query
def chunk_ranges(spark, d):
    """Lines of documents as units, those with a hash sign as code: the ranges of lines that groups of 150 tokens hold, with up to 30 of the group before."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    docs = table(spark, d, "documents").select("doc_id", F.transform(lines, lambda x: F.struct(T.token_count(x).alias("n"), F.contains(x, F.lit("#")).alias("code"))).alias("u"))
    found = docs.select("doc_id", F.posexplode(markdown.group_ranges(150, 30)(F.transform("u", lambda x: x["n"]), F.transform("u", lambda x: x["code"]))).alias("k", "r"))
    return found.select("doc_id", F.col("k").cast("long").alias("k"), F.col("r.a").cast("long").alias("a"), F.col("r.b").cast("long").alias("b"))


@query
def chunk_documents(spark, d):
    chunks = markdown.chunked(table(spark, d, "documents").select(F.col("doc_id").alias("stable_id"), F.col("text").alias("content")))
    return chunks.select("stable_id", "chunk_id", "ordinal", "token_count", "content_hash")


# Retrieval


@query
def trigram_similarity(spark, d):
    scores = retrieval.lexical_scores(asked(spark, d), texts_of(spark, d))
    return scores.select("query_id", "chunk_id", "tf_hits", F.round("similarity", 9).alias("similarity"))


@query
def lexical_topk(spark, d):
    best = retrieval.lexical_best(asked(spark, d), texts_of(spark, d))
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "lexical_score")


@query
def vector_topk(spark, d):
    best = retrieval.vector_best(asked(spark, d), vectors_of(spark, d))
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "vector_score")


@query
def vector_label_agreement(spark, d):
    """Share of each item's 10 nearest vectors that have its label."""
    vectors = table(spark, d, "embeddings")
    near = retrieval.vector_best(asked(spark, d), vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)
    labels = vectors.select("vec_id", "label")
    met = near.join(labels.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return met.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 6).alias("agreement"))


def fused(spark, d):
    chunks, q = texts_of(spark, d), asked(spark, d)
    return retrieval.fuse(retrieval.lexical_best(q, chunks), retrieval.vector_best(q, vectors_of(spark, d))), q, chunks


@query
def rrf_fusion(spark, d):
    return fused(spark, d)[0].select("query_id", F.col("position").cast("long").alias("position"), "chunk_id", "fused_score")


@query
def hybrid_retrieve(spark, d):
    best = retrieval.hybrid(asked(spark, d), texts_of(spark, d), vectors=vectors_of(spark, d))
    return best.select("query_id", F.col("place").cast("long").alias("place"), "chunk_id", "rerank_score")


@query
def evidence_budget(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("place"), "doc_id", T.token_count(F.col("text")).alias("tokens"))
    kept = retrieval.within_budget(docs, 6, 2000)
    return kept.select("query_id", F.col("place").cast("long").alias("place"), "doc_id", F.col("used").cast("long").alias("used"))


@query
def evidence_decision(spark, d):
    q, chunks = asked(spark, d), texts_of(spark, d)
    best = retrieval.hybrid(q, chunks, vectors=vectors_of(spark, d)).where(F.col("place") <= retrieval.EVIDENCE)
    best = few(written(best, "best"))  # read more than once; only its texts move
    said = chunks.select("chunk_id", "content", "title", T.token_count(F.col("content")).alias("tokens"))
    chosen = retrieval.within_budget(said.join(best, "chunk_id"))
    chosen = chosen.withColumn("terms", T.search_terms(F.concat_ws(" ", "title", "heading", "content")))
    disputed = retrieval.contradictions(chosen.select("query_id", "document_id", "content"))
    return retrieval.judge(q, chosen, disputed)


# Policy and conversations


@query
def scope_intent(spark, d):
    user = table(spark, d, "conversations").where("role = 'user'")
    chosen = policy.scope(F.col("text"), EXTRA_DOMAIN, EXTRA_OUTSIDE, EXTRA_INTENTS)
    return user.select("conv_id", "turn", chosen.alias("s")).select("conv_id", "turn", "s.in_scope", "s.intent", "s.reason")


@query
def model_route(spark, d):
    user = table(spark, d, "conversations").where("role = 'user'")
    intent = policy.scope(F.col("text"), EXTRA_DOMAIN, EXTRA_OUTSIDE, EXTRA_INTENTS)["intent"]
    routed = user.select("conv_id", "turn", policy.route(F.col("text"), intent, (F.col("turn") % 4).cast("long"), F.col("conv_id") % 11 == 0).alias("r"))
    return routed.select("conv_id", "turn", "r.tier", "r.reason", F.col("r.max_output_tokens").cast("long").alias("max_output_tokens"))


@query
def prev_assistant_turn(spark, d):
    said = sessions.previous_assistant(turns(spark, d))
    return said.select("session", "turn", "previous_turn", F.md5("previous_text").alias("previous_hash"))


@query
def follow_up_flag(spark, d):
    return sessions.follow_ups(turns(spark, d), ["the", "and", "of", "de"], ["the ", "is "], 4)


@query
def retrieval_rewrite(spark, d):
    t = turns(spark, d)
    flags = sessions.follow_ups(t, ["the", "and", "of", "de"], ["the ", "is "], 4)
    return sessions.rewritten_queries(t, flags, ["the", "and", "of", "de"]).select("session", "turn", F.md5("query").alias("query_hash"), F.length("query").cast("long").alias("n"))


@query
def issue_failures(spark, d):
    counted = sessions.issue_failures(turns(spark, d), EXTRA_FAILURES)
    return counted.select("session", "turn", "issue_key", F.col("failure_count").cast("long").alias("failure_count"))


@query
def history_compaction(spark, d):
    return sessions.compacted(turns(spark, d), 4, 12).select("session", F.md5("summary").alias("summary_hash"), F.col("kept").cast("long").alias("kept"))


@query
def context_fill(spark, d):
    return sessions.context_blocks(turns(spark, d), 1500).select("session", F.md5("context").alias("context_hash"), F.col("turns").cast("long").alias("turns"))


@query
def latest_user_message(spark, d):
    said = turns(spark, d).where("role = 'user'")
    return said.groupBy("session").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


# Calls


@query
def rate_limit_two_level(spark, d):
    calls = table(spark, d, "events").select("event_id", "user_id", "ts")
    return limits.limited(calls, "user_id", "ts", "event_id", 1, 2).select("event_id", "verdict", F.col("retry_after").cast("long").alias("retry_after"))


@query
def rate_limit_minute(spark, d):
    calls = table(spark, d, "events").select("user_id", limits.bucket(F.col("ts"), 60).alias("minute"))
    return calls.groupBy("user_id", "minute").agg(F.count(F.lit(1)).alias("calls")).where("calls > 1")


@query
def session_windows(spark, d):
    out = sessions.sessionized(table(spark, d, "events"), "user_id", "ts", 7200)
    return out.select("user_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "events")


@query
def idempotent_messages(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return limits.first_messages(events, "user_id", "event_type", order=["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query
def circuit_breaker_runs(spark, d):
    runs = limits.failure_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max("failures").alias("longest"), F.count_if("opens").alias("opened"))


def document_files(spark, d, planted: bool = False) -> DataFrame:
    """Documents as Markdown files (path, raw); planted: some with what a parser refuses or skips."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 11
    link = F.concat(F.lit(f"Original link: https://{HOST}/"), n)
    if planted:
        link = F.when(k == 1, F.concat(F.lit("Original link: https://other.example.com/"), n)).when(k == 2, F.concat(F.lit(f"Original link: http://{HOST}/"), n)).when(k == 3, "No link").otherwise(link)
    title = F.concat(F.lit("# Document "), n)
    title = F.when(k == 4, F.concat(F.lit("## Document "), n)).otherwise(title) if planted else title
    tail = F.when(k == 6, "\n\n## All links\n- https://x.example.com").otherwise("") if planted else F.lit("")
    raw = F.concat(link, F.lit("\n"), title, F.lit("\n\n"), F.regexp_replace("text", "#", ""), tail)
    raw = F.when(k == 5, "").otherwise(raw) if planted else raw
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), n, F.lit(".md")).alias("path"), raw.alias("raw"))


@query
def parse_documents(spark, d):
    out = markdown.parse(document_files(spark, d, True), HOST)
    return out.select("path", "status", "reason", "canonical_url", "title", F.md5("content").alias("content_hash"))


def vectors_by_rule(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.array(F.length("chunk_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))


@query
def version_lifecycle(spark, d):
    """All documents from files to the active version: parsed, chunked, registered, embedded as a stream, activated, and read through it."""
    from siltbed.sources.shared import new_dir

    store = versions.Versions(spark, new_dir(spark, "corpus"))
    store.ingest(document_files(spark, d), HOST, vectors_by_rule, "c" * 40, "model", 2, files_at_once=4)
    stats = store.states().where("status = 'active'").select(F.from_json("stats", "map<string,bigint>").alias("s")).select((F.col("s.embedded_chunks") == F.col("s.chunks")).alias("complete"), F.col("s.documents").alias("documents"))
    read = store.active_chunks().groupBy("canonical_url", "title").agg(F.min("ordinal").cast("long").alias("first"), F.count_if(F.col("embedding").isNull()).alias("lacking"))
    return read.withColumn("complete", stats.select("complete").scalar()).withColumn("documents", stats.select("documents").scalar())


@query
def readiness(spark, d):
    """Document sources as versions, of which one is active, with its chunks' embeddings."""
    chunks = text_chunks_of(spark, d).select(F.col("document_id").alias("version_id"), "embedding")
    first = table(spark, d, "documents").agg(F.min("source").alias("s"))
    states = table(spark, d, "documents").select(F.col("source").alias("id")).distinct().withColumn("status", F.when(F.col("id") == first.scalar(), "active").otherwise("indexed"))
    tables = {name: table(spark, d, name) for name in ("documents", "embeddings")}
    return versions.readiness(states, chunks, tables, {"documents": ["doc_id", "text"], "embeddings": ["vec_id", "model"], "chunks": ["chunk_id"]})


def contradicting(spark, d, size: int) -> DataFrame:
    said = F.concat(F.lit("feature "), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, " پشتیبانی نمی کند. ").otherwise(" پشتیبانی می کند. "))
    chunks = table(spark, d, "documents").select(F.floor(F.col("doc_id") / size).alias("query_id"), F.col("doc_id").alias("document_id"), F.concat(said, F.substring("text", 1, 200)).alias("content"))
    return retrieval.contradictions(chunks)


@query
def document_contradictions(spark, d):
    """Ten documents to a question; each says of its language that something is possible, or, with an even number, that it is not."""
    return contradicting(spark, d, 10)


@query
def contradiction_pairs(spark, d):
    """The same with four documents to a question."""
    return contradicting(spark, d, 4)


@query
def extractive_quotes(spark, d):
    """For each benchmark item the sentence that holds a marker and covers the question best, of the documents whose number goes with the item's."""
    asked_items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    evidence = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("query_id"), F.floor(F.col("doc_id") / 40).cast("int").alias("place"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("title"), F.array("source").alias("heading"), F.col("text").alias("content"))
    return answers.extractive_fallback(asked_items, evidence, ["and ", "de "], 0.2)


@query
def provider_stream(spark, d):
    """Ten lines to a provider's stream: pieces, a comment, a line that is cut off, the end, and what comes after it."""
    n = F.col("event_id") % 10
    line = F.when(n == 7, "data: [DONE]").when(n == 3, ": ping").when(n == 5, 'data: {"delta":').otherwise(F.concat(F.lit('data: {"delta":"'), "event_type", F.lit('","n":'), F.col("event_id").cast("string"), F.lit("}")))
    bodies = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 10).alias("stream")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\r\n").alias("body"))
    events = answers.decode_lines(bodies, "stream", "body", "delta string, n long")
    return events.where("event.n is not null").select("stream", F.col("place").cast("long").alias("place"), "event.delta", "event.n")


@query
def after_support_flag(spark, d):
    """Every third assistant turn handed over to support."""
    said = turns(spark, d).withColumn("outcome", F.when((F.col("role") == "assistant") & ((F.col("session") + F.col("turn")) % 3 == 0), "support").otherwise(F.col("outcome")))
    return sessions.after_support(said, ["the ", "of ", "is "], ["and"])


@query
def support_summaries(spark, d):
    """What support is told of each user turn: the redacted question and what was looked at."""
    user = table(spark, d, "conversations").where("role = 'user'")
    titles = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("b"), F.col("conv_id").cast("string"), F.lit("b"), F.lit("never")))
    summary = answers.support_summary(F.concat(F.lit("MY_TOKEN=abc "), F.col("text")), titles, "goal", "seen")
    return user.select("conv_id", "turn", F.md5(summary).alias("summary_hash"), F.length(summary).cast("long").alias("n"))


@query
def prompts(spark, d):
    """Each benchmark item as a question over itself."""
    source = F.array(F.struct(F.col("item_id").cast("string").alias("id"), F.lit("title").alias("title"), F.col("text").alias("content")), F.struct(F.lit("x").alias("id"), F.lit("other").alias("title"), F.lit("more").alias("content")))
    made = answers.prompt(F.col("text"), F.lit("explain"), source, F.when(F.col("item_id") % 2 == 0, F.col("text")))
    return table(spark, d, "benchmark").select("item_id", F.md5(made).alias("prompt_hash"), F.length(made).cast("long").alias("n"))


@query
def row_checks(spark, d):
    """Rows that break a rule: roles that no turn may have, URLs without the wanted beginning."""
    roles = policy.broken(table(spark, d, "conversations"), "role", ~policy.role_allowed(F.col("role")))
    return roles.union(policy.broken(table(spark, d, "pages"), "url prefix", ~F.coalesce(F.startswith("url", F.lit("https://")), F.lit(False))))


@query
def report_json(spark, d):
    """The release report as one JSON text, with the commit set into it."""
    report = evaluation.release_report(evaluation.case_results(*_cases(spark, d)))
    return report.select(evaluation.json_report(F.struct(*report.columns), commit=F.lit("c0ffee")).alias("report"))


@query
def golden_set(spark, d):
    """Benchmark items written as lines of JSON, and read and checked as golden cases."""
    from siltbed.sources.shared import new_dir

    path = new_dir(spark, "golden")
    cases = _cases(spark, d)[0].join(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query")), "id")
    cases.select(F.col("id").cast("string").alias("id"), "query", "expected_in_scope", "expected_urls").write.json(path)
    out = evaluation.golden_cases(spark, path)
    return out.select(F.col("id").cast("long").alias("id"), F.md5("query").alias("query_hash"), "expected_in_scope", F.size("expected_urls").cast("long").alias("n_urls"))


# Machines, each as a batch and, under stream_..., as a stream over the same rows


def _calls(events: DataFrame) -> DataFrame:
    """Events as calls to targets: errors and views fail."""
    return events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").isin("error", "view").alias("failed"))


def _commands(events: DataFrame) -> DataFrame:
    """Events as commands on a user's message of the day."""
    command = F.create_map(*[F.lit(x) for x in ("view", "reserve", "click", "reserve", "purchase", "complete", "error", "release", "signup", "complete")])
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select("event_id", "user_id", F.floor(at / (8 * 86_400_000_000)).alias("message"), at.alias("at"), F.coalesce(F.try_element_at(command, F.col("event_type")), F.lit("reserve")).alias("command"))


def _session_commands(events: DataFrame) -> DataFrame:
    command = F.create_map(*[F.lit(x) for x in ("signup", "create", "view", "load", "click", "append", "purchase", "append", "error", "delete")])
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select("event_id", "user_id", at.alias("at"), F.coalesce(F.try_element_at(command, F.col("event_type")), F.lit("create")).alias("command"))


def _cache_commands(events: DataFrame) -> DataFrame:
    """Clicks write a user's answer; others look it up, unless the text is a report of failure or a turn came before; every eleventh no longer stands."""
    may = answers.cacheable(F.col("event_type"), F.col("event_id") % 5 % 4, 3600, ["error"])
    command = F.when(F.col("event_type") == "click", "write").when(may, "lookup").otherwise("bypass")
    return events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), command.alias("command"), (F.col("event_id") % 11 != 0).alias("valid"))


def _said(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("session"), "turn", "role", "text")


BY_TIME = ["at", "event_id"]


@query
def circuit_states(spark, d):
    out = machines.in_order(_calls(table(spark, d, "events")), ["user_id"], BY_TIME, machines.circuit(3, 6 * 3600))
    return out.select("event_id", "user_id", "circuit")


@query
def reservations(spark, d):
    out = machines.in_order(_commands(table(spark, d, "events")), ["user_id", "message"], BY_TIME, machines.reservation(2 * 86400))
    return out.select("event_id", "command", "result")


@query
def session_states(spark, d):
    out = machines.in_order(_session_commands(table(spark, d, "events")), ["user_id"], BY_TIME, machines.session(12 * 3600))
    return out.select("event_id", "command", "result", F.col("turns").cast("long").alias("turns"))


@query
def answer_cache(spark, d):
    out = machines.in_order(_cache_commands(table(spark, d, "events")), ["user_id"], BY_TIME, machines.answer_cache(86400))
    return out.select("event_id", "command", "cache_status", "written")


@query
def session_compaction(spark, d):
    """The state of a session after each of its turns."""
    out = machines.in_order(_said(table(spark, d, "conversations")), ["session"], ["turn"], machines.compaction(4, 12, 120, 300))
    return out.select("session", "turn", F.col("kept").cast("long").alias("kept"), F.md5("summary").alias("summary_hash"))


@query
def provider_failover_first_success(spark, d):
    attempts = table(spark, d, "events").select((F.col("event_id") / 5).cast("long").alias("request"), (F.col("event_id") % 5).alias("place"), F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")).alias("target"), (F.col("event_type") != "error").alias("ok"))
    return limits.first_success(attempts, "request", "target", "place", F.col("ok"))


@query
def status_classes(spark, d):
    calls = table(spark, d, "events").select((F.element_at(F.array(*[F.lit(x) for x in (200, 401, 408, 429, 503, 404, 403)]), (F.col("event_id") % 7 + 1).cast("int"))).alias("status"))
    return calls.groupBy(limits.failover_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("calls"))


def event_counters(spark, d):
    return metrics.counters(table(spark, d, "events"), F.lit("requests_total"), {"type": F.col("event_type"), "day": F.dayofweek("ts")}, F.lit(1))


@query
def metrics_counters(spark, d):
    events = table(spark, d, "events")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("total"))


@query
def metrics_exposition(spark, d):
    return metrics.exposition(event_counters(spark, d)).select("line", F.col("part").cast("long").alias("part"), "labels")


@query
def p95_by_index(spark, d):
    out = metrics.quantile_by_index(table(spark, d, "events"), "event_type", "value")
    return out.select("event_type", F.round("quantile", 6).alias("p95"), "n")


@query
def cost_estimate(spark, d):
    said = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") > 300, "large").otherwise("small").alias("tier"), T.token_count(F.col("text")).alias("tokens"))
    return said.select("conv_id", "turn", policy.estimated_cost(F.col("tier"), F.col("tokens"), F.col("tokens") * 2, {"small": (0.15, 0.6), "large": (2.5, 10.0)}).alias("cost"))


# Answers and events


@query
def answer_validate(spark, d):
    """Answers made of the documents' hashes by a rule that plants every fault in turn."""
    answered = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.expr(RAW_ANSWER).alias("raw"), F.expr("array(substr(md5(text), 1, 4), substr(md5(text), 5, 4))").alias("allowed"))
    return answers.validated(answered)


#: The same expression in Spark and in DuckDB: an answer to each document, with the fault of its number.
RAW_ANSWER = """
CASE doc_id % 23 WHEN 1 THEN '```json' || chr(10) WHEN 2 THEN '```' || chr(10) WHEN 3 THEN 'so: ' WHEN 4 THEN '[' ELSE '  ' END
|| '{"answer_markdown":' || CASE doc_id % 29 WHEN 1 THEN '""' WHEN 2 THEN '7' WHEN 3 THEN 'null' WHEN 4 THEN '"' || repeat('x', 20001) || '"' WHEN 5 THEN '"see HTTPS://x.example.com"'
   WHEN 6 THEN '"we have ' || 'اطلاعات كافی' || ' not"' WHEN 7 THEN '"' || repeat('x', 20000) || '"' ELSE '"Yes ' || md5(text) || '."' END
|| ',"claims":' || CASE doc_id % 31 WHEN 1 THEN '[]' WHEN 2 THEN 'null' WHEN 3 THEN '{}' WHEN 4 THEN '["a"]' WHEN 5 THEN '[{"text":"","source_ids":["' || substr(md5(text), 1, 4) || '"]}]'
   WHEN 6 THEN '[{"text":"' || repeat('y', 2001) || '","source_ids":["' || substr(md5(text), 1, 4) || '"]}]' WHEN 7 THEN '[{"text":"t","source_ids":[]}]' WHEN 8 THEN '[{"text":"t"}]'
   WHEN 9 THEN '[{"text":5,"source_ids":["' || substr(md5(text), 1, 4) || '"]}]' WHEN 10 THEN '[{"text":"t","source_ids":["' || substr(md5(text), 1, 4) || '"]},{"text":"u","source_ids":["zz"]}]'
   WHEN 11 THEN '[{"text":"t","source_ids":["' || substr(md5(text), 1, 4) || '"' || repeat(',"' || substr(md5(text), 5, 4) || '"', 8) || ']}]'
   WHEN 12 THEN '[{"text":"t","source_ids":["' || substr(md5(text), 1, 4) || '"]}' || repeat(',{"text":"t","source_ids":["' || substr(md5(text), 5, 4) || '"]}', 30) || ']'
   ELSE '[{"text":"t","source_ids":["' || substr(md5(text), 5, 4) || '","' || substr(md5(text), 1, 4) || '","' || substr(md5(text), 5, 4) || '"]},{"text":"' || repeat('z', 2000) || '","source_ids":["' || substr(md5(text), 1, 4) || '"]}]' END
|| CASE doc_id % 7 WHEN 1 THEN '' WHEN 2 THEN ',"suggestions":[]' WHEN 3 THEN ',"suggestions":["a"," b ","a"]' WHEN 4 THEN ',"suggestions":["a","b","c","d"]' WHEN 5 THEN ',"suggestions":["",3]' ELSE ',"suggestions":["  ","more"]' END
|| CASE doc_id % 19 WHEN 1 THEN '' WHEN 2 THEN ',"outcome":"nonsense"' WHEN 3 THEN ',"outcome":5' WHEN 4 THEN ',"outcome":null' ELSE ',"outcome":"answered"' END || '}'
|| CASE doc_id % 23 WHEN 1 THEN chr(10) || '```' WHEN 2 THEN '```  ' WHEN 4 THEN ']' WHEN 5 THEN ' and more' WHEN 6 THEN ',{}' WHEN 7 THEN '}' ELSE chr(10) END
"""


@query
def extractive_fallback(spark, d):
    """Each document's own best sentence on its first 300 characters, if it holds a marker."""
    docs = table(spark, d, "documents")
    asked_of = docs.select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 300).alias("query"))
    evidence = docs.select(F.col("doc_id").alias("query_id"), F.lit(0).alias("place"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("").alias("title"), F.array().cast("array<string>").alias("heading"), F.col("text").alias("content"))
    return answers.extractive_fallback(asked_of, evidence, ["the ", "der "], 0.3).withColumn("sentence", F.md5("sentence"))


@query
def cache_keys(spark, d):
    user = table(spark, d, "conversations").where("role = 'user'")
    key = answers.cache_key(F.regexp_replace("text", '["\\\\/]', " "), F.lit("explain"), F.array(F.lit("v2"), F.lit("v1"), F.lit("v2")), F.lit("en"))
    return user.select("conv_id", "turn", key.alias("cache_key"))


@query
def sse_encode(spark, d):
    events = table(spark, d, "events")
    payload = F.struct(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("code"), F.col("event_type").alias("type"))
    return events.select("event_id", answers.encode_event(F.col("event_type"), payload).alias("event"))


@query
def sse_parse(spark, d):
    bodies = sse_encode(spark, d).withColumn("stream", F.floor(F.col("event_id") / 10)).groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event"))), lambda x: x["event"]), "").alias("body"))
    events = answers.decode_events(bodies, "stream", "body", "id long, code string, type string")
    return events.select("stream", F.col("place").cast("long").alias("place"), "event.id", "event.code", "event.type")


#: What the events of a stream say, by their number: the same expression in Spark and in DuckDB. Some blocks are cut off, some streams never end.
STREAM_EVENT = """CASE WHEN event_id % 37 = 5 THEN '{"type":"text_' WHEN event_id % 12 = 0 THEN '{"type":"message_start","response_id":"r' || event_id || '"}' WHEN event_id % 12 = 1 THEN '{"type":"status","text":"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END || '"}'
WHEN event_id % 12 = 11 AND event_id % 5 <> 0 THEN CASE WHEN event_type = 'error' THEN '{"type":"error"' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ',"message":"failed"' END || '}' ELSE '{"type":"message_end","finish_reason":"' || CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' ELSE 'policy' END || '"}' END
WHEN event_type = 'view' THEN '{"type":"sources","sources":[{"id":"s' || event_id || '","url":"https://docs.example.com/' || event_id || '","title":"t"}]}' WHEN event_type = 'signup' THEN '{"type":"suggestions","suggestions":["a","b' || event_id || '"]}'
WHEN event_type = 'error' THEN '{"type":"support"' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ',"reason_code":"no_results"' END || '}' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN '{"type":"usage","usage":{"model_tier":"small","input_tokens":' || event_id || '}}' WHEN event_type = 'purchase' THEN '{"type":"usage"}'
ELSE '{"type":"text_delta","text":"' || CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type || event_id END || '"}' END"""
EVENT = "struct<type:string,response_id:string,text:string,sources:array<struct<id:string,url:string,title:string>>,suggestions:array<string>,reason_code:string,usage:struct<model_tier:string,input_tokens:bigint>,finish_reason:string,message:string>"


@query
def stream_parts(spark, d):
    """Twelve events to a stream, as the bytes of a body; what a reader is shown of them."""
    said = table(spark, d, "events").select(F.floor(F.col("event_id") / 12).alias("stream"), "event_id", F.concat(F.lit("event: x\ndata: "), F.expr(STREAM_EVENT), F.lit("\n\n")).alias("block"))
    bodies = said.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "block"))), lambda x: x["block"]), "").alias("body"))
    events = answers.decode_events(bodies, "stream", "body", EVENT)
    out = answers.stream_parts(events, "stream", "not a stream", "cut off")
    return out.select("stream", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"), "part", "value")


@query
def source_cards(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 4 == 0, "http").otherwise("https"), F.lit(f"://{HOST}/"), "source").alias("url"), "source", "lang", "text")
    card = answers.source_card(F.col("url"), F.col("source"), F.array("lang", "source"), F.col("text"), HOST)
    return chunks.select("doc_id", card.alias("c")).where("c is not null").select("doc_id", "c.url", "c.section", "c.snippet")


@query
def prompt_tokens(spark, d):
    said = turns(spark, d).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return said.select("session", answers.message_tokens(F.transform("t", lambda x: x["text"])).cast("long").alias("tokens"))


# Evaluation


def benchmark_ranks(spark, d):
    results = retrieval.hybrid(asked(spark, d), texts_of(spark, d), vectors=vectors_of(spark, d)).select("query_id", "chunk_id", F.col("place").alias("rank"))
    expected = few(table(spark, d, "benchmark")).join(table(spark, d, "documents"), "text").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))
    return evaluation.reciprocal_ranks(results, expected)


@query
def eval_recall_mrr(spark, d):
    return evaluation.summary(benchmark_ranks(spark, d))


@query
def eval_gate(spark, d):
    return evaluation.gate(evaluation.summary(benchmark_ranks(spark, d))).select("queries", "passed")


@query
def eval_label_accuracy(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id", "left")
    guess = (F.length("text") >= 200).cast("int")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((guess == F.col("quality")).cast("double")), 9).alias("accuracy"))


# Relational forms


@query
def star_join_active(spark, d):
    regions = table(spark, d, "region").where("r_name = 'EUROPE' or r_regionkey = 3").select("r_regionkey", "r_name")
    nations, customers = table(spark, d, "nation"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    orders, items = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    met = few(nations.join(few(regions), nations.n_regionkey == regions.r_regionkey)).join(customers, F.col("n_nationkey") == F.col("c_nationkey"))
    sold = met.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    revenue = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(6,4)"))
    return sold.groupBy("n_name").agg(F.round(F.sum(revenue), 2).cast("double").alias("revenue"), F.count(F.lit(1)).alias("lines"))


@query
def exists_orders(spark, d):
    late = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(late, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


@query
def missing_children_anti(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query
def topk_tiebreak(spark, d):
    best = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber").limit(30)
    return best


@query
def case_status(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "indexed").when(F.col("o_totalprice") > 200000, "active").otherwise(F.lower("o_orderstatus"))
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("orders"))


# Versions, turns and releases, over tables by rule


def _versioned(spark, d):
    """Documents dealt to three versions, of which one is active; chunks are the documents themselves."""
    docs = table(spark, d, "documents")
    version = F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string"))
    documents = docs.select(version.alias("version_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stable_id"), F.col("source").alias("title"), F.concat(F.lit(f"https://{HOST}/"), F.col("doc_id").cast("string")).alias("canonical_url"))
    chunks = docs.select(version.alias("version_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    states = spark.createDataFrame([("v0", None), ("v1", "2026-02-01"), ("v2", None)], "id string, activated_at string")
    return chunks, documents, states


@query
def active_version_topk(spark, d):
    """Lexical retrieval that sees the active version only."""
    chunks = versions.active_only(*_versioned(spark, d))
    best = retrieval.lexical_best(asked(spark, d), chunks, 10).join(chunks.select("chunk_id", "title", "canonical_url"), "chunk_id")
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "lexical_score", "title", "canonical_url")


@query
def turn_outcomes(spark, d):
    """What becomes of each user turn; what is known of it follows from its numbers by rule."""
    t = turns(spark, d).where("role = 'user'")
    k = (F.col("session") * 31 + F.col("turn") * 7) % 101
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n % len(values) + 1).cast("int"))
    known = {
        "in_scope": k % 13 != 0, "scope_reason": pick(5, "domain_unverified", "domain_keyword"), "failure_count": k % 4, "after_support": k % 11 == 0, "sufficient": k % 3 != 0,
        "evidence_reason": pick(6, "no_results", "low_relevance", "contradictory_sources"), "clarified": k % 17 == 0, "follow_up": k % 2 == 0, "can_help": k % 5 > 1, "cache": pick(7, "hit", "miss", "bypass", "invalid"),
        "input_tokens": k * 100, "max_input_tokens": F.lit(9000), "first": pick(10, "valid", "invalid", "abstained", "failed", "unknown_source"), "repair": pick(9, "valid", "failed", "url"), "fallback": k % 8 < 3,
    }
    return t.select("session", "turn", policy.turn_outcome(known).alias("o")).select("session", "turn", "o.outcome", "o.reason", "o.source")


#: Words of the tables' languages by which whole turns are judged; SQL has the same.
TURN_WORDS = whole_turns.Words(["tion", "and", "de "], ["er"], {"troubleshoot": ["eren"], "compare": ["anre"]}, ["ste", "les"], ["the", "and", "of", "de"], ["the ", "is ", "of "], ["the", "and", "of", "de"])


def user_turns(spark, d) -> DataFrame:
    """User turns, a minute between conversations and ten seconds between turns; every third conversation begins with one of three common questions."""
    user = table(spark, d, "conversations").where("role = 'user'")
    common = F.element_at(F.array(F.lit("and the"), F.lit("that is for the"), F.lit("of this and of that")), (F.col("conv_id") % 7 % 3 + 1).cast("int"))
    text = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") < 2), common).otherwise(F.col("text"))
    return user.select(F.col("conv_id").alias("session"), "turn", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn") * 10).alias("ts"), text.alias("text"))


def item_evidence(spark, d):
    """Evidence of questions: the six benchmark items with most occurrences of their terms."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("content"))

    def found(queries: DataFrame) -> DataFrame:
        asked_terms = queries.select("query_id", T.search_terms(F.col("query")).alias("terms"))
        scores = retrieval.term_hits(asked_terms, items).withColumn("rerank_score", F.round(retrieval.TERM_WEIGHT * F.col("tf_hits"), 9))
        best = retrieval.ranked(scores, "rerank_score", retrieval.EVIDENCE).withColumnRenamed("rank", "place").join(items, "chunk_id")
        best = best.withColumn("terms", T.search_terms(F.col("content")))
        decided = retrieval.judge(queries, best, best.where("false"))
        size = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 4))
        chosen = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"].cast("string")).alias("chunks"), F.sum(size("content")).alias("used"))
        out = decided.join(queries, "query_id").join(chosen, "query_id", "left")
        return out.select("query_id", "sufficient", "reason", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"), F.array(F.lit("v1")).alias("versions"), (F.coalesce("used", F.lit(0)) + size("query")).cast("long").alias("tokens"))

    return found


#: What a model replies, by the number of the turn: the same expression in Spark and in DuckDB. top: the first chunk's id.
REPLY = """CASE {k} WHEN 5 THEN 'no json' WHEN 8 THEN NULL ELSE '{{"answer_markdown":"' || CASE {k} WHEN 7 THEN 'شاهد کافی' WHEN 9 THEN 'see https://x.example.com' ELSE 'Yes.' END
|| '","claims":[{{"text":"t","source_ids":["' || CASE {k} WHEN 6 THEN 'zz' ELSE top END || '"]}}],"outcome":"answered"}}' END"""


def replies_by_rule(asked_turns: DataFrame) -> DataFrame:
    k = asked_turns.withColumn("k", (F.col("session") * 31 + F.col("turn") * 7 + F.col("variant") * 13) % 101).withColumn("top", F.coalesce(F.get("chunks", F.lit(0)), F.lit("-")))
    return k.select("session", "turn", "variant", F.expr(REPLY.format(k="k % 10")).alias("first"), F.expr(REPLY.format(k="(k % 9 + 2)")).alias("repair"), F.expr("k % 8 < 3").alias("quotable"))


@query
def turn_pipeline(spark, d):
    """Whole conversations, turn after turn: scope, history, evidence, cache, answers and what they come to."""
    out = whole_turns.outcomes(user_turns(spark, d), item_evidence(spark, d), replies_by_rule, TURN_WORDS, ttl_seconds=14400, max_input_tokens=500)
    return out.select("session", "turn", "outcome", "reason", "source", "follow_up", F.col("failure_count").cast("long").alias("failure_count"), F.md5("query").alias("query_hash"))


@query
def request_checks(spark, d):
    t = table(spark, d, "conversations")
    k = F.col("conv_id") * 3 + F.col("turn")
    name = F.md5(F.col("text"))
    known = {
        "protocol_version": F.when(k % 17 == 0, "2").otherwise("1"), "session_id": F.when(k % 13 == 0, F.substring(name, 1, 12)).when(k % 19 == 0, F.concat(name, F.lit("!"))).otherwise(name), "message_id": F.when(k % 11 == 0, F.substring(name, 1, 7)).otherwise(F.substring(name, 1, 8)),
        "text": F.when(k % 23 == 0, "  ").otherwise(F.col("text")), "surface": F.when(k % 7 == 0, "mail").when(k % 2 == 0, "popup").otherwise("page"), "locale": F.when(k % 29 == 0, F.lit(None)).otherwise("fa-IR"),
    }
    return t.select("conv_id", "turn", policy.request_problem(known, 300).alias("problem"))


def _cases(spark, d):
    """Benchmark items as golden cases: URLs of the documents that hold the item, every fifth out of scope, and answers by rule."""
    url = lambda c: F.concat(F.lit(f"https://{HOST}/"), c.cast("string"))
    held = table(spark, d, "benchmark").join(table(spark, d, "documents"), "text").groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_set(url(F.col("doc_id")))).alias("expected_urls"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 5 != 4).alias("expected_in_scope")).join(held, "id", "left")
    cases = items.withColumn("expected_urls", F.when(F.col("expected_in_scope"), F.col("expected_urls"))).withColumn("expected_urls", F.coalesce("expected_urls", F.array().cast("array<string>")))
    outcome = F.when(~F.col("expected_in_scope"), "out_of_scope").when(F.col("id") % 7 == 3, "support").otherwise("answered")
    urls = F.when(F.col("id") % 6 == 1, F.concat(F.array(F.lit("https://other.example.com/")), "expected_urls")).when(F.col("id") % 11 == 2, F.slice("expected_urls", 2, 100)).otherwise(F.col("expected_urls"))
    return cases, cases.select("id", outcome.alias("outcome"), urls.alias("urls")).where("id % 13 <> 5")


@query
def release_report(spark, d):
    return evaluation.release_report(evaluation.case_results(*_cases(spark, d)))


@query
def dataset_verification(spark, d):
    cases, _ = _cases(spark, d)
    urls = table(spark, d, "documents").where("doc_id % 40 <> 0").select(F.concat(F.lit(f"https://{HOST}/"), F.col("doc_id").cast("string")).alias("canonical_url"))
    return evaluation.verified(cases, F.col("id") % 9 != 4, evaluation.canonical_urls(urls))


@query
def cache_lookups(spark, d):
    """Each user's events of a type: clicks write, all others look up, with an hour to live."""
    events = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("cache_key"), "ts", "event_type")
    out = answers.cache_hits(events.where("event_type <> 'click'"), events.where("event_type = 'click'").select("cache_key", "ts"), 86400)
    return out.select("event_id", "cache_status", "written")


@query
def cited_sources(spark, d):
    """Chunks that each document's answer cites, in order of citation."""
    docs = table(spark, d, "documents")
    cites = F.array((F.col("doc_id") * 7) % 150, (F.col("doc_id") * 3) % 150, F.col("doc_id") + 1_000_000)
    found = answers.cited_chunks(docs.select(F.col("doc_id").alias("answer_id"), F.array_distinct(cites).alias("source_ids")), docs.select(F.col("doc_id").alias("chunk_id"), "source"))
    return found.select("answer_id", F.col("place").cast("long").alias("place"), "chunk_id", "source")


@query
def usage_totals(spark, d):
    """Tokens of each request's calls; every third call is a repair of the one before."""
    calls = table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("request"), (F.col("event_id") % 3).alias("attempt"), F.length("props").cast("long").alias("input_tokens"), F.floor("value").alias("output_tokens"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 10).alias("cached_tokens"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).otherwise("").alias("provider"))
    return answers.total_usage(calls, "request")


@query
def reply_order(spark, d):
    """A provider's embeddings come in any order and are put into that of their index."""
    replies = table(spark, d, "events").select(F.floor(F.col("event_id") / 16).alias("batch"), ((F.col("event_id") * 5) % 16).alias("index"), "event_type")
    return answers.in_index_order(replies, "batch", "index", "event_type").select("batch", F.array_join("values", ",").alias("values"))


# Streams, read to the end of what there is


def _streamed(spark, d, plan) -> DataFrame:
    from siltbed.streaming import live

    events = live.event_stream(spark, f"{d}/events.parquet*", spark.read.parquet(f"{d}/events.parquet").schema, None)
    return live.replayed(plan(events), "complete")


def _stream_of(spark, d, name: str) -> DataFrame:
    from siltbed.streaming import live

    return live.event_stream(spark, f"{d}/{name}.parquet*", spark.read.parquet(f"{d}/{name}.parquet").schema, None)


def _run(rows: DataFrame, keys: list[str], order: list[str], machine) -> DataFrame:
    from siltbed.streaming import live

    return live.replayed(live.running(rows, keys, order, machine), "append")


@query
def stream_circuit(spark, d):
    return _run(_calls(_stream_of(spark, d, "events")), ["user_id"], BY_TIME, machines.circuit(3, 6 * 3600)).select("event_id", "user_id", "circuit")


@query
def stream_two_level_limit(spark, d):
    calls = _stream_of(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return _run(calls, ["user_id"], BY_TIME, machines.two_level_limit(1, 2)).select("event_id", "verdict", "retry_after")


@query
def stream_reservations(spark, d):
    return _run(_commands(_stream_of(spark, d, "events")), ["user_id", "message"], BY_TIME, machines.reservation(2 * 86400)).select("event_id", "command", "result")


@query
def stream_session_states(spark, d):
    out = _run(_session_commands(_stream_of(spark, d, "events")), ["user_id"], BY_TIME, machines.session(12 * 3600))
    return out.select("event_id", "command", "result", F.col("turns").cast("long").alias("turns"))


@query
def stream_answer_cache(spark, d):
    return _run(_cache_commands(_stream_of(spark, d, "events")), ["user_id"], BY_TIME, machines.answer_cache(86400)).select("event_id", "command", "cache_status", "written")


@query
def stream_compaction(spark, d):
    out = _run(_said(_stream_of(spark, d, "conversations")), ["session"], ["turn"], machines.compaction(4, 12, 120, 300))
    return out.select("session", "turn", F.col("kept").cast("long").alias("kept"), F.md5("summary").alias("summary_hash"))


@query
def stream_counters(spark, d):
    from siltbed.streaming import live

    return _streamed(spark, d, lambda e: live.counters(e, "event_type", value="value").select("event_type", "events"))


@query
def stream_rate_limit(spark, d):
    from siltbed.streaming import live

    out = _streamed(spark, d, lambda e: live.per_window(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "1 hour", None, 1))
    return out.select("user_id", F.unix_micros("start").alias("start"), "calls", "rejected")


@query
def stream_sessions(spark, d):
    from siltbed.streaming import live

    out = _streamed(spark, d, lambda e: live.sessions(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "7200 seconds", None))
    return out.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")
