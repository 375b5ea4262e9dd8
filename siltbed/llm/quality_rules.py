"""Quality rules: text counts, and the log-likelihood ratio of hashed n-grams between trusted and raw text. DataFrame functions only.

Tokens are runs of letters and digits or runs of other visible characters. Unigrams and bigrams are
hashed into BUCKETS buckets; the target multinomial counts the documents that labels call trusted
(quality 1, not toxic), the raw one all documents. A document's score is the mean over its n-grams of
log(p_target / p_raw), so its length does not count; it is kept if the score is not below a fixed
threshold. The ratios form one array of BUCKETS numbers, whatever the input, which every task reads. Texts
are read twice, for the counts and for the scores, and do not move; only with more than IDS_TO_BROADCAST
trusted documents, by count, are they joined with these.

Defined cases: a null text has no words; documents without n-grams score 0; without any trusted text all
ratios are 0; labels with null or repeated ids count once, as trusted if any row says so; a null doc_id
is kept and never trusted; repeated rows give repeated results; empty tables give no rows; other columns
are ignored, or returned in the struct `row` if named in keep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.llm.common import WORD, broadcast_if, words

BUCKETS = 1 << 16
IDS_TO_BROADCAST = 2_000_000
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SMOOTHING = 0.5


def hashed_ngrams(df: DataFrame) -> DataFrame:
    """Adds ngrams: the bucket of every token and of every two consecutive tokens of text."""
    df = df.withColumn("tokens", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)))
    one = F.transform("tokens", lambda t: F.xxhash64(t).bitwiseAND(BUCKETS - 1).cast("int"))
    pair = lambda t, i: F.xxhash64(t, F.get("tokens", i + 1)).bitwiseAND(BUCKETS - 1).cast("int")
    two = F.transform(F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(0))), pair)
    return df.withColumn("ngrams", F.concat(one, two)).drop("tokens")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, one column: array of log(p_target / p_raw) by bucket."""
    ids = broadcast_if(trusted_ids(labels).select(F.col("doc_id").alias("id"), F.lit(1).alias("trusted")), IDS_TO_BROADCAST)
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))  # rows without doc_id are spread by their text
    marked = docs.select("text", own.alias("id"), F.col("doc_id").isNotNull().cast("int").alias("has_id")).join(ids, "id", "left")
    marked = marked.select("text", F.coalesce(F.col("trusted") * F.col("has_id"), F.lit(0)).alias("trusted"))
    # explode_outer: the filter that Spark infers from explode would hash every text once more below the join
    seen = hashed_ngrams(marked).select("trusted", F.explode_outer("ngrams").alias("bucket"))
    counts = seen.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counts = counts.select("*", F.sum("raw").over(everything).alias("n_raw"), F.sum("target").over(everything).alias("n_target"))
    share = lambda n, total: F.log((F.col(n) + SMOOTHING) / (F.col(total) + SMOOTHING * BUCKETS))
    known = counts.select("bucket", F.when(F.col("n_target") > 0, share("target", "n_target") - share("raw", "n_raw")).otherwise(0.0).alias("ratio"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(known, "bucket", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("ratio", F.lit(0.0)).alias("ratio")))), lambda x: x["ratio"]).alias("ratios"))


def with_repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words that lie in a three-word window found twice or more. df has the words, w.

    Windows are named by 64-bit hashes. Texts without an equal pair are told apart first; in the others,
    windows are sorted with their places, so that equal ones are neighbours.
    """
    window = lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2))
    df = df.withColumn("windows", F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), window))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    equal = F.zip_with("sorted", F.slice("sorted", F.lit(2), F.size("sorted")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    df = df.withColumn("starts", F.array_distinct(F.flatten(F.array_compact(equal))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(p, p + 1, p + 2)))))
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("starts").isNotNull(), covered), F.lit(0)).cast("long")).drop("windows", "sorted", "starts")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = -0.8, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each document: doc_id, n_words, the base counts, base_failed, score and kept.

    base_failed: fewer than 50 words, or more than half of them repeated. threshold is in nats an n-gram.
    """
    d = docs.select("doc_id", "text", *([F.struct(*keep).alias("row")] if keep else [])).withColumn("w", words(F.col("text")))
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = with_repeated_words(d).withColumn("lines", lines).withColumn("n_words", F.size("w").cast("long"))
    d = d.select(
        "*",
        F.aggregate("w", F.lit(0), lambda s, x: s + F.length(x)).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ).drop("w", "lines")
    d = hashed_ngrams(d).withColumn("ratios", log_ratios(docs, labels).scalar())
    total = F.aggregate("ngrams", F.lit(0.0), lambda s, b: s + F.get("ratios", b))
    d = d.withColumn("score", F.when(F.size("ngrams") > 0, total / F.size("ngrams")).otherwise(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score", *(["row"] if keep else []))
