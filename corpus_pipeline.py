"""From raw documents to packed sequences: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; docs must be read from files, as a stage's
output is once it is written. All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.llm.common import WORD, broadcast_if, cut, cut_at, documents, remove
from siltbed.llm.jaccard_join import IDS_TO_BROADCAST, link_texts, node, second_name, with_own_names
from siltbed.llm.line_dedup import dedup_rows
from siltbed.llm.packing import pack
from siltbed.llm.quality_classifier import accepted_rows
from siltbed.llm.queries import tokenizer_path
from siltbed.llm.source_mixing import mixed_rows


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of lines go; documents stay, even if nothing of their text is left."""
    return dedup_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id stays, null last; of rows equal in doc_id and text one.

    Texts that share a doc_id are rows of their own, and only what their texts link goes. Rows with a null doc_id and
    no words stay: nothing links them. Rows to be deleted are sent to the scan if they are few by count, else
    joined; texts are sorted only where rows are equal in doc_id and text.
    """
    summary, linked, again_named = link_texts(docs)
    named = cut(linked.join(summary.select(F.col("doc").alias("node"), "doc_id").distinct(), "node"), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first")
    best = named.groupBy("component").agg(first).select(F.col("first.node").alias("node"))
    gone = cut(named.select("node").join(best, "node", "left_anti").distinct().withColumn("gone", F.lit(True)), "gone")
    again = cut(summary.groupBy(F.col("doc").alias("node")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("node", F.lit(True).alias("again")), "again")
    loose = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    d = docs.select(F.struct(*docs.columns).alias("row"), node().alias("doc"), second_name().alias("second"), loose.alias("loose"))
    d = with_own_names(d, again_named).withColumnRenamed("doc", "node")
    kept = d.join(broadcast_if(gone, IDS_TO_BROADCAST), "node", "left").where("loose or gone is null")
    if again.isEmpty():
        return kept.select("row.*")
    marked = kept.join(broadcast_if(again, IDS_TO_BROADCAST), "node", "left")
    one = marked.where("again and not loose").withColumn("k", F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("row")))).where("k = 1")
    return marked.where("again is null or loose").select("row.*").union(one.select("row.*"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 2 times), interleaved within output shards.

    A null text or source is no reason to go: texts without words stay once, a null source is a source of its own. Rows
    equal in doc_id, text and source are taken alike.
    """
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; a null text is the end id alone, repeated rows are packed each."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("source mixing", source_mixing),
    ("packing", packing),
]

#: Tokenizer ids and hashed choices are not SQL: tests compare each stage with a plain definition instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's output is removed once the next one's is written."""
    docs, path = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, now = cut_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if path:
            remove(spark, path)
        path = now
    return STAGES[-1][1](spark, docs, sf_dir)
