"""Retrieval quality against expected documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reciprocal_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results: query_id, chunk_id, rank. expected: query_id, chunk_id. One row for each query with expectations."""
    wanted = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    found = results.join(expected, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("found"))
    met = wanted.join(found, "query_id", "left")
    return met.select("query_id", "expected", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce(F.round(1.0 / F.col("best"), 9), F.lit(0.0)).alias("reciprocal_rank"))


def summary(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg((F.col("found") > 0).cast("double")), 9).alias("recall"), F.round(F.avg("reciprocal_rank"), 9).alias("mrr"))


def gate(totals: DataFrame, recall: float = 0.9, mrr: float = 0.75) -> DataFrame:
    return totals.withColumn("passed", (F.col("recall") >= recall) & (F.col("mrr") >= mrr))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """A golden set of JSON lines: id, query, expected_in_scope, expected_urls."""
    return spark.read.schema("id string, query string, expected_in_scope boolean, expected_urls array<string>").json(path).where("id is not null")


def canonical_urls(parsed: DataFrame) -> DataFrame:
    return parsed.where("canonical_url is not null").select(F.col("canonical_url").alias("url")).distinct()


def verified(cases: DataFrame, in_scope: Column, urls: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: cases, scope_accuracy, missing (expected URLs that the corpus has not) and passed."""
    accuracy = cases.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg((in_scope == F.col("expected_in_scope")).cast("double")), 9).alias("scope_accuracy"))
    missing = cases.select(F.explode("expected_urls").alias("url")).join(urls, "url", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return accuracy.withColumn("missing", missing.scalar()).withColumn("passed", F.coalesce((F.col("scope_accuracy") >= least) & (F.col("missing") == 0), F.lit(False)))


def case_results(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases: id, expected_in_scope, expected_urls; answers: id, outcome, urls (in order). Adds passed and reciprocal_rank."""
    met = cases.join(answers, "id", "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>"))).withColumn("outcome", F.coalesce("outcome", F.lit("missing")))
    passed = (
        F.when(~F.col("expected_in_scope"), (F.col("outcome") == "out_of_scope") & (F.size("urls") == 0))
        .when(F.size("expected_urls") > 0, (F.col("outcome") == "answered") & (F.size(F.array_except("expected_urls", "urls")) == 0))
        .otherwise(F.col("outcome").isin("clarification", "support", "answered"))
    )
    places = F.filter(F.transform("expected_urls", lambda u: F.array_position("urls", u)), lambda k: k > 0)
    return met.withColumn("passed", passed).withColumn("reciprocal_rank", F.coalesce(F.round(1.0 / F.array_min(places), 9), F.lit(0.0)))


def release_report(results: DataFrame, pass_rate: float = 0.9, recall: float = 0.9, mrr: float = 0.75) -> DataFrame:
    """One row: cases, pass_rate, source_recall and mrr (1 without cases that expect URLs), and whether the release passes."""
    with_urls = F.size("expected_urls") > 0
    share = lambda c, where: F.round(F.coalesce(F.avg(F.when(where, c.cast("double"))), F.lit(1.0)), 9)
    out = results.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("passed").cast("double")), 9).alias("pass_rate"), share(F.col("passed"), with_urls).alias("source_recall"), share(F.col("reciprocal_rank"), with_urls).alias("mrr"))
    return out.withColumn("released", (F.col("pass_rate") >= pass_rate) & (F.col("source_recall") >= recall) & (F.col("mrr") >= mrr))


def json_report(report: Column, **values: Column) -> Column:
    """A report as JSON, with further values set into it by name; a value of a name that the report has replaces it."""
    text = F.to_json(report)
    entries = F.from_json(text, "map<string,string>")
    more = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value.cast("string"))])
    return F.to_json(F.map_concat(F.map_filter(entries, lambda k, _: ~k.isin(*values)), more))
