"""URL filters: a dated block list becomes validity intervals, and an as-of join tests every capture at its fetch date.

A pattern is a host, a parent domain, or host/first-path-segment. Of the events of one pattern and
category the last one on or before a date decides: `add` lists, `remove` unlists; on one date a
removal wins. A capture meets every pattern that its URL has; the interval join is an equality join
on (pattern, salt) with a range condition. Patterns are counted over all captures first: one with more than
a share of 1/HOT_SHARE of them (and than `least` captures) is salted by as many numbers as it has such
shares, and only its list entries are repeated, once for each; all others have salt 0. There are no more than
HOT_SHARE times a URL's patterns of such patterns.

Defined cases: events with a null pattern, date or action are ignored; captures without a URL or a
fetch date match nothing and are returned unblocked; rows equal in page_id, url and fetched are one
capture; a null page_id is kept; empty tables give no rows, an empty list blocks nothing; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.llm.common import broadcast_if, cut

HOT_SHARE, LEAST = 4096, 2000
HOT_TO_BROADCAST = 200_000


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, listed, action) -> (pattern, category, since, until); until is null while listed."""
    events = entries.where("pattern is not null and listed is not null and action in ('add', 'remove')")
    daily = events.groupBy(F.lower("pattern").alias("pattern"), F.coalesce("category", F.lit("")).alias("category"), F.col("listed").alias("since")).agg(F.max("action").alias("action"))
    ordered = W.partitionBy("pattern", "category").orderBy("since")
    return daily.withColumn("until", F.lead("since").over(ordered)).where("action = 'add'").drop("action")


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def url_patterns(url: Column) -> Column:
    """array<string>: the host, its parents of two labels or more, and the host with the first path segment."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    known = F.when(path != "", F.concat(parents, F.array(F.concat(host, F.lit("/"), path)))).otherwise(parents)
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(known)).otherwise(F.array().cast("array<string>"))


def filter_urls(captures: DataFrame, entries: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, fetched, blocked, n_hits (active list entries) and categories (sorted, comma-joined)."""
    one = captures.select("page_id", "url", "fetched").distinct()
    listed = intervals(entries)
    keys = one.withColumn("pattern", F.explode_outer(url_patterns(F.col("url"))))
    counts = keys.where("pattern is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.join(listed.select("pattern").distinct(), "pattern", "left_semi"), "patterns")
    share = max(least, captures.count() // HOT_SHARE)
    hot = broadcast_if(counts.where(F.col("n") > share).select("pattern", F.ceil(F.col("n") / share).cast("int").alias("salts")), HOT_TO_BROADCAST)
    salts = F.coalesce("salts", F.lit(1))
    keys = keys.join(hot, "pattern", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched"), salts).cast("int")).drop("salts")
    listed = listed.join(hot, "pattern", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    active = (F.col("c.fetched") >= F.col("l.since")) & (F.col("l.until").isNull() | (F.col("c.fetched") < F.col("l.until")))
    met = keys.alias("c").join(listed.alias("l"), (F.col("c.pattern") == F.col("l.pattern")) & (F.col("c.salt") == F.col("l.salt")) & active, "left")
    hits = met.groupBy("c.page_id", "c.url", "c.fetched").agg(F.count("l.pattern").alias("n_hits"), F.array_sort(F.collect_set("l.category")).alias("found"))
    return hits.select("page_id", "url", "fetched", (F.col("n_hits") > 0).alias("blocked"), "n_hits", F.array_join("found", ",").alias("categories"))
