"""Counters, their text exposition, and latency quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counters(events: DataFrame, name: Column, labels: dict[str, Column], value: Column) -> DataFrame:
    """Sum of value by name and labels (sorted by key)."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in sorted(labels.items())])
    return events.select(name.alias("name"), entries.alias("labels"), value.alias("value")).groupBy("name", "labels").agg(F.sum("value").alias("value"))


def general(value: Column) -> Column:
    """A number as %g prints it: six significant digits, no trailing zeros, an exponent beyond 1e-5 and 1e6."""
    shown = F.format_string("%.5e", value)
    exponent = F.regexp_extract(shown, "e(.*)$", 1).cast("int")
    bare = lambda x: F.regexp_replace(x, r"(\.\d*?)0+$", "$1")
    clean = lambda x: F.regexp_replace(bare(x), r"\.$", "")
    fixed = F.when(exponent == 5, F.format_string("%.0f", value))
    for e in range(-4, 5):
        fixed = fixed.when(exponent == e, clean(F.format_string(f"%.{5 - e}f", value)))
    return F.when(value == 0, "0").otherwise(F.coalesce(fixed, F.concat(clean(F.regexp_extract(shown, "^(.*)e", 1)), F.regexp_extract(shown, "e.*$", 0))))


def exposition(totals: DataFrame) -> DataFrame:
    """Lines in order: a TYPE line before a name's first counter. Of counters, not of events: few rows."""
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    text = F.array_join(F.transform("labels", lambda x: F.concat(x["k"], F.lit('="'), escape(x["v"]), F.lit('"'))), ",")
    line = F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), text, F.lit("}"))).otherwise(""), F.lit(" "), general(F.col("value").cast("double")))
    lines = totals.select("name", text.alias("labels"), line.alias("line"))
    first = F.row_number().over(W.partitionBy("name").orderBy("labels")) == 1
    both = lines.withColumn("lines", F.when(first, F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit("# TYPE "), "name", F.lit(" counter")).alias("line")), F.struct(F.lit(1).alias("k"), F.col("line")))).otherwise(F.array(F.struct(F.lit(1).alias("k"), F.col("line")))))
    return both.select("name", "labels", F.explode("lines").alias("x")).select("name", "labels", F.col("x.k").alias("part"), F.col("x.line").alias("line"))


def quantile_by_index(values: DataFrame, group: str, value: str, q: float = 0.95) -> DataFrame:
    """Element floor(n * q) of the sorted values (counted from 1, at least the first): not interpolated.

    Equal values are counted first, then placed by running counts.
    """
    counts = values.groupBy(group, value).count()
    of_group = W.partitionBy(group)
    upto = counts.select(group, value, F.sum("count").over(of_group.orderBy(value)).alias("upto"), F.sum("count").over(of_group).alias("n"))
    wanted = F.greatest(F.lit(1), F.floor(F.col("n") * q))
    return upto.where(F.col("upto") >= wanted).groupBy(group).agg(F.min(value).alias("quantile"), F.max("n").alias("n"))
