"""Nearest-rank statistics without a task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept


def ranked(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, before, c, n): each different value with its count, the number of smaller ones in its group, and the group's size.

    Equal values are counted before anything is dealt, then rows are dealt by
    ranges of (group, value); a range adds up its own, and the sums of the ranges
    before it are added. So neither a group as large as all rows nor one value
    on most of them is a burden. Null values take no part; a null group is one.
    """
    counts = df.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
    # kept, as another run might draw other ranges
    dealt = kept(counts.repartitionByRange(F.col("g"), F.col("v")).withColumn("p", F.spark_partition_id()))
    sizes = dealt.groupBy("g", "p").agg(F.sum("c").alias("s"))
    w = Window.partitionBy("g").orderBy("p")  # a row a range
    starts = sizes.select(F.col("g").alias("_g"), F.col("p").alias("_p"), (F.sum("s").over(w) - F.col("s")).alias("start"), F.sum("s").over(Window.partitionBy("g")).alias("n"))
    here = dealt.withColumn("i", F.sum("c").over(Window.partitionBy("g", "p").orderBy("v")) - F.col("c"))
    both = here.join(starts, F.col("g").eqNullSafe(F.col("_g")) & (F.col("p") == F.col("_p")))
    return both.select(F.col("g").alias(group), F.col("v").alias(value), (F.col("start") + F.col("i")).alias("before"), "c", "n")


def _at(index, value: str):
    """The value at that index, from 0, of its group."""
    return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("c")), F.col(value)))


def percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, sum, p50, p95, p99 and max of each group: the value at index round((n - 1) * p), halves away from zero.

    A group without values has zeros.
    """
    rows = ranked(df, group, value)
    at = lambda p: _at(F.round((F.col("n") - 1) * F.lit(p)).cast("long"), value)
    told = rows.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col(value) * F.col("c")).alias("sum"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(value).alias("max"))
    every = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_rows")).drop("_rows")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(told.schema[c].dataType)).alias(c)
    return every.join(told, F.col("_g").eqNullSafe(F.col(group)), "left").select(F.col("_g").alias(group), *[zero(c) for c in ("n", "sum", "p50", "p95", "p99", "max")])


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """The upper median, at index n / 2, and the lower one, of each group with a value."""
    rows = ranked(df, group, value)
    at = lambda i: _at(i, value)
    return rows.groupBy(group).agg(at(F.floor(F.col("n") / 2)).alias("upper_median"), at(F.floor((F.col("n") - 1) / 2)).alias("median_low"))


def shares(df: DataFrame, group: str) -> DataFrame:
    """(group, n, share): rows of each group, and their share of all in per cent to one decimal, as text."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n")).first()[0] or 0
    tenths = F.expr("(n * 1000 + whole div 2) div whole")
    return counts.withColumn("whole", F.lit(whole).cast("long")).select(group, "n", F.when(F.col("whole") == 0, "n/a").otherwise(F.concat(F.expr("((n * 1000 + whole div 2) div whole) div 10"), F.lit("."), tenths % 10)).alias("share"))


def saturating_delta(after, before):
    return F.greatest(after - before, F.lit(0))


def throughput(n, seconds):
    return F.when(seconds == 0, 0.0).otherwise(n / seconds)
