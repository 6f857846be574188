"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges that a file of a round holds at least, on average; a small table is not dealt over as many files as a large one.
SHARE = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node long, root long): the smallest node reachable, for every node of `edges` (a long, b long).

    Alternates the large-star and small-star steps until the edges no longer
    change; after that every node points at the smallest of its component.
    Rounds grow with the logarithm of the longest path, each round keeps at
    most as many edges as it got, and so is written in as few files as that many
    fill. Minima are taken with map-side combining; the
    joins back to the edges are plain equi-joins, whose hot keys adaptive
    execution splits. Loops (a = b) and repeated edges are harmless, nulls are
    dropped, no edges give no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = checkpoint(now.dropna().filter("a <> b").distinct())
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        if not mark[0]:
            break
        now = checkpoint(_small_star(_large_star(now)).coalesce(-(-mark[0] // SHARE)))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
