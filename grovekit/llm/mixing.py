"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded draw per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, own_prefix, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is repeated more often.
MOST = 3
SEED = "mix"


def text_size(text: Column) -> Column:
    """Number of words; null has none."""
    bare = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE + "+", " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def _ranged(rows: DataFrame, keys: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in `sums`, the sum of its values over all rows before in the order of `keys`.

    Rows are dealt by ranges, each of which adds up its own; the sums of the
    ranges before it come from a table of one row a range. No task sees all.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as another run might draw other ranges
    dealt = written(rows.repartitionByRange(n, *keys).withColumn("p", F.spark_partition_id()), "mix-ranges")
    w = Window.partitionBy("p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("p").agg(*[F.sum(v).alias(f"s_{k}") for k, v in sums.items()])
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = whole.select(F.col("p").alias("_p"), *[F.coalesce(F.sum(f"s_{k}").over(before), F.lit(0)).alias(f"s_{k}") for k in sums])
    own = dealt.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"o_{k}") for k, v in sums.items()])
    out = own.join(F.broadcast(starts), F.col("p") == F.col("_p"))
    return out.withColumns({k: F.col(f"s_{k}") + F.col(f"o_{k}") for k in sums}).drop("p", "_p", *[f"{x}_{k}" for x in "so" for k in sums])


def source_rates(docs: DataFrame, size: str, source: str = "source", weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target double): a row a source, null included.

    The sources share all sizes by weight; a target above `most` times its
    source's size stops there and the excess goes to the others by weight, until
    none is above. In order of the level at which each stops, that is where
    the words left, over the weights left, first are below that level: one
    cumulative sum over the table of sources.
    """
    sums = written(docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size).alias("source_size")), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    each = _ranged(sums, [F.col("source").isNull(), F.col("source")], {"at": F.lit(1)})
    each = each.withColumn("w", weight).drop("at").withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = [F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")]
    each = _ranged(each, order, {"stopped": F.col("cap"), "gone": F.col("w")})
    everything, weights_ = each.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("w"), F.lit(0.0))).first()  # two numbers
    told = each.withColumn("level", (F.lit(everything) - F.col("stopped")) / (F.lit(weights_) - F.col("gone")))
    found = told.filter(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct(order[0].alias("o"), "level")).alias("l")).first().l
    level = F.lit(float(found.level) if found else 0.0)
    return each.select("source", "source_size", F.least(F.col("w") * level, F.col("cap")).alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) with 52 bits, from a hash of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_counts(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] | None = None) -> DataFrame:
    """`docs`, or just the columns in `keep`, with a column `mix` of struct (size, source_size, target, copies).

    A document of a source with rate r = target / source_size is taken floor(r)
    times, and once more if the draw from its id is below the fraction of r.
    Null texts have size 0; a null source is one of its own, after all others;
    a source of size 0 has rate 0. Repeated rows draw alike, null ids draw
    as one; an empty table gives no rows; a column named `mix` is replaced,
    others stay, whatever their names.
    """
    m = own_prefix(docs.columns, "m")
    sized = docs.withColumn(f"{m}size", text_size(F.col(f"`{text_col}`"))).withColumn(f"{m}from", F.col(f"`{source_col}`")).withColumn(f"{m}draw", draw(F.col(f"`{id_col}`"), seed))
    if keep is not None:  # then texts are read once
        sized = written(sized.select(*[F.col(f"`{c}`") for c in keep], f"{m}size", f"{m}from", f"{m}draw"), "mix-sizes")
    rates = written(source_rates(sized.select(F.col(f"{m}from").alias("source"), F.col(f"{m}size").alias("size")), "size", weights=weights, most=most), "mix-rates")
    few, wide = rates.agg(F.count("*"), F.sum(F.octet_length("source"))).first()
    small = few <= 10_000 and (wide or 0) <= 8 << 20  # else the join shuffles
    rates = rates.select(F.col("source").alias(f"{m}source"), F.col("source_size").alias(f"{m}all"), F.col("target").alias(f"{m}target"))
    joined = sized.join(F.broadcast(rates) if small else rates, F.col(f"{m}from").eqNullSafe(F.col(f"{m}source")))
    rate = F.when(F.col(f"{m}all") > 0, F.col(f"{m}target") / F.col(f"{m}all")).otherwise(0.0)
    copies = F.floor(rate) + (F.col(f"{m}draw") < rate - F.floor(rate)).cast("long")
    mix = F.struct(F.col(f"{m}size").alias("size"), F.col(f"{m}all").alias("source_size"), F.col(f"{m}target").alias("target"), copies.cast("long").alias("copies"))
    return joined.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c != "mix"], mix.alias("mix"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, columns unchanged, one named `mix` too."""
    m = own_prefix(docs.columns, "c")
    renamed = docs.withColumnRenamed("mix", f"{m}mix")
    counted = mix_counts(renamed, **options)
    copies = F.when(F.col("mix.copies") > 0, F.sequence(F.lit(1), F.col("mix.copies").cast("int")))
    taken = counted.withColumn(f"{m}copy", F.explode(copies))
    return taken.select(*[F.col(f"{m}mix").alias(c) if c == "mix" else F.col(f"`{c}`") for c in docs.columns])
