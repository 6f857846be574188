"""Tree differences, exact renames and three-way merge over tables of entries (path, kind, id, exec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from .graph import kept


def _aligned(**sides: DataFrame) -> DataFrame:
    """One row a path with a struct (kind, id, exec) for each side, null if it has none; one shuffle."""
    every = None
    for name, df in sides.items():
        one = df.select("path", F.lit(name).alias("side"), F.struct("kind", "id", "exec").alias("e"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("path").agg(*[F.max(F.when(F.col("side") == n, F.col("e"))).alias(n) for n in sides])


def _same(a: str, b: str) -> Column:
    return F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) == F.col(b))


def _visible(rows: DataFrame) -> DataFrame:
    """Rows whose proper ancestors are all descended into; needs a boolean column `descend`.

    Rows meet only the directories that stop a descent, through their ancestors.
    """
    rows = kept(rows)
    stops = rows.filter(~F.col("descend")).select(F.col("path").alias("stop"))
    hidden = rows.select("path", F.explode(ancestors(F.col("path"))).alias("stop")).join(stops, "stop", "left_semi").select("path").distinct()
    return rows.join(hidden, "path", "left_anti")


def _pair(base: DataFrame, side: DataFrame) -> DataFrame:
    rows = _aligned(a=base, b=side)
    trees = (F.col("a.kind") == "tree") & (F.col("b.kind") == "tree")
    return _visible(rows.withColumn("descend", F.coalesce(trees & (F.col("a.id") != F.col("b.id")), F.lit(False)))).filter("path <> ''")


def changed_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths whose entry differs, whole subtrees as one."""
    rows = _pair(left, right)
    return rows.filter(~_same("a", "b") & ~F.col("descend")).select("path")


def frontier(base: DataFrame, side: DataFrame) -> DataFrame:
    """(path, change, kind, id, exec): entries deleted or added, whole subtrees as one; replaced ones are neither."""
    rows = _pair(base, side)
    change = F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added")
    return rows.withColumn("change", change).filter("change is not null").select("path", "change", F.coalesce("a", "b").alias("e")).select("path", "change", "e.*")


def exact_renames(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(source, destination): deleted entries whose identity is once in the base and once among the added."""
    identity = ["kind", "id", "exec"]
    deleted = changes.filter("change = 'deleted'").select(F.col("path").alias("source"), *identity)
    added = changes.filter("change = 'added'").groupBy(*identity).agg(F.count("*").alias("n"), F.first("path").alias("destination")).filter("n = 1").drop("n")
    wanted = deleted.join(added, identity)
    once = base.filter("path <> ''").join(wanted.select(*identity).distinct(), identity, "left_semi").groupBy(*identity).count().filter("count = 1")
    return wanted.join(once, identity, "left_semi").select("source", "destination")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, outcome, kind, id, exec, a, b, base): each deciding entry of the merge.

    outcome: same, ours, theirs, dropped or conflict; kind, id and exec are of the
    entry kept, null if none is. For conflicts a, b and base are the ids of the
    sides. A conflict stands at the shallowest path that decides it.
    """
    rows = _aligned(a=ours, b=theirs, g=base)
    trees = (F.col("a.kind") == "tree") & (F.col("b.kind") == "tree")
    descend = trees & ~_same("a", "b") & ~_same("g", "a") & ~_same("g", "b")
    rows = _visible(rows.withColumn("descend", F.coalesce(descend, F.lit(False)))).filter("not descend and (a is not null or b is not null)")
    a, b, g = (F.col(c) for c in "abg")
    outcome = (
        F.when(b.isNull(), F.when(_same("g", "a"), "dropped").when(g.isNull(), "ours").otherwise("conflict"))
        .when(a.isNull(), F.when(_same("g", "b"), "dropped").when(g.isNull(), "theirs").otherwise("conflict"))
        .when(_same("a", "b"), "same")
        .when(_same("g", "a"), "theirs")
        .when(_same("g", "b"), "ours")
        .otherwise("conflict")
    )
    kept = F.when(outcome.isin("same", "ours"), a).when(outcome == "theirs", b).when((outcome == "conflict") & b.isNotNull(), a)
    clash = lambda c: F.when(outcome == "conflict", c["id"])
    return rows.select("path", outcome.alias("outcome"), kept.alias("k"), clash(a).alias("a"), clash(b).alias("b"), clash(g).alias("base")).select("path", "outcome", "k.kind", "k.id", "k.exec", "a", "b", "base")


def rename_conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, a, b, base): sources deleted on both sides and renamed on one, or to different places.

    Only where the three trees differ from one another.
    """
    roots = _aligned(a=ours, b=theirs, g=base).filter("path = ''").filter("a <> b and a <> g and b <> g")
    differ = not roots.isEmpty()
    left, right = frontier(base, ours), frontier(base, theirs)
    gone = left.filter("change = 'deleted'").select("path", "id").join(right.filter("change = 'deleted'").select("path"), "path", "left_semi")
    to = lambda x, n: exact_renames(base, x).toDF("path", n)
    rows = gone.join(to(left, "x"), "path", "left").join(to(right, "y"), "path", "left")
    rows = rows.filter(F.lit(differ)).filter("(x is not null or y is not null) and not coalesce(x = y, false)")
    none = F.lit(None).cast("string")
    return rows.select("path", none.alias("a"), none.alias("b"), F.col("id").alias("base"))


def conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, a, b, base) of all conflicts of the merge, renames among them."""
    direct = three_way(base, ours, theirs).filter("outcome = 'conflict'").select("path", "a", "b", "base")
    return direct.unionByName(rename_conflicts(base, ours, theirs))


def in_scope(paths: DataFrame, clashes: DataFrame) -> DataFrame:
    """(path, in_scope): whether a path is, or lies under, a conflict path."""
    up = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("at"))
    hit = up.join(clashes.select(F.col("path").alias("at")).distinct(), "at", "left_semi").select("path").distinct().withColumn("in_scope", F.lit(True))
    return paths.select("path").join(hit, "path", "left").select("path", F.coalesce("in_scope", F.lit(False)).alias("in_scope"))
