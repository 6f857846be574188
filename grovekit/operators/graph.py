"""Reachability over edge tables (src, dst), and what the store derives from it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that lost executors cost no restart."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="grovekit-")  # all runs in one process
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Kept in partitions by these columns, which joins on them find as they are."""
    return kept(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by))


#: Rounds after which what is known is put together, and edges followed in a row in each round.
TOGETHER, HOPS = 8, 4


def closure(starts: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, node): every node reachable from the starts (key, node) of each key, themselves included.

    Semi-naive: each round follows up to HOPS edges from the newest nodes and drops
    what is known; rounds are the longest shortest path over HOPS. Edges are read
    and dealt once, by their source; what is known stays dealt by key and node, so
    a round shuffles no more than its new nodes. Nulls are no nodes; repeated rows
    count once; no starts give no rows. A limit raises, it never cuts.
    """
    front = _dealt(starts.select("key", "node").dropna().distinct(), "key", "node")
    links = _dealt(edges.select(F.col("src").alias("node"), F.col("dst").alias("_dst")).dropna().distinct(), "node")
    known, total = [front], front.count()
    while True:
        if limit is not None and total > limit:
            raise ValueError(f"more than {limit} nodes are reachable")
        steps = []
        for hop in range(1, HOPS + 1):
            front = front.join(links, "node").select("key", F.col("_dst").alias("node")).distinct()
            steps.append(front.withColumn("hop", F.lit(hop)))
        found = _all_of(steps).groupBy("key", "node").agg(F.min("hop").alias("hop"))
        for seen in known:
            found = found.join(seen, ["key", "node"], "left_anti")
        found = _dealt(found, "key", "node")
        fresh, ends = found.agg(F.count("*"), F.count_if(F.col("hop") == HOPS)).first()
        if fresh:
            known, total = [*known, found.select("key", "node")], total + fresh
        if not ends:
            if limit is not None and total > limit:
                raise ValueError(f"more than {limit} nodes are reachable")
            break
        front = found.filter(F.col("hop") == HOPS).select("key", "node")  # the others' edges are followed
        if len(known) > TOGETHER:
            known = [_dealt(_all_of(known), "key", "node")]
    return _all_of(known)


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Edges that reach() walks in the driver, at most, and the most edges into a node that it takes for part of a chain.
FEW, NARROW = 1 << 17, 64


def _sorted(df: DataFrame, by: str) -> DataFrame:
    """As _dealt() and sorted, so that joins on this column need no sort either."""
    return kept(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).sortWithinPartitions(by))


def links(edges: DataFrame) -> DataFrame:
    """(src, dst) of edges as reach() joins them: in partitions by src and sorted by it."""
    return _sorted(edges.select("src", "dst").dropna().filter("src <> dst"), "src")


def reach(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(node): every node that the starts (node) reach by links() of edges, themselves included.

    As closure() of one key, for deep graphs: each node points to one next node, the
    one of fewest edges into it, and pointers are doubled, so a chain takes rounds by
    the logarithm of its length. What was found then follows all its edges once, and
    what is left is a graph of unknown nodes only, down to FEW edges that the driver
    walks. Passes are the most edges beside the pointers on a path, not its length.
    """
    front, known = _dealt(starts.select("node").dropna().distinct(), "node"), []
    while True:
        few = links.count() <= FEW
        found = _walked(front, links) if few else _along(front, links)
        known.append(found)
        if few:
            return _all_of(known)
        here = found.withColumnRenamed("node", "src")
        beside = links.join(here, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        for part in known[:-1]:
            beside = beside.join(part, "node", "left_anti")
        front = _dealt(beside, "node")
        if front.isEmpty():
            return _all_of(known)
        rest = links.join(here, "src", "left_anti").join(found.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        links = _sorted(rest, "src")


def _along(front: DataFrame, links: DataFrame) -> DataFrame:
    """(node): the front and what follows it by pointers alone, to the end of each chain."""
    into = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") <= NARROW)
    inner = into.join(links.select(F.col("src").alias("node")), "node", "left_semi")
    best = links.join(inner.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min(F.struct("n", "dst")).alias("best"))
    jump = _sorted(best.select(F.col("src").alias("node"), F.col("best.dst").alias("_to")), "node")
    found, total = front, front.count()
    while True:
        # after k doublings all that is less than 2^k steps away is found; if nothing is new, nothing lies beyond
        more = found.join(jump, "node").select(F.col("_to").alias("node"))
        found = _sorted(found.unionByName(more).distinct(), "node")
        if (now := found.count()) == total:
            return found
        total = now
        far = jump.select("node", F.col("_to").alias("_mid")).join(jump.withColumnRenamed("node", "_mid"), "_mid").select("node", "_to")
        jump = _sorted(far, "node")


def _walked(front: DataFrame, links: DataFrame) -> DataFrame:
    """(node): the front and all that it reaches, by FEW links."""
    after: dict[object, list[object]] = {}
    for src, dst in links.collect():
        after.setdefault(src, []).append(dst)
    # only starts that have links go to the driver
    todo = [r.node for r in front.join(links.select(F.col("src").alias("node")), "node", "left_semi").collect()]
    seen = set(todo)
    while todo:
        for node in after.get(todo.pop(), ()):
            if node not in seen:
                seen.add(node)
                todo.append(node)
    new = front.sparkSession.createDataFrame([(n,) for n in seen], front.schema)
    return kept(front.unionByName(new).distinct())


def merge_bases(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair, base): best common ancestors of the heads of each pair (pair, a, b).

    Common ancestors that no other common ancestor properly reaches; what the
    parents of common nodes reach is found by one closure, not one a node.
    """
    key = lambda side: F.struct("pair", F.lit(side).alias("side"))
    both = closure(pairs.select(key("a").alias("key"), F.col("a").alias("node")).union(pairs.select(key("b").alias("key"), F.col("b").alias("node"))), edges)
    side = lambda s: both.filter(F.col("key.side") == s).select(F.col("key.pair").alias("pair"), "node")
    common = kept(side("a").join(side("b"), ["pair", "node"], "left_semi"))
    above = common.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("pair").alias("key"), F.col("dst").alias("node"))
    dominated = closure(above, edges).withColumnRenamed("key", "pair")
    return common.join(dominated, ["pair", "node"], "left_anti").withColumnRenamed("node", "base")


def contribution_union(pairs: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(pair, fact): the set union of the facts (node, fact) that either head of a pair reaches."""
    starts = pairs.select(F.col("pair").alias("key"), F.explode(F.array("a", "b")).alias("node"))
    return closure(starts, edges).join(facts, "node").select(F.col("key").alias("pair"), "fact").distinct()


def type_audit(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(src, dst, expected, actual, code): edges (src, dst, expected) to objects (node, kind) that are missing or of another type; expected "any" fits all."""
    rows = edges.join(objects.select(F.col("node").alias("dst"), F.col("kind").alias("actual")), "dst", "left")
    code = F.when(F.col("actual").isNull(), "OBJECT_READ").when((F.col("expected") != "any") & (F.col("expected") != F.col("actual")), "TYPE_MISMATCH")
    return rows.withColumn("code", code).filter("code is not null").select("src", "dst", "expected", "actual", "code")


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the closure of all roots (node)."""
    return closure(roots.select(F.lit(0).alias("key"), "node"), edges).select("node")


def gc_state(objects: DataFrame, roots: DataFrame, edges: DataFrame, floor: int) -> DataFrame:
    """Objects (node, size, age) with `state`: live, collectable (age at least `floor`) or young."""
    live = reachable(roots, edges).withColumn("live", F.lit(True))
    state = F.when(F.col("live"), "live").when(F.col("age") >= floor, "collectable").otherwise("young")
    return objects.join(live, "node", "left").withColumn("state", state).drop("live")


def gc_report(state: DataFrame) -> DataFrame:
    """One row of counts and bytes by state."""
    aggs = []
    for name in ("live", "collectable", "young"):
        hit = F.col("state") == name
        aggs += [F.count_if(hit).alias(f"{name}_objects"), F.coalesce(F.sum(F.when(hit, F.col("size"))), F.lit(0)).cast("long").alias(f"{name}_bytes")]
    return state.agg(F.count("*").alias("scanned_objects"), *aggs)


def gc_sample(state: DataFrame, most: int = 256) -> DataFrame:
    """The smallest collectable ids, and whether there are more."""
    found = state.filter("state = 'collectable'").select("node").orderBy("node").limit(most + 1)
    rank = found.select("node", F.count("*").over(_all()).alias("n"), F.row_number().over(_all().orderBy("node")).alias("at"))
    return rank.filter(F.col("at") <= most).select("node", (F.col("n") > most).alias("truncated"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # of a bounded sample


def gc_doomed(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): collectable objects that no spared object reaches."""
    spared = reachable(state.filter("state = 'young'").select("node"), edges)
    return state.filter("state = 'collectable'").select("node").join(spared, "node", "left_anti")


def provenance_check(closure_: DataFrame, manifest: DataFrame) -> DataFrame:
    """(node, finding): a manifest (node, label) against the closure (node, agent): missing, extra, or another label than a known agent."""
    rows = closure_.select("node", F.lit(True).alias("c"), "agent").join(manifest.select("node", F.lit(True).alias("m"), "label"), "node", "full_outer")
    finding = F.when(F.col("m").isNull(), "missing").when(F.col("c").isNull(), "extra").when(F.col("agent").isNotNull() & ~F.col("agent").eqNullSafe(F.col("label")), "mismatch")
    return rows.select("node", finding.alias("finding")).filter("finding is not null")
