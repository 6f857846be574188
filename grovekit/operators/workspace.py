"""Proposals over references and sessions, judged in batches; one writer would apply what they come to.

Nulls: a null name, namespace or mount matches nothing. Repeated proposals are
judged one by one, in order of `seq`, which must be unique. Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import agent_name, is_fork, ref_kind, valid_ref
from ..functions.paths import ancestors
from .graph import closure, kept


def _judged(proposals: DataFrame, refs: DataFrame, retired: DataFrame) -> DataFrame:
    """Proposals with their reference's head and, where rules refuse them, the outcome."""
    now = refs.select("ref", "head", F.col("kind").alias("_kind"), "protected", "sealed", F.lit(True).alias("_is"))
    rows = proposals.join(now, "ref", "left").join(retired.select(F.col("name").alias("ref"), F.lit(True).alias("_gone")).distinct(), "ref", "left")
    there, ref = F.coalesce("_is", F.lit(False)), F.col("ref")
    refused = (
        F.when(~valid_ref(ref) | F.coalesce(ref_kind(ref) != F.col("kind"), F.lit(False)), "invalid")
        .when(F.startswith(ref, F.lit("tags/")), "denied")
        .when(~there & F.coalesce("_gone", F.lit(False)), "retired")
        .when(there & (F.col("_kind") != F.col("kind")), "invalid")
        .when(there & F.col("sealed"), "sealed")
        .when(there & F.col("protected") & ~F.col("allowed"), "denied")
    )
    return rows.withColumn("_there", there).withColumn("_refused", refused)


def cas_chain(proposals: DataFrame, refs: DataFrame, retired: DataFrame) -> DataFrame:
    """(seq, ref, outcome, at): proposals (seq, ref, agent, kind, expected, new, allowed) one after another.

    refs are (ref, head, kind, protected, sealed), retired (name). The first to
    expect the head is taken, then the first after it to expect what it wrote, and
    so on: a chain of next proposals, found by value and followed like edges, so
    that no task goes through one reference by itself. A reference that isn't there
    is made by the first, whatever it expects. Others become forks, or are refused:
    invalid, denied, retired or sealed.
    """
    rows = kept(_judged(proposals, refs, retired))
    fit = rows.filter("_refused is null")
    made = fit.filter("not _there").groupBy("ref").agg(F.min(F.struct("seq", "kind")).alias("f")).select("ref", F.col("f.seq").alias("start"), F.col("f.kind").alias("made"))
    met = fit.filter(F.col("_there") & (F.col("expected") == F.col("head"))).groupBy("ref").agg(F.min("seq").alias("start"))
    told = fit.join(made.select("ref", "made"), "ref", "left").filter(F.col("_there") | (F.col("made") == F.col("kind")))
    asks = told.filter("expected is not null").select("ref", F.col("expected").alias("value"), "seq", F.lit(None).cast("long").alias("wrote"), F.col("seq").cast("long").alias("asked"))
    writes = told.select("ref", F.col("new").alias("value"), "seq", F.col("seq").cast("long").alias("wrote"), F.lit(None).cast("long").alias("asked"))
    # what nobody writes, as the head that all expect at first, meets nothing
    asks = asks.join(writes.select("ref", "value").distinct(), ["ref", "value"], "left_semi")
    after = Window.partitionBy("ref", "value").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    nexts = asks.unionByName(writes).withColumn("next", F.min("asked").over(after)).filter("wrote is not null and next is not null").select(F.col("wrote").alias("src"), F.col("next").alias("dst"))
    starts = made.select("ref", "start").unionByName(met).select(F.col("ref").alias("key"), F.col("start").cast("long").alias("node"))
    won = closure(starts, nexts).select(F.col("node").alias("seq"), F.lit(True).alias("_won"))
    return _outcomes(rows.join(won, "seq", "left").join(made.select("ref", "made"), "ref", "left"), F.coalesce("_won", F.lit(False)))


def cas_batch(proposals: DataFrame, refs: DataFrame, retired: DataFrame) -> DataFrame:
    """As cas_chain, for proposals none of which expects what another writes: the first to expect the head is taken, or to name what isn't there."""
    rows = kept(_judged(proposals, refs, retired))
    fits = F.col("_refused").isNull() & (~F.col("_there") | F.col("expected").eqNullSafe(F.col("head")))
    first = rows.filter(fits).groupBy("ref").agg(F.min(F.struct("seq", "kind")).alias("f"))
    first = first.select("ref", F.col("f.seq").alias("_first"), F.col("f.kind").alias("made"))
    rows = rows.join(first, "ref", "left").withColumn("made", F.when(~F.col("_there"), F.col("made")))
    return _outcomes(rows, F.coalesce(F.col("seq") == F.col("_first"), F.lit(False)))


def _outcomes(rows: DataFrame, won: Column) -> DataFrame:
    odd = F.coalesce(F.col("made") != F.col("kind"), F.lit(False))  # of another kind than what was made before it
    outcome = F.when(F.col("_refused").isNotNull(), F.col("_refused")).when(won, "updated").when(odd, "invalid").otherwise("forked")
    fork = F.concat(F.lit("forks/"), F.col("ref"), F.lit("/"), agent_name(F.col("agent")), F.lit("/"), F.col("seq"))
    told = rows.select("seq", "ref", outcome.alias("outcome"), fork.alias("fork"))
    return told.select("seq", "ref", "outcome", F.when(F.col("outcome") == "updated", F.col("ref")).when(F.col("outcome") == "forked", F.col("fork")).alias("at"))


def _shadowed(rows: DataFrame, overlay: DataFrame) -> DataFrame:
    """Rows (ns, mount, path) that staged work of their mount covers, at the path or above it."""
    key = ["ns", "mount", "path"]
    up = rows.select(*key, F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("at"))
    return up.join(overlay.select("ns", "mount", F.col("path").alias("at")), ["ns", "mount", "at"], "left_semi").select(*key).distinct()


def stale_observations(observations: DataFrame, mounts: DataFrame, entries: DataFrame, overlay: DataFrame) -> DataFrame:
    """(ns, mount, path, kind, now_kind): recorded reads (ns, mount, path, kind, oid) that no longer hold.

    Each is read again in the tree that its own mount (ns, mount, tree) has now,
    among entries (tree, path, kind, oid), directories included. A path without an
    entry is absent, which is a value. Reads that staged work of the same mount
    covers, at the path or above it, or whose mount is gone, aren't asked.
    """
    key = ["ns", "mount", "path"]
    asked = observations.select(*key, "kind", "oid").join(mounts.select("ns", "mount", "tree"), ["ns", "mount"])
    asked = asked.join(_shadowed(asked.select(*key).distinct(), overlay), key, "left_anti")
    now = asked.join(entries.select("tree", "path", F.col("kind").alias("now_kind"), F.col("oid").alias("now_oid")), ["tree", "path"], "left").withColumn("now_kind", F.coalesce("now_kind", F.lit("absent")))
    return now.filter((F.col("kind") != F.col("now_kind")) | ~F.col("oid").eqNullSafe(F.col("now_oid"))).select(*key, "kind", "now_kind")


def effective_work(overlay: DataFrame, mounts: DataFrame, entries: DataFrame) -> DataFrame:
    """(ns, mount, n): staged rows (ns, mount, path, id; null: removed) that change the tree of their mount."""
    rows = overlay.join(mounts.select("ns", "mount", "tree"), ["ns", "mount"]).join(entries.select("tree", "path", F.col("oid").alias("_oid")), ["tree", "path"], "left")
    return rows.filter(~F.col("id").eqNullSafe(F.col("_oid"))).groupBy("ns", "mount").agg(F.count("*").alias("n"))


def checkin_plan(requests: DataFrame, mounts: DataFrame, refs: DataFrame, stale: DataFrame, work: DataFrame) -> DataFrame:
    """(seq, ns, mount, outcome): what check-ins (seq, ns, mount) come to, at most one of each mount.

    mounts are (ns, mount, mode, ref, base), refs (ref, head), stale the reads that
    no longer hold (ns), work the effective rows (ns, mount, n). In order: unknown
    (no such mount), readonly, stale; without work noop, or stranded if another
    mount of the session holds some; then of those that build on the head the first
    is updated, and all others forked.
    """
    rows = requests.select("seq", "ns", "mount").join(mounts.select("ns", "mount", "mode", "ref", "base"), ["ns", "mount"], "left")
    rows = rows.join(stale.select("ns").distinct().withColumn("_stale", F.lit(True)), "ns", "left").join(work.select("ns", "mount", "n"), ["ns", "mount"], "left")
    sums = work.groupBy("ns").agg(F.sum("n").alias("_all"))
    rows = rows.join(sums, "ns", "left").join(refs.select("ref", "head"), "ref", "left")
    n, all_ = F.coalesce("n", F.lit(0)), F.coalesce("_all", F.lit(0))
    before = F.when(F.col("mode").isNull(), "unknown").when(F.col("mode") != "rw", "readonly").when(F.col("_stale"), "stale").when((n == 0) & (all_ > 0), "stranded").when(n == 0, "noop")
    rows = kept(rows.withColumn("_before", before))
    first = rows.filter(F.col("_before").isNull() & (F.col("base") == F.col("head"))).groupBy("ref").agg(F.min("seq").alias("_first"))
    rows = rows.join(first, "ref", "left")
    outcome = F.coalesce(F.col("_before"), F.when(F.col("seq") == F.col("_first"), "updated").otherwise("forked"))
    return rows.select("seq", "ns", "mount", outcome.alias("outcome"))


def branch_plan(requests: DataFrame, refs: DataFrame, retired: DataFrame) -> DataFrame:
    """(seq, name, outcome): new references (seq, name): created, exists, retired or invalid; of equal names the first is created."""
    name = F.col("name")
    rows = requests.select("seq", "name").join(refs.select(F.col("ref").alias("name"), F.lit(True).alias("_is")).distinct(), "name", "left").join(retired.select("name").distinct().withColumn("_gone", F.lit(True)), "name", "left")
    wrong = F.when(~valid_ref(name) | ~F.coalesce(ref_kind(name) == "commit", F.lit(True)), "invalid").when(F.col("_is"), "exists").when(F.col("_gone"), "retired")
    rows = kept(rows.withColumn("_wrong", wrong))
    first = rows.filter("_wrong is null").groupBy("name").agg(F.min("seq").alias("_first"))
    rows = rows.join(first, "name", "left")
    return rows.select("seq", "name", F.coalesce(F.col("_wrong"), F.when(F.col("seq") == F.col("_first"), "created").otherwise("exists")).alias("outcome"))


def abandon_plan(names: DataFrame, refs: DataFrame, namespaces: DataFrame, mounts: DataFrame) -> DataFrame:
    """(name, outcome): forks to give up: unknown, notfork, protected, sealed, live (head of a session), mounted or abandoned.

    refs are (name, protected, sealed), namespaces (live_ref), mounts (spec).
    """
    target = F.when(F.startswith("spec", F.lit("ref:")), F.substr(F.col("spec"), F.lit(5), F.length("spec"))).when(~F.startswith("spec", F.lit("oid:")), F.col("spec"))
    live = namespaces.select(F.col("live_ref").alias("name")).dropna().distinct().withColumn("_live", F.lit(True))
    held = mounts.select(target.alias("name")).dropna().distinct().withColumn("_held", F.lit(True))
    rows = names.select("name").distinct().join(refs.select("name", "protected", "sealed", F.lit(True).alias("_is")), "name", "left").join(live, "name", "left").join(held, "name", "left")
    outcome = F.when(F.col("_is").isNull(), "unknown").when(~is_fork(F.col("name")), "notfork").when(F.col("protected"), "protected").when(F.col("sealed"), "sealed").when(F.col("_live"), "live").when(F.col("_held"), "mounted").otherwise("abandoned")
    return rows.select("name", outcome.alias("outcome"))
