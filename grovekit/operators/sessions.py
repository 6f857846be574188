"""Sessions and what is asked of them: specs, mounts, renames, marks, receipts, tags, older catalogs.

Requests carry a `seq`, which must be unique, and are judged one by one against
the tables as given; where one would depend on another, that is said. A null name,
path or id matches nothing. Empty tables give no rows; other columns are ignored.
Keys of the tables asked (names, ids, namespaces with mounts) are unique there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import agent_name, spec_parts, valid_tag, valid_task
from ..functions.paths import absolute_ancestors, ancestors, is_under, normalize_abs, rel_of
from .catalog import HEX_ID
from .graph import kept
from .workspace import cas_batch


def resolved(asked: DataFrame, refs: DataFrame, objects: DataFrame, oid: str = HEX_ID) -> DataFrame:
    """`asked` (.., spec) with _state, _oid and _type: what the spec names.

    States: invalid (an id that is none, or no name), notfound (no such
    reference), missing (its object isn't stored) or ok.
    """
    rows = asked.withColumn("_s", spec_parts(F.col("spec")))
    raw, value = F.col("_s.kind") == "oid", F.col("_s.value")
    rows = rows.withColumn("_name", F.when(~raw, value)).join(refs.select(F.col("name").alias("_name"), F.col("oid").alias("_to")), "_name", "left")
    rows = rows.withColumn("_oid", F.when(raw & value.rlike(oid), value).otherwise(F.col("_to")))
    rows = rows.join(objects.select(F.col("oid").alias("_oid"), F.col("kind").alias("_type")).dropDuplicates(["_oid"]), "_oid", "left")
    bad = F.col("spec").isNull() | F.when(raw, ~value.rlike(oid)).otherwise(value == "")
    state = F.when(bad, "invalid").when(F.col("_oid").isNull(), "notfound").when(F.col("_type").isNull(), "missing").otherwise("ok")
    return rows.withColumn("_state", state).drop("_s", "_to")


def peeled(asked: DataFrame, refs: DataFrame, objects: DataFrame, snapshots: DataFrame, oid: str = HEX_ID) -> DataFrame:
    """resolved() with _commit: the commit itself or that of a snapshot; _state is notcommit for all else."""
    rows = resolved(asked, refs, objects, oid).join(snapshots.select(F.col("oid").alias("_oid"), F.col("commit").alias("_of")), "_oid", "left")
    commit = F.when(F.col("_state") == "ok", F.when(F.col("_type") == "commit", F.col("_oid")).when(F.col("_type") == "snapshot", F.col("_of")))
    state = F.when((F.col("_state") == "ok") & commit.isNull(), "notcommit").otherwise(F.col("_state"))
    return rows.withColumn("_commit", commit).withColumn("_state", state).drop("_of")


def peel(specs: DataFrame, refs: DataFrame, objects: DataFrame, snapshots: DataFrame, oid: str = HEX_ID) -> DataFrame:
    """(spec, state, oid, kind, commit) of different specs (spec)."""
    rows = peeled(specs.select("spec").distinct(), refs, objects, snapshots, oid)
    return rows.select("spec", F.col("_state").alias("state"), F.col("_oid").alias("oid"), F.col("_type").alias("kind"), F.col("_commit").alias("commit"))


def session_open(requests: DataFrame, refs: DataFrame, objects: DataFrame, snapshots: DataFrame, oid: str = HEX_ID) -> DataFrame:
    """(seq, outcome, pinned, live_ref): sessions (seq, agent, spec) to open: opened at the commit that the spec peels to, on a head of their own, or why not."""
    rows = peeled(requests.select("seq", "agent", "spec"), refs, objects, snapshots, oid)
    ok = F.col("_state") == "ok"
    live = F.concat(F.lit("heads/agents/"), agent_name(F.col("agent")), F.lit("/"), F.col("seq"))
    return rows.select("seq", F.when(ok, "opened").otherwise(F.col("_state")).alias("outcome"), F.col("_commit").alias("pinned"), F.when(ok, live).alias("live_ref"))


def mount_plan(requests: DataFrame, namespaces: DataFrame, mounts: DataFrame, refs: DataFrame, objects: DataFrame, overlay: DataFrame, oid: str = HEX_ID) -> DataFrame:
    """(seq, outcome, base): mounts (seq, ns_id, path, spec, mode) to take, each judged by the mounts there are.

    In order: unknown session, invalid path or spec, denied (to write to an id or a
    protected reference), notfound, missing, denied (to write to what is no commit),
    staged (work staged there would go elsewhere, or nowhere), else mounted. One to
    write to is pinned to the commit its reference holds now; others stay live.
    """
    where = normalize_abs(F.col("path"))
    rows = requests.select("seq", "ns_id", "spec", F.col("mode").alias("_mode"), where.alias("path"))
    rows = rows.join(namespaces.select(F.col("id").alias("ns_id"), F.lit(True).alias("_ns")), "ns_id", "left")
    rows = resolved(rows, refs, objects, oid).join(refs.select(F.col("name").alias("_name"), F.col("protected").alias("_p")), "_name", "left")
    rows = rows.join(mounts.select("ns_id", "path", F.col("spec").alias("_was"), F.col("mode").alias("_had")), ["ns_id", "path"], "left")
    rows = rows.join(overlay.select("ns_id", F.col("mount").alias("path")).distinct().withColumn("_staged", F.lit(True)), ["ns_id", "path"], "left")
    rw = F.col("_mode") == "rw"
    moved = (F.col("_was") != F.col("spec")) | ((F.col("_had") == "rw") & ~rw)
    outcome = (
        F.when(F.col("_ns").isNull(), "unknown")
        .when(F.col("path").isNull() | (F.col("_state") == "invalid"), "invalid")
        .when(rw & (F.startswith("spec", F.lit("oid:")) | F.coalesce("_p", F.lit(False))), "denied")
        .when(F.col("_state") != "ok", F.col("_state"))
        .when(rw & (F.col("_type") != "commit"), "denied")
        .when(F.col("_was").isNotNull() & moved & F.coalesce("_staged", F.lit(False)), "staged")
        .otherwise("mounted")
    )
    return rows.select("seq", outcome.alias("outcome"), F.when((outcome == "mounted") & rw, F.col("_oid")).alias("base"))


def abandon_sessions(requests: DataFrame, namespaces: DataFrame, mounts: DataFrame, overlay: DataFrame, observations: DataFrame) -> DataFrame:
    """(ns_id, outcome, staged, mounts, observations): sessions (ns_id, discard) to end, each once, and what goes with them.

    unknown, staged (work is left and not to be discarded) or ended; the session's
    head stays. Counts are zero unless it ends.
    """
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("ns_id").agg(F.count("*").alias(f"_{name}"))

    rows = requests.groupBy("ns_id").agg(F.max("discard").alias("discard")).join(namespaces.select(F.col("id").alias("ns_id"), F.lit(True).alias("_ns")), "ns_id", "left")
    for name, df in (("staged", overlay), ("mounts", mounts), ("observations", observations)):
        rows = rows.join(count(df, name), "ns_id", "left")
    outcome = F.when(F.col("_ns").isNull(), "unknown").when(F.col("_staged").isNotNull() & ~F.coalesce("discard", F.lit(False)), "staged").otherwise("ended")
    n = lambda c: F.when(outcome == "ended", F.coalesce(f"_{c}", F.lit(0))).otherwise(F.lit(0)).alias(c)
    return rows.select("ns_id", outcome.alias("outcome"), n("staged"), n("mounts"), n("observations"))


def _hit(rows: DataFrame, path: Column, overlay: DataFrame, name: str, strict: bool) -> DataFrame:
    """`rows` (seq, ns, mount, ..) with `name`: the first staged (path, id) at or above the path, if any; only above with `strict`."""
    own = F.array().cast("array<string>") if strict else F.array(path)
    up = rows.select("seq", "ns", "mount", F.explode(F.concat(ancestors(path), own)).alias("_at"))
    met = up.join(overlay.select("ns", "mount", F.col("path").alias("_at"), F.col("id").alias("_id")), ["ns", "mount", "_at"])
    # a path is longer than those above it
    return rows.join(met.groupBy("seq").agg(F.min_by(F.struct(F.col("_at").alias("path"), F.col("_id").alias("id")), F.length("_at")).alias(name)), "seq", "left")


def rename_plan(requests: DataFrame, mounts: DataFrame, entries: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, outcome, kind, entries) and (seq, ns, mount, path, id): renames (seq, ns, mount, from, to), and the rows they stage.

    Paths are relative to the mount (ns, mount, tree, mode); entries are (tree,
    path, kind, oid), overlay (ns, mount, path, id; null: removed) as staged.
    Outcomes, in order: unknown mount, readonly, root, same, inside (into itself),
    above (onto a directory that holds it), notfound, invalid (below a staged
    file), conflict (staged work above the destination), renamed. What is moved
    is a blob, or a directory of the mount's tree with the work staged under it.
    Staged work under both ends is superseded; the source is staged as removed.
    A directory is moved by equal ancestors, not by comparing prefixes.
    """
    a, b = F.col("from"), F.col("to")
    rows = requests.select("seq", "ns", "mount", "from", "to").join(mounts.select("ns", "mount", "tree", "mode"), ["ns", "mount"], "left")
    rows = _hit(_hit(rows, a, overlay, "_src", False), b, overlay, "_dst", True)
    rows = rows.join(entries.select("tree", F.col("path").alias("from"), F.col("kind").alias("_kind"), F.col("oid").alias("_oid")), ["tree", "from"], "left")
    staged, here = F.col("_src").isNotNull(), F.col("_src.path") == a
    absent = F.when(staged, F.col("_src.id").isNull()).otherwise(F.col("_kind").isNull())
    outcome = (
        F.when(F.col("mode").isNull(), "unknown").when(F.col("mode") != "rw", "readonly")
        .when((a == "") | (b == ""), "root").when(a == b, "same").when(is_under(b, a), "inside").when(is_under(a, b), "above")
        .when(absent, "notfound").when(staged & ~here, "invalid")
        .when(F.col("_dst").isNotNull(), "conflict").otherwise("renamed")
    )
    rows = rows.withColumn("outcome", outcome)
    done = rows.filter("outcome = 'renamed'").select("seq", "ns", "mount", "tree", "from", "to", F.when(staged, "blob").otherwise(F.col("_kind")).alias("kind"), F.coalesce("_src.id", "_oid").alias("id"))
    blobs = done.filter("kind = 'blob'").select("seq", F.col("to").alias("path"), "id")
    tops = done.filter("kind = 'tree'").select("seq", "ns", "mount", "tree", "from", "to")
    rest = F.substr(F.col("path"), F.length("from") + 2)

    def below(df: DataFrame, by: list[str]) -> DataFrame:
        up = df.withColumn("from", F.explode(ancestors(F.col("path"))))
        return tops.join(up, [*by, "from"]).select("seq", "from", "to", "ns", "mount", "path", "id")

    base = below(entries.filter("kind = 'blob'").select("tree", "path", F.col("oid").alias("id")), ["tree"])
    work = below(overlay.select("ns", "mount", "path", "id"), ["ns", "mount"])
    gone = work.filter("id is null").select("seq", F.col("path").alias("_at"))
    hidden = base.select("seq", "path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("_at")).join(gone, ["seq", "_at"], "left_semi").select("seq", "path")
    stays = base.join(hidden.distinct(), ["seq", "path"], "left_anti").join(work.select("seq", "path"), ["seq", "path"], "left_anti")
    moved = stays.select("seq", F.concat("to", F.lit("/"), rest).alias("path"), "id").unionByName(work.filter("id is not null").select("seq", F.concat("to", F.lit("/"), rest).alias("path"), "id"))
    landed = blobs.unionByName(moved)
    told = rows.join(done.select("seq", "kind"), "seq", "left").join(landed.groupBy("seq").agg(F.count("*").alias("n")), "seq", "left")
    told = told.select("seq", "outcome", "kind", F.when(F.col("outcome") == "renamed", F.coalesce("n", F.lit(0))).alias("entries"))
    fresh = landed.unionByName(done.select("seq", F.col("from").alias("path"), F.lit(None).cast("string").alias("id"))).join(done.select("seq", "ns", "mount"), "seq")
    return told, fresh.select("seq", "ns", "mount", "path", "id")


def landmark_plan(requests: DataFrame, objects: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(oid, outcome, kind): objects (oid) to keep for good, each once: missing, exists (and stays as it is) or marked under its kind."""
    rows = requests.select("oid").dropna().distinct().join(objects.select("oid", "kind").dropDuplicates(["oid"]), "oid", "left")
    rows = rows.join(landmarks.select("oid").distinct().withColumn("_is", F.lit(True)), "oid", "left")
    outcome = F.when(F.col("kind").isNull(), "missing").when(F.col("_is"), "exists").otherwise("marked")
    return rows.select("oid", outcome.alias("outcome"), "kind")


def inbox_push(requests: DataFrame, refs: DataFrame, retired: DataFrame, objects: DataFrame, oid: str = HEX_ID) -> DataFrame:
    """(seq, outcome, at): snapshots to hand over (seq, agent, recipient, spec, task): updated (a new name), forked (the task is there), or why not.

    refs are (name, oid, kind, protected, sealed). The first push of a task takes
    its name. Recipients and tasks must be plain names, what is handed over a snapshot.
    """
    rows = resolved(requests.select("seq", "agent", "recipient", "task", "spec"), refs, objects, oid)
    to, task = F.col("recipient"), F.col("task")
    plain = F.coalesce((agent_name(to) == to) & (to != "anon"), F.lit(False))
    wrong = F.when(~plain, "invalid").when(F.col("_state") != "ok", F.col("_state")).when((F.col("_type") != "snapshot") | ~F.coalesce(valid_task(task), F.lit(False)), "invalid")
    rows = rows.withColumn("_wrong", wrong).withColumn("ref", F.concat(F.lit("inbox/"), to, F.lit("/"), task))
    asks = rows.filter("_wrong is null").select("seq", "ref", "agent", F.lit("snapshot").alias("kind"), F.lit(None).cast("string").alias("expected"), F.col("_oid").alias("new"), F.lit(False).alias("allowed"))
    told = cas_batch(asks, refs.select(F.col("name").alias("ref"), F.col("oid").alias("head"), "kind", "protected", "sealed"), retired)
    return told.select("seq", "outcome", "at").unionByName(rows.filter("_wrong is not null").select("seq", F.col("_wrong").alias("outcome"), F.lit(None).cast("string").alias("at")))


def receipts(commits: DataFrame, commit_parent: DataFrame, contributions: DataFrame, contribution_parent: DataFrame, contribution_read: DataFrame, objects: DataFrame) -> DataFrame:
    """(oid, receipt, outcome): what the receipt (a contribution) of each commit is worth.

    commits are (oid, tree, contrib, agent), contributions (oid, base, tree, agent).
    none; corrupt, if it or an object it names is missing or of another kind; differs,
    if its tree, parents or agent are not the commit's; else ok. Parents are compared
    as sets with counts.
    """
    have = objects.select(F.col("oid").alias("dst"), F.col("kind").alias("_kind")).dropDuplicates(["dst"])
    edge = lambda df, c, kind: df.select("oid", F.col(c).alias("dst"), F.lit(kind).alias("want"))
    named = edge(contributions, "base", "commit").unionByName(edge(contributions, "tree", "tree")).unionByName(edge(contribution_parent, "parent", "commit")).unionByName(edge(contribution_read, "id", "blob"))
    named = named.unionByName(contributions.select("oid", F.col("oid").alias("dst"), F.lit("contribution").alias("want")))
    bad = named.join(have, "dst", "left").filter("_kind is null or _kind <> want").select(F.col("oid").alias("contrib")).distinct().withColumn("_bad", F.lit(True))

    def sums(df: DataFrame, key: str, out: str) -> DataFrame:
        # sums of hashes, so that no task gathers the parents of one commit
        return df.groupBy(F.col("oid").alias(key)).agg(F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("parent").cast("decimal(38,0)")).alias("h")).alias(out))

    rows = commits.select("oid", "tree", "agent", "contrib").join(contributions.select(F.col("oid").alias("contrib"), F.col("tree").alias("_tree"), F.col("agent").alias("_agent"), F.lit(True).alias("_is")), "contrib", "left")
    rows = rows.join(bad, "contrib", "left").join(sums(commit_parent, "oid", "_p"), "oid", "left").join(sums(contribution_parent, "contrib", "_q"), "contrib", "left")
    same = F.col("tree").eqNullSafe(F.col("_tree")) & F.col("agent").eqNullSafe(F.col("_agent")) & F.col("_p").eqNullSafe(F.col("_q"))
    outcome = F.when(F.col("contrib").isNull(), "none").when(F.col("_is").isNull() | F.col("_bad"), "corrupt").when(~same, "differs").otherwise("ok")
    return rows.select("oid", F.col("contrib").alias("receipt"), outcome.alias("outcome"))


def verify_tags(tags: DataFrame, refs: DataFrame, seals: DataFrame, snapshots: DataFrame, commits: DataFrame) -> DataFrame:
    """(tag, outcome): whether different tags (tag) still name what was sealed, short of signature and manifest.

    noref, noseal, flags (the reference is another, or open), snapshot (gone, or
    with another commit or tree than sealed), commit (gone, or with another tree), ok.
    """
    name = F.concat(F.lit("tags/"), F.col("tag"))
    rows = tags.select("tag").distinct().withColumn("_name", name)
    rows = rows.join(refs.select(F.col("name").alias("_name"), F.col("oid").alias("_o"), F.col("kind").alias("_k"), (F.col("protected") & F.col("sealed")).alias("_f")), "_name", "left")
    rows = rows.join(seals.select("tag", "snap_oid", "commit_oid", "tree_oid"), "tag", "left")
    rows = rows.join(snapshots.select(F.col("oid").alias("snap_oid"), F.col("commit").alias("_c"), F.col("tree").alias("_t")), "snap_oid", "left")
    rows = rows.join(commits.select(F.col("oid").alias("commit_oid"), F.col("tree").alias("_ct")), "commit_oid", "left")
    fits = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    outcome = (
        F.when(F.col("_o").isNull(), "noref").when(F.col("snap_oid").isNull(), "noseal")
        .when(~(fits("_o", "snap_oid") & (F.col("_k") == "snapshot") & F.col("_f")), "flags")
        .when(~(fits("_c", "commit_oid") & fits("_t", "tree_oid")), "snapshot").when(~fits("_ct", "tree_oid"), "commit").otherwise("ok")
    )
    return rows.select("tag", outcome.alias("outcome"))


def seal_plan(requests: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """(seq, outcome): references to freeze (seq, ref, tag, expected), the commit that was read: invalid tag, notfound, notcommit, sealed (the tag is there, or an earlier request takes it), stale (the reference moved) or sealable."""
    now = refs.select(F.col("name").alias("ref"), F.col("oid").alias("_oid"))
    rows = requests.select("seq", "ref", "tag", "expected").join(now, "ref", "left")
    rows = rows.join(objects.select(F.col("oid").alias("expected"), F.col("kind").alias("_kind")).dropDuplicates(["expected"]), "expected", "left")
    rows = rows.join(refs.select(F.col("name").alias("_tag"), F.lit(True).alias("_is")), F.col("_tag") == F.concat(F.lit("tags/"), F.col("tag")), "left")
    wrong = F.when(~F.coalesce(valid_tag(F.col("tag")), F.lit(False)), "invalid").when(F.col("_oid").isNull(), "notfound").when(~F.coalesce(F.col("_kind") == "commit", F.lit(False)), "notcommit")
    wrong = wrong.when(F.col("_is"), "sealed").when(F.col("_oid") != F.col("expected"), "stale")
    rows = rows.withColumn("_wrong", wrong)
    first = rows.filter("_wrong is null").groupBy("tag").agg(F.min("seq").alias("_first"))
    rows = rows.join(first, "tag", "left")
    return rows.select("seq", F.coalesce("_wrong", F.when(F.col("seq") == F.col("_first"), "sealable").otherwise("sealed")).alias("outcome"))


def migrate_observations(observations: DataFrame) -> DataFrame:
    """Reads (ns_id, mount, path, oid) of the first version, as the second keeps them: all were of blobs. A table with kinds stays as it is."""
    kind = F.col("kind") if "kind" in observations.columns else F.lit("blob")
    return observations.select("ns_id", "mount", "path", kind.alias("kind"), "oid")


def migrate_mounts(mounts: DataFrame, namespaces: DataFrame, refs: DataFrame) -> DataFrame:
    """(ns_id, path, spec, mode, base_oid): mounts (ns_id, path, spec, mode, base_oid if there) of the second version, pinned as the third asks.

    One to write to without a pin takes its session's if it names the session's own
    head, else what its reference holds now; one whose reference is gone stays
    without; one of an id becomes read-only. Pins that are there stay.
    """
    base = F.col("base_oid") if "base_oid" in mounts.columns else F.lit(None).cast("string")
    # no reference's name holds a colon, so a spec names one reference at most
    rows = mounts.select("ns_id", "path", "spec", "mode", base.alias("_had"), F.regexp_replace("spec", "^ref:", "").alias("_name"))
    rows = rows.join(namespaces.select(F.col("id").alias("ns_id"), F.col("pinned_oid").alias("_pin"), F.col("live_ref").alias("_live")), "ns_id", "left")
    rows = rows.join(refs.select(F.col("name").alias("_name"), F.col("oid").alias("_head")), "_name", "left")
    own = F.when(F.col("_live") == F.col("_name"), F.col("_pin"))
    pin = F.when((F.col("mode") == "rw") & F.col("_had").isNull(), F.coalesce(own, F.col("_head"))).otherwise(F.col("_had"))
    mode = F.when((F.col("mode") == "rw") & pin.isNull() & F.startswith("spec", F.lit("oid:")), "ro").otherwise(F.col("mode"))
    return rows.select("ns_id", "path", "spec", mode.alias("mode"), pin.alias("base_oid"))


def ns_access(requests: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(seq, outcome): whether an agent (seq, ns_id, agent) may use a session (id, agent_id): unknown, denied or ok."""
    rows = requests.select("seq", "ns_id", "agent").join(namespaces.select(F.col("id").alias("ns_id"), F.col("agent_id").alias("_own"), F.lit(True).alias("_is")), "ns_id", "left")
    return rows.select("seq", F.when(F.col("_is").isNull(), "unknown").when(F.col("_own") == F.col("agent"), "ok").otherwise("denied").alias("outcome"))


def write_plan(requests: DataFrame, namespaces: DataFrame, mounts: DataFrame, overlay: DataFrame) -> DataFrame:
    """(seq, outcome, mount, path): writes and removals (seq, ns_id, path), each judged by the work staged already.

    In order: unknown session, invalid path, nomount, readonly, root (of a mount),
    conflict (work is staged above or below), else staged at `path` of the mount
    that holds it most closely. The path itself may be staged; it is replaced.
    """
    where = normalize_abs(F.col("path"))
    rows = requests.select("seq", "ns_id", where.alias("_abs")).join(namespaces.select(F.col("id").alias("ns_id"), F.lit(True).alias("_ns")), "ns_id", "left")
    up = rows.select("seq", "ns_id", F.explode(absolute_ancestors(F.col("_abs"))).alias("mount")).join(mounts.select("ns_id", F.col("path").alias("mount"), "mode"), ["ns_id", "mount"])
    most = up.groupBy("seq").agg(F.max_by(F.struct("mount", "mode"), F.length("mount")).alias("_m"))
    rows = rows.join(most, "seq", "left").withColumn("mount", F.col("_m.mount")).withColumn("path", rel_of(F.col("_abs"), F.col("_m.mount")))
    asked, work = rows.filter("path <> ''").select("seq", "ns_id", "mount", "path"), overlay.select("ns_id", "mount", "path")
    keys = ["ns_id", "mount", "_at"]
    above = asked.select("seq", "ns_id", "mount", F.explode(ancestors(F.col("path"))).alias("_at")).join(work.withColumnRenamed("path", "_at"), keys, "left_semi").select("seq")
    below = asked.withColumnRenamed("path", "_at").join(work.select("ns_id", "mount", F.explode(ancestors(F.col("path"))).alias("_at")).distinct(), keys, "left_semi").select("seq")
    rows = rows.join(above.union(below).distinct().withColumn("_met", F.lit(True)), "seq", "left")
    outcome = (
        F.when(F.col("_ns").isNull(), "unknown").when(F.col("_abs").isNull(), "invalid").when(F.col("mount").isNull(), "nomount")
        .when(F.col("_m.mode") != "rw", "readonly").when(F.col("path") == "", "root").when(F.col("_met"), "conflict").otherwise("staged")
    )
    here = lambda c: F.when(F.col("outcome") == "staged", F.col(c)).alias(c)
    return rows.withColumn("outcome", outcome).select("seq", "outcome", here("mount"), here("path"))


def observe_plan(reads: DataFrame, observations: DataFrame) -> DataFrame:
    """(ns_id, mount, path, kind, oid): what reads (seq, ns_id, mount, path, kind, oid) have recorded anew; of each place the last counts, and what is recorded so already is left."""
    key = ["ns_id", "mount", "path"]
    last = reads.groupBy(*key).agg(F.max_by(F.struct("kind", "oid"), "seq").alias("_l")).select(*key, "_l.kind", "_l.oid")
    o = observations.select(*key, "kind", "oid").alias("o")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*key, "kind", "oid")]
    return last.alias("l").join(o, same, "left_anti")


def resolve_plan(requests: DataFrame, refs: DataFrame, objects: DataFrame, conflicts: DataFrame, causal: DataFrame, bases: DataFrame, paths: DataFrame, outside: DataFrame) -> DataFrame:
    """(seq, outcome, tree): conflicts to settle (seq, conflict, into, choice: "ours", "theirs" or a tree's "oid:").

    outside (conflict, tree) are trees that change more than the conflict's paths
    (see merging.in_scope). In order: notfound (no such reference), missing (no such
    conflict), unpublished (not below conflicts/ of the reference), stale (the
    reference moved off the conflict's causes), missing or notree (what is chosen),
    sides (without paths only the two sides will do), bases (of several none can
    be scoped), scope, else resolved to the tree.
    """
    choice, tree = F.col("choice"), F.substr(F.col("choice"), F.lit(5))
    rows = requests.select("seq", "conflict", "into", "choice").join(refs.select(F.col("name").alias("into"), F.col("oid").alias("_head")), "into", "left")
    rows = rows.join(conflicts.select(F.col("oid").alias("conflict"), "ours", "theirs"), "conflict", "left")
    open_ = refs.filter("kind = 'conflict'").select(F.col("oid").alias("conflict"), F.regexp_extract("name", r"^conflicts/(.+)/[^/]+$", 1).alias("into")).distinct().withColumn("_open", F.lit(True))
    rows = rows.join(open_, ["conflict", "into"], "left")
    rows = rows.join(causal.select(F.col("oid").alias("conflict"), F.col("commit").alias("_head")).distinct().withColumn("_fits", F.lit(True)), ["conflict", "_head"], "left")
    rows = rows.withColumn("tree", F.when(choice == "ours", F.col("ours")).when(choice == "theirs", F.col("theirs")).otherwise(tree))
    rows = rows.join(objects.select(F.col("oid").alias("tree"), F.col("kind").alias("_kind")).dropDuplicates(["tree"]), "tree", "left")
    rows = rows.join(bases.groupBy(F.col("oid").alias("conflict")).agg(F.count("*").alias("_bases")), "conflict", "left")
    rows = rows.join(paths.select(F.col("oid").alias("conflict")).distinct().withColumn("_paths", F.lit(True)), "conflict", "left")
    rows = rows.join(outside.select("conflict", "tree").distinct().withColumn("_out", F.lit(True)), ["conflict", "tree"], "left")
    own = choice.isin("ours", "theirs")
    outcome = (
        F.when(F.col("_head").isNull(), "notfound").when(F.col("ours").isNull(), "missing").when(F.col("_open").isNull(), "unpublished").when(F.col("_fits").isNull(), "stale").when(own, "resolved")
        .when(F.col("_kind").isNull(), "missing").when(F.col("_kind") != "tree", "notree")
        .when(F.col("_paths").isNull(), F.when((F.col("tree") == F.col("ours")) | (F.col("tree") == F.col("theirs")), "resolved").otherwise("sides"))
        .when(F.col("_bases") > 1, "bases").when(F.col("_out"), "scope").otherwise("resolved")
    )
    return rows.withColumn("outcome", outcome).select("seq", "outcome", F.when(F.col("outcome") == "resolved", F.col("tree")).alias("tree"))


def tree_walk(roots: DataFrame, tree_entry: DataFrame) -> DataFrame:
    """(root, path, kind, id): all that lies below trees (root), by names (tree, name, kind, id); a level is one join. Trees that are missing hold nothing."""
    inner = kept(tree_entry.select(F.col("tree").alias("_t"), "name", "kind", "id"))
    front = roots.select("root", F.lit("").alias("path"), F.col("root").alias("id")).dropna().distinct()
    levels = []
    while not levels or not levels[-1].filter("kind = 'tree'").isEmpty():
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("/"), "name")).alias("path")
        levels.append(kept(front.select("root", "path", F.col("id").alias("_t")).join(inner, "_t").select("root", path, "kind", "id").distinct()))
        front = levels[-1].filter("kind = 'tree'")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def verified_get(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """(oid, outcome, size): what is read of different ids (oid) among stored objects (oid, data): missing, corrupt (its hash is another) or ok with its bytes."""
    rows = asked.select("oid").distinct().join(stored.select("oid", F.octet_length("data").alias("_n"), F.sha2("data", 256).alias("_h")), "oid", "left")
    outcome = F.when(F.col("_h").isNull(), "missing").when(F.col("_h") != F.col("oid"), "corrupt").otherwise("ok")
    return rows.select("oid", outcome.alias("outcome"), F.when(outcome == "ok", F.col("_n")).alias("size"))
