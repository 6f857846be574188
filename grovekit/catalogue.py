"""All queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import authority, catalog, graph, history, merging, metrics, sessions, trees, workspace
from .plans import sql
from .sources import datasets as data
from .sources import filesystem, store
from .sources.datasets import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)


@query
def blob_dedup(spark, sf_dir):
    return history.blob_dedup(data.blobs(spark, sf_dir))


@query
def first_introducer(spark, sf_dir):
    return history.first_introducer(data.blobs(spark, sf_dir))


def _entries(spark, sf_dir, *sides):
    base = graph.kept(data.hashed(spark, sf_dir))  # texts are hashed once
    every = None
    for s in sides:
        one = data.files(spark, sf_dir, s, base).withColumn("side", F.lit(s))
        every = one if every is None else every.unionByName(one)
    every = graph.kept(trees.entries(every, "side"))
    return [every.filter(F.col("side") == s).drop("side") for s in sides]


@query
def intro_new_objects(spark, sf_dir):
    return trees.new_objects(*_entries(spark, sf_dir, "base", "ours"))


@query
def tree_flatten(spark, sf_dir):
    flat = trees.flatten(data.files(spark, sf_dir))
    return flat.select("path", "id", "exec", *[F.coalesce(F.col("parts")[i], F.lit("")).alias(f"part{i}") for i in range(3)])


@query
def tree_merkle(spark, sf_dir):
    return _entries(spark, sf_dir, "ours")[0].select("path", "kind", "id", "exec")


@query
def overlay_fold(spark, sf_dir):
    return trees.overlay_fold(data.files(spark, sf_dir), data.files(spark, sf_dir, "overlay"))


@query
def overlay_shadowed(spark, sf_dir):
    return trees.overlay_shadowed(data.files(spark, sf_dir), data.files(spark, sf_dir, "overlay"))


@query
def overlay_prefix_conflict(spark, sf_dir):
    staged = data.files(spark, sf_dir, "overlay")
    tried = data.files(spark, sf_dir).select("path").unionByName(staged.select(F.concat("path", F.lit("/y")).alias("path")))
    return trees.prefix_conflicts(tried, staged)


@query
def ns_ls(spark, sf_dir):
    return trees.listing(data.files(spark, sf_dir), data.files(spark, sf_dir, "overlay"))


@query
def ns_resolve(spark, sf_dir):
    files, edits = data.files(spark, sf_dir), data.files(spark, sf_dir, "overlay")
    asked = files.select("path").unionByName(edits.select("path")).unionByName(files.select(F.concat("path", F.lit("/in")).alias("path")))
    return trees.resolve(asked, files, edits)


@query
def longest_mount(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return history.longest_mount(paths, spark.createDataFrame([(m,) for m in sql.MOUNTS], "mount string"))


@query
def diff_changed_paths(spark, sf_dir):
    return merging.changed_paths(*_entries(spark, sf_dir, "base", "ours"))


@query
def diff_frontier(spark, sf_dir):
    return merging.frontier(*_entries(spark, sf_dir, "base", "ours"))


@query
def exact_renames(spark, sf_dir):
    base, ours = _entries(spark, sf_dir, "base", "ours")
    return merging.exact_renames(base, merging.frontier(base, ours))


@query
def merge_three_way(spark, sf_dir):
    return merging.three_way(*_entries(spark, sf_dir, "base", "ours", "theirs"))


@query
def merge_conflicts(spark, sf_dir):
    return merging.conflicts(*_entries(spark, sf_dir, "base", "ours", "theirs"))


@query
def resolve_scope(spark, sf_dir):
    base, ours, theirs = _entries(spark, sf_dir, "base", "ours", "theirs")
    return merging.in_scope(merging.changed_paths(ours, theirs), merging.three_way(base, ours, theirs).filter("outcome = 'conflict'"))


def _heads(spark, sf_dir):
    p = data.pairs(spark, sf_dir)
    return p.select(F.col("a").alias("key"), F.col("a").alias("node"))


@query
def commit_ancestry(spark, sf_dir):
    return graph.closure(_heads(spark, sf_dir), data.commits(spark, sf_dir)[1]).select(F.col("key").alias("head"), "node")


@query
def merge_bases(spark, sf_dir):
    return graph.merge_bases(data.pairs(spark, sf_dir), data.commits(spark, sf_dir)[1])


@query
def contribution_union(spark, sf_dir):
    nodes, edges = data.commits(spark, sf_dir)
    facts = nodes.select("node", F.concat("role", F.lit(":"), (F.col("node") % 7).cast("string")).alias("fact"))
    return graph.contribution_union(data.pairs(spark, sf_dir), edges, facts)


def _roots(spark, sf_dir):
    nodes, edges = data.objects(spark, sf_dir)
    return nodes, edges, nodes.filter(data.ROOTS).select("node")


@query
def graph_closure(spark, sf_dir):
    nodes, edges, roots = _roots(spark, sf_dir)
    return graph.reachable(roots, edges)


@query
def graph_type_audit(spark, sf_dir):
    nodes, edges = data.objects(spark, sf_dir)
    spoilt = nodes.filter("not (kind = 'order' and age = 13)").withColumn("kind", F.expr("case when kind = 'nation' and age % 11 = 5 then 'customer' else kind end"))
    return graph.type_audit(edges, spoilt)


def _state(spark, sf_dir):
    nodes, edges, roots = _roots(spark, sf_dir)
    return graph.gc_state(nodes, roots, edges, 24), edges


@query
def gc_plan(spark, sf_dir):
    return graph.gc_report(_state(spark, sf_dir)[0])


@query
def gc_collectable(spark, sf_dir):
    return graph.gc_sample(_state(spark, sf_dir)[0])


@query
def gc_doomed(spark, sf_dir):
    return graph.gc_doomed(*_state(spark, sf_dir))


@query
def provenance_check(spark, sf_dir):
    nodes, edges, roots = _roots(spark, sf_dir)
    live = graph.reachable(roots, edges).join(nodes.select("node", "kind", "age"), "node")
    known = live.select("node", F.when(F.col("kind") == "order", F.concat(F.lit("a"), (F.col("age") % 5).cast("string"))).alias("agent"))
    listed = nodes.join(live.select("node"), "node", "left_semi").filter("age % 19 <> 3").unionByName(nodes.filter("kind = 'customer' and age = 7"), allowMissingColumns=True)
    label = F.when(F.col("age") % 23 == 4, "odd").otherwise(F.concat(F.lit("a"), (F.col("age") % 5).cast("string")))
    return graph.provenance_check(known, listed.select("node", label.alias("label")).distinct())


def _names(spark, sf_dir):
    odd = spark.createDataFrame([(n,) for n in sql.ODD_NAMES], "name string")
    return table(spark, sf_dir, "part").selectExpr(sql.PART_NAMES + " as name").unionByName(odd).distinct()


@query
def refs_list(spark, sf_dir):
    cap = authority.parse(sql.TOKENS["t1"])
    return authority.visible(_names(spark, sf_dir), cap, F.lit("read"), F.lit(sql.NOW))


@query
def cap_allows(spark, sf_dir):
    rows = None
    for token, caveats in sql.TOKENS.items():
        cap = authority.parse(caveats)
        for op in ("read", "write", "merge"):
            one = _names(spark, sf_dir).select(F.lit(token).alias("token"), F.lit(op).alias("op"), "name", authority.allows(cap, F.lit(op), F.col("name"), F.lit(sql.NOW)).alias("allowed"))
            rows = one if rows is None else rows.unionByName(one)
    return rows


@query
def ref_kind_audit(spark, sf_dir):
    name = F.col("name")
    return _names(spark, sf_dir).select("name", names.valid_ref(name).alias("valid"), names.ref_kind(name).alias("kind"), names.is_fork(name).alias("fork"), names.agent_name(name).alias("agent"))


@query
def inbox_list(spark, sf_dir):
    refs = table(spark, sf_dir, "events").select(F.concat(F.lit("inbox/u"), F.col("user_id"), F.lit("/t"), F.col("event_id")).alias("name"))
    return history.inbox(refs, "u7")


@query
def reflog_log(spark, sf_dir):
    return history.log(data.reflog(spark, sf_dir)[0], "heads/agents/u7/main").select("name", "id", "new_oid", "reason")


@query
def reflog_chain_audit(spark, sf_dir):
    return history.chain_audit(*data.reflog(spark, sf_dir))


@query
def retired_names(spark, sf_dir):
    return history.retired(data.reflog(spark, sf_dir)[0])


def _proposals(spark, sf_dir, chained):
    e, expected = table(spark, sf_dir, "events"), "chained" if chained else "batch"
    return spark.sql(store.PROPOSALS.format(events="{e}", expected=store.EXPECTED[expected]), e=e), spark.sql(store.HEADS, events=e), spark.sql(store.RETIRED, events=e)


@query
def cas_batch(spark, sf_dir):
    return workspace.cas_batch(*_proposals(spark, sf_dir, False))


@query
def cas_chain(spark, sf_dir):
    return workspace.cas_chain(*_proposals(spark, sf_dir, True))


def _reads(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ns, path = F.concat(F.lit("c"), F.col("o_custkey")).alias("ns"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("path")
    mount = F.concat(F.lit("/m"), (F.col("o_orderkey") % 3).cast("string")).alias("mount")
    return o, ns, mount, path


def _session(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return {n: spark.sql(q, orders=o) for n, q in store.SESSIONS.items()}


@query
def stale_observations(spark, sf_dir):
    of = _session(spark, sf_dir)
    return workspace.stale_observations(of["reads"], of["mounted"], of["entries"], of["staged"])


@query
def effective_work(spark, sf_dir):
    of = _session(spark, sf_dir)
    return workspace.effective_work(of["staged"], of["mounted"], of["entries"])


@query
def checkin_plan(spark, sf_dir):
    of = _session(spark, sf_dir)
    stale = workspace.stale_observations(of["reads"], of["mounted"], of["entries"], of["staged"])
    work = workspace.effective_work(of["staged"], of["mounted"], of["entries"])
    return workspace.checkin_plan(of["requests"], of["mounted"], of["heads"], stale, work)


@query
def branch_plan(spark, sf_dir):
    tried, heads, retired = _proposals(spark, sf_dir, False)
    more = tried.select("seq", F.concat("ref", F.lit("/b"), (F.col("seq") % 7).cast("string")).alias("name")).unionByName(tried.select((-F.col("seq") - 1).alias("seq"), F.col("ref").alias("name")))
    return workspace.branch_plan(more, heads, retired)


@query
def abandon_plan(spark, sf_dir):
    of = store.relations(spark, sf_dir, "refs", "namespaces", "mounts")
    forks = of["refs"].filter("name like 'forks/%'")
    mounts = of["mounts"].unionByName(forks.filter("oid like '%7'").select(F.lit("n1").alias("ns_id"), F.lit("/f").alias("path"), F.concat(F.lit("ref:"), "name").alias("spec"), F.lit("ro").alias("mode"), F.lit(None).cast("string").alias("base_oid")))
    asked = of["refs"].select("name").unionByName(forks.select(F.concat("name", F.lit("x")).alias("name")))
    live = of["namespaces"].select("live_ref").unionByName(forks.filter("oid like '%3'").select(F.col("name").alias("live_ref")))
    return workspace.abandon_plan(asked, of["refs"], live, mounts)


def _catalog(spark, sf_dir, *names):
    of = store.relations(spark, sf_dir, *names)
    return of | {"objects": store.spoilt(of["objects"])} if "objects" in of else of


def _asked(spark, sf_dir, name, **more):
    return store.asked(spark, name, events=table(spark, sf_dir, "events"), orders=table(spark, sf_dir, "orders"), **more)


@query
def spec_peel(spark, sf_dir):
    of = store.relations(spark, sf_dir, "refs", "objects", "mounts", "snapshots")
    return sessions.peel(_asked(spark, sf_dir, "specs", refs=of["refs"], objects=of["objects"], mounts=of["mounts"]), of["refs"], store.spoilt(of["objects"]), of["snapshots"], store.OID)


@query
def session_open(spark, sf_dir):
    return sessions.session_open(_asked(spark, sf_dir, "opens"), **_catalog(spark, sf_dir, "refs", "objects", "snapshots"), oid=store.OID)


@query
def mount_plan(spark, sf_dir):
    return sessions.mount_plan(_asked(spark, sf_dir, "mountings"), **_catalog(spark, sf_dir, "namespaces", "mounts", "refs", "objects", "overlay"), oid=store.OID)


@query
def abandon_sessions(spark, sf_dir):
    return sessions.abandon_sessions(_asked(spark, sf_dir, "endings"), **_catalog(spark, sf_dir, "namespaces", "mounts", "overlay", "observations"))


def _renames(spark, sf_dir):
    return sessions.rename_plan(*[_asked(spark, sf_dir, n) if n else _session(spark, sf_dir)["mounted"] for n in ("renames", None, "nested", "work")])


@query
def rename_plan(spark, sf_dir):
    return _renames(spark, sf_dir)[0]


@query
def rename_rows(spark, sf_dir):
    return _renames(spark, sf_dir)[1]


@query
def landmark_plan(spark, sf_dir):
    of = store.relations(spark, sf_dir, "objects", "landmarks")
    return sessions.landmark_plan(of["objects"], store.spoilt(of["objects"]), of["landmarks"])


@query
def inbox_push(spark, sf_dir):
    return sessions.inbox_push(_asked(spark, sf_dir, "pushes"), retired=_asked(spark, sf_dir, "left"), **_catalog(spark, sf_dir, "refs", "objects"), oid=store.OID)


@query
def receipts(spark, sf_dir):
    of = _catalog(spark, sf_dir, "commits", "commit_parent", "contributions", "contribution_parent", "contribution_read", "objects")
    for n, agent in store.AGENTS.items():
        of[n] = of[n].withColumn("agent", F.expr(agent))
    of["contributions"] = of["contributions"].withColumn("tree", F.expr(store.OTHER["contributions"]))
    return sessions.receipts(**of)


@query
def verify_tags(spark, sf_dir):
    of = store.relations(spark, sf_dir, "refs", "seals", "snapshots", "commits")
    for n in ("snapshots", "commits"):
        of[n] = of[n].withColumn("tree", F.expr(store.OTHER[n]))
    tags = of["seals"].select("tag").unionByName(of["refs"].filter("name like 'tags/%'").selectExpr("substr(name, 6) as tag"))
    return sessions.verify_tags(tags, **of)


@query
def seal_plan(spark, sf_dir):
    return sessions.seal_plan(_asked(spark, sf_dir, "seals_asked"), **_catalog(spark, sf_dir, "refs", "objects"))


@query
def migrate_mounts(spark, sf_dir):
    of = store.relations(spark, sf_dir, "mounts", "namespaces", "refs")
    return sessions.migrate_mounts(of["mounts"].withColumn("base_oid", F.expr(store.UNPINNED)), of["namespaces"], of["refs"])


@query
def migrate_observations(spark, sf_dir):
    return sessions.migrate_observations(store.relation(spark, sf_dir, "observations").filter("oid is not null").drop("kind"))


@query
def ns_access(spark, sf_dir):
    return sessions.ns_access(_asked(spark, sf_dir, "uses"), store.relation(spark, sf_dir, "namespaces"))


@query
def write_plan(spark, sf_dir):
    return sessions.write_plan(_asked(spark, sf_dir, "writes"), **_catalog(spark, sf_dir, "namespaces", "mounts", "overlay"))


@query
def observe_plan(spark, sf_dir):
    return sessions.observe_plan(_asked(spark, sf_dir, "seen"), store.relation(spark, sf_dir, "observations"))


@query
def resolve_plan(spark, sf_dir):
    of = store.relations(spark, sf_dir, "objects", "conflicts", "conflict_causal", "conflict_base", "conflict_path")
    asked = _asked(spark, sf_dir, "settlings").withColumnRenamed("into_", "into")
    bases = of["conflict_base"].unionByName(of["conflict_base"].filter(store.MORE))
    outside = asked.filter(store.BEYOND).selectExpr("conflict", "substr(choice, 5) as tree")
    return sessions.resolve_plan(asked, _asked(spark, sf_dir, "targets"), store.spoilt(of["objects"]), of["conflicts"], of["conflict_causal"], bases, of["conflict_path"].filter(store.PATHS), outside)


@query
def tree_walk(spark, sf_dir):
    entries = store.relation(spark, sf_dir, "tree_entry")
    return sessions.tree_walk(entries.filter("kind = 'tree'").select(F.col("tree").alias("root")), entries)


@query
def verified_get(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stored = spark.sql(store.STORED.format(sha="sha2", bits=", 256", documents="{d}"), d=docs)
    return sessions.verified_get(stored.select("oid").unionByName(docs.select(F.sha2("text", 256).alias("oid"))), stored)


def _staged(spark, sf_dir):
    o, ns, mount, path = _reads(spark, sf_dir)
    return o.select(ns, mount, path, F.sha2(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise(F.lit("new")), 256).alias("id"))


@query
def stranded_mounts(spark, sf_dir):
    o, _, _, path = _reads(spark, sf_dir)
    return history.stranded_mounts(_staged(spark, sf_dir), o.select(path, F.sha2("o_orderstatus", 256).alias("id")), "/m0")


@query
def catalog_orphans(spark, sf_dir):
    o, ns, mount, path = _reads(spark, sf_dir)
    namespaces = table(spark, sf_dir, "customer").filter("c_custkey % 19 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("ns"))
    mounts = o.filter("o_orderkey % 23 <> 0").select(ns, mount).distinct()
    suppliers = table(spark, sf_dir, "supplier")
    tag = F.concat(F.lit("v"), F.col("s_suppkey"))
    refs = suppliers.filter("s_suppkey % 4 <> 1").select(F.concat(F.lit("tags/"), tag).alias("name"))
    rows = o.select(ns, mount, path)
    return history.orphans(namespaces=namespaces, mounts=mounts, overlay=rows, observations=rows, seals=suppliers.select(tag.alias("tag")), refs=refs)


@query
def export_collisions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return trees.collisions(docs.selectExpr("source as dir", sql.SIBLINGS + " as name"))


@query
def latency_percentiles(spark, sf_dir):
    # sums of floats depend on their order by the last bits
    return metrics.percentiles(table(spark, sf_dir, "events"), "event_type", "value").withColumn("sum", F.round("sum", 6))


@query
def latency_medians(spark, sf_dir):
    return metrics.medians(table(spark, sf_dir, "events"), "event_type", "value")


@query
def event_shares(spark, sf_dir):
    return metrics.shares(table(spark, sf_dir, "events"), "event_type")


@query
def w6_tree(spark, sf_dir):
    i = F.col("id")
    return spark.range(table(spark, sf_dir, "events").count()).select(F.format_string("/d%04d/f%04d.txt", F.floor(i / 1000), i % 1000).alias("path"), i.alias("n"))


OBJECTS = ("tree_entry", "commits", "commit_parent", "contributions", "contribution_parent", "contribution_read", "snapshots", "conflicts", "conflict_base", "conflict_causal", "conflict_path", "objects")


@query
def edge_expansion(spark, sf_dir):
    return catalog.typed_edges(store.relations(spark, sf_dir, *OBJECTS))


@query
def gc_roots(spark, sf_dir):
    return catalog.gc_roots(store.relations(spark, sf_dir), store.OID).distinct()


@query
def gc_root_counts(spark, sf_dir):
    return catalog.root_counts(store.relations(spark, sf_dir), store.OID)


@query
def closure_verified(spark, sf_dir):
    of = store.relations(spark, sf_dir)
    return catalog.verified_closure(catalog.gc_roots(of, store.OID), catalog.typed_edges(of), store.spoilt(of["objects"]))


@query
def gc_live(spark, sf_dir):
    return catalog.live_objects(store.relations(spark, sf_dir), store.OID)


@query
def gc_sweep(spark, sf_dir):
    of = store.relations(spark, sf_dir, steps=True)
    edges = graph.links(catalog.typed_edges(of))  # for what is live and for what is held
    return catalog.sweep(of["objects"], catalog.live_objects(of, store.OID, edges), edges, 60, batch=300)


@query
def catalog_audit(spark, sf_dir):
    return catalog.audit(store.relations(spark, sf_dir), store.OID)


@query
def fsck(spark, sf_dir):
    of = store.relations(spark, sf_dir)
    return catalog.fsck(of | {"objects": store.spoilt(of["objects"])}, store.OID)


@query
def lca(spark, sf_dir):
    pairs = data.pairs(spark, sf_dir)
    return catalog.lca(pairs, graph.merge_bases(pairs, data.commits(spark, sf_dir)[1]))


@query
def tar_entries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("/d"), "doc_id").alias("path"), (F.col("n_chars") % 2 == 1).alias("exec"), F.octet_length("text").alias("size"))
    return filesystem.tar_entries(docs)


@query
def object_layout(spark, sf_dir):
    return filesystem.layout_audit(spark.sql(store.LAYOUT.format(sha="sha2", bits=", 256", documents="{d}"), d=table(spark, sf_dir, "documents")))


@query
def ledger_standing(spark, sf_dir):
    return catalog.ledger(store.relation(spark, sf_dir, "schema_migrations"))
