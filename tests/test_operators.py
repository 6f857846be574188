"""Small cases of the store's operators, against plain Python where there are many."""

import random

import pytest
from pyspark.sql import functions as F

from grovekit.functions import names, paths
from grovekit.operators import authority, catalog, graph, history, merging, metrics, sessions, trees, workspace

FILE = "path string, id string, exec boolean"


def tree(spark, files):
    return trees.entries(spark.createDataFrame([(p, i, x) for p, (i, x) in files.items()], FILE))


def nested(files):
    out = {}
    for path, (i, x) in files.items():
        *dirs, name = path.split("/")
        at = out
        for d in dirs:
            at = at.setdefault(d, {})
        at[name] = (i, x)
    return out


def merged(g, a, b, at=""):
    """Rows (path, outcome) of a recursive merge of nested dicts."""
    out = {}
    for name in sorted({*a, *b}):
        x, y, z, path = a.get(name), b.get(name), (g or {}).get(name), f"{at}{name}"
        if y is None or x is None:
            one, side = (x, "ours") if y is None else (y, "theirs")
            out[path] = "dropped" if z == one else side if z is None else "conflict"
        elif x == y:
            out[path] = "same"
        elif z == x:
            out[path] = "theirs"
        elif z == y:
            out[path] = "ours"
        elif isinstance(x, dict) and isinstance(y, dict):
            out |= merged(z if isinstance(z, dict) else {}, x, y, path + "/")
        else:
            out[path] = "conflict"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_three_way(spark, seed):
    rnd = random.Random(seed)
    places = ["a", "b", "d", "d/x", "d/y", "e/f/g", "e/h"]

    def files():
        out = {p: (rnd.choice("123"), rnd.random() < 0.2) for p in places if rnd.random() < 0.7}
        return {p: v for p, v in out.items() if not any(q.startswith(p + "/") for q in out)}

    g, a, b = files(), files(), files()
    if not (g and a and b):
        pytest.skip("an empty tree")
    rows = merging.three_way(tree(spark, g), tree(spark, a), tree(spark, b)).collect()
    ng, na, nb = nested(g), nested(a), nested(b)
    if na != nb and na != ng and nb != ng:
        assert {r.path: r.outcome for r in rows} == merged(ng, na, nb)
    else:
        assert [r.path for r in rows] == [""]


def test_rename_conflicts(spark):
    g = {"a": ("1", False), "b": ("2", False), "k": ("9", False)}
    a = {"x": ("1", False), "c": ("2", False), "k": ("9", False)}
    b = {"y": ("1", False), "c": ("2", False), "k": ("9", False), "n": ("5", False)}
    rows = merging.rename_conflicts(*(tree(spark, f) for f in (g, a, b))).collect()
    assert [(r.path, r.a, r.b, r.base) for r in rows] == [("a", None, None, "1")]  # b went to c on both sides


def test_overlay(spark):
    base = spark.createDataFrame([("d/x", "1", False), ("d/y", "2", False), ("f", "3", False), ("z", "4", False)], FILE)
    edits = spark.createDataFrame([("d", "9", False), ("f/x", None, False), ("n/m", "5", True)], FILE)
    rows = {(r.path, r.id) for r in trees.overlay_fold(base, edits).collect()}
    assert rows == {("d", "9"), ("n/m", "5"), ("z", "4")}  # a removal below a file takes the file


def test_merge_bases_criss_cross(spark):
    edges = spark.createDataFrame([("a", "base"), ("b", "base"), ("base", "root"), ("a2", "a"), ("a2", "b"), ("b2", "b"), ("b2", "a")], "src string, dst string")
    heads = spark.createDataFrame([(1, "a2", "b2"), (2, "a", "b"), (3, "a", "a")], "pair long, a string, b string")
    rows = {(r.pair, r.base) for r in graph.merge_bases(heads, edges).collect()}
    assert rows == {(1, "a"), (1, "b"), (2, "base"), (3, "a")}


def test_closure_limit(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    with pytest.raises(ValueError):
        graph.closure(spark.createDataFrame([(0, 1)], "key long, node long"), edges, limit=2)


REFS = "ref string, head string, kind string, protected boolean, sealed boolean"


def cas_one_by_one(proposals, refs, retired):
    heads, out = {r[0]: list(r[1:]) for r in refs}, {}
    for seq, ref, agent, kind, expected, new, allowed in sorted(proposals):
        if kind != "commit" and ref.startswith("heads/"):
            out[seq] = "invalid"
        elif ref not in heads:
            out[seq] = "retired" if ref in retired else "updated"
            if ref not in retired:
                heads[ref] = [new, kind, False, False]
        elif heads[ref][1] != kind:
            out[seq] = "invalid"
        elif heads[ref][3]:
            out[seq] = "sealed"
        elif heads[ref][2] and not allowed:
            out[seq] = "denied"
        elif heads[ref][0] == expected:
            out[seq], heads[ref][0] = "updated", new
        else:
            out[seq] = "forked"
    return out


@pytest.mark.parametrize("seed", range(2))
def test_cas_chain(spark, seed):
    rnd = random.Random(seed)
    names = ["heads/a", "heads/b", "heads/c", "odd/x", "odd/y", "heads/gone"]
    refs = [("heads/a", "v0", "commit", False, False), ("heads/b", "v1", "commit", True, False), ("heads/c", "v0", "commit", False, True)]
    proposals = [(i, rnd.choice(names), "u 1", rnd.choice(["commit", "commit", "commit", "tree"]), rnd.choice([None, "v0", "v1", "v2"]), rnd.choice(["v0", "v1", "v2", "v3"]), rnd.random() < 0.5) for i in range(150)]
    rows = workspace.cas_chain(spark.createDataFrame(proposals, "seq long, ref string, agent string, kind string, expected string, new string, allowed boolean"), spark.createDataFrame(refs, REFS), spark.createDataFrame([("heads/gone",)], "name string")).collect()
    assert {r.seq: r.outcome for r in rows} == cas_one_by_one(proposals, refs, {"heads/gone"})
    assert all((r["at"] == r.ref) == (r.outcome == "updated") for r in rows) and any(r["at"] == f"forks/{r.ref}/u_1/{r.seq}" for r in rows)


def test_percentiles(spark):
    rows = metrics.percentiles(spark.createDataFrame([("t", float(v)) for v in (4, 1, 3, 2)] + [("u", 7.0), ("u", None)], "g string, v double"), "g", "v").collect()
    assert {(r.g, r.n, r.p50, r.p99, r.max) for r in rows} == {("t", 4, 3.0, 4.0, 4.0), ("u", 1, 7.0, 7.0, 7.0)}


def test_authority():
    cap = authority.parse(["ops=read,write", "ops=read", "time<=5", "time<=3", "agent=a", "agent=b"])
    assert cap.ops == {"read"} and cap.until == 3 and cap.poisoned
    with pytest.raises(ValueError):
        authority.parse(["size=3"])
    assert authority.chain(b"k", ["a", "b"]) == authority.chain(authority.chain(b"k", ["a"]), ["b"])


def test_names_and_paths(spark):
    rows = spark.createDataFrame([("forks/inbox/a",), ("inbox/a/b",), ("heads//x",)], "n string")
    got = rows.select("n", names.valid_ref(F.col("n")).alias("ok"), names.ref_kind(F.col("n")).alias("kind")).collect()
    assert [(r.ok, r.kind) for r in got] == [(True, "snapshot"), (True, "snapshot"), (False, "commit")]
    p = spark.createDataFrame([("",), ("a/b/",), ("/a//b",)], "p string").select(paths.normalize_abs(F.col("p")).alias("x"))
    assert [r.x for r in p.collect()] == ["/", "/a/b", None]


def test_heads_of_all_conversations(spark, tmp_path):
    from grovekit import catalogue

    turns = {c: 1 + c * 7 % 4 for c in range(60) if c != 50}
    rows = [(c, t, "user" if t % 2 else "bot") for c, n in turns.items() for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string").write.parquet(str(tmp_path / "conversations.parquet"))
    nodes = {c * 100 + t: role for c, t, role in rows}
    parents = {n: [] for n in nodes}
    for c, n in turns.items():
        for t in range(1, n):
            parents[c * 100 + t].append(c * 100 + t - 1)
        if c:
            parents[c * 100].append(c // 2 * 100)
        if c and n > 1:
            parents[c * 100 + n - 1].append(c // 3 * 100)

    def above(node):
        seen, todo = set(), [node]
        while todo:
            x = todo.pop()
            if x in nodes and x not in seen:
                seen.add(x)
                todo += parents[x]
        return seen

    head = {c: c * 100 + n - 1 for c, n in turns.items()}
    pairs = [(c, head[c], head[c + 1]) for c in turns if c + 1 in turns]
    bases = set()
    for c, a, b in pairs:
        common = above(a) & above(b)
        bases |= {(c, x) for x in common if not any(x in above(y) - {y} for y in common)}
    want = {
        "commit_ancestry": {(a, x) for _, a, _ in pairs for x in above(a)},
        "merge_bases": bases,
        "contribution_union": {(c, f"{nodes[x]}:{x % 7}") for c, a, b in pairs for x in above(a) | above(b)},
    }
    for name, rows in want.items():
        assert sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect())) == sorted(rows)


def test_import_and_export(spark, tmp_path):
    import hashlib
    import tarfile

    from grovekit.sources import filesystem

    root = tmp_path / "in"
    texts = {"a.txt": b"one", "a/x": b"", "b/c/d é.bin": bytes(range(256)), "z%20q": b"two"}
    for path, content in {**texts, ".git/skip": b"no"}.items():
        if path == "a.txt" or path != "a/x":
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_bytes(content)
    (root / "a").mkdir(exist_ok=True)
    (root / "a/x").write_bytes(b"")
    modes = spark.createDataFrame([("a.txt", 0o100), ("z%20q", 0o644)], "path string, mode int")
    files = filesystem.scan(spark, str(root), modes)
    assert {r.path: (bytes(r.content), r.id, r.exec, r.size) for r in files.collect()} == {p: (c, hashlib.sha256(c).hexdigest(), p == "a.txt", len(c)) for p, c in texts.items()}
    assert filesystem.write_tar(files, str(tmp_path / "o.tar")) == len(texts) + 3
    with tarfile.open(tmp_path / "o.tar") as tar:
        held = [(m.name, m.isdir(), m.mode, m.mtime, tar.extractfile(m).read() if m.isfile() else None) for m in tar]
    assert [h[0] for h in held] == ["a", "a/x", "a.txt", "b", "b/c", "b/c/d é.bin", "z%20q"]
    assert all(h[3] == 0 and (h[1] or h[4] == texts[h[0]]) and h[2] == (0o755 if h[1] or h[0] == "a.txt" else 0o644) for h in held)
    filesystem.write_tar(files.repartition(3), str(tmp_path / "p.tar"))
    assert (tmp_path / "o.tar").read_bytes() == (tmp_path / "p.tar").read_bytes()
    (root / "b/_kept").write_bytes(b"yes")
    with pytest.raises(ValueError):
        filesystem.scan(spark, str(root))


def test_put_stream(spark, tmp_path):
    from grovekit.streaming import blobs

    where, schema = str(tmp_path / "in"), "content binary, agent string, seq long"
    batches = [[(b"a", "x", 2), (b"a", "y", 1), (b"b", "x", 3)], [(b"a", "z", 4), (b"c", "z", 5), (b"c", "y", 6)]]
    for n, rows in enumerate([*batches, []]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        query = blobs.put_stream(spark.readStream.schema(schema).parquet(where), str(tmp_path / "store"), str(tmp_path / "check"), once=True)
        query.awaitTermination()
        assert query.exception() is None
        got = sorted((r.first_seq, r.first_agent, r.size) for r in blobs.stored(spark, str(tmp_path / "store")).collect())
        assert got == ([(1, "y", 1), (3, "x", 1)] if n == 0 else [(1, "y", 1), (3, "x", 1), (5, "z", 1)])


def test_gc_fails_closed(spark):
    from grovekit.sources import store

    empty = {n: spark.sql(q, events=spark.createDataFrame([], "event_id long, user_id long, event_type string"), documents=spark.createDataFrame([], "doc_id long, n_chars long")) for n, q in store.RELATIONS.items()}
    empty = {n: df.limit(0) for n, df in empty.items()}
    refs = spark.createDataFrame([("heads/a", "c1", "commit", False, False)], empty["refs"].schema)
    commits = spark.createDataFrame([("c1", "t1", None)], empty["commits"].schema)
    have = lambda *ids: spark.createDataFrame([(i, k, 1, 1) for i, k in ids], "oid string, kind string, size long, age long")
    of = empty | {"refs": refs, "commits": commits}
    assert {r.node for r in catalog.live_objects(of | {"objects": have(("c1", "commit"), ("t1", "tree"))}, store.OID).collect()} == {"c1", "t1"}
    with pytest.raises(ValueError):
        catalog.live_objects(of | {"objects": have(("c1", "commit"))}, store.OID)
    with pytest.raises(ValueError):
        catalog.gc_roots(of | {"observations": spark.createDataFrame([("n", "/", "p", "odd", "b1")], empty["observations"].schema)}, store.OID)
    with pytest.raises(ValueError):
        catalog.sweep(have(), refs.select(F.col("oid").alias("node")), catalog.typed_edges(of), 59)
    for versions, verdict in (([], "damaged"), ([1, 3], "damaged"), ([1, 1, 2], "damaged"), ([1, 2], "needs-migration"), ([1, 2, 3], "current"), ([1, 2, 3, 4], "newer")):
        assert catalog.ledger(spark.createDataFrame([(v,) for v in versions], "version long")).first().verdict == verdict
    found = {r.code for r in catalog.fsck(of | {"objects": have(("c1", "tree")), "commits": commits}, store.OID).collect()}
    assert found == {"TYPE_MISMATCH", "OBJECT_READ", "REFLOG_MISSING", "SCHEMA_LEDGER"}


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_reach(spark, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW", few)
    rnd = random.Random(21)
    pairs = [(i, i + 1) for i in range(150)] + [(60, 10), (300, 301), (301, 300), (5, 5), (None, 3), (7, None)]
    pairs += [(rnd.randrange(150, 260), rnd.randrange(150, 260)) for _ in range(120)] + [(i, 400 + i % 2) for i in range(150)] * 2 + [(400, 401), (401, 402)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for starts in ([40, 40, None], [0, 200, 999], [300, 160, 161], []):
        want, todo = set(), [s for s in starts if s is not None]
        while todo:
            node = todo.pop()
            if node not in want:
                want.add(node)
                todo += [d for s, d in pairs if s == node and d is not None]
        got = [r.node for r in graph.reach(spark.createDataFrame([(s,) for s in starts], "node long"), graph.links(edges)).collect()]
        assert sorted(got) == sorted(want)


def test_sweep_of_long_history(spark, monkeypatch):
    """Rounds don't follow the length of a chain; repeated objects fill no batch."""
    monkeypatch.setattr(graph, "FEW", 0)
    rounds = []
    keep = graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: rounds.append(1) or keep(df))
    edges = spark.createDataFrame([(f"{k}{i:03}", f"{k}{i + 1:03}") for k in "ab" for i in range(200)], "src string, dst string")
    objects = spark.createDataFrame([(f"{k}{i:03}", 1, 70) for k in "ab" for i in range(201)] * 2, "oid string, size long, age long")
    live = graph.reach(spark.createDataFrame([("b000",)], "node string"), graph.links(edges))
    got = sorted(r.oid for r in catalog.sweep(objects, live, edges, 60, batch=120).collect())
    assert got == [f"a{i:03}" for i in range(120)] and len(rounds) < 50


def test_suppressed_count_without_visible_names(spark):
    names_ = spark.createDataFrame([("heads/a",), ("heads/b",)], "name string")
    rows = authority.visible(names_, authority.parse(["ops=read", "ref=tags/*"]), F.lit("read"), F.lit(1)).collect()
    assert [(r.name, r.suppressed) for r in rows] == [(None, 2)]


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(45)] + [(45, 0), (7, 30), (50, 51)], "src long, dst long")
    rows = graph.closure(spark.createDataFrame([(0, 0), (1, 40), (1, 40), (2, None), (3, 99)], "key long, node long"), edges).collect()
    assert {(r.key, r.node) for r in rows} == {(0, i) for i in range(46)} | {(1, i) for i in range(46)} | {(3, 99)} and len(rows) == 93


def test_ranks_of_ties(spark):
    df = spark.createDataFrame([("t", 5.0)] * 900 + [("t", float(i)) for i in range(100)] + [(None, 1.0), ("e", None)], "g string, v double")
    got = {r.g: r for r in metrics.percentiles(df, "g", "v").collect()}
    values = sorted([5.0] * 900 + [float(i) for i in range(100)])
    at = lambda p: values[int((len(values) - 1) * p + 0.5)]
    assert (got["t"].n, got["t"]["sum"], got["t"].p50, got["t"].p95, got["t"].p99, got["t"].max) == (1000, sum(values), at(0.5), at(0.95), at(0.99), 99.0)
    assert got[None].p50 == 1.0 and (got["e"].n, got["e"].p50, got["e"].max) == (0, 0.0, 0.0)


def test_sessions_on_odd_rows(spark):
    refs = spark.createDataFrame([("main", "c1", "commit", True, False), ("tags/v", "s1", "snapshot", True, True)], "name string, oid string, kind string, protected boolean, sealed boolean")
    objects = spark.createDataFrame([("c1", "commit"), ("c1", "commit"), ("s1", "snapshot"), ("b1", "blob")], "oid string, kind string")
    snapshots = spark.createDataFrame([("s1", "c1", 9)], "oid string, commit string, spec int")
    specs = spark.createDataFrame([("main",), ("main",), ("ref:tags/v",), ("oid:b1",), ("oid:c9",), ("oid:",), ("",), (None,), ("no",)], "spec string")
    got = {r.spec: (r.state, r.commit) for r in sessions.peel(specs, refs, objects, snapshots, "^[a-z][0-9]+$").collect()}
    assert got == {"main": ("ok", "c1"), "ref:tags/v": ("ok", "c1"), "oid:b1": ("notcommit", None), "oid:c9": ("missing", None), "oid:": ("invalid", None), "": ("invalid", None), None: ("invalid", None), "no": ("notfound", None)}
    assert sessions.peel(specs.limit(0), refs, objects, snapshots).isEmpty()
    asked = spark.createDataFrame([(1, "n", "/", "main", "rw"), (2, "n", "/", "main", "ro"), (3, None, "/", "main", "ro"), (4, "n", None, "main", "ro"), (5, "n", "a//b", "main", "ro")], "seq int, ns_id string, path string, spec string, mode string")
    spaces = spark.createDataFrame([("n",)], "id string")
    mounts = spark.createDataFrame([("n", "/", "other", "rw")], "ns_id string, path string, spec string, mode string")
    none = spark.createDataFrame([], "ns_id string, mount string")
    work = spark.createDataFrame([("n", "/")], "ns_id string, mount string")
    plan = lambda staged: {r.seq: r.outcome for r in sessions.mount_plan(asked, spaces, mounts, refs, objects, staged, "^[a-z][0-9]+$").collect()}
    assert plan(none) == {1: "denied", 2: "mounted", 3: "unknown", 4: "invalid", 5: "invalid"}
    assert plan(work)[2] == "staged"


def test_rename_moves_trees_with_staged_work(spark):
    mounts = spark.createDataFrame([("n", "/", "T", "rw")], "ns string, mount string, tree string, mode string")
    entries = spark.createDataFrame([("T", "a", "tree", "A"), ("T", "a/x", "blob", "1"), ("T", "a/d", "tree", "D"), ("T", "a/d/y", "blob", "2"), ("T", "a/d/z", "blob", "3"), ("T", "ab", "blob", "4")], "tree string, path string, kind string, oid string")
    overlay = spark.createDataFrame([("n", "/", "a/d", None), ("n", "/", "a/x", "9"), ("n", "/", "a/new/w", "8"), ("n", "/", "up", "7")], "ns string, mount string, path string, id string")
    asks = [(1, "a", "b"), (2, "ab", "a/q"), (3, "a/d", "c"), (4, "a/d/y", "c"), (5, "up/in", "c"), (6, "a", "up/q"), (7, "up", "new"), (8, "a", "a"), (9, "a", "a/k"), (10, "a/x", "a"), (11, None, "b")]
    told, rows = sessions.rename_plan(spark.createDataFrame([(s, "n", "/", a, b) for s, a, b in asks], "seq int, ns string, mount string, from string, to string"), mounts, entries, overlay)
    got = {r.seq: (r.outcome, r.kind, r.entries) for r in told.collect()}
    assert got[1] == ("renamed", "tree", 2) and got[2] == ("renamed", "blob", 1) and got[7] == ("renamed", "blob", 1)
    assert [got[i][0] for i in (3, 4, 5, 6, 8, 9, 10, 11)] == ["notfound", "notfound", "invalid", "conflict", "same", "inside", "above", "notfound"]
    assert sorted((r.path, r.id or "") for r in rows.filter("seq = 1").collect()) == [("a", ""), ("b/new/w", "8"), ("b/x", "9")]


def test_writes_reads_and_walks_on_odd_rows(spark):
    frame = spark.createDataFrame
    spaces, mounts = frame([("n", "a")], "id string, agent_id string"), frame([("n", "/m", "rw"), ("n", "/m/in", "ro")], "ns_id string, path string, mode string")
    work = frame([("n", "/m", "d/x")], "ns_id string, mount string, path string")
    asks = frame([(1, "n", "/else"), (2, "n", "/m/in/f"), (3, "n", "/m/d"), (4, "n", "/m/d/x"), (5, "n", "/m/d/x/y"), (6, "n", "m/e/"), (7, "n", None), (8, None, "/m/e"), (9, "n", "/m")], "seq int, ns_id string, path string")
    got = {r.seq: (r.outcome, r.path) for r in sessions.write_plan(asks, spaces, mounts, work).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["nomount", "readonly", "conflict", "staged", "conflict", "staged", "invalid", "unknown", "root"] and got[6][1] == "e"
    reads = frame([(1, "n", "/m", "p", "blob", "1"), (2, "n", "/m", "p", "absent", None), (3, "n", "/m", "q", "blob", "2"), (4, "n", "/m", "r", "absent", None)], "seq int, ns_id string, mount string, path string, kind string, oid string")
    was = frame([("n", "/m", "q", "blob", "2"), ("n", "/m", "q", "blob", "2"), ("n", "/m", "p", "blob", "1")], "ns_id string, mount string, path string, kind string, oid string")
    assert sorted((r.path, r.kind) for r in sessions.observe_plan(reads, was).collect()) == [("p", "absent"), ("r", "absent")]
    tree = frame([("r", "a", "tree", "t"), ("t", "x", "blob", "1"), ("r", "b", "tree", "t"), ("r", "c", "tree", "gone"), ("r", "a", "tree", "t")], "tree string, name string, kind string, id string")
    roots = frame([("r",), ("r",), (None,), ("no",)], "root string")
    assert sorted(r.path for r in sessions.tree_walk(roots, tree).collect()) == ["a", "a/x", "b", "b/x", "c"]
    assert sessions.tree_walk(roots.limit(0), tree).isEmpty()
    refs = frame([("h", "c1", "commit"), ("conflicts/h/1", "k1", "conflict")], "name string, oid string, kind string")
    objects = frame([("t1", "tree"), ("t2", "tree"), ("t3", "tree")], "oid string, kind string")
    one, pair = frame([("k1", "t1", "t2")], "oid string, ours string, theirs string"), frame([("k1", "b1"), ("k1", "b2")], "oid string, base string")
    asks = frame([(1, "k1", "h", "ours"), (2, "k1", "h", "oid:t3"), (3, "k9", "h", "ours"), (4, "k1", None, "ours"), (5, "k1", "h", "oid:t2")], "seq int, conflict string, into string, choice string")
    paths, outside = frame([("k1", "p")], "oid string, path string"), frame([], "conflict string, tree string")
    settle = lambda p: {r.seq: r.outcome for r in sessions.resolve_plan(asks, refs, objects, one, frame([("k1", "c1")], "oid string, commit string"), pair, p, outside).collect()}
    assert settle(paths) == {1: "resolved", 2: "bases", 3: "missing", 4: "notfound", 5: "bases"}
    assert settle(paths.limit(0)) == {1: "resolved", 2: "sides", 3: "missing", 4: "notfound", 5: "resolved"}
