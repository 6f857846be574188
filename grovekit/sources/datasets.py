"""The store's relations, derived from the driver's tables.

A side is told by expressions that Spark and DuckDB both read, but for the
hash, so that queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From the path, id and exec of the base to those of each side; rows without a path are gone.
SIDES = {
    "ours": {
        "path": "case when d = 'es/src3' or d = 'fr/src5' then null when d = 'de/src6' then concat('de/src6o/d', doc_id) when doc_id % 20 = 0 then null when doc_id % 20 = 3 then concat(d, '/o', doc_id) else path end",
        "id": "case when d <> 'de/src6' and doc_id % 20 = 1 then {sha}(concat('o', doc_id){bits}) else id end",
        "exec": "case when d <> 'de/src6' and doc_id % 20 = 2 then not exec else exec end",
        "more": [("concat('new/o/d', doc_id)", "{sha}(concat('n', doc_id){bits})", "doc_id % 20 = 4"), ("concat('new/s/d', doc_id)", "{sha}(concat('os', doc_id){bits})", "doc_id % 50 = 7"), ("'fr/src5'", "{sha}('fr/src5'{bits})", "doc_id = 0")],
    },
    "theirs": {
        "path": "case when d = 'de/src4' then null when d = 'de/src6' then concat('de/src6t/d', doc_id) when doc_id % 21 = 0 then null when doc_id % 21 = 3 then concat(d, '/t', doc_id) else path end",
        "id": "case when d <> 'de/src6' and doc_id % 21 = 1 then {sha}(concat('t', doc_id){bits}) else id end",
        "exec": "case when d <> 'de/src6' and doc_id % 21 = 2 then not exec else exec end",
        "more": [("concat('new/t/d', doc_id)", "{sha}(concat('m', doc_id){bits})", "doc_id % 21 = 4"), ("concat('new/s/d', doc_id)", "{sha}(concat('ts', doc_id){bits})", "doc_id % 50 = 7")],
    },
    "overlay": {
        "path": "case when d = 'es/src7' or d = 'fr/src8' then null when doc_id % 13 in (0, 1) then path when doc_id % 13 = 3 then concat(path, 'x') when doc_id % 13 = 4 then concat(path, '/x') end",
        "id": "case when doc_id % 13 = 1 then {sha}(concat('e', doc_id){bits}) end",
        "exec": "false",
        "more": [("concat('extra/d', doc_id)", "{sha}(concat('x', doc_id){bits})", "doc_id % 13 = 2"), ("'es/src7'", "cast(null as varchar(99))", "doc_id = 0"), ("'fr/src8'", "{sha}('fr/src8'{bits})", "doc_id = 0")],
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, size, agent, seq)"""
    return table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("oid"), F.octet_length("text").cast("long").alias("size"), F.col("source").alias("agent"), F.col("doc_id").alias("seq"))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "lang", "source").alias("d"), F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/d"), F.col("doc_id")).alias("path"), F.sha2("text", 256).alias("id"), (F.col("n_chars") % 2 == 1).alias("exec"))


def files(spark: SparkSession, sf_dir: str, side: str = "base", base: DataFrame | None = None) -> DataFrame:
    """(path, id, exec) of the base, of ours or theirs, or of the edits of an overlay (id null: removed); `base` may hold the hashed documents."""
    base = hashed(spark, sf_dir) if base is None else base
    if side == "base":
        return base.select("path", "id", "exec")
    told = SIDES[side]
    spell = lambda x: F.expr(x.format(sha="sha2", bits=", 256"))
    rows = base.select(spell(told["path"]).alias("path"), spell(told["id"]).alias("id"), spell(told["exec"]).alias("exec")).filter("path is not null")
    for path, id_, where in told["more"]:
        rows = rows.unionByName(base.filter(where).select(spell(path).alias("path"), spell(id_).cast("string").alias("id"), F.lit(False).alias("exec")))
    return rows


def files_sql(side: str = "base") -> str:
    """The same in DuckDB."""
    base = "select doc_id, concat(lang, '/', source) as d, concat(lang, '/', source, '/d', doc_id) as path, sha256(text) as id, n_chars % 2 = 1 as exec from documents"
    if side == "base":
        return f"select path, id, exec from ({base})"
    told = SIDES[side]
    spell = lambda x: x.format(sha="sha256", bits="")
    parts = [f"select * from (select {spell(told['path'])} as path, {spell(told['id'])} as id, {spell(told['exec'])} as exec from ({base})) where path is not null"]
    parts += [f"select {spell(p)}, {spell(i)}, false from ({base}) where {w}" for p, i, w in told["more"]]
    return " union all ".join(parts)


def commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(node, role) and edges (src, dst): turns follow turns, a first turn that of half its conversation, a last one also that of a third."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("node"), "conv_id", "turn", "role")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    conv = F.col("conv_id")
    first = F.floor(conv / 2) * 100
    edges = turns.filter("turn > 0").select(F.col("node").alias("src"), (F.col("node") - 1).alias("dst"))
    edges = edges.union(turns.filter("turn = 0 and conv_id > 0").select("node", first.cast("long")))
    edges = edges.union(last.filter("turn > 0 and conv_id > 0").select(conv * 100 + F.col("turn"), (F.floor(conv / 3) * 100).cast("long")))
    return turns.select("node", "role"), edges.join(turns.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


COMMITS_SQL = """turns as (select conv_id * 100 + turn as node, conv_id, turn, role from conversations),
alledges as (select node as src, node - 1 as dst from turns where turn > 0
  union all select node, (conv_id // 2) * 100 from turns where turn = 0 and conv_id > 0
  union all select conv_id * 100 + max(turn), (conv_id // 3) * 100 from turns group by conv_id having max(turn) > 0 and conv_id > 0),
edges as (select src, dst from alledges where dst in (select node from turns))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, a, b): heads of neighbouring conversations."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    head = (F.col("conv_id") * 100 + F.col("turn")).alias("b")
    right = last.select((F.col("conv_id") - 1).alias("conv_id"), head)
    return last.withColumn("a", F.col("conv_id") * 100 + F.col("turn")).join(right, "conv_id").select(F.col("conv_id").alias("pair"), "a", "b")


PAIRS_SQL = """heads as (select conv_id, conv_id * 100 + max(turn) as head from conversations group by conv_id),
pairs as (select x.conv_id as pair, x.head as a, y.head as b from heads x join heads y on y.conv_id = x.conv_id + 1)"""

#: Object graph of the trade tables: (kind, table, node, parent's node, size, age).
GRAPH = (
    ("region", "region", "concat('r', r_regionkey)", None, "10", "r_regionkey * 7"),
    ("nation", "nation", "concat('n', n_nationkey)", "concat('r', n_regionkey)", "20", "n_nationkey * 5"),
    ("customer", "customer", "concat('c', c_custkey)", "concat('n', c_nationkey)", "100 + c_custkey % 50", "c_custkey % 97"),
    ("order", "orders", "concat('o', o_orderkey)", "concat('c', o_custkey)", "50 + o_orderkey % 30", "o_orderkey % 89"),
    ("line", "lineitem", "concat('l', l_orderkey, '-', l_linenumber)", "concat('o', l_orderkey)", "5 + l_linenumber", "(l_orderkey + l_linenumber) % 83"),
)
ROOTS = "kind = 'region' and node in ('r0', 'r3') or kind = 'nation' and size = 20 and age % 15 = 5"


def objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(node, kind, size, age) and edges (src, dst, expected)."""
    nodes = edges = None
    for kind, name, node, up, size, age in GRAPH:
        t = table(spark, sf_dir, name)
        own = t.selectExpr(f"{node} as node", f"'{kind}' as kind", f"cast({size} as bigint) as size", f"cast({age} as bigint) as age")
        nodes = own if nodes is None else nodes.unionByName(own)
        if up:
            link = t.selectExpr(f"{up} as src", f"{node} as dst", f"'{kind}' as expected")
            edges = link if edges is None else edges.unionByName(link)
    return nodes, edges


def objects_sql() -> str:
    nodes = " union all ".join(f"select {n} as node, '{k}' as kind, cast({s} as bigint) as size, cast({a} as bigint) as age from {t}" for k, t, n, _, s, a in GRAPH)
    edges = " union all ".join(f"select {u} as src, {n} as dst, '{k}' as expected from {t}" for k, t, n, u, _, _ in GRAPH if u)
    return f"objects as ({nodes}), edges as ({edges}), roots as (select node from objects where {ROOTS})"


#: Reference log from events; the hash stands for an object's id. Some rows are spoilt.
REFLOG = "select concat('heads/agents/u', user_id, '/main') as name, event_id as id, {sha}(concat('e', event_id){bits}) as new_oid, case when event_id % 37 = 0 then {sha}('x'{bits}) when prev is null then null else {sha}(concat('e', prev){bits}) end as old_oid, case when event_id % 41 = 0 then 'abandon' when event_id % 43 = 0 then 'fork' else 'cas' end as reason from (select *, lag(event_id) over (partition by user_id order by event_id) as prev from {events})"
REFS = "select name, case when user_id % 11 = 0 then {sha}('y'{bits}) else {sha}(concat('e', id){bits}) end as oid from (select concat('heads/agents/u', user_id, '/main') as name, user_id, max(event_id) as id from {events} group by user_id) where user_id % 13 <> 0 union all select 'heads/agents/nobody/main', {sha}('z'{bits})"


def reflog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(name, id, new_oid, old_oid, reason) and refs (name, oid)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return tuple(spark.sql(q.format(sha="sha2", bits=", 256", events="{e}"), e=events) for q in (REFLOG, REFS))


def reflog_sql() -> str:
    spell = lambda q: q.format(sha="sha256", bits="", events="events")
    return f"reflog as ({spell(REFLOG)}), refs as ({spell(REFS)})"
