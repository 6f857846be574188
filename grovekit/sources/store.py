"""A store's objects and catalog, derived from the driver's tables by text that Spark and DuckDB both read.

Ids are short: a letter for the kind and a number. Faults are planted by modulus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import kept
from .datasets import table

#: Events as steps of their users: step, user, the user's step before, the step before of the same type.
_E = "(select event_id as i, user_id as u, lag(event_id) over (partition by user_id order by event_id) as p, lag(event_id) over (partition by event_type order by event_id) as q from {events}) e"
#: Users with their first and last step.
_U = "(select user_id as u, min(event_id) as a, max(event_id) as z from {events} group by user_id) u"
_HEAD = "concat('heads/agents/u', u, '/main')"

RELATIONS = {
    # objects: a tree of ten trees of documents, commits by step, contributions, snapshots, conflicts
    "tree_entry": "select concat('t', doc_id % 10) as tree, concat('d', doc_id) as name, 'blob' as kind, concat('b', doc_id) as id from {documents} union all select distinct 'r0', concat('k', doc_id % 10), 'tree', concat('t', doc_id % 10) from {documents}",
    "commits": f"select concat('c', i) as oid, concat('t', i % 10) as tree, case when i % 3 = 0 and p is not null then concat('x', i) end as contrib from {_E}",
    "commit_parent": f"select concat('c', i) as oid, concat('c', p) as parent from {_E} where p is not null union all select concat('c', i), concat('c', q) from {_E} where q is not null and i % 17 = 0",
    "contributions": f"select concat('x', i) as oid, concat('c', p) as base, concat('t', i % 10) as tree from {_E} where i % 3 = 0 and p is not null",
    "contribution_parent": f"select concat('x', i) as oid, concat('c', p) as parent from {_E} where i % 3 = 0 and p is not null",
    "contribution_read": f"select concat('x', i) as oid, concat('d', i % 150) as path, concat('b', i % 150) as id from {_E} where i % 3 = 0 and p is not null",
    "snapshots": f"select concat('s', i) as oid, concat('t', i % 10) as tree, concat('c', i) as commit, concat('b', i % 150) as prov from {_E} where i % 40 = 7",
    "conflicts": f"select concat('k', i) as oid, concat('t', i % 10) as ours, concat('t', (i + 3) % 10) as theirs from {_E} where i % 53 = 11",
    "conflict_base": f"select concat('k', i) as oid, concat('t', (i + 5) % 10) as base from {_E} where i % 53 = 11",
    "conflict_causal": f"select concat('k', i) as oid, concat('c', i) as commit from {_E} where i % 53 = 11 union all select concat('k', i), concat('c', p) from {_E} where i % 53 = 11 and p is not null",
    "conflict_path": f"select concat('k', i) as oid, concat('d', i % 150) as path, concat('b', i % 150) as a, case when i % 2 = 0 then concat('t', i % 10) end as b, concat('b', (i + 1) % 150) as base from {_E} where i % 53 = 11",
    "objects": f"select concat('b', doc_id) as oid, 'blob' as kind, n_chars as size, doc_id % 97 as age from {{documents}} union all select distinct concat('t', doc_id % 10), 'tree', cast(50 as bigint), cast(9 as bigint) from {{documents}} union all select 'r0', 'tree', cast(50 as bigint), cast(9 as bigint) union all select concat('c', i), 'commit', cast(100 as bigint), i % 89 from {_E} union all select concat('x', i), 'contribution', cast(80 as bigint), i % 89 from {_E} where i % 3 = 0 and p is not null union all select concat('s', i), 'snapshot', cast(60 as bigint), i % 89 from {_E} where i % 40 = 7 union all select concat('k', i), 'conflict', cast(70 as bigint), i % 89 from {_E} where i % 53 = 11 union all select concat('z', i), 'blob', cast(10 as bigint), i % 89 from {_E} where i % 19 = 0",
    # the catalog
    "refs": f"""select {_HEAD} as name, concat('c', case when u % 11 = 0 then a else z end) as oid, case when u % 43 = 8 then 'tree' else 'commit' end as kind, false as protected, false as sealed from {_U} where u % 13 <> 0
union all select concat('tags/v', i), concat('s', i), case when i % 600 = 167 then 'commit' else 'snapshot' end, true, i % 120 <> 47 from {_E} where i % 40 = 7
union all select concat('conflicts/main/', i), concat('k', i), 'conflict', false, false from {_E} where i % 53 = 11
union all select concat('inbox/u', u, '/', case when i % 160 = 87 then 'no task' else 't' end, i), concat('s', i), 'snapshot', false, false from {_E} where i % 80 = 7
union all select concat('forks/main/u', u, '/', i), concat('c', i), 'commit', false, false from {_E} where i % 29 = 3
union all select concat('odd/', i), concat('c', i), case when i % 122 = 5 then 'thing' else 'tree' end, false, false from {_E} where i % 61 = 5
union all select 'main', concat('c', min(event_id)), 'commit', true, false from {{events}}""",
    "reflog": f"""select i as id, {_HEAD} as name, case when i % 37 = 0 then 'c999999999' when p is null then null else concat('c', p) end as old_oid, concat('c', i) as new_oid, case when i % 41 = 0 then 'abandon' when i % 43 = 0 then 'fork' else 'cas' end as reason from {_E}
union all select 1000000000 + i, concat('tags/v', i), null, concat('s', i), 'seal' from {_E} where i % 40 = 7 and i % 280 <> 127
union all select 1000000000 + i, concat('conflicts/main/', i), null, concat('k', i), 'conflict' from {_E} where i % 53 = 11
union all select 1000000000 + i, concat('forks/main/u', u, '/', i), case when p is not null then concat('c', p) end, concat('c', i), case when i % 58 = 3 then 'fork' else 'cas' end from {_E} where i % 29 = 3
union all select 1000000000 + min(event_id), 'main', null, concat('c', min(event_id)), 'init' from {{events}}""",
    "namespaces": f"select concat('n', u) as id, concat('u', u) as agent_id, case when u % 29 <> 4 then concat('c', z) end as pinned_oid, case when u % 37 = 9 then 'conflicts/main/11' when u % 7 <> 6 then {_HEAD} end as live_ref from {_U}",
    "mounts": f"""select concat('n', u) as ns_id, '/' as path, concat('ref:', {_HEAD}) as spec, 'rw' as mode, case when u % 47 = 3 then 'not an id' else concat('c', z) end as base_oid from {_U}
union all select concat('n', u), '/main', case when u % 17 = 3 then 'heads/gone' else 'main' end, 'ro', null from {_U}
union all select concat('n', u), '/raw', case when u % 19 = 5 then 'oid:??' else concat('oid:c', a) end, case when u % 5 = 2 then 'rw' else 'ro' end, null from {_U} where u % 3 = 1
union all select concat('gone', u), '/', 'main', 'ro', null from {_U} where u % 23 = 2""",
    "overlay": f"select distinct concat(case when i % 71 = 1 then 'lost' else 'n' end, u) as ns_id, case when i % 67 = 1 then '/nope' else '/' end as mount, concat('k', i % 10, '/d', i % 150) as path, case when i % 12 <> 1 then concat('b', i % 150) end as blob_oid from {_E} where i % 6 = 1",
    "observations": f"select distinct concat(case when i % 73 = 2 then 'lost' else 'n' end, u) as ns_id, case when i % 69 = 2 then '/nope' else '/' end as mount, concat('k', i % 10, case when i % 8 = 2 then '' else concat('/d', i % 150) end) as path, case when i % 8 = 2 then 'tree' when i % 16 = 6 then 'absent' else 'blob' end as kind, case when i % 8 = 2 then concat('t', i % 10) when i % 16 = 6 then null when i % 236 = 118 then 'no id' else concat('b', i % 150) end as oid from {_E} where i % 4 = 2",
    "seals": f"select concat('v', i) as tag, concat('s', i) as snap_oid, concat('c', i) as commit_oid, concat('t', i % 10) as tree_oid from {_E} where i % 40 = 7 and i % 200 <> 87 union all select concat('w', i), concat('s', i), concat('c', i), 'r0' from {_E} where i % 320 = 7",
    "landmarks": f"select concat('s', i) as oid, case when i % 480 = 207 then 'thing' else 'snapshot' end as kind from {_E} where i % 40 = 7 and i % 360 <> 47 union all select concat('c', i), 'commit' from {_E} where i % 40 = 7",
    "object_intro": "select concat('b', doc_id) as oid, 'r0' as commit_oid from {documents} where doc_id % 11 = 3 union all select concat('b', doc_id), 'c1' from {documents} where doc_id % 11 = 4",
    "schema_migrations": "select distinct 1 + 2 * (event_id % 2) as version from {events}",
}
#: Proposals to move references, what they expect, and references as they stand.
_REF = "concat('heads/', event_type, '/', user_id % 12)"
PROPOSALS = f"select event_id as seq, ref, concat('u:', user_id) as agent, case when event_id % 31 = 4 then 'tree' else 'commit' end as kind, {{expected}} as expected, concat('c', event_id) as new, event_id % 4 = 1 as allowed from (select *, lag(event_id) over (partition by ref order by event_id) as p, lag(event_id, 2) over (partition by ref order by event_id) as q from (select *, case when event_id % 101 = 7 then concat('tags/', event_type) when event_id % 103 = 7 then 'heads/../x' else {_REF} end as ref from {{events}}) a) b"
EXPECTED = {"batch": "case when event_id % 5 = 0 then 'old' when event_id % 7 <> 0 then 'h' end", "chained": "case when event_id % 3 = 0 and p is not null then concat('c', p) when event_id % 3 = 1 and q is not null then concat('c', q) when event_id % 2 = 0 then 'h' end"}
HEADS = f"select distinct {_REF} as ref, 'h' as head, case when user_id % 12 = 8 then 'tree' else 'commit' end as kind, user_id % 12 = 6 as protected, user_id % 12 = 7 as sealed from {{events}} where user_id % 12 not in (4, 5, 9)"
RETIRED = f"select distinct {_REF} as name from {{events}} where user_id % 12 = 5"
#: Sessions over orders: three versions of a tree, mounts, reads, staged work, check-ins.
_V = "(select 0 as v union all select 1 union all select 2) t"
SESSIONS = {
    "entries": f"select concat('T', v) as tree, concat('s', o_orderkey % 7, '/o', o_orderkey) as path, 'blob' as kind, case when (o_orderkey * (v + 1)) % 31 = 1 then concat('x', o_orderkey) else concat('o', o_orderkey) end as oid from {{orders}} cross join {_V} where (o_orderkey + v) % 29 <> 0 union all select distinct concat('T', v), concat('s', o_orderkey % 7), 'tree', concat('D', v, '-', case when o_orderkey % 7 < 3 then 0 else v end) from {{orders}} cross join {_V}",
    "mounted": "select distinct concat('c', o_custkey) as ns, concat('/m', o_orderkey % 3) as mount, concat('T', o_custkey % 3) as tree, case when o_custkey % 6 = 5 then 'ro' else 'rw' end as mode, concat('heads/', o_custkey % 40) as ref, concat('b', o_custkey % 80) as base from {orders} where o_custkey % 41 <> 0",
    "reads": "select concat('c', o_custkey) as ns, concat('/m', o_orderkey % 3) as mount, concat('s', o_orderkey % 7, case when o_orderkey % 19 = 3 then '' else concat('/o', o_orderkey) end) as path, case when o_orderkey % 19 = 3 then 'tree' when o_orderkey % 17 = 0 then 'absent' else 'blob' end as kind, case when o_orderkey % 19 = 3 then 'D0-0' when o_orderkey % 17 <> 0 then concat('o', o_orderkey) end as oid from {orders} where o_custkey % 5 <> 0",
    "staged": "select concat('c', o_custkey) as ns, concat('/m', o_orderkey % 3) as mount, case when o_custkey % 53 = 1 then concat('s', o_orderkey % 7) else concat('s', o_orderkey % 7, '/o', o_orderkey) end as path, case when o_orderkey % 4 = 1 then concat('o', o_orderkey) when o_orderkey % 4 = 2 then concat('n', o_orderkey) end as id from {orders} where o_orderkey % 37 = 0 or o_custkey % 53 = 1 or o_custkey % 10 = 0",
    "heads": "select distinct concat('heads/', o_custkey % 40) as ref, concat('b', o_custkey % 40) as head from {orders}",
    "requests": "select 10 * o_custkey + k as seq, concat('c', o_custkey) as ns, concat('/m', k) as mount from (select distinct o_custkey from {orders}) c cross join (select 0 as k union all select 1 union all select 2 union all select 3) m",
}
#: Requests of sessions. Some name what isn't there, or what may not be.
_DIR, _FILE = "concat('s', o_orderkey % 7, '/p', cast(floor(o_orderkey / 50) as bigint))", "concat('s', o_orderkey % 7, '/p', cast(floor(o_orderkey / 50) as bigint), '/o', o_orderkey)"
_NEXT = "concat('s', (o_orderkey + 50) % 7, '/p', cast(floor((o_orderkey + 50) / 50) as bigint))"
_PLACE = "concat('c', o_custkey) as ns, concat('/m', o_orderkey % 3) as mount"
REQUESTS = {
    "specs": "select name as spec from {refs} union select concat('ref:', name, case when oid like '%5' then 'x' else '' end) from {refs} union select concat('oid:', oid) from {objects} union select spec from {mounts} union select concat('oid:', substr(oid, 2)) from {refs}",
    "opens": "select event_id as seq, concat('u:', user_id) as agent, case event_id % 8 when 0 then concat('oid:c', event_id) when 1 then concat('tags/v', event_id) when 2 then 'oid:??' when 3 then concat('heads/agents/u', user_id, '/main') when 4 then concat('oid:s', event_id) when 5 then concat('oid:b', event_id % 100) when 6 then 'main' else concat('ref:forks/main/u', user_id, '/', event_id) end as spec from {events}",
    "mountings": "select event_id as seq, concat(case when event_id % 83 = 2 then 'gone' else 'n' end, user_id) as ns_id, case event_id % 5 when 0 then '/' when 1 then '/raw' when 2 then '/x/../y' when 3 then 'main/' else '/main' end as path, case event_id % 9 when 0 then concat('oid:c', event_id) when 1 then 'main' when 2 then concat('heads/agents/u', user_id, '/main') when 3 then concat('ref:heads/agents/u', user_id, '/main') when 4 then 'oid:??' when 5 then concat('tags/v', 40 * (event_id % 9) + 7) when 6 then concat('forks/main/u', user_id, '/', event_id) when 7 then 'heads/gone' else 'conflicts/main/11' end as spec, case when event_id % 4 = 0 then 'ro' else 'rw' end as mode from {events}",
    "endings": "select concat(case when event_id % 10 = 9 then 'gone' else 'n' end, user_id) as ns_id, event_id % 11 = 3 as discard from {events}",
    "pushes": "select event_id as seq, concat('u:', user_id) as agent, case event_id % 9 when 0 then 'a b' when 1 then 'anon' else concat('u', user_id) end as recipient, case when event_id % 40 = 7 then concat('oid:s', event_id) when event_id % 7 = 0 then concat('oid:c', event_id) when event_id % 7 = 1 then 'tags/none' else 'tags/v7' end as spec, case when event_id % 13 = 0 then 'no task' when event_id % 80 = 7 then concat('t', event_id) else concat('t', event_id % 6) end as task from {events}",
    "left": "select distinct concat('inbox/u', user_id, '/t4') as name from {events} where user_id % 3 = 0",
    "seals_asked": "select event_id as seq, concat('heads/agents/u', user_id, case when event_id % 37 = 1 then '/gone' else '/main' end) as ref, case when event_id % 9 = 0 then 'bad tag' when event_id % 40 = 7 then concat('v', event_id) else concat('r', event_id % 50) end as tag, case when event_id % 31 = 2 then concat('b', event_id % 100) else concat('c', case when event_id % 4 = 0 then event_id else max(event_id) over (partition by user_id) end) end as expected from {events}",
    "nested": f"select concat('T', v) as tree, {_FILE} as path, 'blob' as kind, concat('o', o_orderkey) as oid from {{orders}} cross join {_V} where (o_orderkey + v) % 29 <> 0 union all select distinct concat('T', v), {_DIR}, 'tree', concat('D', v) from {{orders}} cross join {_V} union all select distinct concat('T', v), concat('s', o_orderkey % 7), 'tree', 'S' from {{orders}} cross join {_V}",
    "work": f"select ns, mount, path, min(id) as id from (select {_PLACE}, case when o_orderkey % 11 = 3 then {_DIR} else {_FILE} end as path, case when o_orderkey % 4 <> 3 then concat('n', o_orderkey) end as id from {{orders}} where o_orderkey % 5 = 0) w group by ns, mount, path",
    "renames": f"""select o_orderkey as seq, {_PLACE}, case when o_orderkey % 41 = 0 then '' when o_orderkey % 10 = 0 then {_NEXT} when o_orderkey % 3 = 0 then {_DIR} when o_orderkey % 7 = 1 then 'nowhere' when o_orderkey % 13 = 2 then concat({_FILE}, '/in') else {_FILE} end as `from`,
case when o_orderkey % 17 = 0 then {_FILE} when o_orderkey % 19 = 0 or o_orderkey % 20 = 0 then concat({_FILE}, '/z') when o_orderkey % 23 = 0 then concat('s', o_orderkey % 7) else concat('moved/m', o_orderkey) end as `to` from {{orders}}""",
    "uses": "select event_id as seq, concat(case when event_id % 13 = 5 then 'gone' else 'n' end, user_id) as ns_id, concat('u', case when event_id % 4 = 1 then event_id % 9 else user_id end) as agent from {events}",
    "writes": "select event_id as seq, concat(case when event_id % 13 = 5 then 'gone' else 'n' end, user_id) as ns_id, case event_id % 7 when 0 then concat('/k', event_id % 10, '/d', event_id % 150) when 1 then concat('/k', event_id % 10) when 2 then concat('k', event_id % 10, '/d', event_id % 150, '/x') when 3 then '/main/f' when 4 then case when event_id % 2 = 0 then '/' else '/raw' end when 5 then concat('/raw/f', event_id) else '/a//b' end as path from {events}",
    "seen": "select event_id as seq, concat('n', user_id) as ns_id, case when event_id % 3 = 1 then '/main' else '/' end as mount, concat('k', event_id % 10, '/d', event_id % 30) as path, case when event_id % 5 = 0 then 'absent' else 'blob' end as kind, case when event_id % 5 = 0 then null when event_id % 7 = 0 then 'b7' else concat('b', event_id % 30) end as oid from {events}",
    "targets": "select concat('heads/x', event_id) as name, concat('c', case when event_id % 4 = 1 then event_id + 1 else event_id end) as oid, 'commit' as kind from {events} where event_id % 53 = 11 and event_id % 9 <> 2 union all select concat('conflicts/heads/x', event_id, case when event_id % 10 = 3 then 'y' else '' end, '/', event_id), concat('k', event_id), 'conflict' from {events} where event_id % 53 = 11",
    "settlings": "select event_id as seq, concat('k', case when event_id % 71 = 3 then 0 else event_id end) as conflict, concat('heads/x', event_id) as into_, case event_id % 6 when 0 then 'ours' when 1 then 'theirs' when 2 then concat('oid:t', event_id % 10) when 3 then concat('oid:t', (event_id + 1) % 10) when 4 then 'oid:b1' else concat('oid:t', event_id % 12) end as choice from {events} where event_id % 53 = 11",
}
#: Of conflicts, those with other paths and bases, and trees that go beyond.
PATHS, MORE, BEYOND = "oid not like '%7'", "oid like '%3'", "seq % 5 = 2"
#: What the tables say otherwise, to be found out.
AGENTS = {"commits": "case when oid like '%31' then 'odd' else 'a' end", "contributions": "case when oid like '%52' then 'odd' else 'a' end"}
OTHER = {"contributions": "case when oid like '%63' then 't0' else tree end", "snapshots": "case when oid like '%27' then 't0' else tree end", "commits": "case when oid like '%367' then 't1' else tree end"}
UNPINNED = "case when base_oid like '%1' then base_oid end"
#: Paths of stored objects, some where none should lie.
LAYOUT = "select case when doc_id % 19 = 1 then concat('objects/f', doc_id) when doc_id % 19 = 2 then concat('objects/', a, '/', h) when doc_id % 19 = 3 then concat('objects/', a, '/', b, '/', h, '/more/', doc_id) when doc_id % 19 = 4 then concat('objects/', a, '/', b, '/', a, b, 'tmp') when doc_id % 19 = 5 then concat('objects/', b, '/zz/', h) when doc_id % 19 = 6 then concat('other/', doc_id) else concat('objects/', a, '/', b, '/', h) end as path from (select doc_id, h, substr(h, 1, 2) as a, substr(h, 3, 2) as b from (select doc_id, {sha}(concat('z', doc_id){bits}) as h from {documents}) x) y"
#: What an id looks like here.
OID = "^[a-z][0-9]+$"
#: Objects that are gone, or of another kind than their edges say.
SPOILT = "select oid, case when kind = 'commit' and age = 13 then 'tree' when kind = 'tree' and oid = 't3' then 'blob' else kind end as kind, size, age from {objects} where not (kind = 'blob' and age % 31 = 5) and not (kind = 'contribution' and age = 21)"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(RELATIONS[name], **{t: table(spark, sf_dir, t) for t in ("events", "documents") if f"{{{t}}}" in RELATIONS[name]})


def relations(spark: SparkSession, sf_dir: str, *names: str, steps: bool = False) -> dict[str, DataFrame]:
    """With `steps`, the events' steps are derived once and kept, for queries that read many relations."""
    if not steps:
        return {n: relation(spark, sf_dir, n) for n in names or RELATIONS}
    tables = {t: table(spark, sf_dir, t) for t in ("events", "documents")}
    steps = spark.sql(f"select * from {_E}", events=tables["events"])
    tables["steps"] = kept(steps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i"))  # types of events are few
    text = {n: RELATIONS[n].replace(_E, "{steps} e") for n in names or RELATIONS}
    return {n: spark.sql(q, **{t: df for t, df in tables.items() if f"{{{t}}}" in q}) for n, q in text.items()}


def spoilt(objects: DataFrame) -> DataFrame:
    return objects.sparkSession.sql(SPOILT, objects=objects)


def relations_sql(*names: str) -> str:
    """The same as common table expressions of DuckDB."""
    return ",\n".join(f"{n} as ({RELATIONS[n].format(events='events', documents='documents')})" for n in names or RELATIONS)


def asked(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(REQUESTS[name], **{t: df for t, df in tables.items() if f"{{{t}}}" in REQUESTS[name]})


def asked_sql(*names: str) -> str:
    return ",\n".join(f"{n} as ({REQUESTS[n].replace('`', chr(34)).format(events='events', orders='orders', refs='refs', objects='objects', mounts='mounts')})" for n in names)


#: Objects as stored, some under a wrong name, and ids that are asked for.
STORED = "select distinct {sha}(case when doc_id % 17 = 3 then concat('x', text) else text end{bits}) as oid, text as data from {documents}"
