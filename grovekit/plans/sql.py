"""The queries in DuckDB's SQL, over the same derived relations."""

from __future__ import annotations

from . import session_sql, store_sql
from ..sources.datasets import COMMITS_SQL, PAIRS_SQL, files_sql, objects_sql, reflog_sql

MOUNTS = ("/", "/en", "/fr", "/de", "/fr/825", "/en/25", "/es/533", "/e")
NOW = 1_000
TOKENS = {
    "t1": ["ops=read,write", "ref=heads/*,tags/*,forks/*", "ref!=heads/b*"],
    "t2": ["ops=read,write,merge", "ops=read,merge", "allow=merge:main,heads/a*", "time<=2000"],
    "t3": ["ops=read", "time<=999"],
    "t4": ["ops=read", "agent=x", "agent=y"],
    "t5": ["ref=heads/*"],
    "t6": ["ops=write", "ref=heads/*,inbox/*", "ref=*", "ref!=inbox/*"],
}
PREFIXES = ("heads/", "forks/inbox/", "forks/", "conflicts/", "resolutions/", "tags/", "inbox/a/", "inbox/", "odd/", "heads//", "heads/agents/q/forks/", "heads/../")
PART_NAMES = "concat(case " + " ".join(f"when p_partkey % {len(PREFIXES)} = {i} then '{p}'" for i, p in enumerate(PREFIXES)) + " end, replace(lower(p_name), ' ', case when p_partkey % 5 = 0 then '/' when p_partkey % 5 = 1 then ':' else '-' end))"
SIBLINGS = "concat(case when doc_id % 3 = 0 then 'Read' when doc_id % 3 = 1 then 'read' else 'caf' end, case when doc_id % 2 = 0 then 'é' else 'é' end, cast(floor(doc_id / 60) as int))"

WORD = "sum(('0x' || substr(sha256(concat(length(name), ':', name, '|', kind, '|', id, '|', exec::int)), {at}, 15))::bigint)::varchar"
DIR = "sha256(concat_ws(':', count(*)::varchar, " + ", ".join(WORD.format(at=16 * i + 1) for i in range(4)) + "))"
E3 = """{s}_f as ({files}),
{s}_3 as (select path, regexp_replace(path, '/?[^/]*$', '') as up, regexp_extract(path, '[^/]*$') as name, len(string_split(path, '/')) as depth, 'blob' as kind, id, exec from {s}_f),
{s}_d3 as (select up as path, {DIR} as id from {s}_3 where depth = 4 group by up),
{s}_2 as (select path, up, name, kind, id, exec from {s}_3 where depth = 3 union all select path, regexp_replace(path, '/?[^/]*$', ''), regexp_extract(path, '[^/]*$'), 'tree', id, false from {s}_d3),
{s}_d2 as (select up as path, {DIR} as id from {s}_2 group by up),
{s}_1 as (select path, up, name, kind, id, exec from {s}_3 where depth = 2 union all select path, regexp_replace(path, '/?[^/]*$', ''), regexp_extract(path, '[^/]*$'), 'tree', id, false from {s}_d2),
{s}_d1 as (select up as path, {DIR} as id from {s}_1 group by up),
{s}_0 as (select path, name, kind, id, exec from {s}_3 where depth = 1 union all select path, path, 'tree', id, false from {s}_d1),
{s} as (select path, kind, id, exec from {s}_3 where depth > 3 union all select path, kind, id, exec from {s}_2 union all select path, kind, id, exec from {s}_1 union all select path, kind, id, exec from {s}_0
  union all select '', 'tree', {DIR}, false from {s}_0)"""


def trees(*sides: str) -> str:
    return ",\n".join(E3.format(s=s, files=files_sql(s), DIR=DIR) for s in sides)


def under(path: str, top: str) -> str:
    return f"({path} <> {top} and ({top} = '' or starts_with({path}, concat({top}, '/'))))"


def paired(name: str, left: str, right: str) -> str:
    """Visible rows of two trees: path, and kind, id, exec of each side."""
    return f"""{name}_all as (select path, l.kind as lk, l.id as li, l.exec as lx, r.kind as rk, r.id as ri, r.exec as rx,
  coalesce(l.kind = 'tree' and r.kind = 'tree' and l.id <> r.id, false) as descend from {left} l full join {right} r using (path)),
{name} as (select * from {name}_all x where path <> '' and not exists (select 1 from {name}_all s where not s.descend and {under("x.path", "s.path")}))"""


def frontier(name: str) -> str:
    return f"select path, case when rk is null then 'deleted' else 'added' end as change, coalesce(lk, rk) as kind, coalesce(li, ri) as id, coalesce(lx, rx) as exec from {name} where lk is null or rk is null"


def renames(changes: str) -> str:
    return f"""select d.path as source, min(a.path) as destination from {changes} d join {changes} a on d.change = 'deleted' and a.change = 'added' and (d.kind, d.id, d.exec) = (a.kind, a.id, a.exec)
  where (select count(*) from base b where b.path <> '' and (b.kind, b.id, b.exec) = (d.kind, d.id, d.exec)) = 1 group by d.path having count(*) = 1"""


MERGE = f"""rows as (select path, a.kind as ak, a.id as ai, a.exec as ax, b.kind as bk, b.id as bi, b.exec as bx, g.id as gi,
  coalesce((a.kind, a.id, a.exec) = (b.kind, b.id, b.exec), false) as ab, coalesce((a.kind, a.id, a.exec) = (g.kind, g.id, g.exec), false) as ga, coalesce((b.kind, b.id, b.exec) = (g.kind, g.id, g.exec), false) as gb
  from ours a full join theirs b using (path) full join base g using (path)),
told as (select *, coalesce(ak = 'tree' and bk = 'tree', false) and not ab and not ga and not gb as descend from rows),
seen as (select * from told x where not descend and (ak is not null or bk is not null) and not exists (select 1 from told s where not s.descend and {under("x.path", "s.path")})),
judged as (select *, case when bk is null then case when ga then 'dropped' when gi is null then 'ours' else 'conflict' end
  when ak is null then case when gb then 'dropped' when gi is null then 'theirs' else 'conflict' end
  when ab then 'same' when ga then 'theirs' when gb then 'ours' else 'conflict' end as outcome from seen),
merged as (select path, outcome, case when outcome in ('same', 'ours') or outcome = 'conflict' and bk is not null then ak when outcome = 'theirs' then bk end as kind,
  case when outcome in ('same', 'ours') or outcome = 'conflict' and bk is not null then ai when outcome = 'theirs' then bi end as id,
  case when outcome in ('same', 'ours') or outcome = 'conflict' and bk is not null then ax when outcome = 'theirs' then bx end as exec,
  case when outcome = 'conflict' then ai end as a, case when outcome = 'conflict' then bi end as b, case when outcome = 'conflict' then gi end as base from judged)"""

OVERLAY = f"files as ({files_sql()}), edits as ({files_sql('overlay')})"
FOLDED = f"""{OVERLAY}, folded as (select * from files f where not exists (select 1 from edits e where e.path = f.path or {under("f.path", "e.path")} or {under("e.path", "f.path")})
  union all select * from edits where id is not null)"""
LIVE = f"""{objects_sql()}, live as (select node from roots union select e.dst from live l join edges e on e.src = l.node)"""
STATE = f"""{LIVE}, state as (select o.*, case when l.node is not null then 'live' when age >= 24 then 'collectable' else 'young' end as state from objects o left join live l on l.node = o.node)"""
ORDERS = "reads as (select concat('c', o_custkey) as ns, concat('/m', o_orderkey % 3) as mount, concat('o', o_orderkey) as path, o_orderkey as k, o_custkey as c, sha256(o_orderstatus) as status from orders)"


def _fits(globs: list[str]) -> str:
    return "(" + " or ".join(f"starts_with(name, '{g[:-1]}')" if g.endswith("*") else f"name = '{g}'" for g in globs) + ")"


#: What the tokens come to, told by hand: operations that pass at NOW, and the condition on a name by operation ("" : any).
READS = {
    "t1": {"read": "(starts_with(name, 'heads/') or starts_with(name, 'tags/') or starts_with(name, 'forks/')) and not starts_with(name, 'heads/b')", "write": "(starts_with(name, 'heads/') or starts_with(name, 'tags/') or starts_with(name, 'forks/')) and not starts_with(name, 'heads/b')"},
    "t2": {"read": "true", "merge": "(name = 'main' or starts_with(name, 'heads/a'))"},
    "t3": {},  # its time is over
    "t4": {},  # two agents
    "t5": {},  # no operation
    "t6": {"write": "(starts_with(name, 'heads/') or starts_with(name, 'inbox/')) and not starts_with(name, 'inbox/')"},
}


def allowed(token: str, op: str) -> str:
    return READS[token].get(op, "false")


ODD_NAMES = ("main", "", "inbox/a/anon", "inbox/a/t", "inbox/a b/t", "inbox/a/" + "t" * 80, "inbox/a/" + "t" * 64, "inbox//t", "inbox/anon/x.y", "heads/x\u0085y", "heads/x\u009f", "heads/x\u00a0", "tags/" + "v" * 507, "tags/" + "v" * 508, "a/./b", "/a", "a/")
NAMES = f"names as (select distinct {PART_NAMES} as name from part union select unnest([{', '.join(repr(n) if n.isprintable() else chr(39) + n + chr(39) for n in ODD_NAMES)}]))"
ANY_PATH = "select distinct regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) as path from pages"
ROUND = "(round((n - 1) * {p}))::bigint + 1"

SQL = {
    "blob_dedup": "select sha256(text) as oid, count(*) as puts, count(*) - 1 as dedup_hits, max(strlen(text)) as size from documents group by 1",
    "first_introducer": "select sha256(text) as oid, arg_min(source, doc_id) as agent, min(doc_id) as seq from documents group by 1",
    "intro_new_objects": f"with {trees('base', 'ours')} select distinct id, kind from ours where (path, kind, id) not in (select path, kind, id from base)",
    "tree_flatten": f"select path, id, exec, string_split(path, '/')[1] as part0, string_split(path, '/')[2] as part1, string_split(path, '/')[3] as part2 from ({files_sql()})",
    "tree_merkle": f"with {trees('ours')} select path, kind, id, exec from ours",
    "overlay_fold": f"with {FOLDED} select * from folded",
    "overlay_shadowed": f"with {OVERLAY} select distinct path from files f where exists (select 1 from edits e where e.path = f.path or {under('f.path', 'e.path')})",
    "overlay_prefix_conflict": f"with {OVERLAY}, tried as (select path from files union all select concat(path, '/y') from edits) select distinct t.path, e.path as other from tried t join edits e on {under('t.path', 'e.path')} or {under('e.path', 't.path')}",
    "ns_ls": f"""with {FOLDED}, told as (select path, path in (select path from edits where id is not null) as fresh from folded),
ups as (select unnest([string_split(path, '/')[1:i] for i in range(1, len(string_split(path, '/')) + 1)]) as parts, path, fresh from told)
select coalesce(array_to_string(parts[1:len(parts) - 1], '/'), '') as parent, parts[len(parts)] as name, case when bool_or(array_to_string(parts, '/') = path) then 'blob' else 'tree' end as kind, bool_or(fresh) as staged from ups group by parts""",
    "ns_resolve": f"""with {OVERLAY}, asked as (select path from files union select path from edits union select concat(path, '/in') from files),
near as (select a.path, arg_max(e.path, length(e.path)) as ep, arg_max(coalesce(e.id, '-'), length(e.path)) as eid from asked a join edits e on a.path = e.path or {under("a.path", "e.path")} group by a.path),
told as (select a.path, n.ep, n.eid, f.id as fid, case when n.ep = a.path and n.eid <> '-' then 'blob' when n.ep is not null and n.eid = '-' then 'absent' when n.ep is not null then 'invalid' when f.id is not null then 'blob' else 'absent' end as state
  from asked a left join near n on n.path = a.path left join files f on f.path = a.path)
select path, state, case when state = 'blob' then coalesce(eid, fid) end as id from told""",
    "longest_mount": f"""with mounts as (select unnest([{", ".join(f"'{m}'" for m in MOUNTS)}]) as mount),
asked as (select path, concat('/', regexp_replace(regexp_replace(path, '^/', ''), '/$', '')) as pt from ({ANY_PATH})),
fine as (select * from asked where pt = '/' or len(list_filter(string_split(pt[2:], '/'), lambda c: c in ('', '.', '..'))) = 0),
hit as (select path, pt, arg_max(mount, length(mount)) as mount from fine join mounts on mount = '/' or pt = mount or starts_with(pt, concat(mount, '/')) group by path, pt)
select path, mount, case when pt = mount then '' when mount = '/' then pt[2:] else pt[length(mount) + 2:] end as rel from hit""",
    "diff_changed_paths": f"with {trees('base', 'ours')}, {paired('p', 'base', 'ours')} select path from p where not descend and not coalesce((lk, li, lx) = (rk, ri, rx), false)",
    "diff_frontier": f"with {trees('base', 'ours')}, {paired('p', 'base', 'ours')} {frontier('p')}",
    "exact_renames": f"with {trees('base', 'ours')}, {paired('p', 'base', 'ours')}, ch as ({frontier('p')}) {renames('ch')}",
    "merge_three_way": f"with {trees('base', 'ours', 'theirs')}, {MERGE} select * from merged",
    "merge_conflicts": f"""with {trees("base", "ours", "theirs")}, {MERGE}, {paired("p", "base", "ours")}, {paired("q", "base", "theirs")}, pc as ({frontier("p")}), qc as ({frontier("q")}), pr as ({renames("pc")}), qr as ({renames("qc")})
select path, a, b, base from merged where outcome = 'conflict' union all
select x.path, null, null, x.id from pc x join qc y on x.path = y.path and x.change = 'deleted' and y.change = 'deleted' left join pr on pr.source = x.path left join qr on qr.source = x.path
  where (pr.destination is not null or qr.destination is not null) and not coalesce(pr.destination = qr.destination, false)
  and (select count(distinct id) from (select id from base where path = '' union all select id from ours where path = '' union all select id from theirs where path = '')) = 3""",
    "resolve_scope": f"""with {trees("base", "ours", "theirs")}, {MERGE}, {paired("p", "ours", "theirs")}
select path, exists (select 1 from merged m where m.outcome = 'conflict' and (m.path = p.path or {under("p.path", "m.path")})) as in_scope from p where not descend and not coalesce((lk, li, lx) = (rk, ri, rx), false)""",
    "commit_ancestry": f"with recursive {COMMITS_SQL}, {PAIRS_SQL}, up as (select a as head, a as node from pairs union select u.head, e.dst from up u join edges e on e.src = u.node) select head, node from up",
    "merge_bases": f"""with recursive {COMMITS_SQL}, {PAIRS_SQL}, up as (select head as k, head as node from heads union select u.k, e.dst from up u join edges e on e.src = u.node),
common as (select distinct pair, x.node from pairs join up x on x.k = a join up y on y.k = b and y.node = x.node),
above as (select pair, dst as node from common c join edges e on e.src = c.node union select b.pair, e.dst from above b join edges e on e.src = b.node)
select pair, node as base from common where (pair, node) not in (select pair, node from above)""",
    "contribution_union": f"""with recursive {COMMITS_SQL}, {PAIRS_SQL}, up as (select head as k, head as node from heads union select u.k, e.dst from up u join edges e on e.src = u.node)
select distinct pair, concat(t.role, ':', u.node % 7) as fact from pairs join up u on u.k in (a, b) join turns t on t.node = u.node""",
    "graph_closure": f"with recursive {LIVE} select node from live",
    "graph_type_audit": f"""with {objects_sql()}, spoilt as (select node, case when kind = 'nation' and age % 11 = 5 then 'customer' else kind end as kind from objects where not (kind = 'order' and age = 13))
select src, dst, expected, kind as actual, case when kind is null then 'OBJECT_READ' else 'TYPE_MISMATCH' end as code from edges left join spoilt on node = dst where kind is null or kind <> expected""",
    "gc_plan": "with recursive " + STATE + " select count(*) as scanned_objects, " + ", ".join(f"count(*) filter (state = '{s}') as {s}_objects, coalesce(sum(size) filter (state = '{s}'), 0)::bigint as {s}_bytes" for s in ("live", "collectable", "young")) + " from state",
    "gc_collectable": f"with recursive {STATE} select node, (select count(*) from state where state = 'collectable') > 256 as truncated from state where state = 'collectable' order by node limit 256",
    "gc_doomed": f"with recursive {STATE}, spared as (select node from state where state = 'young' union select e.dst from spared s join edges e on e.src = s.node) select node from state where state = 'collectable' and node not in (select node from spared)",
    "provenance_check": f"""with recursive {LIVE}, known as (select o.node, case when kind = 'order' then concat('a', age % 5) end as agent, age from live join objects o using (node)),
listed as (select node, age from known where age % 19 <> 3 union select node, age from objects where kind = 'customer' and age = 7),
man as (select distinct node, case when age % 23 = 4 then 'odd' else concat('a', age % 5) end as label from listed)
select node, finding from (select node, case when m.label is null then 'missing' when k.age is null then 'extra' when k.agent is not null and k.agent <> m.label then 'mismatch' end as finding from known k full join man m using (node)) where finding is not null""",
    "refs_list": f"with {NAMES} select name, (select count(*) from names where not ({allowed('t1', 'read')})) as suppressed from names where {allowed('t1', 'read')}",
    "cap_allows": f"with {NAMES} " + " union all ".join(f"select '{t}' as token, '{op}' as op, name, {allowed(t, op)} as allowed from names" for t in TOKENS for op in ("read", "write", "merge")),
    "ref_kind_audit": f"""with {NAMES} select name, strlen(name) between 1 and 512 and not regexp_matches(name, '[\\x00-\\x1f\\x7f-\\x{{9f}}\\\\:]') and len(list_filter(string_split(name, '/'), lambda p: p in ('', '.', '..'))) = 0 and (not starts_with(name, 'inbox/') or regexp_full_match(name, 'inbox/[A-Za-z0-9._-]+/[A-Za-z0-9._-]{{1,64}}') and not ends_with(name, '/anon')) as valid,
case when name = 'main' or starts_with(name, 'heads/') then 'commit' when starts_with(name, 'forks/inbox/') then 'snapshot' when starts_with(name, 'forks/') or starts_with(name, 'resolutions/') then 'commit' when starts_with(name, 'conflicts/') then 'conflict' when starts_with(name, 'tags/') or starts_with(name, 'inbox/') then 'snapshot' end as kind,
starts_with(name, 'forks/') or regexp_matches(name, '^heads/agents/[^/]+/forks/.+') as fork, case when name = '' then 'anon' else regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') end as agent from names""",
    "inbox_list": "select concat('inbox/u', user_id, '/t', event_id) as name from events where user_id = 7",
    "reflog_log": f"with {reflog_sql()} select name, id, new_oid, reason from reflog where name = 'heads/agents/u7/main' order by id desc limit 32",
    "reflog_chain_audit": f"""with {reflog_sql()}, w as (select *, lag(new_oid) over (partition by name order by id) as before, row_number() over (partition by name order by id) as pos from reflog),
last as (select name, max(id) as id, arg_max(new_oid, id) as new_oid, arg_max(reason, id) as reason from reflog group by name)
select 'REFLOG_CHAIN' as code, name, id from w where case when pos = 1 then old_oid is not null and reason <> 'fork' else old_oid is distinct from before end
union all select 'REFLOG_MISSING', name, null from refs where name not in (select name from reflog)
union all select 'REFLOG_ORPHAN', name, id from last where reason <> 'abandon' and name not in (select name from refs)
union all select 'REFLOG_TERMINAL', name, id from last join refs using (name) where oid <> new_oid""",
    "retired_names": f"with {reflog_sql()} select name from reflog group by name having arg_max(reason, id) = 'abandon'",
    "stranded_mounts": f"with {ORDERS} select ns, mount, count(*) as n from reads where mount <> '/m0' and case when k % 5 = 0 then status else sha256('new') end <> status group by ns, mount",
    "catalog_orphans": f"""with {ORDERS}, ns as (select concat('c', c_custkey) as ns from customer where c_custkey % 19 <> 0), mounts as (select distinct ns, mount from reads where k % 23 <> 0), ov as (select * from reads), ob as (select * from reads)
select distinct 'MOUNT_NAMESPACE' as code, concat(ns, ':', mount) as resource from mounts where ns not in (select ns from ns)
union all select distinct 'OVERLAY_NAMESPACE', concat(ns, ':', mount, ':', path) from ov where ns not in (select ns from ns)
union all select distinct 'OVERLAY_MOUNT', concat(ns, ':', mount, ':', path) from ov where (ns, mount) not in (select ns, mount from mounts)
union all select distinct 'OBSERVATION_NAMESPACE', concat(ns, ':', mount, ':', path) from ob where ns not in (select ns from ns)
union all select distinct 'OBSERVATION_MOUNT', concat(ns, ':', mount, ':', path) from ob where (ns, mount) not in (select ns, mount from mounts)
union all select distinct 'SEAL_TAG_REF', concat('tags/v', s_suppkey) from supplier where s_suppkey % 4 = 1""",
    "export_collisions": f"with n as (select distinct source as dir, {SIBLINGS} as name from documents) select dir, nfc_normalize(lower(name)) as fold_key, count(*) as n, string_agg(name, ',' order by name) as names from n group by 1, 2 having count(*) > 1",
    "latency_percentiles": "with r as (select event_type, value, row_number() over (partition by event_type order by value) as pos, count(*) over (partition by event_type) as n from events where value is not null) select event_type, max(n) as n, round(sum(value), 6) as sum, " + ", ".join(f"max(value) filter (pos = {ROUND.format(p=p)}) as p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + ", max(value) as max from r group by event_type",
    "latency_medians": "with r as (select event_type, value, row_number() over (partition by event_type order by value) as pos, count(*) over (partition by event_type) as n from events where value is not null) select event_type, max(value) filter (pos = n // 2 + 1) as upper_median, max(value) filter (pos = (n - 1) // 2 + 1) as median_low from r group by event_type",
    "event_shares": "with r as (select event_type, count(*) as n, (select count(*) from events) as whole from events group by event_type) select event_type, n, concat(((n * 1000 + whole // 2) // whole) // 10, '.', ((n * 1000 + whole // 2) // whole) % 10) as share from r",
    "w6_tree": "select format('/d{:04d}/f{:04d}.txt', range // 1000, range % 1000) as path, range as n from range((select count(*) from events))",
}
SQL |= store_sql.SQL | session_sql.SQL
