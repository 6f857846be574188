"""The questions about typed objects, roots and the catalog, in DuckDB's SQL."""

from __future__ import annotations

from ..sources.datasets import COMMITS_SQL, PAIRS_SQL
from ..sources.store import EXPECTED, HEADS, LAYOUT, PROPOSALS, RETIRED, SESSIONS, SPOILT, relations_sql

RELS = relations_sql()
ID = "regexp_full_match({}, '[a-z][0-9]+')"

EDGES = """edges as (
select tree as src, id as dst, kind as expected, concat('tree:', tree, ':', name) as resource from tree_entry
union all select oid, tree, 'tree', concat('commit:', oid, ':tree') from commits
union all select oid, contrib, 'contribution', concat('commit:', oid, ':contribution') from commits where contrib is not null
union all select oid, parent, 'commit', concat('commit:', oid, ':parent') from commit_parent
union all select oid, base, 'tree', concat('conflict:', oid, ':base') from conflict_base
union all select oid, ours, 'tree', concat('conflict:', oid, ':ours') from conflicts
union all select oid, theirs, 'tree', concat('conflict:', oid, ':theirs') from conflicts
union all select oid, "commit", 'commit', concat('conflict:', oid, ':causal') from conflict_causal
union all select oid, x, 'any', concat('conflict:', oid, ':path:', path) from (select oid, path, unnest([a, b, base]) as x from conflict_path) where x is not null
union all select oid, tree, 'tree', concat('snapshot:', oid, ':tree') from snapshots
union all select oid, "commit", 'commit', concat('snapshot:', oid, ':commit') from snapshots
union all select oid, prov, 'blob', concat('snapshot:', oid, ':provenance') from snapshots
union all select oid, base, 'commit', concat('contribution:', oid, ':base') from contributions
union all select oid, tree, 'tree', concat('contribution:', oid, ':tree') from contributions
union all select oid, parent, 'commit', concat('contribution:', oid, ':parent') from contribution_parent
union all select oid, id, 'blob', concat('contribution:', oid, ':read:', path) from contribution_read)"""

ROOTS = f"""roots as (
select 'ref' as source, oid as node, 'any' as expected, concat('ref:', name) as resource from refs
union select 'pin', pinned_oid, 'commit', concat('namespace:', id, ':pin') from namespaces where pinned_oid is not null
union select 'mount', spec[5:], 'any', concat('namespace:', ns_id, ':mount:', path) from mounts where starts_with(spec, 'oid:') and {ID.format("spec[5:]")}
union select 'base', base_oid, 'any', concat('namespace:', ns_id, ':mount:', path, ':base') from mounts where {ID.format("base_oid")}
union select 'overlay', blob_oid, 'blob', concat('namespace:', ns_id, ':overlay:', path) from overlay where blob_oid is not null
union select 'observation', oid, kind, concat('namespace:', ns_id, ':observation:', path) from observations where {ID.format("oid")}
union select 'landmark', oid, 'any', concat('landmark:', oid) from landmarks
union select 'seal', snap_oid, 'snapshot', concat('seal:', tag, ':snapshot') from seals
union select 'seal', commit_oid, 'commit', concat('seal:', tag, ':commit') from seals
union select 'seal', tree_oid, 'tree', concat('seal:', tag, ':tree') from seals)"""

FULL = f"""roots as (
select oid as node, case when kind in ('commit', 'tree', 'conflict', 'snapshot') then kind else 'any' end as expected, concat('ref:', name) as resource from refs
union select pinned_oid, 'commit', concat('namespace:', id, ':pin') from namespaces where pinned_oid is not null
union select spec[5:], 'any', concat('namespace:', ns_id, ':mount:', path, ':oid') from mounts where starts_with(spec, 'oid:') and {ID.format("spec[5:]")}
union select r.oid, r.kind, concat('namespace:', m.ns_id, ':mount:', m.path, ':ref:', r.name) from mounts m join refs r on r.name = case when starts_with(m.spec, 'ref:') then m.spec[5:] else m.spec end and r.kind in ('commit', 'tree', 'conflict', 'snapshot')
union select base_oid, 'any', concat('namespace:', ns_id, ':mount:', path, ':base') from mounts where {ID.format("base_oid")}
union select blob_oid, 'blob', concat('namespace:', ns_id, ':mount:', mount, ':overlay:', path) from overlay where blob_oid is not null
union select oid, kind, concat('namespace:', ns_id, ':observation:', mount, ':', path) from observations where {ID.format("oid")}
union select oid, case when kind = 'thing' then 'any' else kind end, concat('catalog:landmark:', oid) from landmarks
union select unnest([snap_oid, commit_oid, tree_oid]), unnest(['snapshot', 'commit', 'tree']), concat('catalog:seal:', tag, ':', unnest(['snapshot', 'commit', 'tree'])) from seals
union select oid, 'entry', concat('catalog:object_intro:', oid) from object_intro
union select commit_oid, 'commit', concat('catalog:object_intro:', oid, ':commit') from object_intro)"""

JUDGED = """have as (select oid as node, any_value(kind) as actual from spoilt group by oid),
sound as (select * from edges where src in (select node from have)),
reached as (select node from roots union select s.dst from reached r join sound s on s.src = r.node),
met as (select node, expected, resource from roots union all select dst, expected, resource from sound where src in (select node from reached)),
once as (select node, expected, min(resource) as resource from met group by node, expected),
judged as (select once.node, expected, actual, case when actual is null then 'OBJECT_READ' when expected <> 'any' and expected <> actual and not (expected = 'entry' and actual in ('blob', 'tree')) then 'TYPE_MISMATCH' end as code, resource
  from once left join have on have.node = once.node)"""

LIVE = f"{RELS}, {EDGES}, {ROOTS}, live as (select node from roots union select e.dst from live l join edges e on e.src = l.node)"

AUDIT = f"""named as (select *, case when starts_with(spec, 'ref:') then spec[5:] else spec end as target, not starts_with(spec, 'oid:') as by_ref, concat('namespace:', ns_id, ':mount:', path) as place from mounts),
logged as (select *, lag(new_oid) over (partition by name order by id) as before, row_number() over (partition by name order by id) as pos from reflog),
ends as (select name, arg_max(new_oid, id) as new_oid, arg_max(reason, id) as reason from reflog group by name),
audit as (
select 'REF_KIND' as code, concat('catalog:ref:', name) as resource from refs where kind not in ('commit', 'tree', 'conflict', 'snapshot') or contains(name, 'no task')
  or (name = 'main' or starts_with(name, 'heads/') or starts_with(name, 'forks/')) and kind <> 'commit' or starts_with(name, 'conflicts/') and kind <> 'conflict' or (starts_with(name, 'tags/') or starts_with(name, 'inbox/')) and kind <> 'snapshot'
union select 'TAG_FLAGS', concat('catalog:ref:', name) from refs where starts_with(name, 'tags/') and (not protected or not sealed or kind <> 'snapshot')
union select 'CATALOG_OID', concat('catalog:mount:', ns_id, ':', path) from mounts where base_oid = 'not an id'
union select 'CATALOG_OID', concat('catalog:observation:', ns_id, ':', mount, ':', path) from observations where oid = 'no id'
union select 'REFLOG_CHAIN', concat('catalog:reflog:', name, ':', id) from logged where case when pos = 1 then old_oid is not null and reason <> 'fork' else old_oid is distinct from before end
union select 'REFLOG_MISSING', concat('catalog:ref:', name) from refs where name not in (select name from ends)
union select 'REFLOG_TERMINAL', concat('catalog:ref:', name) from refs join ends using (name) where oid <> new_oid
union select 'REFLOG_ORPHAN', concat('catalog:reflog:', name) from ends where reason <> 'abandon' and name not in (select name from refs)
union select 'NS_PIN', concat('catalog:namespace:', id) from namespaces where pinned_oid is null
union select 'NS_LIVE_REF', concat('catalog:namespace:', id) from namespaces where live_ref is not null and live_ref not in (select name from refs)
union select 'NS_LIVE_TYPE', concat('catalog:namespace:', id) from namespaces join refs on name = live_ref where kind <> 'commit'
union select 'MOUNT_REF', place from named where by_ref and target not in (select name from refs)
union select 'MOUNT_SPEC', place from named where not by_ref and not {ID.format("spec[5:]")}
union select 'MOUNT_RW_OID', place from named where not by_ref and {ID.format("spec[5:]")} and mode = 'rw'
union select 'MOUNT_NAMESPACE', concat('catalog:mount:', ns_id, ':', path) from mounts where ns_id not in (select id from namespaces)
union select 'OBSERVATION_NAMESPACE', concat('catalog:observation:', ns_id, ':', mount, ':', path) from observations where ns_id not in (select id from namespaces)
union select 'OBSERVATION_MOUNT', concat('catalog:observation:', ns_id, ':', mount, ':', path) from observations where ns_id in (select id from namespaces) and (ns_id, mount) not in (select ns_id, path from mounts)
union select 'OVERLAY_NAMESPACE', concat('catalog:overlay:', ns_id, ':', mount, ':', path) from overlay where ns_id not in (select id from namespaces)
union select 'OVERLAY_MOUNT', concat('catalog:overlay:', ns_id, ':', mount, ':', path) from overlay where ns_id in (select id from namespaces) and (ns_id, mount) not in (select ns_id, path from mounts)
union select 'SEAL_TAG_REF', concat('catalog:seal:', tag) from seals where not exists (select 1 from refs r where r.name = concat('tags/', tag) and r.oid = snap_oid and r.kind = 'snapshot' and r.protected and r.sealed)
union select 'SEAL_ROW', concat('catalog:ref:', name) from refs where starts_with(name, 'tags/') and name[6:] not in (select tag from seals)
union select 'LANDMARK_KIND', concat('catalog:landmark:', oid) from landmarks where kind = 'thing'
union select 'SEAL_LANDMARK', concat('catalog:seal:', tag) from seals where not exists (select 1 from landmarks l where l.oid = snap_oid and l.kind = 'snapshot') or not exists (select 1 from landmarks l where l.oid = commit_oid and l.kind = 'commit')
union select 'SCHEMA_LEDGER', 'catalog:schema_migrations' where (select list(version order by version) from schema_migrations) <> [1, 2, 3])"""

def proposals(expected: str) -> str:
    """Proposals with what rules say of them: `no` is why one is refused."""
    return f"""p as ({PROPOSALS.format(events="events", expected=EXPECTED[expected])}), h as ({HEADS.format(events="events")}), gone as ({RETIRED.format(events="events")}),
told as (select p.*, h.head, h.ref is not null as there, case when contains(p.ref, '..') or p.kind <> 'commit' and starts_with(p.ref, 'heads/') or p.kind <> 'snapshot' and starts_with(p.ref, 'tags/') then 'invalid' when h.ref is null and p.ref in (select name from gone) then 'retired'
  when h.kind <> p.kind then 'invalid' when h.sealed then 'sealed' when h.protected and not p.allowed then 'denied' end as no from p left join h on h.ref = p.ref)"""


AT = "case outcome when 'updated' then ref when 'forked' then concat('forks/', ref, '/', replace(agent, ':', '_'), '/', seq) end as at"
SESSION = ", ".join(f"{n} as ({q.format(orders='orders')})" for n, q in SESSIONS.items()) + """,
stale as (select r.ns, r.mount, r.path, r.kind, coalesce(e.kind, 'absent') as now_kind from reads r join mounted m on m.ns = r.ns and m.mount = r.mount left join entries e on e.tree = m.tree and e.path = r.path
  where not exists (select 1 from staged s where s.ns = r.ns and s.mount = r.mount and (s.path = r.path or starts_with(r.path, concat(s.path, '/')))) and (r.kind <> coalesce(e.kind, 'absent') or r.oid is distinct from e.oid)),
work as (select s.ns, s.mount, count(*) as n from staged s join mounted m on m.ns = s.ns and m.mount = s.mount left join entries e on e.tree = m.tree and e.path = s.path where s.id is distinct from e.oid group by s.ns, s.mount)"""

SQL = {
    "cas_batch": f"""with {proposals("batch")}, firsts as (select ref, min(seq) as first from told where no is null and (not there or expected = head) group by ref),
judged as (select told.*, coalesce(no, case when seq = first then 'updated' else 'forked' end) as outcome from told left join firsts using (ref)) select seq, ref, outcome, {AT} from judged""",
    "cas_chain": f"""with recursive {proposals("chained")}, won as (select ref, min(seq) as seq from told where no is null and (not there or expected = head) group by ref
  union select w.ref, (select min(t.seq) from told t where t.no is null and t.ref = w.ref and t.seq > w.seq and t.expected = concat('c', w.seq)) from won w where w.seq is not null),
judged as (select *, coalesce(no, case when seq in (select seq from won) then 'updated' else 'forked' end) as outcome from told) select seq, ref, outcome, {AT} from judged""",
    "stale_observations": f"with {SESSION} select * from stale",
    "effective_work": f"with {SESSION} select * from work",
    "checkin_plan": f"""with {SESSION}, t as (select r.*, m.mode, m.ref, m.base = h.head as fits, case when m.mode is null then 'unknown' when m.mode <> 'rw' then 'readonly' when r.ns in (select ns from stale) then 'stale'
  when w.n is null then case when r.ns in (select ns from work) then 'stranded' else 'noop' end end as b from requests r left join mounted m on m.ns = r.ns and m.mount = r.mount left join work w on w.ns = r.ns and w.mount = r.mount left join heads h on h.ref = m.ref),
f as (select ref, min(seq) as first from t where b is null and fits group by ref) select seq, ns, mount, coalesce(b, case when seq = first then 'updated' else 'forked' end) as outcome from t left join f using (ref)""",
    "branch_plan": f"""with {proposals("batch")}, r as (select seq, concat(ref, '/b', seq % 7) as name from p union all select -seq - 1, ref from p),
j as (select *, case when contains(name, '..') or starts_with(name, 'tags/') then 'invalid' when name in (select ref from h) then 'exists' when name in (select name from gone) then 'retired' end as no from r)
select seq, name, coalesce(no, case when row_number() over (partition by name, no order by seq) = 1 then 'created' else 'exists' end) as outcome from j""",
    "abandon_plan": f"""with {RELS}, f as (select * from refs where starts_with(name, 'forks/')), asked as (select name from refs union select concat(name, 'x') from f),
live as (select live_ref as name from namespaces where live_ref is not null union select name from f where oid like '%3'), held as (select case when starts_with(spec, 'ref:') then spec[5:] else spec end as name from mounts where not starts_with(spec, 'oid:') union select name from f where oid like '%7')
select name, case when r.oid is null then 'unknown' when not starts_with(name, 'forks/') then 'notfork' when protected then 'protected' when sealed then 'sealed' when name in (select name from live) then 'live' when name in (select name from held) then 'mounted' else 'abandoned' end as outcome from asked left join refs r using (name)""",
    "edge_expansion": f"with {RELS}, {EDGES} select * from edges",
    "gc_roots": f"with {RELS}, {ROOTS} select * from roots",
    "gc_root_counts": f"""with {RELS} select (select count(*) from refs) as refs, (select count(*) from refs where starts_with(name, 'forks/')) as unresolved_forks, (select count(pinned_oid) from namespaces) as session_pins, (select count(live_ref) from namespaces) as session_live_refs,
(select count(*) from mounts) as mounts, (select count(base_oid) from mounts) as mount_pins, (select count(blob_oid) from overlay) as overlay_blobs, (select count(oid) from observations) as observations, (select count(*) from landmarks) as landmarks, (select count(*) from seals) as seals""",
    "closure_verified": f"with recursive {RELS}, {EDGES}, {ROOTS}, spoilt as ({SPOILT.format(objects='objects')}), {JUDGED} select * from judged where code is not null",
    "gc_live": f"with recursive {LIVE} select node from live",
    "gc_sweep": f"""with recursive {LIVE}, dead as (select distinct oid, size, age from objects where oid not in (select node from live)), chosen as (select oid, size from dead where age >= 60 order by oid limit 300),
held as (select oid as node from dead where oid not in (select oid from chosen) union select e.dst from held h join edges e on e.src = h.node) select oid, size from chosen where oid not in (select node from held)""",
    "catalog_audit": f"with {RELS}, {AUDIT} select * from audit",
    "fsck": f"with recursive {RELS}, {EDGES}, {FULL}, spoilt as ({SPOILT.format(objects='objects')}), {JUDGED}, {AUDIT} select * from audit union select code, resource from judged where code is not null",
    "lca": f"""with recursive {COMMITS_SQL}, {PAIRS_SQL}, up as (select head as k, head as node from heads union select u.k, e.dst from up u join edges e on e.src = u.node),
common as (select distinct pair, x.node from pairs join up x on x.k = a join up y on y.k = b and y.node = x.node),
above as (select pair, dst as node from common c join edges e on e.src = c.node union select b.pair, e.dst from above b join edges e on e.src = b.node),
best as (select * from common where (pair, node) not in (select pair, node from above))
select pair, case count(node) when 0 then 'none' when 1 then 'one' else 'several' end as outcome, case when count(node) = 1 then min(node) end as base from pairs left join best using (pair) group by pair""",
    "tar_entries": """with f as (select concat(lang, '/', source, '/d', doc_id) as path, n_chars % 2 = 1 as exec, strlen(text) as size, lang, source from documents)
select path, 'blob' as kind, case when exec then 493 else 420 end as mode, size from f union select lang, 'tree', 493, 0 from f union select concat(lang, '/', source), 'tree', 493, 0 from f""",
    "object_layout": f"""with l as (select path, string_split(path, '/') as p from ({LAYOUT.format(sha="sha256", bits="", documents="documents")}) where starts_with(path, 'objects/'))
select distinct case when len(p) <> 4 then 'OBJECT_LAYOUT' when not regexp_full_match(p[4], '[0-9a-f]{{64}}') then 'OBJECT_NAME' else 'OBJECT_SHARD' end as code, array_to_string(p[1:4], '/') as resource from l where len(p) <> 4 or not regexp_full_match(p[4], '[0-9a-f]{{64}}') or p[2] <> p[4][1:2] or p[3] <> p[4][3:4]""",
    "ledger_standing": f"with {RELS} select case when max(version) <> count(*) then 'damaged' when max(version) < 3 then 'needs-migration' when max(version) > 3 then 'newer' else 'current' end as verdict from schema_migrations",
}
