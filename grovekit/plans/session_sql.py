"""The questions about sessions and what is asked of them, in DuckDB's SQL."""

from __future__ import annotations

from ..sources.store import AGENTS, BEYOND, MORE, OTHER, PATHS, SESSIONS, SPOILT, STORED, UNPINNED, asked_sql, relations_sql

RELS = relations_sql()
ID = "regexp_full_match({}, '[a-z][0-9]+')"
KNOWN = f"""spoilt as ({SPOILT.format(objects="objects")}), have as (select oid, any_value(kind) as kind from spoilt group by oid)"""


def named(rows: str, columns: str) -> str:
    """CTE `told`: `rows` with what their spec names and what it peels to."""
    return f"""{KNOWN}, aimed as (select {columns}, spec, case when not starts_with(spec, 'oid:') then replace(spec, 'ref:', '') end as ref, case when starts_with(spec, 'oid:') then case when {ID.format("spec[5:]")} then spec[5:] else 'bad' end end as raw from {rows}),
found as (select a.*, coalesce(a.raw, r.oid) as oid, r.protected from aimed a left join refs r on r.name = a.ref),
told as (select f.* exclude (oid), nullif(f.oid, 'bad') as oid, h.kind, case when f.oid = 'bad' then 'invalid' when f.oid is null then 'notfound' when h.kind is null then 'missing' else 'ok' end as state,
  case when h.kind = 'commit' then f.oid when h.kind = 'snapshot' then s.commit end as commit from found f left join have h on h.oid = f.oid left join snapshots s on s.oid = f.oid)"""


STATE = "case when state = 'ok' and commit is null then 'notcommit' else state end"
MOUNTED = f"mounted as ({SESSIONS['mounted'].format(orders='orders')})"
UNDER = "(({a} = {b}) or starts_with({a}, concat({b}, '/')))"
RENAMES = f"""with {asked_sql("renames", "nested", "work")}, {MOUNTED}, q as (select r.*, r."from" as a, r."to" as b, m.tree, m.mode from renames r left join mounted m on m.ns = r.ns and m.mount = r.mount),
over as (select seq, w.path as at, w.id, row_number() over (partition by seq order by length(w.path)) as n from q join work w on w.ns = q.ns and w.mount = q.mount and {UNDER.format(a="q.a", b="w.path")}),
onto as (select distinct seq from q join work w on w.ns = q.ns and w.mount = q.mount and starts_with(q.b, concat(w.path, '/'))),
j as (select q.seq, q.ns, q.mount, q.tree, q.a, q.b, case when o.at is not null then 'blob' else e.kind end as kind, coalesce(o.id, e.oid) as id,
  case when q.mode is null then 'unknown' when q.mode <> 'rw' then 'readonly' when q.a = '' or q.b = '' then 'root' when q.a = q.b then 'same' when starts_with(q.b, concat(q.a, '/')) then 'inside' when starts_with(q.a, concat(q.b, '/')) then 'above'
  when o.at is not null and o.id is null or o.at is null and e.kind is null then 'notfound' when o.at <> q.a then 'invalid' when q.seq in (select seq from onto) then 'conflict' else 'renamed' end as outcome
  from q left join over o on o.seq = q.seq and o.n = 1 left join nested e on e.tree = q.tree and e.path = q.a),
tops as (select * from j where outcome = 'renamed' and kind = 'tree'),
under as (select t.seq, w.path, w.id from tops t join work w on w.ns = t.ns and w.mount = t.mount and starts_with(w.path, concat(t.a, '/'))),
base as (select t.seq, e.path, e.oid as id from tops t join nested e on e.tree = t.tree and e.kind = 'blob' and regexp_replace(e.path, '/[^/]*$', '') = t.a),
held as (select * from base b where not exists (select 1 from under u where u.seq = b.seq and (u.path = b.path or u.id is null and starts_with(b.path, concat(u.path, '/')))) union all select * from under where id is not null),
landed as (select seq, b as path, id from j where outcome = 'renamed' and kind = 'blob' union all select h.seq, concat(t.b, h.path[length(t.a) + 1:]), h.id from held h join tops t on t.seq = h.seq)"""

SQL = {
    "spec_peel": f"with {RELS}, {asked_sql('specs')}, {named('specs', '1 as one')} select spec, {STATE} as state, oid, kind, case when state = 'ok' then commit end as commit from told",
    "session_open": f"""with {RELS}, {asked_sql('opens')}, {named('opens', 'seq, agent')}, s as (select *, {STATE} as st from told)
select seq, case when st = 'ok' then 'opened' else st end as outcome, commit as pinned, case when st = 'ok' then concat('heads/agents/', replace(agent, ':', '_'), '/', seq) end as live_ref from s""",
    "mount_plan": f"""with {RELS}, {asked_sql('mountings')}, {named('mountings', "seq, ns_id, mode, case path when 'main/' then '/main' when '/x/../y' then null else path end as path")},
j as (select t.seq, t.oid, t.mode, case when t.ns_id not in (select id from namespaces) then 'unknown' when t.path is null or t.state = 'invalid' then 'invalid' when t.mode = 'rw' and (t.raw is not null or t.protected) then 'denied' when t.state <> 'ok' then t.state
  when t.mode = 'rw' and t.kind <> 'commit' then 'denied' when (m.spec <> t.spec or m.mode = 'rw' and t.mode <> 'rw') and (t.ns_id, t.path) in (select ns_id, mount from overlay) then 'staged' else 'mounted' end as outcome
  from told t left join mounts m on m.ns_id = t.ns_id and m.path = t.path) select seq, outcome, case when outcome = 'mounted' and mode = 'rw' then oid end as base from j""",
    "abandon_sessions": f"""with {RELS}, {asked_sql('endings')}, r as (select ns_id, bool_or(discard) as discard from endings group by ns_id),
n as (select *, (select count(*) from overlay o where o.ns_id = r.ns_id) as s, (select count(*) from mounts o where o.ns_id = r.ns_id) as m, (select count(*) from observations o where o.ns_id = r.ns_id) as b from r),
j as (select *, case when ns_id not in (select id from namespaces) then 'unknown' when s > 0 and not discard then 'staged' else 'ended' end as outcome from n)
select ns_id, outcome, case when outcome = 'ended' then s else 0 end as staged, case when outcome = 'ended' then m else 0 end as mounts, case when outcome = 'ended' then b else 0 end as observations from j""",
    "rename_plan": f"{RENAMES} select j.seq, outcome, case when outcome = 'renamed' then kind end as kind, case when outcome = 'renamed' then (select count(*) from landed l where l.seq = j.seq) end as entries from j",
    "rename_rows": f"{RENAMES} select l.seq, j.ns, j.mount, l.path, l.id from landed l join j on j.seq = l.seq union all select seq, ns, mount, a, null from j where outcome = 'renamed'",
    "landmark_plan": f"with {RELS}, {KNOWN} select oid, case when h.kind is null then 'missing' when oid in (select oid from landmarks) then 'exists' else 'marked' end as outcome, h.kind from (select distinct oid from objects) o left join have h using (oid)",
    "inbox_push": f"""with {RELS}, {asked_sql('pushes', 'left').replace('left as', 'quit as')}, {named('pushes', 'seq, agent, recipient, task')},
j as (select seq, agent, concat('inbox/', recipient, '/', task) as name, case when recipient in ('a b', 'anon') then 'invalid' when state <> 'ok' then state when kind <> 'snapshot' or task = 'no task' then 'invalid' end as wrong from told),
p as (select j.*, r.kind as k, r.name is not null as there, j.name in (select name from quit) as gone from j left join refs r on r.name = j.name),
o as (select seq, agent, name, coalesce(wrong, case when not there and gone then 'retired' when there and k <> 'snapshot' then 'invalid' when there then 'forked' when row_number() over (partition by name, wrong is null order by seq) = 1 then 'updated' else 'forked' end) as outcome from p)
select seq, outcome, case outcome when 'updated' then name when 'forked' then concat('forks/', name, '/', replace(agent, ':', '_'), '/', seq) end as at from o""",
    "receipts": f"""with {RELS}, {KNOWN}, x as (select oid, base, {OTHER['contributions']} as tree, {AGENTS['contributions']} as agent from contributions),
named as (select oid, base as dst, 'commit' as want from x union all select oid, tree, 'tree' from x union all select oid, parent, 'commit' from contribution_parent union all select oid, id, 'blob' from contribution_read union all select oid, oid, 'contribution' from x),
bad as (select distinct n.oid from named n left join have h on h.oid = n.dst where h.kind is null or h.kind <> want),
p as (select oid, list(parent order by parent) as ps from commit_parent group by oid), q as (select oid, list(parent order by parent) as ps from contribution_parent group by oid)
select c.oid, contrib as receipt, case when contrib is null then 'none' when x.oid is null or contrib in (select oid from bad) then 'corrupt' when c.tree <> x.tree or x.agent <> {AGENTS['commits'].replace('oid', 'c.oid')} or p.ps is distinct from q.ps then 'differs' else 'ok' end as outcome
from commits c left join x on x.oid = contrib left join p on p.oid = c.oid left join q on q.oid = contrib""",
    "verify_tags": f"""with {RELS}, n as (select oid, commit, {OTHER['snapshots']} as tree from snapshots), c as (select oid, {OTHER['commits']} as tree from commits), t as (select tag from seals union select name[6:] from refs where starts_with(name, 'tags/'))
select t.tag, case when r.oid is null then 'noref' when s.tag is null then 'noseal' when not (r.oid = snap_oid and r.kind = 'snapshot' and protected and sealed) then 'flags' when n.oid is null or n.commit <> commit_oid or n.tree <> tree_oid then 'snapshot' when c.oid is null or c.tree <> tree_oid then 'commit' else 'ok' end as outcome
from t left join refs r on r.name = concat('tags/', t.tag) left join seals s on s.tag = t.tag left join n on n.oid = snap_oid left join c on c.oid = commit_oid""",
    "seal_plan": f"""with {RELS}, {asked_sql('seals_asked')}, {KNOWN}, j as (select a.*, case when tag = 'bad tag' then 'invalid' when r.oid is null then 'notfound' when h.kind is distinct from 'commit' then 'notcommit' when concat('tags/', tag) in (select name from refs) then 'sealed' when r.oid <> expected then 'stale' end as wrong
  from seals_asked a left join refs r on r.name = a.ref left join have h on h.oid = expected) select seq, coalesce(wrong, case when row_number() over (partition by tag, wrong is null order by seq) = 1 then 'sealable' else 'sealed' end) as outcome from j""",
    "migrate_mounts": f"""with {RELS}, m as (select ns_id, path, spec, mode, {UNPINNED} as had from mounts), j as (select m.*, case when mode = 'rw' and had is null then coalesce((select n.pinned_oid from namespaces n where n.id = ns_id and (spec = n.live_ref or spec = concat('ref:', n.live_ref))), (select r.oid from refs r where spec = r.name or spec = concat('ref:', r.name))) else had end as base_oid from m)
select ns_id, path, spec, case when mode = 'rw' and base_oid is null and starts_with(spec, 'oid:') then 'ro' else mode end as mode, base_oid from j""",
    "migrate_observations": f"with {RELS} select ns_id, mount, path, 'blob' as kind, oid from observations where oid is not null",
    "ns_access": f"with {RELS}, {asked_sql('uses')} select seq, case when n.id is null then 'unknown' when agent_id = agent then 'ok' else 'denied' end as outcome from uses left join namespaces n on n.id = ns_id",
    "write_plan": f"""with {RELS}, {asked_sql('writes')}, a as (select seq, ns_id, case when path = '/a//b' then null when starts_with(path, '/') then path else concat('/', path) end as p from writes),
m as (select a.*, m.path as held, m.mode, row_number() over (partition by seq order by length(m.path) desc) as n from a left join mounts m on m.ns_id = a.ns_id and (m.path = '/' or m.path = p or starts_with(p, concat(m.path, '/')))),
r as (select *, case when p = held then '' when held = '/' then p[2:] else p[length(held) + 2:] end as rel from m where n = 1),
j as (select r.*, case when ns_id not in (select id from namespaces) then 'unknown' when p is null then 'invalid' when held is null then 'nomount' when mode <> 'rw' then 'readonly' when rel = '' then 'root'
  when exists (select 1 from overlay o where o.ns_id = r.ns_id and o.mount = held and (starts_with(o.path, concat(rel, '/')) or starts_with(rel, concat(o.path, '/')))) then 'conflict' else 'staged' end as outcome from r)
select seq, outcome, case when outcome = 'staged' then held end as mount, case when outcome = 'staged' then rel end as path from j""",
    "observe_plan": f"""with {RELS}, {asked_sql('seen')}, l as (select * from seen qualify row_number() over (partition by ns_id, mount, path order by seq desc) = 1)
select ns_id, mount, path, kind, oid from l where not exists (select 1 from observations o where o.ns_id = l.ns_id and o.mount = l.mount and o.path = l.path and o.kind = l.kind and o.oid is not distinct from l.oid)""",
    "resolve_plan": f"""with {RELS}, {asked_sql('targets', 'settlings')}, {KNOWN}, b as (select oid, count(*) as n from (select oid from conflict_base union all select oid from conflict_base where {MORE}) group by oid),
s as (select a.*, c.ours, c.theirs, h.oid as head, case choice when 'ours' then c.ours when 'theirs' then c.theirs else choice[5:] end as tree from settlings a left join targets h on h.name = into_ left join conflicts c on c.oid = conflict),
j as (select s.*, case when head is null then 'notfound' when ours is null then 'missing' when not exists (select 1 from targets t where t.kind = 'conflict' and t.oid = conflict and regexp_matches(t.name, concat('^conflicts/', into_, '/[^/]+$'))) then 'unpublished'
  when (conflict, head) not in (select oid, "commit" from conflict_causal) then 'stale' when choice in ('ours', 'theirs') then 'resolved' when o.kind is null then 'missing' when o.kind <> 'tree' then 'notree'
  when conflict not in (select oid from conflict_path where {PATHS}) then case when tree in (ours, theirs) then 'resolved' else 'sides' end when (select n from b where b.oid = conflict) > 1 then 'bases' when {BEYOND} then 'scope' else 'resolved' end as outcome from s left join have o on o.oid = tree)
select seq, outcome, case when outcome = 'resolved' then tree end as tree from j""",
    "tree_walk": f"""with recursive {RELS}, w as (select distinct tree as root, name as path, kind, id from tree_entry where tree in (select tree from tree_entry where kind = 'tree')
  union select w.root, concat(w.path, '/', e.name), e.kind, e.id from w join tree_entry e on w.kind = 'tree' and e.tree = w.id) select * from w""",
    "verified_get": f"""with st as ({STORED.format(sha='sha256', bits='', documents='documents')}), a as (select oid from st union select sha256(text) from documents),
j as (select a.oid, case when st.oid is null then 'missing' when sha256(data) <> a.oid then 'corrupt' else 'ok' end as outcome, strlen(data) as n from a left join st on st.oid = a.oid) select oid, outcome, case when outcome = 'ok' then n end as size from j""",
}
