"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import MOST, SEED, WEIGHTS

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP4 = f"""
with sized as (select doc_id, source, len({WORDS})::bigint as size from documents),
sums as (select source, sum(size)::bigint as source_size from sized group by source),
placed as (select *, ([{", ".join(f"{w}.0" for w in WEIGHTS)}])[((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int]::double as w from sums),
capped as (select *, ({MOST} * source_size)::double as cap, sum(source_size) over () as everything,
  sum(({MOST} * source_size)::double) over (order by ({MOST} * source_size) / w, source nulls last rows between unbounded preceding and 1 preceding) as stopped,
  sum(w) over (order by ({MOST} * source_size) / w, source nulls last rows between current row and unbounded following) as rest from placed),
level as (select arg_min((everything::double - coalesce(stopped, 0.0)) / rest, n) as l from
  (select *, row_number() over (order by cap / w, source nulls last) as n from capped)
  where (everything::double - coalesce(stopped, 0.0)) / rest * w <= cap),
rates as (select source, source_size, least(w * l, cap) as target from capped, level),
drawn as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / {float(1 << 52)!r}::double as u
  from sized join rates on sized.source is not distinct from rates.source)
select doc_id, size, source_size, target, ((floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken from drawn
"""

OP9 = """
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r as q, q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r),
t as (select *, row_number() over (partition by q order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from t where rank <= 5
"""

SQL = {"op4_mix_sources": OP4, "op9_exact_top_k": OP9}
