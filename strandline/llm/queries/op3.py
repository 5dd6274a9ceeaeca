"""op3: the mix of `documents`."""

from strandline.llm.mixing import MOST_EPOCHS, SALT, SHARE, WEIGHTS, WORD, mixed
from strandline.llm.registry import register
from strandline.session import table

_SQL = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size, md5('{SALT}' || coalesce(doc_id::varchar, md5(coalesce(text, '')))) as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [{', '.join(f'{x}.0::double' for x in WEIGHTS)}][((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] as weight, {MOST_EPOCHS} * source_size::double as cap from s),
l as (
  select *, ({SHARE}::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level,
    coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped_before from w),
t as (select source, source_size, coalesce(least(cap, (arg_min(level, capped_before) filter (level * weight <= cap) over ()) * weight), cap) as target from l),
p as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget, case when t.source_size > 0 then floor(t.target)::bigint // t.source_size else 0 end as epochs,
    sum(d.size) over (partition by d.source order by key, d.size rows between unbounded preceding and current row) - d.size as start
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::bigint as taken from p"""


@register("op3_mix_sources", _SQL)
def op3(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents")).drop("text_hash")
