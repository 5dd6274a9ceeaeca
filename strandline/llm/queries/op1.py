"""op1: near-duplicates among `documents`."""

from strandline.llm.near_dedup import near_groups
from strandline.llm.registry import register
from strandline.session import table

_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest([array_to_string(ws[i : i + 4], ' ') for i in range(1, greatest(2, len(ws) - 3))]) as sh from w where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 75 * (na.n + nb.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.doc_id),
c as (select doc_id, min(c) as component_id from r group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id"""


@register("op1_lsh_forest_dedup", _SQL)
def op1(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))
