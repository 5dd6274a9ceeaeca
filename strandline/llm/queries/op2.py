"""op2: exact duplicates among `documents`."""

from strandline.llm.exact_dedup import exact_groups
from strandline.llm.registry import register
from strandline.session import table

_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as c, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
  doc_id is not distinct from first_value(doc_id) over w as kept, sha256(norm) as text_sha256
from d window w as (partition by norm order by c desc, doc_id nulls first)"""


@register("op2_exact_dedup", _SQL)
def op2(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))
