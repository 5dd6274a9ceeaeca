"""op10: `pages` through WARC archives."""

from strandline.llm.registry import register
from strandline.llm.warc import round_trip
from strandline.session import table

_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
b as (
  select *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1) for i in range(0, 32)], '') as payload_digest,
    min(page_id) over (partition by h) as first from p)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from b"""


@register("op10_warc_round_trip", _SQL)
def op10(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"))
