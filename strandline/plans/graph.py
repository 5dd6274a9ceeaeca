"""Queries of the assembly graph and of phasing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strandline.functions.bridge import READS_SQL, REF_SQL, reads, reference
from strandline.operators import graph as G
from strandline.operators import phase as H
from strandline.operators import variants as V
from strandline.plans import register
from strandline.plans.variants import ID_SQL, PILE_SQL, ided
from strandline.session import staged

K = 15
KEYS = ["contig"]
VERT_SQL = f"""{REF_SQL}, vraw as (select contig, {K} - 2 as pos, 'B' || substr(seq, 1, {K} - 1) as kmer, 'start' as vtype from ref union all select contig, p::int, substr(seq, p::int - {K} + 2, {K}), 'middle' from (select contig, seq, unnest(range({K} - 1, 2048)) as p from ref)
  union all select contig, 2048, substr(seq, 2048 - {K} + 2) || 'B', 'end' from ref),
vert as (select contig, pos::int as pos, kmer, vtype, (row_number() over (partition by contig, kmer order by pos) - 1)::int as ctx from vraw),
redge as (select * from (select contig, kmer as src, ctx as src_ctx, lead(kmer) over w as dst, lead(ctx) over w as dst_ctx from vert window w as (partition by contig order by pos)) where dst is not null)"""
STEP_SQL = f"""{READS_SQL}, own as (select contig, {ID_SQL} as read, seq, qual from reads),
steps as (select contig, substr(seq, i::int + 1, {K}) as src, substr(seq, i::int + 2, {K}) as dst, read, (i + {K})::int as pos, (ascii(substr(qual, i::int + {K} + 1, 1)) - 33)::int as q from (select *, unnest(range(0, 60 - {K})) as i from own)),
edges as (select contig, src, dst, count(*) as n, max(pos) as last_pos from steps group by 1, 2, 3)"""


def vertices(spark, sf):
    return G.reference_vertices(reference(spark, sf).select("contig", "seq"), K, KEYS)


def named(spark, sf):
    return ided(reads(spark, sf)).withColumnRenamed("id", "read")


def steps(spark, sf):
    return G.read_edges(named(spark, sf), K, KEYS)


def support(spark, sf):
    return G.support_of_reads(reads(spark, sf), K, KEYS)


@register("G2_ref_vertices", f"with {VERT_SQL} select * from vert")
def g2(spark, sf):
    return vertices(spark, sf)


@register("G2_ref_edges", f"with {VERT_SQL} select * from redge")
def g2e(spark, sf):
    return G.reference_edges(vertices(spark, sf), KEYS)


@register("J2_vertex_sets", f"with {STEP_SQL}, {VERT_SQL.replace(REF_SQL + ',', '')}, rk as (select contig, read, pos, src as kmer from steps) select rk.contig, rk.read, rk.pos, rk.kmer, coalesce(v.ctx, 0)::int as ctx, coalesce(vtype, 'read') as vtype from rk left join vert v using (contig, kmer)")
def j2(spark, sf):
    rk = steps(spark, sf).select("contig", "read", F.col("pos").alias("at"), F.col("src").alias("kmer"))
    return G.vertex_sets(rk, vertices(spark, sf), KEYS).select("contig", "read", F.col("at").alias("pos"), "kmer", F.col("ctx").cast("int").alias("ctx"), "vtype")


@register("G7_edge_support", f"with {STEP_SQL} select * from edges")
def g7(spark, sf):
    return support(spark, sf)


@register("F9_edge_prune", f"with {STEP_SQL} select * from edges where n > 4 and last_pos >= {2 * K}")
def f9(spark, sf):
    return G.supported(support(spark, sf), K)


@register("A8_G15_edge_weight", f"with {STEP_SQL}, f as (select contig, src, dst, read, arg_min(q, pos) as q from steps group by 1, 2, 3, 4) select contig, src, dst, sum(case when q >= 21 then 100 else 0 end)::bigint as weight from f group by 1, 2, 3")
def a8(spark, sf):
    return G.read_weights(named(spark, sf), K, KEYS)


@register("A22_degrees", f"with {STEP_SQL}, e as (select contig, src as kmer, 0 as i, 1 as o from edges union all select contig, dst, 1, 0 from edges) select contig, kmer, sum(i)::bigint as din, sum(o)::bigint as dout from e group by 1, 2")
def a22(spark, sf):
    return G.degrees(support(spark, sf), KEYS)


@register("J3_A23_edge_types", f"with {STEP_SQL}, {VERT_SQL.replace(REF_SQL + ',', '')}, k as (select distinct contig, src, dst from redge) select e.contig, case when k.src is null then 'read' else 'reference' end as etype, count(*) as n from edges e left join k using (contig, src, dst) group by 1, 2")
def a23(spark, sf):
    e = G.edge_types(support(spark, sf), G.reference_edges(vertices(spark, sf), KEYS), KEYS)
    return G.type_counts(e, KEYS, "etype")


@register("K4_dot", f"with {STEP_SQL}, {VERT_SQL.replace(REF_SQL + ',', '')}, k as (select distinct contig, src, dst from redge) select e.contig, '\"' || e.src || '\" -> \"' || e.dst || '\" [color=' || case when k.src is null then 'red' else 'green' end || ',label=\"' || e.n || '\"];' as line from edges e left join k using (contig, src, dst)")
def k4(spark, sf):
    return G.dot(G.edge_types(support(spark, sf), G.reference_edges(vertices(spark, sf), KEYS), KEYS), KEYS)


@register(
    "G12_without_dead_ends",
    f"""with recursive {STEP_SQL}, good as (select contig, src, dst from edges where n > 4),
seed as (select contig, substr(seq, 200, {K}) as a, substr(seq, 1800, {K}) as z, substr(alt, 200, {K}) as b, substr(alt, 1800, {K}) as y from hap),
heads as (select contig, a as kmer from seed union select contig, b from seed), tails as (select contig, z as kmer from seed union select contig, y from seed),
ahead as (select contig, kmer from heads union select g.contig, g.dst from ahead r join good g on g.contig = r.contig and g.src = r.kmer),
back as (select contig, kmer from tails union select g.contig, g.src from back r join good g on g.contig = r.contig and g.dst = r.kmer)
select g.contig, g.src, g.dst from good g join ahead a on a.contig = g.contig and a.kmer = g.src join back b on b.contig = g.contig and b.kmer = g.dst""",
)
def g12(spark, sf):
    """Without cycles, what no dead end eats is what lies on a way from a fixed k-mer to a later one."""
    good = support(spark, sf).filter("n > 4").select("contig", "src", "dst")
    ref = reference(spark, sf)
    ends = [F.substr(c, F.lit(at), F.lit(K)) for c in ("seq", "alt") for at in (200, 1800)]
    return G.without_dead_ends(good, KEYS, ref.select("contig", F.explode(F.array(*ends)).alias("kmer")).distinct())


CONTRACT_SQL = f"""good as (select contig, src, dst, n from edges where n > 4),
ends as (select contig, src as kmer, 0 as i, 1 as o from good union all select contig, dst, 1, 0 from good),
inner_v as (select e.contig, e.kmer, (case when k.kmer is null then '0' else '1' end) || e.kmer as place from (select contig, kmer from ends group by 1, 2 having sum(i) = 1 and sum(o) = 1) e left join (select distinct contig, kmer from vert) k using (contig, kmer)),
walk as (select g.contig, g.src as head, g.dst as first, g.src, g.dst, g.n, 1 as i from good g anti join inner_v v on v.contig = g.contig and v.kmer = g.src
  union all select w.contig, w.head, w.first, g.src, g.dst, g.n, w.i + 1 from walk w join inner_v v on v.contig = w.contig and v.kmer = w.dst join good g on g.contig = w.contig and g.src = w.dst),
marks as (select w.*, v.place from walk w left join inner_v v on v.contig = w.contig and v.kmer = w.dst),
chain as (select contig, head, first, arg_max(dst, i) as tail, max(place) as top, arg_max(i, place) as spot from marks group by 1, 2, 3),
ranked as (select *, row_number() over (partition by contig, head, tail order by top nulls first) as o from chain)"""


@register(
    "G13_contracted",
    f"""with recursive {STEP_SQL}, {VERT_SQL.replace(REF_SQL + ',', '')}, {CONTRACT_SQL}
select contig, src, dst, bases, n, steps from (select contig, head, first, coalesce((o > 1 or head = tail) and i > spot, false) as late, arg_min(src, i) as src, arg_max(dst, i) as dst, string_agg(right(dst, 1), '' order by i) as bases, max(n) as n, count(*) as steps
  from marks join ranked using (contig, head, first) group by 1, 2, 3, 4)""",
)
def g13(spark, sf):
    """Linear stretches as one edge; of the two sides of a site one keeps a vertex."""
    return G.contracted(support(spark, sf).filter("n > 4"), KEYS, vertices(spark, sf).select("contig", "kmer").distinct())


@register(
    "K4_dot_vertices",
    f"""with {STEP_SQL}, {VERT_SQL.replace(REF_SQL + ',', '')}, k as (select *, count(*) over (partition by contig, kmer) as times from vert), e as (select contig, src as kmer from edges union select contig, dst from edges)
select contig, '"' || kmer || case when ctx > 0 then '#' || ctx else '' end || '"[label="' || kmer || '\\nRef\\nPOS: ' || pos || '\\n' || case when times = 1 then 'unique' else 'repeat' end || '",style=filled,color=' || case vtype when 'start' then 'yellow' when 'middle' then 'lightgreen' else 'blue' end || '];' as line from k
union all select contig, '"' || kmer || '"[label="' || kmer || '\\nRead",style=filled,color=red];' from e anti join vert using (contig, kmer)""",
)
def k4v(spark, sf):
    return G.dot_vertices(vertices(spark, sf), support(spark, sf), KEYS)


@register(
    "K4_edges_by_stage",
    f"""with recursive {STEP_SQL}, {VERT_SQL.replace(REF_SQL + ',', '')}, sup as (select contig, src, dst, n from edges where n > 4 and last_pos >= {2 * K}),
fix as (select distinct contig, kmer from vert where vtype = 'middle'),
ahead as (select s.contig, s.src as kmer from sup s join fix f on f.contig = s.contig and f.kmer = s.src union select s.contig, s.dst from ahead a join sup s on s.contig = a.contig and s.src = a.kmer),
back as (select s.contig, s.dst as kmer from sup s join fix f on f.contig = s.contig and f.kmer = s.dst union select s.contig, s.src from back a join sup s on s.contig = a.contig and s.dst = a.kmer),
kept as (select s.* from sup s semi join ahead a on a.contig = s.contig and a.kmer = s.src semi join back b on b.contig = s.contig and b.kmer = s.dst),
{CONTRACT_SQL.replace('from edges where n > 4', 'from kept')}
select 'read' as stage, contig, count(*) as n from edges group by 2 union all select 'supported', contig, count(*) from sup group by 2 union all select 'trimmed', contig, count(*) from kept group by 2
union all select 'contracted', contig, count(*) from (select contig, head, first, coalesce((o > 1 or head = tail) and i > spot, false) as late from marks join ranked using (contig, head, first) group by 1, 2, 3, 4) group by 2""",
)
def k4s(spark, sf):
    """How many edges there are after each stage."""
    found = G.stages(vertices(spark, sf), staged(support(spark, sf), "support"), K, KEYS)
    each = [df.groupBy("contig").agg(F.count("*").alias("n")).withColumn("stage", F.lit(name)) for name, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b), each).select("stage", "contig", "n")


PAIR_KEYS = ("contig", "src", "dst", "next")
NEXT_SQL = f"""{STEP_SQL}, pairs as (select e.contig, e.src, e.dst, f.dst as next from edges e join edges f on e.contig = f.contig and e.dst = f.src),
na as (select p.*, s.read, s.pos, s.q from pairs p join steps s using (contig, src, dst)),
nb as (select p.*, s.read, s.pos, s.q from pairs p join steps s on s.contig = p.contig and s.src = p.dst and s.dst = p.next)"""
SAME_SQL = "na.contig = nb.contig and na.src = nb.src and na.dst = nb.dst and na.next = nb.next and na.read = nb.read"


def next_supports(spark, sf):
    """Supports of every two successive edges, over all steps."""
    return G.Successive(named(spark, sf), K, KEYS)


@register("J4_support_intersection", f"with {NEXT_SQL} select * from na where exists (select 1 from nb where {SAME_SQL} and na.pos + 1 = nb.pos)")
def j4n(spark, sf):
    return next_supports(spark, sf).intersection()


@register("J5_support_difference", f"with {NEXT_SQL} select * from nb where not exists (select 1 from na where {SAME_SQL} and na.pos + 1 = nb.pos)")
def j5n(spark, sf):
    return next_supports(spark, sf).difference()


@register("U3_support_union", f"with {NEXT_SQL} select * from na union select * from nb")
def u3n(spark, sf):
    return next_supports(spark, sf).union()


@register("U4_support_merge", f"with {NEXT_SQL}, u as (select * from na union all select * from nb) select contig, src, dst, next, read, min(pos) as pos, arg_min(q, pos) as q from u group by all")
def u4n(spark, sf):
    return next_supports(spark, sf).merge()


@register("A10_O6_supporting_reads", f"with {NEXT_SQL}, u as (select * from na union all select * from nb) select contig, src, dst, next, list_sort(list(distinct read)) as reads from u group by all")
def a10n(spark, sf):
    if (found := G.reads_of_pairs(named(spark, sf), K, KEYS)) is not None:
        return found
    sup = next_supports(spark, sf).merge().groupBy(*PAIR_KEYS).agg(F.collect_list(F.struct("read")).alias("sup"))
    return sup.select(*PAIR_KEYS, G.supporting_reads(F.array("sup")).alias("reads"))


@register("X15_spelled", f"with {REF_SQL} select contig, seq from ref")
def x15(spark, sf):
    v = vertices(spark, sf).filter("vtype = 'middle'").groupBy("contig").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kmer"))), lambda x: x.kmer).alias("p"))
    return v.select("contig", G.spelled(F.col("p")).alias("seq"))


VID_SQL = f"{READS_SQL}, {PILE_SQL}, vs as (select chrom::bigint * 100000 + pos as vid, * from calls)"


def with_vid(spark, sf):
    return V.sites(ided(reads(spark, sf)), reference(spark, sf)).withColumn("vid", F.col("chrom").cast("bigint") * 100000 + F.col("pos"))


TOUCH_SQL = "touch as (select unnest(ref_reads) as read, vid, 0 as side from vs union all select unnest(alt_reads), vid, 1 from vs)"


@register("J8_touched", f"with {VID_SQL}, {TOUCH_SQL} select * from touch")
def j8(spark, sf):
    return V.touches(ided(reads(spark, sf)), with_vid(spark, sf)).select("read", "vid", "side")


ADJ_SQL = """nx as (select *, lead(vid) over w as v2, lead(ref_reads) over w as r2, lead(alt_reads) over w as a2 from vs window w as (partition by chrom order by pos, ref, alt)),
adj as (select v1, s1, v2, s2, n from (select vid as v1, 0 as s1, v2, 0 as s2, len(list_intersect(ref_reads, r2))::int as n from nx union all select vid, 0, v2, 1, len(list_intersect(ref_reads, a2)) from nx union all select vid, 1, v2, 0, len(list_intersect(alt_reads, r2)) from nx union all select vid, 1, v2, 1, len(list_intersect(alt_reads, a2)) from nx) where v2 is not null and n > 0)"""


PAIR_SQL = f"""{TOUCH_SQL}, nm as (select {ID_SQL} as read, qname from reads), tn as (select * from touch join nm using (read)),
pe as (select least(struct_pack(v := a.vid, s := a.side), struct_pack(v := b.vid, s := b.side)) as x, greatest(struct_pack(v := a.vid, s := a.side), struct_pack(v := b.vid, s := b.side)) as y from tn a join tn b on a.qname = b.qname and a.read < b.read and a.vid <> b.vid),
paired as (select x.v as v1, x.s as s1, y.v as v2, y.s as s2, count(*) as n from pe group by 1, 2, 3, 4)"""


def paired(spark, sf, v, threshold=0):
    return H.paired_touches(V.named_touches(ided(reads(spark, sf)), v), threshold)


@register("J9_H3_paired_edges", f"with {VID_SQL}, {PAIR_SQL} select * from paired")
def j9(spark, sf):
    return paired(spark, sf, with_vid(spark, sf))


COMP_SQL = f"{ADJ_SQL}, {PAIR_SQL}, el as (select v1 as a, v2 as b from adj union select v2, v1 from adj union select v1, v2 from paired where n > 1 union select v2, v1 from paired where n > 1), reach as (select vid, vid as c from vs union select el.b, reach.c from reach join el on el.a = reach.vid), comp as (select vid, min(c) as component from reach group by 1)"


def component_input(spark, sf):
    v = with_vid(spark, sf)
    near = H.site_edges(V.shared(ided(reads(spark, sf)), v), 0)
    return v, near.withColumn("n", F.col("n").cast("bigint")).unionByName(paired(spark, sf, v, 1))


@register("H4_components", f"with recursive {VID_SQL}, {COMP_SQL} select * from comp")
def h4(spark, sf):
    v, edges = component_input(spark, sf)
    return H.variant_components(v, edges)
