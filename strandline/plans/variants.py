"""Queries of variants, pile-ups and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.bridge import READS_SQL, REF_SQL, reads, reference
from strandline.operators import compare as C
from strandline.operators import variants as V
from strandline.plans import register

ID_SQL = "l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey"


def ided(df):
    return df.withColumn("id", F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


PILE_SQL = f"""ids as (select {ID_SQL} as id, * from reads),
each as (select contig, id, (pos0 + i - 1)::bigint as pos, (i - 1)::int as i, substr(seq, i::int, 1) as base, ascii(substr(qual, i::int, 1)) - 33 as q from (select *, unnest(range(1, 61)) as i from ids)),
pile as (select contig, pos, base, count(*) as n, list_sort(list(id)) as reads from each group by 1, 2, 3),
truth as (select contig, p::bigint as pos, substr(seq, p::int + 1, 1) as ref from (select contig, seq, unnest(range(0, 2048)) as p from ref)),
calls as (select a.contig::varchar as chrom, a.pos + 1 as pos, t.ref, a.base as alt, coalesce(o.n, 0) as rc, a.n as ac, coalesce(o.reads, []) as ref_reads, a.reads as alt_reads
  from pile a join truth t on t.contig = a.contig and t.pos = a.pos left join pile o on o.contig = a.contig and o.pos = a.pos and o.base = t.ref where a.base <> t.ref and a.n > 4)"""
PLANTED_SQL = "planted as (select contig::varchar as chrom, p::bigint as pos, substr(seq, p::int, 1) as ref, substr(alt, p::int, 1) as alt from (select contig, seq, alt, unnest(range(1, 2049)) as p from hap) where p % 97 = 13)"


def calls(spark, sf):
    return V.snp_calls(V.pileup(ided(reads(spark, sf))), reference(spark, sf))


def planted(spark, sf):
    """chrom, pos, ref, alt: the substitutions of the alternate haplotypes."""
    d = reference(spark, sf).select(F.col("contig").cast("string").alias("chrom"), F.inline(V.differences(F.col("seq"), F.col("alt"))))
    return d.select("chrom", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("a").alias("ref"), F.col("b").alias("alt"))


@register("A21_pileup", f"with {READS_SQL}, {PILE_SQL} select contig, pos, base, n from pile")
def a21(spark, sf):
    return V.pileup(ided(reads(spark, sf))).select("contig", "pos", "base", "n")


@register("A21_snp_calls", f"with {READS_SQL}, {PILE_SQL} select chrom, pos, ref, alt, rc, ac from calls")
def a21c(spark, sf):
    return calls(spark, sf).select("chrom", "pos", "ref", "alt", "rc", "ac")


BP_SQL = """(case when {r} + {a} = 0 then 100 else round(least(1.0::double, 2 * list_sum([exp(lgamma(({r} + {a} + 1)::double) - lgamma((k + 1)::double) - lgamma(({r} + {a} - k + 1)::double) - ({r} + {a}) * ln(2.0::double)) for k in range({r}, {r} + {a} + 1)])) * 100 + 1e-6) end)::int"""


@register("X11_binomial", f"with {READS_SQL}, {PILE_SQL} select chrom, pos, alt, {BP_SQL.format(r='rc', a='ac')} as bp from calls")
def x11(spark, sf):
    return calls(spark, sf).select("chrom", "pos", "alt", V.binomial_percent(F.col("rc"), F.col("ac")).alias("bp"))


@register("F10_reliable", f"with {READS_SQL}, {PILE_SQL}, b as (select chrom, pos, alt, rc, ac, {BP_SQL.format(r='rc', a='ac')} as bp from calls) select * from b where ac > 12 or bp >= 30")
def f10(spark, sf):
    c = calls(spark, sf).select("chrom", "pos", "alt", "rc", "ac", V.binomial_percent(F.col("rc"), F.col("ac")).alias("bp"))
    return V.reliable(c, 12, 30)


#: Records with alleles of every type, from line items.
REC_SQL = """recs as (select (l_suppkey % 5)::varchar as chrom, (1 + l_partkey * 13 % 997)::bigint as pos, repeat('AC', (l_linenumber % 3)::int) || substr('ACGT', (1 + l_partkey % 4)::int, 1) || repeat('G', (l_quantity::int % 45)) as ref,
  repeat('AC', (l_linenumber % 3)::int) || substr('ACGT', (1 + l_suppkey % 4)::int, 1) || repeat('T', (l_orderkey % 3)::int) as alt, (l_quantity * 100)::bigint as aw, (l_linenumber * 7)::bigint as ac, (21 + 10 * (l_linenumber % 3))::int as ks, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)"""
NORM_SQL = """norm as (select *, coalesce((select min(i) - 1 from range(1, least(length(ref), length(alt))) t(i) where substr(ref, i::int, 1) <> substr(alt, i::int, 1)), greatest(0, least(length(ref), length(alt)) - 1))::int as n from recs)"""


def records(spark, sf):
    from strandline.session import table

    li = table(spark, sf, "lineitem")
    head = F.expr("repeat('AC', cast(l_linenumber % 3 as int))")
    base = lambda c: F.substr(F.lit("ACGT"), (F.col(c) % 4 + 1).cast("int"), F.lit(1))
    return li.select(
        (F.col("l_suppkey") % 5).cast("string").alias("chrom"), (F.col("l_partkey") * 13 % 997 + 1).cast("bigint").alias("pos"),
        F.concat(head, base("l_partkey"), F.expr("repeat('G', cast(l_quantity as int) % 45)")).alias("ref"), F.concat(head, base("l_suppkey"), F.expr("repeat('T', cast(l_orderkey % 3 as int))")).alias("alt"),
        (F.col("l_quantity") * 100).cast("bigint").alias("aw"), (F.col("l_linenumber") * 7).cast("bigint").alias("ac"), (F.col("l_linenumber") % 3 * 10 + 21).cast("int").alias("ks"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@register("X7_normalised", f"with {REC_SQL}, {NORM_SQL} select {KEYS}, pos + n as pos, substr(ref, n + 1) as ref, substr(alt, n + 1) as alt from norm")
def x7(spark, sf):
    return V.normalised(records(spark, sf)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pos", "ref", "alt")


TYPE_SQL = "case when length(ref) = 1 and length(alt) = 1 then 'SNP' when length(ref) = 1 then 'INSERTION' when length(alt) = 1 then 'DELETION' else 'REPLACE' end"


@register("X8_A13_type_counts", f"with {REC_SQL} select {TYPE_SQL} as vtype, count(*) as n from recs group by 1")
def x8(spark, sf):
    return C.type_counts(records(spark, sf))


@register("A14_length_histogram", f"with {REC_SQL}, t as (select {TYPE_SQL} as vtype, abs(length(alt) - length(ref))::int as len from recs) select vtype, len, count(*) as n from t where vtype in ('INSERTION', 'DELETION') group by 1, 2")
def a14(spark, sf):
    return C.length_histogram(records(spark, sf))


@register("X9_info_fields", f"with {REC_SQL} select {KEYS}, aw::int as aw, ac::int as ac, 0 as rw, 7 as rc from recs")
def x9(spark, sf):
    r = records(spark, sf).withColumn("info", F.when(F.col("l_orderkey") % 2 == 0, F.format_string("RC=7;AW=%d;AC=%d;KS=1", "aw", "ac")).otherwise(F.format_string("RefCount=7;AW=%d;AltCount=%d", "aw", "ac")))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(k) for k, c in V.info_fields(F.col("info"), V.INFO_NAMES).items()])


@register("X12_phred", "select q, pow(10.0::double, -q / 10.0::double) as p from range(0, 71) t(q)")
def x12(spark, sf):
    return spark.range(71).select(F.col("id").alias("q"), V.phred_probability(F.col("id")).alias("p"))


@register("X14_differences", f"with {REF_SQL}, {PLANTED_SQL} select * from planted")
def x14(spark, sf):
    return planted(spark, sf)


@register("F11_long_reference", f"with {REC_SQL} select {KEYS}, length(ref) < 40 as valid from recs")
def f11(spark, sf):
    return V.flag_long(records(spark, sf)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "valid")


@register("F12_type_filter", f"with {REC_SQL} select {KEYS}, ref, alt from recs where {TYPE_SQL} in ('SNP', 'REPLACE')")
def f12(spark, sf):
    return C.of_types(records(spark, sf), {"SNP"}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ref", "alt")


@register("F13_weight_filter", f"with {REC_SQL} select {KEYS}, aw, ac from recs where aw >= 1000 and ac <> 0 and aw // ac >= 100")
def f13(spark, sf):
    return C.of_weight(records(spark, sf), 1000, 100).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "aw", "ac")


DEDUP_SQL = "row_number() over (partition by chrom, pos, ref, alt order by aw desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1"
TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("A12_deduplicated", f"with {REC_SQL} select chrom, pos, ref, alt, aw, {KEYS} from recs qualify {DEDUP_SQL}")
def a12(spark, sf):
    return V.deduplicated(records(spark, sf), "aw", TIES).select("chrom", "pos", "ref", "alt", "aw", *TIES)


HALVES = f"{REC_SQL}, a as (select chrom, pos, ref, alt, max(aw) as aw, min(ks) as ks from recs where l_orderkey % 2 = 0 group by 1, 2, 3, 4), b as (select chrom, pos, ref, alt, max(aw) as aw, min(ks) as ks from recs where l_orderkey % 2 = 1 group by 1, 2, 3, 4)"


def halves(spark, sf):
    r = records(spark, sf)
    half = lambda i: r.filter(F.col("l_orderkey") % 2 == i).groupBy("chrom", "pos", "ref", "alt").agg(F.max("aw").alias("aw"), F.min("ks").alias("ks"))
    return half(0), half(1)


@register("U1_intersection", f"with {HALVES} select a.chrom, a.pos, a.ref, a.alt, a.aw, least(a.ks, b.ks) as ks from a join b using (chrom, pos, ref, alt)")
def u1(spark, sf):
    return V.intersection(*halves(spark, sf))


@register("U2_union", f"with {HALVES} select chrom, pos, ref, alt, max(aw) as aw from (select * from a union all select * from b) group by 1, 2, 3, 4")
def u2(spark, sf):
    return V.union(*halves(spark, sf)).select("chrom", "pos", "ref", "alt", "aw")


@register("O2_O3_merged", f"with {HALVES} select chrom, pos, ref, alt, max(aw) as aw from (select * from a union all select * from b) group by 1, 2, 3, 4")
def o3(spark, sf):
    return V.merged(list(halves(spark, sf))).select("chrom", "pos", "ref", "alt", "aw")


@register("A24_contig_lengths", f"with {REC_SQL} select chrom, arg_max(pos + length(ref), pos * 1000 + length(ref)) as length from recs group by 1")
def a24(spark, sf):
    return V.contig_lengths(records(spark, sf))


@register("J11_between_edges", f"with {REC_SQL}, e as (select distinct (l_suppkey % 5)::varchar as chrom, (l_partkey * 7 % 900)::bigint as start, (l_partkey * 7 % 900 + 50)::bigint as \"end\" from lineitem), v as (select distinct chrom, pos from recs) select v.chrom, v.pos, e.start, e.\"end\" from v join e on v.chrom = e.chrom and e.start <= v.pos and v.pos < e.\"end\"")
def j11(spark, sf):
    v = records(spark, sf).select("chrom", "pos").distinct()
    from strandline.session import table

    start = (F.col("l_partkey") * 7 % 900).cast("bigint")
    e = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("chrom"), start.alias("start"), (start + 50).alias("end")).distinct()
    return V.between_edges(v, e)


INC_SQL = f"""with {READS_SQL}, {PILE_SQL}, {PLANTED_SQL},
ta as (select chrom, pos, ref, case when pos % 5 = 0 then 'N' else alt end as alt, row_number() over (partition by chrom, pos order by ref, case when pos % 5 = 0 then 'N' else alt end) as rn from planted),
tb as (select chrom, pos, ref, alt, row_number() over (partition by chrom, pos order by ref, alt) as rn from calls),
met as (select coalesce(ta.chrom, tb.chrom) as chrom, coalesce(ta.pos, tb.pos) as pos, ta.ref as ra, ta.alt as aa, tb.ref as rb, tb.alt as ab from ta full join tb on ta.chrom = tb.chrom and ta.pos = tb.pos and ta.rn = tb.rn),
inc as (select 'TP' as incident, chrom, pos, ra as ref, aa as alt from met where ra = rb and aa = ab
  union all select 'FN', chrom, pos, ra, aa from met where ra is not null and not coalesce(ra = rb and aa = ab, false)
  union all select 'FP', chrom, pos, rb, ab from met where rb is not null and not coalesce(ra = rb and aa = ab, false))"""


def compared(spark, sf):
    truth = planted(spark, sf).withColumn("alt", F.when(F.col("pos") % 5 == 0, "N").otherwise(F.col("alt")))
    return C.incidents(truth, calls(spark, sf).select("chrom", "pos", "ref", "alt"))


@register("J12_J13_incidents", f"{INC_SQL} select * from inc")
def j12(spark, sf):
    return compared(spark, sf)


@register("A17_totals", f"{INC_SQL} select incident, count(*) as n from inc group by 1")
def a17(spark, sf):
    return C.totals(compared(spark, sf))


@register("F14_U7_false_calls", f"{INC_SQL} select * from inc where incident in ('FN', 'FP')")
def f14(spark, sf):
    return C.of_kinds(compared(spark, sf), {"FN", "FP"})


@register("A16_recall", f"{INC_SQL}, t as (select {TYPE_SQL} as vtype, count(*) filter (where incident = 'TP') as hits, count(*) as total from inc where incident <> 'FP' group by 1) select *, (hits + 1) * 100 // (total + 1) as percent from t")
def a16(spark, sf):
    return C.recall_percent(compared(spark, sf))


CROSS_SQL = ", ".join(f"case when sum({k}) over () > 0 then {k} * 100.0::double / sum({k}) over () else 0.0 end as {k}_share" for k in ("TP", "FN", "FP"))


@register("A15_length_crosstab", f"{INC_SQL}, t as (select (length(alt) - length(ref))::int as len, count(*) filter (where incident = 'TP') as TP, count(*) filter (where incident = 'FN') as FN, count(*) filter (where incident = 'FP') as FP from inc group by 1) select *, {CROSS_SQL} from t")
def a15(spark, sf):
    return C.length_crosstab(compared(spark, sf))


@register("W7_without_repeats", f"with {REC_SQL}, o as (select chrom, pos, ref, alt, row_number() over (order by chrom, pos, ref, alt, {KEYS}) as line from recs), p as (select *, lag({{'p': pos, 'r': ref, 'a': alt}}) over (partition by chrom order by line) as prev from o) select chrom, pos, ref, alt from p where prev is distinct from {{'p': pos, 'r': ref, 'a': alt}}")
def w7(spark, sf):
    r = records(spark, sf).withColumn("line", F.struct("pos", "ref", "alt", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return C.without_repeats(r).select("chrom", "pos", "ref", "alt")


@register("J14_contained", f"with {READS_SQL}, {PILE_SQL}, {PLANTED_SQL} select p.*, exists (select 1 from calls c where c.chrom = p.chrom and c.pos = p.pos and c.alt = p.alt) as found from planted p")
def j14(spark, sf):
    ref = reference(spark, sf).select(F.col("contig").cast("string").alias("chrom"), "seq")
    return C.contained(planted(spark, sf), calls(spark, sf), ref)
