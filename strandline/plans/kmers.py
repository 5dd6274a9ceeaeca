"""Queries of the k-mer family."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.bridge import READS_SQL, REF_SQL, reads, reference
from strandline.operators import kmers
from strandline.plans import register

K = 21
KMERS_SQL = f"kmers as (select substr(seq, i::int, {K}) as kmer from (select seq, unnest(range(1, length(seq) - {K} + 2)) as i from reads))"


@register("A4_kmer_histogram", f"with {READS_SQL}, {KMERS_SQL}, n as (select kmer, count(*) as n from kmers group by 1) select n as freq, count(*) as kmers from n group by 1")
def a4(spark, sf_dir):
    return kmers.histogram(kmers.count_plain(reads(spark, sf_dir), K))


RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
CANON = "least(kmer, " + RC.format("kmer") + ")"
ID_SQL = "l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey"
LOW = "".join(chr(c) for c in range(33, 53)).replace("'", "''")
QK = 15
COUNTS_SQL = f"""qk as (select substr(seq, i::int, {QK}) as kmer, substr(qual, i::int, {QK}) as q from (select seq, qual, unnest(range(1, 60 - {QK} + 2)) as i from reads)),
counts as (select {CANON} as kmer, least(count(*), 255) as occ, least(count(*) filter (where translate(q, '{LOW}', '') = q), 63) as occ_hi from qk group by 1)"""


def ided(df):
    return df.withColumn("id", F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def counts(spark, sf):
    return kmers.count_canonical(reads(spark, sf), QK)


def known(spark, sf):
    return kmers.count_known(reads(spark, sf), QK)


@register("A2_kmer_canonical", f"with {READS_SQL}, {COUNTS_SQL} select * from counts")
def a2(spark, sf):
    return counts(spark, sf)


@register("A3_kmer_plain", f"with {READS_SQL}, {KMERS_SQL} select kmer, count(*) as n from kmers group by 1")
def a3(spark, sf):
    return kmers.count_plain(reads(spark, sf), K)


@register("A4_mode", f"with {READS_SQL}, {COUNTS_SQL}, h as (select occ as freq, count(*) as kmers from counts where occ >= 3 group by 1) select freq as mode from h order by kmers desc, freq limit 1")
def a4m(spark, sf):
    return kmers.mode_of(kmers.histogram(counts(spark, sf), "occ"))


@register("A5_distinct_kmers", f"with {READS_SQL}, {KMERS_SQL} select count(distinct kmer) as kmers from kmers")
def a5(spark, sf):
    return kmers.count_plain(reads(spark, sf), K).agg(F.count("*").alias("kmers"))


@register(
    "A6_coverage_floor",
    f"with {READS_SQL}, {COUNTS_SQL}, h as (select occ as freq, count(*) as kmers from counts where occ >= 4 group by 1), m as (select sum(freq * kmers)::double / sum(kmers) as kcov from h) select kcov, greatest(4, least(8, floor(0.1::double * kcov + 0.499::double)))::int as min_cov from m",
)
def a6(spark, sf):
    return kmers.coverage_floor(kmers.histogram(counts(spark, sf), "occ"))


@register("A7_automatic_k", f"with {READS_SQL}, t as (select sum(length(seq))::bigint as total_bases from reads), b as (select total_bases, coalesce((select min(n) from range(10, 32) r(n) where pow(2, n) > total_bases), 32) as bits from t) select total_bases, (case when ((bits + 12) // 2) % 2 = 1 then (bits + 12) // 2 else (bits + 12) // 2 + 1 end)::int as k from b")
def a7(spark, sf):
    return kmers.automatic_k_of(reads(spark, sf))


@register("X2_reverse_complement", f"with {REF_SQL} select contig, {RC.format('seq')} as rc from ref")
def x2(spark, sf):
    return reference(spark, sf).select("contig", kmers.revcomp(F.col("seq")).alias("rc"))


@register(
    "X3_X4_kmer_edits",
    f"""with {REF_SQL}, k as (select contig, i::int as i, substr(seq, i::int + 1, 9) as kmer from (select contig, seq, unnest(range(0, 2040)) as i from ref))
select contig, i, instr('ACGT', substr(kmer, 5, 1))::int - 1 as code, substr(kmer, 2) || 'A' as appended, 'T' || substr(kmer, 1, 8) as prepended, substr(kmer, 1, 4) || 'G' || substr(kmer, 6) as changed, substr(kmer, 9, 1) as last from k""",
)
def x34(spark, sf):
    k = kmers.explode_kmers(reference(spark, sf).select("contig", "seq"), 9)
    km = F.col("kmer")
    return k.select(
        "contig", "i", kmers.base_code(F.substr(km, F.lit(5), F.lit(1))).cast("int").alias("code"), kmers.appended(km, F.lit("A")).alias("appended"),
        kmers.prepended(km, F.lit("T")).alias("prepended"), kmers.with_base(km, 4, F.lit("G")).alias("changed"), F.right(km, F.lit(1)).alias("last"),
    )


@register("X5_canonical_kmers", f"with {READS_SQL}, {KMERS_SQL} select distinct {CANON} as kmer from kmers")
def x5(spark, sf):
    return kmers.explode_kmers(reads(spark, sf).select("seq"), K).select(kmers.canonical(F.col("kmer")).alias("kmer")).distinct()


@register("W1_ref_kmers", f"with {REF_SQL} select contig, i::int as i, substr(seq, i::int + 1, 21) as kmer from (select contig, seq, unnest(range(0, 2028)) as i from ref)")
def w1(spark, sf):
    return kmers.explode_kmers(reference(spark, sf).select("contig", "seq"), K)


SHORT = f"with {REF_SQL}, k as (select contig, i::int as i, substr(seq, i::int + 1, 5) as kmer from (select contig, seq, unnest(range(0, 2044)) as i from ref))"


@register("W2_context_numbers", f"{SHORT} select contig, i, kmer, (row_number() over (partition by contig, kmer order by i) - 1)::int as ctx from k")
def w2(spark, sf):
    return kmers.with_context(kmers.explode_kmers(reference(spark, sf).select("contig", "seq"), 5), ["contig"])


@register("W3_successors", f"{SHORT} select contig, i, kmer, lead(kmer) over (partition by contig order by i) as next from k")
def w3(spark, sf):
    return kmers.successors(kmers.explode_kmers(reference(spark, sf).select("contig", "seq"), 5), ["contig"])


SOLID_SQL = f"""ids as (select {ID_SQL} as id, * from reads), rk as (select id, (i - 1)::int as i, substr(seq, i::int, {QK}) as kmer from (select id, seq, unnest(range(1, 60 - {QK} + 2)) as i from ids)),
flags as (select id, i, (coalesce(occ, 0) >= 4)::int as solid from (select id, i, {CANON} as kmer from rk) left join counts using (kmer)),
runs as (select id, i - sum(solid) over (partition by id order by i) as g, i from flags qualify solid = 1), sized as (select id, min(i) as start, count(*) as streak from runs group by id, g),
best as (select id, start, streak from sized qualify row_number() over (partition by id order by streak desc, start) = 1)"""


@register("W4_W5_longest_streak", f"with {READS_SQL}, {COUNTS_SQL}, {SOLID_SQL} select f.id, start, coalesce(streak, 0) as streak from (select distinct id from flags) f left join best using (id)")
def w45(spark, sf):
    own = ided(reads(spark, sf)).select("id", "seq")
    return kmers.with_streaks(own, known(spark, sf), QK, 4).filter("streak is not null").drop("seq")


@register("W6_base_coverage", f"with {READS_SQL}, {COUNTS_SQL}, {SOLID_SQL} select id, p::int as pos, coalesce(sum(solid), 0)::int as cover from (select id, unnest(range(0, 60)) as p from (select distinct id from flags)) join flags using (id) where i <= p and i > p - {QK} group by 1, 2")
def w6(spark, sf):
    return kmers.solid_coverage(ided(reads(spark, sf)).select("id", "seq"), known(spark, sf), QK, 4)


@register(
    "C5_streak_trim",
    f"with {READS_SQL}, {COUNTS_SQL}, {SOLID_SQL} select i.id, substr(seq, (start + 1)::int, (streak + {QK} - 1)::int) as seq, substr(qual, (start + 1)::int, (streak + {QK} - 1)::int) as qual from ids i join best using (id) where (streak + {QK} - 1) / 60.0 > 0.8",
)
def c5(spark, sf):
    own = ided(reads(spark, sf)).select("id", "seq", "qual")
    return kmers.cut_to_streak(kmers.with_streaks(own, known(spark, sf), QK, 4), QK)


@register("C2_first_plain_kmer", f"with {READS_SQL} select {ID_SQL} as id, case when l_partkey % 3 = 0 then 8 + l_linenumber else 0 end::int as at from reads")
def c2(spark, sf):
    noisy = F.when(F.col("l_partkey") % 3 == 0, F.overlay("seq", F.lit("N"), (F.col("l_linenumber") + 8).cast("int"), F.lit(1))).otherwise(F.col("seq"))
    return ided(reads(spark, sf)).select("id", kmers.first_plain(noisy, K).cast("int").alias("at"))


@register(
    "C1_greedy_repair",
    f"""with {READS_SQL}, {COUNTS_SQL}, rare as (select kmer from counts where occ <= 2),
cand as (select kmer as k0, substr(kmer, 1, i::int - 1) || b || substr(kmer, i::int + 1) as kmer from rare, range(1, {QK + 1}) r(i), (values ('A'), ('C'), ('G'), ('T')) v(b) where b <> substr(kmer, i::int, 1)),
met as (select c.k0, c.kmer as c, n.occ from (select k0, kmer, {CANON} as canon from cand) c join counts n on n.kmer = c.canon),
top as (select k0, c, occ, coalesce(lead(occ) over w, 0) as second, row_number() over w as r from met window w as (partition by k0 order by occ desc, c desc))
select k0 as kmer, c as best, occ as best_occ from top where r = 1 and 3 * occ > 10 and second < 3""",
)
def c1(spark, sf):
    n = counts(spark, sf)
    return kmers.greedy_repairs(n.filter("occ <= 2").select("kmer"), n, 10)
