"""Queries of read correction and of simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.bridge import READS_SQL, reads
from strandline.operators import correct as X
from strandline.operators import kmers as K
from strandline.operators import pipelines as P
from strandline.operators import simulate as S
from strandline.operators import variants as V
from strandline.plans import register
from strandline.plans.variants import ID_SQL, ided
from strandline.session import staged

#: K-mer size, and how often a trusted k-mer occurs: the highest floor that the coverage rule gives.
KC, LEAST = 15, 8


def wrong(spark, sf, qual=None):
    """Reads with their truth; one in thirty-one has a wrong base, at a place that its keys name, and half of these another one 10 to 14 bases on."""
    own = ided(reads(spark, sf)).withColumn("at", (F.col("l_partkey") % 25 + 20).cast("int"))
    swapped = lambda seq, at: F.concat(F.substr(seq, F.lit(1), at), F.translate(F.substr(seq, at + 1, F.lit(1)), "ACGT", "GTAC"), F.substr(seq, at + 2))
    one = swapped(F.col("seq"), F.col("at"))
    bad = F.when(F.col("l_linenumber") % 2 == 0, swapped(one, F.col("at") + (F.col("l_suppkey") % 5 + 10).cast("int"))).otherwise(one)
    hit = F.col("l_orderkey") % 31 == 0
    return own.select("id", F.col("seq").alias("truth"), F.when(hit, bad).otherwise(F.col("seq")).alias("seq"), (F.repeat(F.lit("I"), F.lit(60)) if qual is None else qual).alias("qual"), "pos0", "cigar")


def fixed(spark, sf):
    own = staged(wrong(spark, sf), "wrong-reads")
    counts = staged(K.count_canonical(own, KC), "counts")
    return own, X.corrected(own, counts, KC, LEAST)


@register("C3_C4_C6_corrected")
def corrected(spark, sf):
    """No SQL: a best-first search. The tests count the planted errors that it repairs."""
    _, rows = fixed(spark, sf)
    return rows.select("id", F.upper("fixed").alias("fixed"))


@register("C7_converted")
def converted(spark, sf):
    own, rows = fixed(spark, sf)
    return X.converted(rows.join(own.select("id", "cigar", "pos0"), "id")).select("id", "seq", "cigar")


@register("A18_correction_stats")
def stats(spark, sf):
    return X.statistics(fixed(spark, sf)[1])


@register("A18_changes_by_distance")
def distance(spark, sf):
    return X.changes_by_distance(fixed(spark, sf)[1])


WRONG_SQL = f"""{READS_SQL}, own as (select distinct {ID_SQL} as id, qual, seq as truth, (l_partkey % 25 + 20)::int as spot, l_orderkey % 31 = 0 as hit, l_linenumber % 2 = 0 as twice, (l_suppkey % 5 + 10)::int as more from reads),
one as (select *, substr(truth, 1, spot) || translate(substr(truth, spot + 1, 1), 'ACGT', 'GTAC') || substr(truth, spot + 2) as s from own),
wrong as (select id, qual, truth, case when not hit then truth when not twice then s else substr(s, 1, spot + more) || translate(substr(s, spot + more + 1, 1), 'ACGT', 'GTAC') || substr(s, spot + more + 2) end as seq from one),
bases as (select id, qual, i::int as i, substr(seq, i::int, 1) as b, substr(truth, i::int, 1) as t from (select *, unnest(range(1, 61)) as i from wrong)),
fixed as (select id, string_agg(b, '' order by i) as seq, string_agg(case when b = t then t else lower(t) end, '' order by i) as fixed, count(*) filter (where b <> t) as n_changes from bases group by 1)"""


def planted(spark, sf):
    """What a correction that undoes every planted error gives: one row for each id, which has one read and quality."""
    mark = lambda a, b: F.when(a == b, b).otherwise(F.lower(b))
    marked = F.array_join(F.zip_with(F.split("seq", ""), F.split("truth", ""), mark), "")
    once, more = V.by_id(wrong(spark, sf, F.col("qual")).drop("pos0", "cigar"))
    rows = once.unionByName(more.distinct()).withColumn("fixed", F.when(F.col("seq") == F.col("truth"), F.col("truth")).otherwise(marked))  # few reads are wrong
    return rows.withColumn("n_changes", F.length(F.regexp_replace("fixed", "[^a-z]", "")))


@register("A18_changes_per_read", f"with {WRONG_SQL} select n_changes::int as n_changes, count(*) as reads from fixed group by 1")
def per_read(spark, sf):
    return X.changes_per_read(planted(spark, sf))


@register("A18_planted_by_distance", f"with {WRONG_SQL} select (60 - i)::int as distance, count(*) as n from bases where b <> t group by 1")
def planted_distance(spark, sf):
    return X.changes_by_distance(planted(spark, sf))


@register("C4_recoded_quality", f"""with {WRONG_SQL}
select id, string_agg(case when b <> t then chr(34 + instr('ACGT', b)::int - 1) when ascii(substr(qual, i, 1)) - 33 >= 20 then '?' else '+' end, '' order by i) as qual from bases group by 1""")
def recoded(spark, sf):
    return planted(spark, sf).select("id", X.recoded_quality(F.col("seq"), F.col("fixed"), F.col("qual")).alias("qual"))


KT = 31
TRIM_SQL = f"""km as (select id, (i - 1)::int as i, substr(upper(fixed), i::int, {KT}) as x from (select id, fixed, unnest(range(1, 60 - {KT} + 2)) as i from fixed)),
canon as (select id, i, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) as x from km), often as (select x from canon group by 1 having count(*) > 1),
runs as (select id, i, i - row_number() over (partition by id order by i) as g from canon semi join often using (x)),
size as (select id, min(i) as start, count(*) as streak from runs group by id, g),
best as (select id, arg_min(start, struct_pack(a := -streak, b := start)) as start, max(streak) as streak from size group by 1),
cut as (select id, substr(fixed, (start + 1)::int, (streak + {KT} - 1)::int) as fixed from best join fixed using (id) where (streak + {KT} - 1) / 60.0 > 0.8)"""


@register("C5_C6_trimmed_after", f"with {WRONG_SQL}, {TRIM_SQL} select * from cut")
def trimmed(spark, sf):
    return X.trimmed(planted(spark, sf).select("id", "seq", "fixed", "qual"), KT).select("id", "fixed")


@register("A18_removed_shortened", f"""with {WRONG_SQL}, {TRIM_SQL}, n as (select id, length(fixed) as size, len(regexp_extract_all(fixed, '[a-z]')) as c from cut)
select (select count(*) from wrong) as reads, (select count(*) * 60 from wrong) as bases, (select count(*) from wrong) - count(*) as removed, count(*) filter (where size < 60) as shortened, count(*) filter (where c > 0) as repaired_reads, sum(c)::bigint as repaired_bases from n""")
def outcome(spark, sf):
    return X.trim_statistics(planted(spark, sf), KT)


RATES = (0.01, 0.002, 0.002)
_DRAW = "('0x' || substr(md5('{0}-{1}-' || i), 1, 10))::bigint / 1099511627776.0::double"
_BASE = "substr('ACGT', floor({0} * 4)::int + 1, 1)"


def simulated_sql(length: int, ref_seed: int, alt_seed: int) -> str:
    """SQL for alt: position i, base, alt."""
    event, one, two = _DRAW.format(alt_seed, "event"), _BASE.format(_DRAW.format(alt_seed, "one")), _BASE.format(_DRAW.format(alt_seed, "two"))
    a, b, c = RATES[0], RATES[0] + RATES[1], RATES[0] + RATES[1] + RATES[2]
    return f"""rb as (select i, {_BASE.format(_DRAW.format(ref_seed, 'base'))} as base, {event} as e, {one} as one, {two} as two from range(0, {length}) t(i)),
alt as (select i, base, case when e < {a!r}::double then translate(base, 'ACGT', 'CGTA') when e < {b!r}::double then base || one || two when e < {c!r}::double then '' else base end as alt from rb)"""


@register("Y1_Y2_simulated_reads", f"with {simulated_sql(3000, 5, 6)}, s as (select string_agg(alt, '' order by i) as seq from alt) select pos0::bigint as pos0, substr(seq, pos0::int + 1, 100) as seq from (select seq, unnest(range(0, length(seq) - 99, 10)) as pos0 from s)")
def simulated(spark, sf):
    alt = S.alternate(S.positions(spark, 3000, 5), 6, *RATES)
    return S.simulated_reads(S.spelled(alt, "alt"), 100, 10)


@register("Y3_recovered", f"with {simulated_sql(1500, 5, 6)} select string_agg(case when i < 100 or i >= 1400 then base else alt end, '' order by i) as seq, true as found from alt")
def recovered(spark, sf):
    """Reads of a simulated alternate are assembled and called; the alternate must be among what the calls spell. Events lie away from the ends."""
    rows = S.alternate(S.positions(spark, 1500, 5), 6, *RATES)
    rows = rows.withColumn("alt", F.when(F.col("pos").between(100, 1399), F.col("alt")).otherwise(F.col("base")))
    ref, alt = (staged(S.spelled(rows, c).select(F.lit("0").alias("contig"), "seq"), f"simulated-{c}") for c in ("base", "alt"))
    own = S.simulated_reads(alt, 100, 1).select(F.concat(F.lit("r"), "pos0").alias("id"), F.lit("0").alias("contig"), "pos0", "seq", F.repeat(F.lit("I"), F.lit(100)).alias("qual"))
    calls = P.called(own, ref, 1000).withColumn("gt", F.lit("1|1"))
    paths = V.haplotypes(calls, ref.withColumnRenamed("contig", "chrom")).select(F.col("first").alias("seq"))
    return S.recovered(paths, alt.select("seq"))
