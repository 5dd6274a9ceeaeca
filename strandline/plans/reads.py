"""Queries of read preparation and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.bridge import READS_SQL, REF_SQL, reads, reference
from strandline.operators import reads as R
from strandline.operators import windows as W
from strandline.plans import register

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ID_SQL = "l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey"
BAD_SQL = "(mapq < 10 or (flag & 3332) <> 0)"
WINDOW, STEP, LENGTH = 500, 375, 2048


def with_id(df):
    return df.withColumn("id", F.concat_ws(".", *KEY))


@register("F1_good_reads", f"with {READS_SQL} select {ID_SQL} as id, qname, pos0, mapq, flag from reads where not {BAD_SQL}")
def f1(spark, sf):
    return with_id(R.good_reads(reads(spark, sf))).select("id", "qname", "pos0", "mapq", "flag")


@register(
    "A1_read_stats",
    f"""with {READS_SQL} select count(*) as total, count(*) filter ((flag & 1) <> 0) as paired, count(*) filter {BAD_SQL.join(['(', ')'])} as bad_total, 0::bigint as bad_pos,
  count(*) filter (mapq < 10) as bad_mapq, count(*) filter ((flag & 1024) <> 0) as bad_duplicate, count(*) filter ((flag & 2048) <> 0) as bad_supplementary, count(*) filter ((flag & 256) <> 0) as bad_secondary,
  count(*) filter ((flag & 4) <> 0) as bad_unmapped, count(*) filter (not {BAD_SQL} and cigar like '%S%' and cigar like '%H%') as both_clipped,
  count(*) filter (not {BAD_SQL} and cigar not like '%S%' and cigar like '%H%') as hard_clipped, count(*) filter (not {BAD_SQL} and cigar like '%S%' and cigar not like '%H%') as soft_clipped from reads""".replace("filter (", "filter (where "),
)
def a1(spark, sf):
    return R.statistics(reads(spark, sf))


@register(
    "F3_quality_cap",
    f"with {READS_SQL} select {ID_SQL} as id, array_to_string([chr((least(ascii(substr(qual, i::int, 1)) - 33, mapq) + 33)::int) for i in range(1, 61)], '') as qual from reads",
)
def f3(spark, sf):
    return with_id(R.capped_quality(reads(spark, sf))).select("id", "qual")


CLIP_SQL = """clips as (select *, case when cigar = '5S50M5S' then 5 when cigar = '2H8S52M' then 8 else 0 end as skip, case cigar when '5S50M5S' then 50 when '60M' then 60 when '2H8S52M' then 52 else 57 end as take from reads)"""


@register("F4_clip", f"with {READS_SQL}, {CLIP_SQL} select {ID_SQL} as id, substr(seq, skip + 1, take) as seq, substr(qual, skip + 1, take) as qual, '*' as cigar, pos0 from clips")
def f4(spark, sf):
    return with_id(R.without_clips(reads(spark, sf))).select("id", "seq", "qual", "cigar", "pos0")


@register("F5_end_strip", f"with {READS_SQL} select {ID_SQL} as id, substr(seq, 1, 55) as seq, substr(qual, 1, 55) as qual from reads")
def f5(spark, sf):
    return with_id(R.shortened(reads(spark, sf))).select("id", "seq", "qual")


WIN_SQL = f"""wins as (select contig, start::bigint as win from ref, (select unnest(range(0, {LENGTH - WINDOW}, {STEP})) as start union select {LENGTH - WINDOW})),
placed as (select r.*, w.win from reads r join wins w on w.contig = r.contig and ((r.pos0 >= win and r.pos0 < win + {WINDOW}) or (r.pos0 + 60 >= win and r.pos0 + 60 < win + {WINDOW}))),
cut as (select *, greatest(0, win - pos0)::int as offs, greatest(0, pos0 + 60 - win - {WINDOW})::int as tail from placed)"""


@register("W9_windows", f"with {READS_SQL}, {WIN_SQL} select contig, win as start from wins")
def w9(spark, sf):
    return W.windows(W.segments(reference(spark, sf)), WINDOW, STEP)


@register("J1_read_windows", f"with {READS_SQL}, {WIN_SQL} select {ID_SQL} as id, contig, win from placed")
def j1(spark, sf):
    return with_id(W.assigned(reads(spark, sf), F.lit(LENGTH), WINDOW, STEP)).select("id", "contig", "win")


def cut_reads(spark, sf, k: int = 21):
    """Reads cut to their windows, longer than k before and after."""
    placed = W.assigned(reads(spark, sf).filter(F.length("seq") > k), F.lit(LENGTH), WINDOW, STEP)
    return R.clipped_to(placed, F.col("win"), F.lit(WINDOW)).filter(F.length("seq") > k)


CUT_SQL = f"with {READS_SQL}, {WIN_SQL}, kept as (select {ID_SQL} as id, contig, win, pos0 + offs as pos0, offs as offset, substr(seq, offs + 1, 60 - offs - tail) as seq, substr(qual, offs + 1, 60 - offs - tail) as qual from cut where 60 - offs - tail > 21)"


@register("F6_clip_to_window", f"{CUT_SQL} select * exclude (qual) from kept")
def f6(spark, sf):
    return with_id(cut_reads(spark, sf)).select("id", "contig", "win", "pos0", "offset", "seq")


@register("A9_window_coverage", f"{CUT_SQL} select contig, win, sum(length(seq))::bigint as bases, (sum(length(seq)) // {WINDOW})::bigint as coverage from kept group by 1, 2")
def a9(spark, sf):
    return W.coverage(cut_reads(spark, sf), WINDOW)


@register("A9_window_quality", f"{CUT_SQL} select contig, win, q, count(*) as n from (select contig, win, unnest([ascii(substr(qual, i::int, 1)) - 33 for i in range(1, length(qual) + 1)])::int as q from kept) group by 1, 2, 3")
def a9q(spark, sf):
    return W.quality_histogram(cut_reads(spark, sf)).withColumn("q", F.col("q").cast("int"))


@register("A20_position_coverage", f"with {READS_SQL} select contig, pos, count(*) as depth from (select contig, unnest(range(pos0, pos0 + 60)) as pos from reads) group by 1, 2")
def a20(spark, sf):
    return W.position_coverage(reads(spark, sf))


@register("A20_uncovered", f"with {READS_SQL}, c as (select distinct contig, unnest(range(pos0, pos0 + 60)) as pos from reads), e as (select contig, unnest(range(0, 2048)) as pos from ref) select * from e anti join c using (contig, pos)")
def a20u(spark, sf):
    return W.uncovered(reference(spark, sf), W.position_coverage(reads(spark, sf)))


@register(
    "J10_mate_overlap",
    f"""with {READS_SQL}, r as (select *, {ID_SQL} as id from reads),
m as (select a.qname, a.id as id1, b.id as id2, least(a.pos0 + 60 - b.pos0, 60)::int as overlap, substr(a.seq, (b.pos0 - a.pos0 + 1)::int) as s1, b.seq as s2 from r a join r b on a.qname = b.qname and a.id <> b.id and b.pos0 >= a.pos0 and b.pos0 < a.pos0 + 60 and not (b.pos0 + 60 >= a.pos0 and b.pos0 + 60 < a.pos0 + 60))
select qname, id1, id2, overlap, len([i for i in range(1, overlap + 1) if substr(s1, i::int, 1) <> substr(s2, i::int, 1)])::int as mismatches from m""",
)
def j10(spark, sf):
    return R.mate_overlaps(with_id(reads(spark, sf)))


@register("A19_pair_groups", f"with {READS_SQL} select reads, count(*) as groups from (select qname, count(*) as reads from reads group by 1) group by 1")
def a19(spark, sf):
    return R.group_sizes(reads(spark, sf))


N_SQL = "masked as (select contig, substr(seq, 1, 500) || repeat('N', 20 + contig) || substr(seq, 501) as seq from ref)"


@register(
    "W8_segments",
    f"""with {REF_SQL}, {N_SQL}, p as (select contig, regexp_extract_all(seq, '[ACGT]+|[^ACGT]+') as runs from masked), u as (select contig, unnest(runs) as run, generate_subscripts(runs, 1) as i from p)
select contig, coalesce(sum(length(run)) over (partition by contig order by i rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", length(run)::bigint as length, regexp_matches(run, '^[ACGT]') as valid from u""",
)
def w8(spark, sf):
    ref = reference(spark, sf)
    masked = ref.withColumn("seq", F.concat(F.substr("seq", F.lit(1), F.lit(500)), F.expr("repeat('n', 20 + contig)"), F.substr("seq", F.lit(501))))
    return W.segments(masked)


@register("W10_segment_at", f"with {REF_SQL} select contig, 500::bigint as \"offset\", (20 + contig)::bigint as length, false as valid from ref")
def w10(spark, sf):
    ref = reference(spark, sf)
    masked = ref.withColumn("seq", F.concat(F.substr("seq", F.lit(1), F.lit(500)), F.expr("repeat('N', 20 + contig)"), F.substr("seq", F.lit(501))))
    return W.segment_at(W.segments(masked), "contig", 505)
