"""Queries of readers and writers, as round trips on the bridge, and of streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.bridge import READS_SQL, REF_SQL, reads, reference
from strandline.operators import compare as C
from strandline.operators import kmers
from strandline.plans import register
from strandline.plans.kmers import KMERS_SQL, K
from strandline.plans.variants import INC_SQL, KEYS, PILE_SQL, REC_SQL, calls, compared, ided, records
from strandline.sources import formats, sinks
from strandline.streaming.reads import event_windows
from strandline.session import scratch_path, table

SAM_SQL = "select qname, flag, contig::varchar as rname, pos0 + 1 as pos, mapq, cigar, '*' as rnext, 0::bigint as pnext, 0 as tlen, seq, qual, pos0 from reads"


def sam_rows(spark, sf):
    return reads(spark, sf).select("qname", "flag", F.col("contig").cast("string").alias("rname"), "pos0", "mapq", "cigar", F.lit("*").alias("rnext"), F.lit(0).cast("bigint").alias("pnext"), F.lit(0).alias("tlen"), "seq", "qual")


@register("S3_S4_K2_sam", f"with {READS_SQL} {SAM_SQL}")
def sam(spark, sf):
    """Written as text below the shared folder, and read again."""
    path = scratch_path(spark, "sam")
    sinks.write_lines(sinks.sam_lines(sam_rows(spark, sf)), path)
    return formats.read_sam(spark, path)


@register("K2_sam_lines", f"with {READS_SQL}, s as ({SAM_SQL}) select concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual) as value from s")
def k2(spark, sf):
    return sinks.sam_lines(sam_rows(spark, sf))


@register("S5_S6_K3_fastq", f"with {READS_SQL} select qname, seq, qual from reads")
def fastq(spark, sf):
    path = scratch_path(spark, "fastq")
    sinks.write_lines(sinks.fastq_lines(reads(spark, sf)), path)
    return formats.read_fastq(spark, path).select("qname", "seq", "qual")


@register("S7_S8_fasta", f"with {REF_SQL} select 'chr' || contig as name, (100 * contig)::bigint as start0, 2048::bigint as length, seq from ref")
def fasta(spark, sf):
    path = scratch_path(spark, "fasta")
    ref = reference(spark, sf).select(F.concat(F.lit("chr"), "contig", F.lit(":"), (F.col("contig") * 100 + 1).cast("string")).alias("name"), "seq")
    sinks.write_lines(sinks.fasta_lines(ref), path)
    return formats.read_fasta(spark, path)


@register("S9_one_sequence", f"with {REF_SQL} select string_agg(seq, '' order by contig) as seq from ref")
def s9(spark, sf):
    ref = reference(spark, sf).select("contig", F.posexplode(F.array(F.concat(F.lit(">"), F.col("contig").cast("string")), F.col("seq"))).alias("i", "value"))
    return formats.one_sequence(ref.select("value", (F.col("contig") * 2 + F.col("i")).alias("n")))


@register("S10_S11_vcf", f"with {REC_SQL} select chrom, pos, ref, unnest([alt, alt || 'TT']) as alt, unnest([0, 1])::int as allele from recs")
def vcf(spark, sf):
    r = records(spark, sf).select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", F.concat("alt", F.lit(","), "alt", F.lit("TT")), F.lit("60"), F.lit("PASS"), F.lit(".")).alias("value"))
    head = spark.range(1).select(F.lit("##fileformat=VCFv4.0").alias("value"))
    return formats.parse_vcf(head.unionByName(r)).select("chrom", "pos", "ref", "alt", "allele")


@register("K1_vcf_rows", f"with {READS_SQL}, {PILE_SQL} select concat_ws(chr(9), chrom, pos, '.', ref, alt, '60', 'PASS', 'RW=' || rc * 100 || ';RC=' || rc || ';AW=' || ac * 100 || ';AC=' || ac || ';KS=21;BP=1', 'GT:PS', '0/1:' || pos) as value from calls")
def k1(spark, sf):
    c = calls(spark, sf).withColumns({"rw": F.col("rc") * 100, "aw": F.col("ac") * 100, "ks": F.lit(21), "bp": F.lit(1), "gt": F.lit("0/1"), "ps": F.col("pos"), "valid": F.lit(True)})
    return sinks.vcf_rows(c)


@register("K6_mini_vcf", f"{INC_SQL} select concat_ws(chr(9), chrom, pos, '.', ref, alt) as value from inc where incident <> 'TP' and length(ref) = 1 and length(alt) = 1")
def k6(spark, sf):
    return sinks.mini_vcf(C.of_kinds(compared(spark, sf), {"FN", "FP"}))


@register("K7_weight_csv", f"with {REC_SQL} select (ac // 100) || '.' || (ac % 100) || ',' || (aw // 100) || '.' || (aw % 100) as value from recs")
def k7(spark, sf):
    return sinks.weight_csv(records(spark, sf).select(F.col("ac").alias("rw"), "aw"))


@register("K8_histogram_csv", f"with {READS_SQL}, {KMERS_SQL}, n as (select kmer, count(*) as n from kmers group by 1), h as (select n as freq, count(*) as kmers from n group by 1) select printf('%d, %d, %.4f', freq, kmers, freq * kmers * 100.0::double / (select sum(freq * kmers) from h) + 1e-9) as value from h")
def k8(spark, sf):
    return sinks.histogram_csv(kmers.histogram(kmers.count_plain(reads(spark, sf), K)))


@register(
    "W9_event_windows",
    """with e as (select epoch(ts) as s, event_type, value from events), w as (select unnest(range((floor((s - 2000) / 1500)::bigint + 1) * 1500, (floor(s / 1500)::bigint) * 1500 + 1, 1500)) as b, * from e)
select make_timestamp((b * 1000000)::bigint) as start, event_type, count(*) as n, sum(value) as total from w group by 1, 2""",
)
def event_query(spark, sf):
    return event_windows(table(spark, sf, "events"))
