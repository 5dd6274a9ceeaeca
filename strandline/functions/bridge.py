"""Deterministic sequences and reads derived from the driver's tables.

The tables hold no sequence data. These relations make some from ``region``
and ``lineitem`` with functions that SQL engines evaluate alike: a reference
of 2,048 bases for each region, an alternate haplotype with planted
substitutions, and one read of 60 bases for each line item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import table

#: Fixed values of the bridge.
PIECES, READ_LEN, STARTS, EVERY, PHASE = 64, 60, 1988, 97, 13
HEX, BASES, BASES_ALT = "0123456789abcdef", "ACGTACGTACGTACGT", "CGTA"

REF_SQL = f"""
ref as (
  select r_regionkey as contig, string_agg(translate(md5('ref-' || r_regionkey || '-' || i), '{HEX}', '{BASES}'), '' order by i) as seq
  from region, (select unnest(range(0, {PIECES}))::int as i) group by r_regionkey),
hap as (
  select contig, seq, array_to_string([case when p % {EVERY} = {PHASE} then translate(substr(seq, p::int, 1), 'ACGT', '{BASES_ALT}') else substr(seq, p::int, 1) end for p in range(1, 2049)], '') as alt from ref)"""

READS_SQL = f"""{REF_SQL},
reads as (
  select 'o' || l_orderkey as qname, l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_suppkey % 5)::int as contig,
    ((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 31) % {STARTS})::bigint as pos0, l_quantity::int as mapq,
    ((case when l_returnflag = 'R' then 4 else 0 end) + (case when l_linestatus = 'F' and l_linenumber = 1 then 1024 else 0 end) + (case when l_partkey % 50 = 7 then 256 else 0 end) + (case when l_partkey % 50 = 9 then 2048 else 0 end))::int as flag,
    substr(case when l_orderkey % 2 = 0 then seq else alt end, (1 + (l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 31) % {STARTS})::int, {READ_LEN}) as seq,
    translate(substr(md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey) || md5(l_orderkey || '+' || l_linenumber || '+' || l_suppkey), 1, {READ_LEN}), '{HEX}', '#+05:?BDFGHIIIII') as qual,
    case l_linenumber % 4 when 0 then '5S50M5S' when 1 then '60M' when 2 then '2H8S52M' else '30M2I20M3D5M3S' end as cigar
  from lineitem join hap on contig = (l_suppkey % 5))"""


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, seq (2,048 bases), alt: one row for each region, five in all."""
    piece = F.translate(F.md5(F.concat(F.lit("ref-"), F.col("r_regionkey"), F.lit("-"), F.col("i"))), HEX, BASES)
    ref = (
        table(spark, sf_dir, "region")
        .select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("i"))
        .groupBy(F.col("r_regionkey").alias("contig"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("s")))), lambda x: x.s), "").alias("seq"))
    )
    base = lambda p: F.substr("seq", p, F.lit(1))
    alt = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32 * PIECES)), lambda p: F.when(p % EVERY == PHASE, F.translate(base(p), "ACGT", BASES_ALT)).otherwise(base(p))), "")
    return ref.withColumn("alt", alt)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read for each line item: key columns, qname, contig, pos0, mapq, flag, seq, qual, cigar.

    The reference side has five rows of 4 kB, whatever the scale; the
    broadcast is bounded by that.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    pos0 = (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729 + F.col("l_linenumber") * 31) % STARTS
    flag = (
        F.when(F.col("l_returnflag") == "R", 4).otherwise(0)
        + F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), 1024).otherwise(0)
        + F.when(F.col("l_partkey") % 50 == 7, 256).otherwise(0)
        + F.when(F.col("l_partkey") % 50 == 9, 2048).otherwise(0)
    )
    digest = lambda sep, last: F.md5(F.concat_ws(sep, "l_orderkey", "l_linenumber", last))
    cigar = F.when(F.col("l_linenumber") % 4 == 0, "5S50M5S").when(F.col("l_linenumber") % 4 == 1, "60M").when(F.col("l_linenumber") % 4 == 2, "2H8S52M").otherwise("30M2I20M3D5M3S")
    return (
        li.withColumn("contig", (F.col("l_suppkey") % 5).cast("int"))
        .join(F.broadcast(reference(spark, sf_dir)), "contig")
        .select(
            F.concat(F.lit("o"), "l_orderkey").alias("qname"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "contig",
            pos0.cast("bigint").alias("pos0"), F.col("l_quantity").cast("int").alias("mapq"), flag.cast("int").alias("flag"),
            F.substr(F.when(F.col("l_orderkey") % 2 == 0, F.col("seq")).otherwise(F.col("alt")), (pos0 + 1).cast("int"), F.lit(READ_LEN)).alias("seq"),
            F.translate(F.substr(F.concat(digest("-", "l_partkey"), digest("+", "l_suppkey")), F.lit(1), F.lit(READ_LEN)), HEX, "#+05:?BDFGHIIIII").alias("qual"),
            cigar.alias("cigar"),
        )
    )


#: Fixed values of the wide reads: length, first and last planted site, inserted bases.
WIDE, FIRST_SITE, LAST_SITE, INSERTED = 240, 207, 1856, "GAT"


def site_kind(p: str) -> str:
    """SQL for the kind of the site at position p (from 1), 0 to 4, or null: on the first haplotype, on the second, on both, on the first, on the second."""
    return f"(case when {p} % {EVERY} = {PHASE} and {p} >= {FIRST_SITE} and {p} <= {LAST_SITE} then (({p} - {FIRST_SITE}) // {EVERY}) % 5 end)"


def _pieces_sql(side: int, indels: bool) -> str:
    """SQL for what a haplotype has in the place of position p."""
    base, kind = "substr(seq, p::int, 1)", site_kind("p")
    swapped = f"translate({base}, 'ACGT', '{BASES_ALT}')"
    snps = {0: "(0, 2, 3)", 1: "(1, 2, 4)"}[side] if not indels else {0: "(0, 2)", 1: "(1, 2)"}[side]
    lost = f"when {site_kind('(p - 1)')} = 3 or {site_kind('(p - 2)')} = 3 then '' " if indels and side == 0 else ""
    more = f"when {kind} = 4 then {base} || '{INSERTED}' " if indels and side == 1 else ""
    return f"[case {lost}{more}when {kind} in {snps} then {swapped} else {base} end for p in range(1, 2049)]"


def wide_sql(indels: bool = False) -> str:
    """SQL for ref, wide_hap and wide (a read of 240 bases for each order, from one of two haplotypes)."""
    error = "o_orderkey % 53 = 3"
    return f"""{REF_SQL},
wide_hap as (select contig, seq, {_pieces_sql(0, indels)} as first, {_pieces_sql(1, indels)} as second from ref),
cut as (
  select o_orderkey, contig, (o_orderkey % {WIDE})::int as e, {error} as wrong, ((o_custkey * 7919 + o_orderkey * 104729) % {2048 - WIDE + 1})::bigint as pos0,
    case when (o_orderkey // 2) % 2 = 0 then first else second end as pieces from orders join wide_hap on contig = (o_custkey % 5)),
taken as (select *, substr(array_to_string(pieces[pos0 + 1 : pos0 + {WIDE} + 40], ''), 1, {WIDE}) as s from cut),
wide as (
  select 'w' || o_orderkey as id, 'p' || (o_orderkey // 2) as qname, contig, pos0, 0::int as flag, 60::int as mapq, '*' as cigar,
    case when wrong and e < length(s) then substr(s, 1, e) || translate(substr(s, e + 1, 1), 'ACGT', 'GTAC') || substr(s, e + 2) else s end as seq,
    case when wrong and e < length(s) then repeat('I', e) || '#' || repeat('I', length(s) - e - 1) else repeat('I', length(s)) end as qual from taken)"""


def wide_haplotypes(spark: SparkSession, sf_dir: str, indels: bool = False) -> DataFrame:
    """contig, seq, first, second: the reference and, as arrays of pieces for each of its positions, two haplotypes with planted sites."""
    ref = reference(spark, sf_dir).select("contig", "seq")
    kind = lambda p: F.when((p % EVERY == PHASE) & (p >= FIRST_SITE) & (p <= LAST_SITE), F.floor((p - FIRST_SITE) / EVERY) % 5)

    def pieces(side: int):
        def one(p):
            base = F.substr("seq", p, F.lit(1))
            snp = {0: (0, 2, 3), 1: (1, 2, 4)}[side] if not indels else {0: (0, 2), 1: (1, 2)}[side]
            out = F.when(kind(p).isin(*snp), F.translate(base, "ACGT", BASES_ALT)).otherwise(base)
            if indels and side == 0:
                out = F.when((kind(p - 1) == 3) | (kind(p - 2) == 3), "").otherwise(out)
            if indels and side == 1:
                out = F.when(kind(p) == 4, F.concat(base, F.lit(INSERTED))).otherwise(out)
            return out

        return F.transform(F.sequence(F.lit(1), F.lit(2048)), one)

    return ref.select("contig", "seq", pieces(0).alias("first"), pieces(1).alias("second"))


def wide_reads(spark: SparkSession, sf_dir: str, indels: bool = False) -> DataFrame:
    """A read of 240 bases for each order: id, qname, contig, pos0, flag, mapq, cigar, seq, qual.

    Orders of two successive keys are mates, so they read the same haplotype;
    every other pair reads the first. One read in 53 has a wrong base, of low
    quality. The broadcast has five rows.
    """
    hap = wide_haplotypes(spark, sf_dir, indels)
    pos0 = ((F.col("o_custkey") * 7919 + F.col("o_orderkey") * 104729) % (2048 - WIDE + 1)).cast("bigint")
    cut = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("contig"), pos0.alias("pos0"), (F.col("o_orderkey") % WIDE).cast("int").alias("e"))
    cut = cut.join(F.broadcast(hap.drop("seq")), "contig")
    pieces = F.when(F.floor(F.col("o_orderkey") / 2) % 2 == 0, F.col("first")).otherwise(F.col("second"))
    taken = cut.withColumn("s", F.substr(F.array_join(F.slice(pieces, (F.col("pos0") + 1).cast("int"), WIDE + 40), ""), F.lit(1), F.lit(WIDE)))
    wrong = (F.col("o_orderkey") % 53 == 3) & (F.col("e") < F.length("s"))
    swapped = F.concat(F.substr("s", F.lit(1), F.col("e")), F.translate(F.substr("s", F.col("e") + 1, F.lit(1)), "ACGT", "GTAC"), F.substr("s", F.col("e") + 2))
    marks = lambda n: F.repeat(F.lit("I"), n)
    return taken.select(
        F.concat(F.lit("w"), "o_orderkey").alias("id"), F.concat(F.lit("p"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("qname"), "contig", "pos0", F.lit(0).alias("flag"), F.lit(60).alias("mapq"), F.lit("*").alias("cigar"),
        F.when(wrong, swapped).otherwise(F.col("s")).alias("seq"), F.when(wrong, F.concat(marks(F.col("e")), F.lit("#"), marks(F.length("s") - F.col("e") - 1))).otherwise(marks(F.length("s"))).alias("qual"),
    )
