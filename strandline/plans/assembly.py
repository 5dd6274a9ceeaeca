"""Queries that assemble, against the planted truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.bridge import READS_SQL, REF_SQL, reads, reference
from strandline.operators import pipelines as P
from strandline.operators.assemble import alignment
from strandline.plans import register
from strandline.plans.variants import PLANTED_SQL, ided

WINDOW = 2000


def assembled(spark, sf):
    good = P.R.good_reads(ided(reads(spark, sf)))
    return P.called(good, reference(spark, sf).select("contig", "seq"), WINDOW)


@register("G20_assembled_variants", f"with {REF_SQL}, {PLANTED_SQL} select chrom, pos, ref, alt from planted where pos > 21 and pos <= 2048 - 21")
def g20(spark, sf):
    """Every planted substitution with room for a k-mer on both sides, and nothing else."""
    return assembled(spark, sf).select("chrom", "pos", "ref", "alt")


@register("X10_alignment", f"with {REF_SQL} select contig, 'MMMMMMMMMM' || 'X' || repeat('M', 20) as ops from ref")
def x10(spark, sf):
    """A substitution ten bases into a stretch: the reference's own bases around it."""
    rows = reference(spark, sf).select("contig", F.substr("seq", F.lit(101), F.lit(31)).alias("a"))
    rows = rows.withColumn("b", F.concat(F.substr("a", F.lit(1), F.lit(10)), F.translate(F.substr("a", F.lit(11), F.lit(1)), "ACGT", "CGTA"), F.substr("a", F.lit(12))))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(ops=[alignment(a, b) for a, b in zip(pdf.a, pdf.b)])[["contig", "ops"]]

    return rows.mapInPandas(run, "contig int, ops string")


GAPS_SQL = """r as (select contig, substr(seq, 301, 60) as a, 'substitution' as kind from ref)
select contig, 'deletion' as kind, 57 as m, 0 as x, 0 as i, 3 as d from r union all select contig, 'insertion', 60, 0, 4, 0 from r union all select contig, 'border', 50, 0, 0, 10 from r"""


@register("X10_alignment_gaps", f"with {REF_SQL}, {GAPS_SQL}")
def x10_gaps(spark, sf):
    """How many of each step there are where three bases are missing, four are added, and the first ten are missing."""
    rows = reference(spark, sf).select("contig", F.substr("seq", F.lit(301), F.lit(60)).alias("a"))
    head, tail = F.substr("a", F.lit(1), F.lit(30)), F.substr("a", F.lit(31))
    kinds = [("deletion", F.concat(head, F.substr(tail, F.lit(4)))), ("insertion", F.concat(head, F.lit("ACCA"), tail)), ("border", F.substr("a", F.lit(11)))]
    rows = rows.select("contig", "a", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("b")) for k, b in kinds])).alias("v")).select("contig", "a", "v.kind", "v.b")

    def run(batches):
        for pdf in batches:
            ops = [alignment(a, b) for a, b in zip(pdf.a, pdf.b)]
            yield pdf[["contig", "kind"]].assign(**{c.lower(): [o.count(c) for o in ops] for c in "MXID"})

    return rows.mapInPandas(run, "contig int, kind string, m int, x int, i int, d int")
