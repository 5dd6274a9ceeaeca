"""Comparison of call sets: exact, by haplotype, and what is counted about it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.variants import variant_type


def without_repeats(calls: DataFrame, order: str = "line") -> DataFrame:
    """Drop a row that equals the one before it on pos, ref and alt, in file order."""
    w = Window.partitionBy("chrom").orderBy(order)
    same = F.lag(F.struct("pos", "ref", "alt")).over(w).eqNullSafe(F.struct("pos", "ref", "alt"))
    return calls.withColumn("_same", same).filter(~F.col("_same")).drop("_same")


def incidents(truth: DataFrame, test: DataFrame) -> DataFrame:
    """incident (TP, FN, FP), chrom, pos, ref, alt of two call sets.

    At a position, the n-th call of one set is compared with the n-th of the
    other; a pair of different alleles is one FN and one FP.
    """
    w = Window.partitionBy("chrom", "pos").orderBy("ref", "alt")
    side = lambda d, s: d.select("chrom", "pos", F.row_number().over(w).alias("rn"), F.col("ref").alias(f"ref_{s}"), F.col("alt").alias(f"alt_{s}"))
    met = side(truth, "a").join(side(test, "b"), ["chrom", "pos", "rn"], "full")
    tp = (F.col("ref_a") == F.col("ref_b")) & (F.col("alt_a") == F.col("alt_b"))
    a, b = (F.struct(F.lit(k).alias("incident"), F.col(f"ref_{s}").alias("ref"), F.col(f"alt_{s}").alias("alt")) for k, s in (("FN", "a"), ("FP", "b")))
    both = F.struct(F.lit("TP").alias("incident"), F.col("ref_a").alias("ref"), F.col("alt_a").alias("alt"))
    rows = F.when(tp, F.array(both)).otherwise(F.filter(F.array(a, b), lambda x: x.ref.isNotNull()))
    return met.select("chrom", "pos", F.explode(rows).alias("x")).select("x.incident", "chrom", "pos", "x.ref", "x.alt")


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("incident").agg(F.count("*").alias("n"))


def type_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy(variant_type(F.col("ref"), F.col("alt")).alias("vtype")).agg(F.count("*").alias("n"))


def length_histogram(calls: DataFrame) -> DataFrame:
    """vtype, len, n: how long insertions and deletions are."""
    t, size = variant_type(F.col("ref"), F.col("alt")), F.abs(F.length("alt") - F.length("ref"))
    return calls.select(t.alias("vtype"), size.alias("len")).filter(F.col("vtype").isin("INSERTION", "DELETION")).groupBy("vtype", "len").agg(F.count("*").alias("n"))


def length_crosstab(rows: DataFrame) -> DataFrame:
    """len, TP, FN, FP, and each as a percentage of its column: incidents by change of length."""
    kinds = ["TP", "FN", "FP"]
    t = rows.groupBy((F.length("alt") - F.length("ref")).alias("len")).agg(*[F.count_if(F.col("incident") == k).alias(k) for k in kinds])
    everything = Window.partitionBy()  # one row for each length
    share = lambda k: F.when(F.sum(k).over(everything) > 0, F.col(k) * 100.0 / F.sum(k).over(everything)).otherwise(0.0)
    return t.select("len", *kinds, *[share(k).alias(f"{k}_share") for k in kinds])


def recall_percent(rows: DataFrame) -> DataFrame:
    """vtype, hits, total, percent: (hits + 1) * 100 over (total + 1), whole, of true calls by type."""
    t = rows.filter(F.col("incident") != "FP").groupBy(variant_type(F.col("ref"), F.col("alt")).alias("vtype"))
    t = t.agg(F.count_if(F.col("incident") == "TP").alias("hits"), F.count("*").alias("total"))
    return t.withColumn("percent", F.expr("((hits + 1) * 100) div (total + 1)"))


def of_types(calls: DataFrame, kinds: set[str]) -> DataFrame:
    """Calls of the chosen types; REPLACE is always kept."""
    return calls.filter(variant_type(F.col("ref"), F.col("alt")).isin(*kinds, "REPLACE"))


def of_weight(calls: DataFrame, min_weight: int, min_per_read: int) -> DataFrame:
    """Calls of enough alternate weight, in all and for each alternate read, as whole numbers."""
    return calls.filter((F.col("aw") >= min_weight) & (F.col("ac") != 0) & (F.expr("aw div nullif(ac, 0)") >= min_per_read))


def of_kinds(rows: DataFrame, kinds: set[str]) -> DataFrame:
    return rows.filter(F.col("incident").isin(*kinds))


GAP, FLANK, TAIL = 200, 100, 5


def clusters(calls: DataFrame, gap: int = GAP) -> DataFrame:
    """Add cluster: calls of a chromosome with at most ``gap`` bases between neighbours have one number."""
    w = Window.partitionBy("chrom").orderBy("pos", "ref", "alt", "side")
    return calls.withColumn("_new", (F.coalesce(F.col("pos") - F.lag("pos").over(w) > gap, F.lit(True))).cast("int")).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def spelled(ref: str, start: int, truth: list[tuple[int, str, str]], test: list[tuple[int, str, str]]) -> list[bool]:
    """For each true call, whether its alternate can be spelled from its place over reference and test alternates.

    ``ref`` begins at position ``start`` (from 1). States are reference
    positions; from one, a base leads to the next, and each test call leads to
    the position after its reference allele by its alternate. A deletion must
    also match the next TAIL reference bases, up to an N.
    """
    jumps: dict[int, list[tuple[str, int]]] = {}
    for pos, r, a in test:
        jumps.setdefault(pos, []).append((a, pos + len(r)))
    end = start + len(ref)

    def reach(pos: int, text: str) -> bool:
        seen, todo = set(), [(pos, 0, "", pos)]
        while todo:
            at, k, pending, nxt = todo.pop()
            if k == len(text):
                return True
            if (at, k, pending) in seen:
                continue
            seen.add((at, k, pending))
            if pending:
                if pending[0] == text[k]:
                    todo.append((at, k + 1, pending[1:], nxt) if len(pending) > 1 else (nxt, k + 1, "", nxt))
                continue
            if start <= at < end and ref[at - start] == text[k]:
                todo.append((at + 1, k + 1, "", at + 1))
            todo += [(at, k, a, to) for a, to in jumps.get(at, ())]
        return False

    out = []
    for pos, r, a in truth:
        text = a
        if len(r) > len(a):
            tail = ref[pos - start + len(r) : pos - start + len(r) + TAIL]
            text += tail.split("N")[0]
        out.append(reach(pos, text))
    return out


def contained(truth: DataFrame, test: DataFrame, ref: DataFrame) -> DataFrame:
    """chrom, pos, ref, alt, found for every true call, by haplotype.

    Calls near each other form a cluster; each cluster gets the reference
    around it and is decided by itself. ``ref`` has chrom and seq, whole; its
    slice is cut out in the join, so only slices reach the workers.
    """
    side = lambda d, s: d.select("chrom", "pos", "ref", "alt").withColumn("side", F.lit(s))
    rows = clusters(side(truth, "truth").unionByName(side(test, "test")))
    span = rows.groupBy("chrom", "cluster").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + F.length("ref")).alias("hi"))
    start = F.greatest(F.lit(1), F.col("lo") - FLANK)
    slices = span.join(ref.select("chrom", "seq"), "chrom").select("chrom", "cluster", start.alias("start"), F.substr("seq", start.cast("int"), (F.col("hi") + FLANK - start).cast("int")).alias("slice"))

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.side == "truth"]
        if own.empty:
            return pd.DataFrame([], columns=["chrom", "pos", "ref", "alt", "found"])
        other = pdf[pdf.side == "test"]
        pick = lambda d: list(zip(d.pos.tolist(), d["ref"].tolist(), d["alt"].tolist()))
        found = spelled(pdf["slice"].iloc[0], int(pdf.start.iloc[0]), pick(own), pick(other))
        return own[["chrom", "pos", "ref", "alt"]].assign(found=found)

    return rows.join(slices, ["chrom", "cluster"]).groupBy("chrom", "cluster").applyInPandas(decide, "chrom string, pos bigint, ref string, alt string, found boolean")
