"""Random references, alternates and reads, and whether calls recover them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(i: Column, seed: int, what: str) -> Column:
    """A repeatable number from 0 to 1 for each position, from digits of an MD5, which other engines have too."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}-{what}-"), i.cast("string"))), F.lit(1), F.lit(10)), 16, 10).cast("double") / F.lit(float(1 << 40))


def _base(x: Column) -> Column:
    return F.substr(F.lit("ACGT"), (F.floor(x * 4) + 1).cast("int"), F.lit(1))


def positions(spark: SparkSession, length: int, seed: int = 1) -> DataFrame:
    """pos (from 0), base of a random reference, one row for each position."""
    return spark.range(length).select(F.col("id").alias("pos"), _base(_draw(F.col("id"), seed, "base")).alias("base"))


def alternate(ref: DataFrame, seed: int, snp: float, insertion: float, deletion: float) -> DataFrame:
    """Add alt: what stands at each position of an alternate; an insertion follows the base, a deletion is empty."""
    event = _draw(F.col("pos"), seed, "event")
    other = F.translate("base", "ACGT", "CGTA")
    more = F.concat("base", _base(_draw(F.col("pos"), seed, "one")), _base(_draw(F.col("pos"), seed, "two")))
    alt = F.when(event < snp, other).when(event < snp + insertion, more).when(event < snp + insertion + deletion, "").otherwise(F.col("base"))
    return ref.withColumn("alt", alt)


def spelled(rows: DataFrame, col: str) -> DataFrame:
    """seq: one simulated sequence as a value; for tests, of bounded length."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", col))), lambda x: x[col]), "").alias("seq"))


def simulated_reads(seq: DataFrame, length: int, step: int) -> DataFrame:
    """pos0, seq: reads that begin every ``step`` bases."""
    at = F.explode(F.sequence(F.lit(0), F.length("seq") - length, F.lit(step)))
    return seq.filter(F.length("seq") >= length).select("seq", at.alias("pos0")).select(F.col("pos0").cast("bigint").alias("pos0"), F.substr("seq", F.col("pos0") + 1, F.lit(length)).alias("seq"))


def recovered(paths: DataFrame, wanted: DataFrame, most: int = 10) -> DataFrame:
    """seq, found: which wanted sequences are among the spelled paths; with more than ``most`` paths none counts as tried."""
    n = paths.agg((F.count("*") <= most).alias("tried"))
    hit = wanted.join(paths.select("seq").distinct().withColumn("hit", F.lit(True)), "seq", "left")
    return hit.crossJoin(n).select("seq", F.when(F.col("tried"), F.coalesce("hit", F.lit(False))).alias("found"))  # one row on the right
