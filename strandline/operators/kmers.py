"""K-mers: extraction, strand, counting, histograms, per-read coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import packed
from strandline.session import staged


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than ACGT stay as they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def kmers_of(seq: Column, k: int) -> Column:
    """Array of structs (i from 0, kmer); empty where the sequence is shorter than k or null."""
    none = F.array().cast("array<struct<i:int,kmer:string>>")
    each = F.transform(F.sequence(F.lit(0), F.length(seq) - k), lambda i: F.struct(i.cast("int").alias("i"), F.substr(seq, i + 1, F.lit(k)).alias("kmer")))
    return F.when(F.length(seq) >= k, each).otherwise(none)


def explode_kmers(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """One row for each k-mer: the other columns, i, kmer. A narrow step; nothing is shuffled."""
    rest = [c for c in df.columns if c != seq]
    return df.select(*rest, F.inline(kmers_of(F.col(seq), k)))


def count_plain(reads: DataFrame, k: int) -> DataFrame:
    """kmer, n. Counted before and after the shuffle, so a frequent k-mer doesn't skew it."""
    if k <= packed.MOST_K:
        return packed.counts(reads, k)
    return explode_kmers(reads.select("seq"), k).groupBy("kmer").agg(F.count("*").alias("n"))


def histogram(counts: DataFrame, col: str = "n") -> DataFrame:
    """freq, kmers: how many k-mers occur so often."""
    return counts.groupBy(F.col(col).alias("freq")).agg(F.count("*").alias("kmers"))


def base_code(base: Column) -> Column:
    """A 0, C 1, G 2, T 3, anything else 4."""
    at = F.instr(F.lit("ACGT"), base)
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(4)


def appended(kmer: Column, base: Column) -> Column:
    """Drop the first base and add one at the end."""
    return F.concat(F.substr(kmer, F.lit(2)), base)


def prepended(kmer: Column, base: Column) -> Column:
    """Drop the last base and add one at the front."""
    return F.concat(base, F.substr(kmer, F.lit(1), F.length(kmer) - 1))


def with_base(kmer: Column, i: int, base: Column) -> Column:
    """Set the base at index i (from 0)."""
    return F.overlay(kmer, base, F.lit(i + 1), F.lit(1))


def count_canonical(reads: DataFrame, k: int, min_quality: int = 20, most: int = 255, most_high: int = 63) -> DataFrame:
    """kmer, occ, occ_hi: strand-neutral counts that saturate; occ_hi takes k-mers whose bases all have the quality. K-mers with other letters than ACGT are left out."""
    if k <= packed.MOST_K:
        n = packed.canonical_counts(reads, k, min_quality)
        return n.select(packed.text(F.col("number"), k).alias("kmer"), F.least("n", F.lit(most)).alias("occ"), F.least("high", F.lit(most_high)).alias("occ_hi"))
    quals = F.transform(F.sequence(F.lit(0), F.length("seq") - k), lambda i: F.struct(i.cast("int").alias("i"), F.substr("seq", i + 1, F.lit(k)).alias("kmer"), F.substr("qual", i + 1, F.lit(k)).alias("q")))
    each = reads.filter(F.length("seq") >= k).select(F.inline(quals)).filter(~F.col("kmer").rlike("[^ACGT]"))
    low = "".join(chr(c) for c in range(33, 33 + min_quality))
    high = F.translate(F.col("q"), low, "") == F.col("q")
    return each.groupBy(canonical(F.col("kmer")).alias("kmer")).agg(F.least(F.count("*"), F.lit(most)).alias("occ"), F.least(F.count_if(high), F.lit(most_high)).alias("occ_hi"))


def count_known(reads: DataFrame, k: int, most: int = 255) -> DataFrame:
    """kmer, occ of ``count_canonical``, for those who don't ask for qualities; so only ``seq`` is read and sent to Python."""
    if k <= packed.MOST_K:
        return packed.canonical_numbers(reads, k).select(packed.text(F.col("number"), k).alias("kmer"), F.least("n", F.lit(most)).alias("occ"))
    return count_canonical(reads.select("seq", F.col("seq").alias("qual")), k, most=most).select("kmer", "occ")


def mode_of(hist: DataFrame, least: int = 3) -> DataFrame:
    """One row: the frequency from ``least`` on that most k-mers have, the smaller of equals."""
    return hist.filter(F.col("freq") >= least).agg(F.max(F.struct("kmers", -F.col("freq"))).alias("m")).select((-F.col("m.col2")).alias("mode"))


def coverage_floor(hist: DataFrame, least: int = 4, share: float = 0.1, low: int = 4, high: int = 8) -> DataFrame:
    """One row: mean count of k-mers seen at least ``least`` times, and the smallest count that is trusted."""
    mean = F.sum(F.col("freq") * F.col("kmers")).cast("double") / F.sum("kmers")
    h = hist.filter(F.col("freq") >= least).agg(mean.alias("kcov"))
    return h.select("kcov", F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.lit(share) * F.col("kcov") + 0.499))).cast("int").alias("min_cov"))


def automatic_k(total_bases: int) -> int:
    """An odd k from the number of bases: the first L of 10 to 31 with 2**L above it, plus 12, halved."""
    bits = next((n for n in range(10, 32) if 2**n > total_bases), 32)
    k = (bits + 12) // 2
    return k if k % 2 else k + 1


def automatic_k_of(reads: DataFrame) -> DataFrame:
    """total_bases, k as one row, without a trip to the driver."""
    total = reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("total_bases"))
    bits = F.coalesce(F.element_at(F.filter(F.sequence(F.lit(10), F.lit(31)), lambda n: F.pow(F.lit(2.0), n) > F.col("total_bases")), 1), F.lit(32))
    k = F.floor((bits + 12) / 2).cast("int")
    return total.select("total_bases", F.when(k % 2 == 1, k).otherwise(k + 1).alias("k"))


def with_context(kmers: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Add ctx, which numbers equal k-mers of one sequence from 0."""
    return kmers.withColumn("ctx", F.row_number().over(Window.partitionBy(*keys, "kmer").orderBy(order)) - 1)


def successors(kmers: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Add next: the k-mer after each one in its sequence."""
    return kmers.withColumn("next", F.lead("kmer").over(Window.partitionBy(*keys).orderBy(order)))


def solid(reads: DataFrame, counts: DataFrame, k: int, least: int, key: str = "id") -> DataFrame:
    """key, i, solid for each k-mer of each read: whether its strand-neutral count reaches ``least``."""
    if k <= packed.MOST_K:
        each = packed.canonical_windows(reads, k, key)
        known = counts.filter(F.col("occ") >= least).select(packed.number(F.col("kmer")).alias("number"), F.lit(1).alias("hit"))
        return each.join(known, "number", "left").select(key, "i", F.coalesce("hit", F.lit(0)).alias("solid"))
    each = explode_kmers(reads.select(key, "seq"), k).withColumn("kmer", canonical(F.col("kmer")))
    known = counts.filter(F.col("occ") >= least).select("kmer", F.lit(1).alias("hit"))
    return each.join(known, "kmer", "left").select(key, "i", F.coalesce("hit", F.lit(0)).alias("solid"))


def base_coverage(flags: DataFrame, k: int, length: Column, key: str = "id") -> DataFrame:
    """key, pos, cover: how many solid k-mers cover each base.

    The flags of one read are gathered in order, so the sums stay in the row.
    """
    by = flags.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "solid"))), lambda x: x.solid).alias("s"))
    n = F.size("s") + k - 1
    cover = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.aggregate(F.slice("s", F.greatest(F.lit(1), p - k + 2), F.least(p, F.size("s") - 1) - F.greatest(F.lit(0), p - k + 1) + 1), F.lit(0), lambda a, x: a + x))
    return by.select(key, F.posexplode(cover).alias("pos", "cover"))


def longest_run(flags: DataFrame, key: str = "id") -> DataFrame:
    """key, start, streak: the first longest run of solid k-mers; start is null and streak 0 without one."""
    own = Window.partitionBy(key).orderBy("i")
    runs = flags.withColumn("g", F.col("i") - F.sum("solid").over(own))
    size = runs.filter("solid = 1").groupBy(key, "g").agg(F.min("i").alias("start"), F.count("*").alias("streak"))
    best = size.groupBy(key).agg(F.max(F.struct("streak", -F.col("start"))).alias("b")).select(key, (-F.col("b.col2")).alias("start"), F.col("b.streak").alias("streak"))
    return flags.select(key).distinct().join(best, key, "left").select(key, "start", F.coalesce("streak", F.lit(0)).cast("bigint").alias("streak"))


def with_streaks(reads: DataFrame, counts: DataFrame, k: int, least: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """Reads with start and streak: the first longest run of k-mers that occur ``least`` times, as ``longest_run`` says; both null for reads shorter than k.

    Each read is looked over in its own row. Where the known k-mers are too
    many to be sent to every worker, reads meet them by joins; ``key`` then
    tells reads apart.
    """
    known = staged(counts.filter(F.col("occ") >= least), "known-kmers")
    if k <= packed.MOST_K and (numbers := packed.known_numbers(known)) is not None:
        return packed.with_streaks(reads, numbers, k, seq)
    own = reads.select(key, F.col(seq).alias("seq")).filter(F.length("seq") >= k)
    return reads.join(longest_run(solid(own, known, k, least, key), key), key, "left")


def solid_coverage(reads: DataFrame, counts: DataFrame, k: int, least: int, key: str = "id") -> DataFrame:
    """key, pos, cover: how many k-mers that occur ``least`` times cover each base, as ``base_coverage`` says."""
    known = staged(counts.filter(F.col("occ") >= least), "known-kmers")
    if k <= packed.MOST_K and (numbers := packed.known_numbers(known)) is not None:
        return packed.coverage(reads, numbers, k, key)
    return base_coverage(solid(reads.filter(F.length("seq") >= k), known, k, least, key), k, F.length("seq"), key)


def trimmed_by_streak(reads: DataFrame, runs: DataFrame, k: int, share: float = 0.8, key: str = "id") -> DataFrame:
    """Keep each read's longest run of known k-mers if it is more than ``share`` of the read; drop other reads; reads shorter than k stay."""
    return cut_to_streak(reads.join(runs, key, "left"), k, share)


def cut_to_streak(met: DataFrame, k: int, share: float = 0.8) -> DataFrame:
    """``trimmed_by_streak`` of reads that have their start and streak."""
    keep, cut = streak_cut(k, share)
    return met.filter(keep).withColumns({"qual": cut("qual"), "seq": cut("seq")}).drop("start", "streak")


def streak_cut(k: int, share: float) -> tuple[Column, Callable[[str], Column]]:
    """Whether a read (seq, start, streak) stays, and what its run leaves of a column."""
    part = F.col("streak") + k - 1
    whole = F.length("seq") < k
    cut = lambda c: F.when(whole, F.col(c)).otherwise(F.substr(F.col(c), (F.col("start") + 1).cast("int"), part.cast("int")))
    return whole | ((F.col("streak") > 0) & (part / F.length("seq") > share)), cut


def first_plain(seq: Column, k: int, start: int = 0) -> Column:
    """Index of the first k-mer of ACGT only at or after ``start``; null without one."""
    at = F.regexp_instr(F.substr(seq, F.lit(start + 1)), F.lit(f"[ACGT]{{{k}}}"))
    return F.when(at > 0, at - 1 + start)


def greedy_repairs(kmers: DataFrame, counts: DataFrame, mode: int) -> DataFrame:
    """kmer, best, best_occ for k-mers that one changed base makes frequent.

    Of the k-mers that differ in one base, the most frequent wins if three
    times its count exceeds the mode and the runner-up has fewer than 3.
    Candidates are looked up by a join; each k-mer makes 3 k of them.
    """
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    all_i = F.sequence(F.lit(1), F.length("kmer"))
    cand = kmers.select("kmer", F.explode(all_i).alias("i")).select("kmer", F.explode(F.transform(F.filter(bases, lambda b: b != F.substr("kmer", F.col("i"), F.lit(1))), lambda b: F.overlay("kmer", b, F.col("i"), F.lit(1)))).alias("c"))
    known = counts.select(F.col("kmer").alias("canon"), "occ")
    met = cand.withColumn("canon", canonical(F.col("c"))).join(known, "canon")
    ranked = met.groupBy("kmer").agg(F.slice(F.sort_array(F.collect_list(F.struct("occ", "c")), False), 1, 2).alias("top"))
    best, second = F.col("top")[0], F.get("top", F.lit(1))
    return ranked.filter((3 * best.occ > mode) & (F.coalesce(second.occ, F.lit(0)) < 3)).select("kmer", best.c.alias("best"), best.occ.alias("best_occ"))
