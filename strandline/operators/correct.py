"""Read correction by k-mer counts: best-first search over single-base changes.

The search itself is plain Python on one read; ``corrected`` gives each read
the counts of the k-mers that it may need, by joins, so no table of all counts
is shipped to any worker.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import kmers as K
from strandline.operators import packed

#: Weights of a change, of a change at a good base, of an absent k-mer, and of one absent among good ones.
CHANGE, CHANGE_GOOD, ABSENT, ABSENT_GOOD = 1, 7, 3, 1
MOST_PATHS, MOST_HEAP, GAP, NEAR, MOST_N = 4, 100, 15, 10, 0.05
GOOD_Q = 20
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def canonical(kmer: str) -> str:
    return min(kmer, kmer[::-1].translate(_COMPLEMENT))


def one_way(seq: str, good: list[bool], k: int, start: int, counts: dict[str, tuple[int, int]], least: int) -> str | None:
    """The cheapest sequence from the solid k-mer at ``start`` to the end, changing bases after it.

    States wait in a heap by cost. A trusted base (its k-mer frequent enough)
    is kept without looking further; changes stay NEAR bases apart; a few
    finished ways, or a cost well above the first one's, end the search.
    """
    n = len(seq)
    heap: list[tuple[int, int, str, int]] = [(0, -(start + k), seq[: start + k], -NEAR)]
    done: list[tuple[int, str]] = []
    while heap:
        cost, at, text, last = heapq.heappop(heap)
        at = -at
        if done and cost > done[0][0] + GAP:
            break
        if at == n:
            done.append((cost, text))
            if len(done) >= MOST_PATHS:
                break
            continue
        own, options = seq[at], []
        for b in "ACGT":
            occ, high = counts.get(canonical(text[at - k + 1 :] + b), (0, 0))
            price = ABSENT * (occ < least) + ABSENT_GOOD * (high < least)
            if b == own:
                if occ >= least and high >= least:
                    options = [(0, b, last)]
                    break
                options.append((price, b, last))
            elif own == "N" or at - last >= NEAR:
                if occ >= least:
                    options.append((price + CHANGE + CHANGE_GOOD * good[at], b, at))
        if own not in "ACGT" and not options:
            options = [(ABSENT + ABSENT_GOOD, "A", at)]
        if len(heap) > MOST_HEAP:
            options = options[:1] if len(options) == 1 else [min(options)]
        for price, b, where in options:
            heapq.heappush(heap, (cost + price, -(at + 1), text + b, where))
    return min(done)[1] if done else None


def both_ways(seq: str, qual: list[int], k: int, counts: dict[str, tuple[int, int]], least: int) -> tuple[str, int]:
    """The corrected sequence, changed bases in lower case, and how many changed; a read with too many N stays."""
    if len(seq) < k or seq.count("N") > MOST_N * len(seq):
        return seq, 0
    solid = [counts.get(canonical(seq[i : i + k]), (0, 0))[0] >= least and "N" not in seq[i : i + k] for i in range(len(seq) - k + 1)]
    best, run = (0, -1), 0
    for i, s in enumerate(solid):
        run = run + 1 if s else 0
        best = max(best, (run, -(i - run + 1)), key=lambda x: x)
    if not best[0]:
        return seq, 0
    start, end = -best[1], -best[1] + best[0] - 1  # the longest island of solid k-mers
    good = [q >= GOOD_Q for q in qual]
    right = one_way(seq, good, k, end, counts, least) or seq
    flipped = seq[::-1].translate(_COMPLEMENT)
    left = one_way(flipped, good[::-1], k, len(seq) - k - start, counts, least)
    left = left[::-1].translate(_COMPLEMENT) if left else seq
    text = left[:start] + seq[start : end + k] + right[end + k :]
    changed = [i for i in range(len(seq)) if text[i] != seq[i]]
    return "".join(c.lower() if i in set(changed) else c for i, c in enumerate(text)), len(changed)


def recoded_quality(before: Column, after: Column, qual: Column) -> Column:
    """Quality of a corrected read: where a base changed (lower case in ``after``) 34 and the code of the base that was there, else ``?`` at good quality and ``+`` at bad.

    Codes are 0 to 3 for A, C, G and T, and 4 for any other letter.
    """
    old = lambda b: F.translate(F.when(b.isin(*"ACGT"), b).otherwise("N"), "ACGTN", "\"#$%&")
    mark = lambda x: F.when(x["a"].rlike("[a-z]"), old(x["b"])).when(F.ascii(x["q"]) - 33 >= GOOD_Q, "?").otherwise("+")
    each = F.arrays_zip(F.split(before, "").alias("b"), F.split(after, "").alias("a"), F.split(qual, "").alias("q"))
    return F.when(F.length(before) > 0, F.array_join(F.transform(each, mark), "")).otherwise(F.lit(""))


def neighbourhood(reads: DataFrame, k: int) -> DataFrame:
    """id, kmer (canonical): each read's solid k-mers, and all that the search may make of another of its k-mers; few of a read's k-mers make the same one, so a repeated row stays.

    ``weak`` lists the places of a read's k-mers that aren't solid. Those have any base for each N and changes NEAR bases apart or more, as
    many as a k-mer has room for.
    """
    own = K.explode_kmers(reads.select("id", "seq", "weak"), k)
    bases, places = F.array(*[F.lit(b) for b in "ACGT"]), F.sequence(F.lit(1), F.lit(k))
    put = lambda s, i: F.transform(bases, lambda b: F.overlay(s, b, i, F.lit(1)))
    filled = F.aggregate(places, F.array("kmer"), lambda made, i: F.when(F.substr("kmer", i, F.lit(1)) == "N", F.flatten(F.transform(made, lambda s: put(s, i)))).otherwise(made))
    ways = F.transform(filled, lambda s: F.struct(s.alias("s"), F.lit(1 - NEAR).alias("last")))
    near = [filled]
    for _ in range(0, k, NEAR):
        ways = F.flatten(F.transform(ways, lambda x: F.flatten(F.transform(F.filter(places, lambda i: i >= x["last"] + NEAR), lambda i: F.transform(put(x["s"], i), lambda s: F.struct(s.alias("s"), i.alias("last")))))))
        near.append(F.transform(ways, lambda x: x["s"]))
    near = F.when(~F.array_contains("weak", F.col("i")), F.array("kmer")).otherwise(F.array_distinct(F.concat(*near)))
    return own.select("id", F.explode(near).alias("kmer")).select("id", K.canonical(F.col("kmer")).alias("kmer"))


def corrected(reads: DataFrame, counts: DataFrame, k: int, least: int) -> DataFrame:
    """id, seq, fixed (changes in lower case), n_changes for reads of id, seq, qual.

    Reads whose k-mers are all frequent need no search and no counts; the
    others get their neighbourhood's counts by a join, as one map for each
    read.
    """
    places = K.solid(reads, counts, k, least).filter("solid = 0").groupBy("id").agg(F.collect_set("i").alias("weak"))
    weak = reads.select("id", "seq", "qual").join(places, "id")
    near, often = neighbourhood(weak, k), counts.filter(F.col("occ") >= least)
    if k <= packed.MOST_K:  # numbers are what the many candidates are shuffled as
        key = packed.number(F.col("kmer")).alias("number")
        met = near.select("id", key).join(often.select(key, "kmer", "occ", "occ_hi"), "number")
    else:
        met = near.join(often, "kmer")
    known = met.groupBy("id").agg(F.collect_set(F.struct("kmer", "occ", "occ_hi")).alias("counts"))
    rows = weak.drop("weak").join(known, "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, seq, qual, found in zip(pdf.id, pdf.seq, pdf.qual, pdf["counts"]):
                table = {x["kmer"]: (x["occ"], x["occ_hi"]) for x in found} if found is not None else {}
                out.append((i, seq, *both_ways(seq, [ord(c) - 33 for c in qual], k, table, least)))
            yield pd.DataFrame(out, columns=["id", "seq", "fixed", "n_changes"])

    fixed = rows.mapInPandas(run, "id string, seq string, fixed string, n_changes int")
    whole = reads.join(places, "id", "left_anti").select("id", "seq", F.col("seq").alias("fixed"), F.lit(0).alias("n_changes"))
    return whole.unionByName(fixed)


def converted(rows: DataFrame) -> DataFrame:
    """Upper-case reads again; a read whose length changed aligns as one block, or not at all without a position."""
    size = F.length("fixed")
    cigar = F.when(size == F.length("seq"), F.col("cigar")).when(F.col("pos0").isNull(), "*").otherwise(F.concat(size.cast("string"), F.lit("M")))
    return rows.withColumns({"cigar": cigar, "seq": F.upper("fixed")}).drop("fixed")


def trimmed(rows: DataFrame, k: int = 33, least: int = 2, share: float = 0.8) -> DataFrame:
    """Corrected rows (id, seq, fixed, qual) with ``fixed`` and ``qual`` cut to the longest run of k-mers that corrected reads have more than once.

    Reads whose run is not more than ``share`` of them are dropped, reads
    shorter than k stay; ``n_changes`` is counted again.
    """
    cut = K.cut_to_streak(_streaks(rows, k, least).withColumnsRenamed({"seq": "before", "fixed": "seq"}), k, share).withColumnsRenamed({"seq": "fixed", "before": "seq"})
    return cut.withColumn("n_changes", F.length(F.regexp_replace("fixed", "[^a-z]", "")))


def _streaks(rows: DataFrame, k: int, least: int) -> DataFrame:
    """Corrected rows with start and streak of the longest run of k-mers that corrected reads have ``least`` times."""
    upper = rows.withColumn("upper", F.upper("fixed"))
    counts = K.count_known(upper.select(F.col("upper").alias("seq")), k)
    return K.with_streaks(upper, counts, k, least, seq="upper").drop("upper")


def trim_statistics(rows: DataFrame, k: int = 33, least: int = 2, share: float = 0.8) -> DataFrame:
    """``statistics`` of ``trimmed`` rows against the rows before, each row by itself."""
    met = _streaks(rows.select("id", "seq", "fixed", "qual"), k, least).withColumnsRenamed({"seq": "before", "fixed": "seq"})
    keep, cut = K.streak_cut(k, share)
    left = F.when(keep, cut("seq"))
    return _outcome(met.select(F.length("before").alias("size"), F.length(left).alias("left"), F.length(F.regexp_replace(left, "[^a-z]", "")).alias("n_changes")))


def statistics(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row: reads, repaired reads, repaired bases, from rows of n_changes; against ``before`` (id, seq) also removed and shortened reads and all bases."""
    counts = [F.count_if(F.col("n_changes") > 0).alias("repaired_reads"), F.coalesce(F.sum("n_changes"), F.lit(0)).alias("repaired_bases")]
    if before is None:
        return rows.agg(F.count("*").alias("reads"), *counts)
    met = before.select("id", F.length("seq").alias("size")).join(rows.select("id", F.length("fixed").alias("left"), "n_changes"), "id", "left")
    return _outcome(met)


def _outcome(met: DataFrame) -> DataFrame:
    """Statistics of rows of size, left (null where nothing is) and n_changes."""
    counts = [F.count_if(F.col("n_changes") > 0).alias("repaired_reads"), F.coalesce(F.sum("n_changes"), F.lit(0)).alias("repaired_bases")]
    gone, less = F.col("left").isNull() | (F.col("left") == 0), F.col("left") != F.col("size")
    return met.agg(F.count("*").alias("reads"), F.sum("size").alias("bases"), F.count_if(gone).alias("removed"), F.count_if(~gone & less).alias("shortened"), *counts)


def changes_per_read(rows: DataFrame) -> DataFrame:
    return rows.groupBy("n_changes").agg(F.count("*").alias("reads"))


def changes_by_distance(rows: DataFrame) -> DataFrame:
    """distance (from a read's end, from 0), n of changed bases."""
    low = F.filter(F.transform(F.split("fixed", ""), lambda c, i: F.when(c.rlike("[a-z]"), F.length("fixed") - 1 - i)), lambda x: x.isNotNull())
    return rows.select(F.explode(low).alias("distance")).groupBy("distance").agg(F.count("*").alias("n"))
