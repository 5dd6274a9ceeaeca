"""Variant records: alleles, types, pile-up calls, support statistics, sets of calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import packed
from strandline.session import staged


def common_prefix(ref: Column, alt: Column) -> Column:
    """Bases to trim from the front: equal ones, while both alleles keep one."""
    most = F.least(F.length(ref), F.length(alt)) - 1
    first = F.array_position(F.transform(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), lambda i: (F.substr(ref, i, F.lit(1)) != F.substr(alt, i, F.lit(1))).cast("int")), 1)
    return F.when(first > 0, first - 1).otherwise(F.greatest(most, F.lit(0))).cast("int")


def normalised(variants: DataFrame) -> DataFrame:
    """Trim the shared front of ref and alt and move pos along."""
    n = common_prefix(F.col("ref"), F.col("alt"))
    v = variants.withColumn("_n", n)
    return v.withColumns({"pos": F.col("pos") + F.col("_n"), "ref": F.substr("ref", F.col("_n") + 1), "alt": F.substr("alt", F.col("_n") + 1)}).drop("_n")


def variant_type(ref: Column, alt: Column) -> Column:
    """SNP, INSERTION, DELETION or REPLACE, by lengths."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNP").when(r == 1, "INSERTION").when(a == 1, "DELETION").otherwise("REPLACE")


def info_fields(info: Column, names: dict[str, list[str]]) -> dict[str, Column]:
    """Integers of an INFO text by any of their names; 0 where absent."""
    parsed = F.str_to_map(info, F.lit(";"), F.lit("="))
    return {out: F.coalesce(*[F.element_at(parsed, n).cast("int") for n in keys], F.lit(0)) for out, keys in names.items()}


#: The names that writers use for weights and read counts.
INFO_NAMES = {"rw": ["RW"], "rc": ["RC", "RefCount"], "aw": ["AW"], "ac": ["AC", "AltCount"]}
EPSILON = 1e-6


def binomial_percent(ref_reads: Column, alt_reads: Column) -> Column:
    """How well equal chances explain the reads: twice the upper tail of a fair coin, in percent, at most 100.

    The tail from ``ref_reads`` on of a binomial with all reads; terms are
    made from one another, starting at 2**-n, in logarithms so that deep sites
    don't underflow. A tiny number is added before rounding, so that halves
    round alike everywhere.
    """
    n = (ref_reads + alt_reads).cast("double")
    r = ref_reads.cast("double")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    tail = F.aggregate(
        F.sequence(F.lit(0), (ref_reads + alt_reads).cast("int")), start,
        lambda a, k: F.struct((a.t + F.log((n - k + F.when(k == n, 1).otherwise(0)) / (k + 1.0))).alias("t"), (a.s + F.when(k >= r, F.exp(a.t)).otherwise(0.0)).alias("s")),
    )["s"]
    return F.when(n == 0, 100).otherwise(F.round(F.least(F.lit(1.0), 2 * tail) * 100 + EPSILON)).cast("int")


def phred_probability(q: Column) -> Column:
    """The chance that a base of this quality is wrong."""
    return F.pow(F.lit(10.0), -q / 10.0)


def reliable(variants: DataFrame, low_reads: int = 3, threshold: int = 1) -> DataFrame:
    """Keep calls with more alternate reads than ``low_reads``, or a binomial percentage of at least ``threshold``."""
    return variants.filter((F.col("ac") > low_reads) | (F.col("bp") >= threshold))


def flag_long(variants: DataFrame, most: int = 40) -> DataFrame:
    """Add valid: whether the reference allele is shorter than ``most``."""
    return variants.withColumn("valid", F.length("ref") < most)


def deduplicated(variants: DataFrame, weight: str = "aw", ties: tuple[str, ...] = ()) -> DataFrame:
    """One call for each site and pair of alleles, letters' case aside: that of the greatest weight.

    ``ties`` decide among equals, the smaller first, so that reruns agree. The
    best row of each group is found before the shuffle as well as after.
    """
    rest = F.struct(F.col(weight), *[(-F.col(c)).alias(f"_{c}") for c in ties], F.struct(*variants.columns).alias("row"))
    keys = [F.lower("chrom").alias("_c"), "pos", F.lower("ref").alias("_r"), F.lower("alt").alias("_a")]
    best = variants.groupBy(*[k if not isinstance(k, str) else F.col(k).alias("_p") for k in keys]).agg(F.max(rest).alias("b"))
    return best.select("b.row.*")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return deduplicated(a.unionByName(b))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Calls of the first set that the second has too; the smaller k of both."""
    keys = ["chrom", "pos", "ref", "alt"]
    low = [F.lower(c).alias(f"{c}_b") if c != "pos" else F.col(c).alias("pos_b") for c in keys]
    k = F.col("ks") if "ks" in b.columns else F.lit(None).cast("int")
    other = b.select(*low, k.alias("ks_b")).groupBy(*[f"{c}_b" for c in keys]).agg(F.min("ks_b").alias("ks_b"))
    x = a.alias("x")
    same = [(F.lower(f"x.{c}") if c != "pos" else F.col("x.pos")) == F.col(f"{c}_b") for c in keys]
    met = x.join(other, same[0] & same[1] & same[2] & same[3])
    return deduplicated(met.select(*[F.least("x.ks", "ks_b").alias("ks") if c == "ks" else F.col(f"x.{c}") for c in a.columns]))


def merged(sets: list[DataFrame]) -> DataFrame:
    """All calls of several sorted sets as one set, in order of chrom, pos, ref, alt."""
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return in_order(deduplicated(out))


def in_order(variants: DataFrame) -> DataFrame:
    return variants.orderBy(F.lower("chrom"), "pos", F.lower("ref"), F.lower("alt"))


def contig_lengths(variants: DataFrame) -> DataFrame:
    """chrom, length: where the last call of each chromosome ends."""
    return variants.groupBy("chrom").agg(F.max_by(F.col("pos") + F.length("ref"), F.struct("pos", F.length("ref"))).alias("length"))


def pileup(reads: DataFrame, name: str = "contig") -> DataFrame:
    """name, pos, base, n, reads: what reads say at each position, their ids sorted.

    Bases of a read lie next to each other from its pos0; an alignment with
    gaps is not followed.
    """
    each = reads.select(name, "id", "pos0", F.posexplode(F.split("seq", "")).alias("i", "base")).filter(F.col("base") != "")
    return each.groupBy(name, (F.col("pos0") + F.col("i")).alias("pos"), "base").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("reads"))


def _summed(parts: list[pa.RecordBatch], keys: list[str]) -> list[pa.RecordBatch]:
    """The rows of batches with all that isn't a key summed for each key."""
    numbers = [c for c in parts[0].schema.names if c not in keys]
    table = pa.Table.from_batches(parts).group_by(keys).aggregate([(c, "sum") for c in numbers])
    return table.select([*keys, *(f"{c}_sum" for c in numbers)]).rename_columns([*keys, *numbers]).to_batches(max_chunksize=10_000)


def pile_counts(reads: DataFrame, name: str = "contig", good: int | None = None) -> DataFrame:
    """name, pos, base, n: ``pileup`` without its lists and without reads of no name or position, counted within each batch before the shuffle.

    With ``good``, n_good is how many of the n bases have that quality at least.
    """

    sums = ["n"] if good is None else ["n", "n_good"]
    names = [name, "pos", "base", *sums]

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, off = _letters(batch.column(2))
        code = batch.column(0).dictionary_encode()
        row, i, at = _bases(off, np.asarray(code.is_valid()) & np.asarray(batch.column(1).is_valid()))
        if not len(row):
            return None
        pos = np.asarray(batch.column(1).fill_null(0))[row] + i
        kinds = np.flatnonzero(np.bincount(raw[at])) if raw.dtype == np.uint8 else np.unique(raw[at])
        low, span = int(pos.min()), int(pos.max() - pos.min()) + 1
        key = (np.asarray(code.indices.fill_null(0)).astype(np.int64)[row] * span + pos - low) * len(kinds) + np.searchsorted(kinds, raw[at])
        cells = len(code.dictionary) * span * len(kinds)
        if cells > 4 * len(row) + PILE:
            found, key = np.unique(key, return_inverse=True)
            cells = len(found)
        else:
            found = np.arange(cells)
        n = np.bincount(key, minlength=cells)
        numbers = [n]
        if good is not None:
            qual, qoff = _letters(batch.column(3))
            there = i < np.diff(qoff)[row]
            q = qual[np.minimum(qoff[row] + i, len(qual) - 1)] if len(qual) else np.zeros(len(row), np.uint8)
            numbers.append(np.bincount(key[there & (q >= good + 33)], minlength=cells))
        some = np.flatnonzero(n)
        found = found[some]
        bases = pa.array([chr(x) for x in kinds]).take(pa.array(found % len(kinds)))
        place = found // len(kinds)
        return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(place // span)), pa.array(place % span + low), bases, *(pa.array(x[some]) for x in numbers)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                if (some := counted(whole.slice(k, 2000))) is not None:
                    pending.append(some)
            if sum(x.num_rows for x in pending) > PENDING:
                pending = _summed(pending, [name, "pos", "base"])
                if sum(x.num_rows for x in pending) > PENDING // 2:  # little is alike here
                    yield from pending
                    pending = []
        yield from _summed(pending, [name, "pos", "base"]) if pending else []

    kind = reads.schema[name].dataType.simpleString()
    own = reads.filter(F.col(name).isNotNull()).select(name, F.col("pos0").cast("long").alias("pos0"), "seq", *(["qual"] if good is not None else []))
    found = own.mapInArrow(run, f"{name} {kind}, pos long, base string, {', '.join(f'{c} long' for c in sums)}")
    return found.groupBy(name, "pos", "base").agg(*[F.sum(c).alias(c) for c in sums])


def snp_calls(piles: DataFrame, ref: DataFrame, threshold: int = 4, name: str = "contig") -> DataFrame:
    """chrom, pos (from 1), ref, alt, rc, ac, ref_reads, alt_reads for alternate bases of more than ``threshold`` reads.

    ``ref`` is exploded to one row for each position and joined by position.
    """
    met = _with_reference(piles, ref, name)
    own = met.filter(F.col("base") == F.col("ref")).select(name, "pos", F.col("n").alias("rc"), F.col("reads").alias("ref_reads"))
    calls = met.filter((F.col("base") != F.col("ref")) & (F.col("n") > threshold)).join(own, [name, "pos"], "left")
    return calls.select(
        F.col(name).cast("string").alias("chrom"), (F.col("pos") + 1).alias("pos"), "ref", F.col("base").alias("alt"), F.coalesce("rc", F.lit(0)).alias("rc"), F.col("n").alias("ac"),
        F.coalesce("ref_reads", F.array().cast("array<string>")).alias("ref_reads"), F.col("reads").alias("alt_reads"),
    )


def _with_reference(piles: DataFrame, ref: DataFrame, name: str) -> DataFrame:
    truth = ref.select(name, F.posexplode(F.split("seq", "")).alias("p", "ref")).select(name, F.col("p").cast("bigint").alias("pos"), "ref")
    return piles.join(truth, [name, "pos"])


#: Positions to a block of sites, sites that are sent to every worker (more are met by a join), counters that a small batch may have, and counts that wait to be summed.
BLOCK, MOST_SITES, PILE, PENDING = 256, 1 << 18, 1 << 16, 1 << 20


def sites(reads: DataFrame, ref: DataFrame, threshold: int = 4, name: str = "contig", good: int | None = None) -> DataFrame:
    """chrom, pos (from 1), ref, alt, rc, ac, nth: what ``snp_calls`` finds, from counts alone, numbered in order within each chromosome.

    Lists of all reads at all positions are never made: ``touches``,
    ``shared`` and ``named_touches`` look at the reads again for these sites only.
    With ``good``, sure says whether more alternate bases than the threshold have that quality at least.
    """
    met = _with_reference(staged(pile_counts(reads, name, good), "piles"), ref, name)
    own = met.filter(F.col("base") == F.col("ref")).select(name, "pos", F.col("n").alias("rc"))
    calls = met.filter((F.col("base") != F.col("ref")) & (F.col("n") > threshold)).join(own, [name, "pos"], "left")
    calls = calls.select(F.col(name).cast("string").alias("chrom"), (F.col("pos") + 1).alias("pos"), "ref", F.col("base").alias("alt"), F.coalesce("rc", F.lit(0)).alias("rc"), F.col("n").alias("ac"), *([(F.col("n_good") > threshold).alias("sure")] if good is not None else []))
    return staged(numbered(calls), "sites")


def numbered(calls: DataFrame) -> DataFrame:
    """Calls with nth, their number in order within each chromosome."""
    return calls.withColumn("nth", F.row_number().over(Window.partitionBy("chrom").orderBy("pos", "ref", "alt")))


def sure_sites(places: DataFrame) -> DataFrame:
    """The ``sites`` that are sure, numbered anew: each is followed by the next sure one, whatever lies between."""
    return staged(numbered(places.filter("sure")), "sure-sites")


def _followed(places: DataFrame) -> DataFrame:
    """Sites (with vid) and the vid, position and alleles of the next one of each chromosome: v2, pos2, ref2, alt2."""
    w = Window.partitionBy("chrom").orderBy("nth")
    return places.withColumns({f"{new}2": F.lead(c).over(w) for new, c in (("v", "vid"), ("pos", "pos"), ("ref", "ref"), ("alt", "alt"))})


def _met(reads: DataFrame, places: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Reads (id, pos0, seq and ``keep``) with the sites of each block of positions that they touch, as an array.

    The table of blocks is staged, so its size is known: a small one is
    broadcast, a large one is joined by shuffling a read once for each of its blocks.
    """
    by = _followed(places).groupBy("chrom", F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(F.collect_list(F.struct("nth", "vid", "pos", "ref", "alt", "v2", "pos2", "ref2", "alt2")).alias("sites"))
    blocks = F.sequence(F.floor(F.col("pos0") / BLOCK), F.floor((F.col("pos0") + F.length("seq") - 1) / BLOCK))
    own = reads.select(F.col("id").alias("read"), *keep, F.col(name).cast("string").alias("chrom"), "pos0", "seq", F.explode(blocks).alias("block"))
    return own.join(staged(by, "blocks"), ["chrom", "block"])


def _side(pos: Column, ref: Column, alt: Column) -> Column:
    """0 where the read has the reference allele at this position (from 1), 1 for the alternate, null for neither or elsewhere."""
    at = (pos - F.col("pos0")).cast("int")
    base = F.when((at >= 1) & (at <= F.length("seq")), F.substr(F.col("seq"), at, F.lit(1)))
    return F.when(base == ref, 0).when(base == alt, 1)


def touches(reads: DataFrame, places: DataFrame, name: str = "contig", keep: tuple[str, ...] = ()) -> DataFrame:
    """read, keep, chrom, nth, vid, v2, side: which reads (id, pos0, seq) support which allele of which site, as ``phase.touched`` says of lists of reads; v2 is the next site's vid."""
    if (sent := _site_table(places)) is not None:
        return _touches_alone(reads, places, sent, name, keep)
    each = F.transform("sites", lambda x: F.struct(x.nth.alias("nth"), x.vid.alias("vid"), x.v2.alias("v2"), _side(x.pos, x.ref, x.alt).alias("side")))
    return _met(reads, places, name, keep).select("read", *keep, "chrom", F.inline(F.filter(each, lambda x: x.side.isNotNull())))


def repeated_ids(reads: DataFrame, key: str = "id") -> DataFrame:
    """h: the hashes of ids that more than one row has."""
    return staged(reads.select(F.xxhash64(key).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated-ids")


def by_id(reads: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Reads whose id no other row has, and the rest; by hashes, so some single ones may be with the rest."""
    h, often = F.xxhash64(key), repeated_ids(reads, key)
    if often.isEmpty():  # the branch of the rest then leaves the plan
        return reads, reads.filter(F.lit(False))
    return tuple(reads.withColumn("h", h).join(often, "h", how).drop("h") for how in ("left_anti", "left_semi"))


def _letters(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a string column as numbers, and n+1 offsets into them; bytes, unless there are others than ASCII."""
    raw, off = packed.buffers(seqs)
    if not len(off) or not (raw[off[0] : off[-1]] > 127).any():
        return raw, off
    texts = seqs.fill_null("").to_pylist()
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in texts])])


def _site_table(places: DataFrame):
    """Sites of one letter for another, in order, as a broadcast of names, places, letters, nth and vid; nothing if there are too many or others."""
    fits = F.coalesce((F.length("ref") == 1) & (F.length("alt") == 1) & F.col("chrom").isNotNull() & F.col("vid").isNotNull(), F.lit(False))
    n, plain = places.limit(MOST_SITES + 1).agg(F.count("*"), F.count_if(fits)).first()
    if n > MOST_SITES or plain < n:
        return None
    t = places.select("chrom", "nth", F.col("pos").cast("long").alias("pos"), F.ascii("ref").alias("ref"), F.ascii("alt").alias("alt"), "vid").toArrow().combine_chunks()
    names = sorted(set(t["chrom"].to_pylist()))
    index = {x: j for j, x in enumerate(names)}
    code = np.array([index[x] for x in t["chrom"].to_pylist()], np.int64)
    nth, pos, ref, alt, vid = (t[c].to_numpy() for c in ("nth", "pos", "ref", "alt", "vid"))
    order = np.lexsort((nth, code))
    return places.sparkSession.sparkContext.broadcast((index, code[order] << 40 | (pos[order].astype(np.int64) + _SHIFT), ref[order], alt[order], nth[order], vid[order]))


def _touches_alone(reads: DataFrame, places: DataFrame, sent, name: str, keep: tuple[str, ...]) -> DataFrame:
    """``touches`` by looking each read over in its own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, place, ref, alt, nth, vid = sent.value
        names, last = pa.array(list(index), pa.string()), np.append(place[1:] >> 40 != place[:-1] >> 40, True)[: len(place)]
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                site, row, side = _sides(batch, index, place, ref, alt)
                hit = np.flatnonzero(side >= 0)
                at, of = site[hit], pa.array(row[hit])
                v2 = pa.array(vid[np.minimum(at + 1, len(vid) - 1)].astype(np.int64), pa.int64(), mask=last[at])
                rest = [names.take(pa.array(place[at] >> 40)), pa.array(nth[at].astype(np.int64)), pa.array(vid[at].astype(np.int64)), v2, pa.array(side[hit], pa.int32())]
                yield pa.RecordBatch.from_arrays([*(batch.column(3 + j).take(of) for j in range(1 + len(keep))), *rest], ["read", *keep, "chrom", "nth", "vid", "v2", "side"])

    own = reads.select(F.col(name).cast("string").alias("name"), F.col("pos0").cast("long").alias("pos0"), "seq", F.col("id").alias("read"), *keep)
    kinds = {c: places.schema[c].dataType.simpleString() for c in ("nth", "vid")}
    first = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("read", *keep))
    found = own.mapInArrow(run, f"{first}, chrom string, nth long, vid long, v2 long, side int")
    return found.withColumns({"nth": F.col("nth").cast(kinds["nth"]), "vid": F.col("vid").cast(kinds["vid"]), "v2": F.col("v2").cast(kinds["vid"])})


def _shared_alone(reads: DataFrame, places: DataFrame, sent, name: str) -> DataFrame:
    """chrom, nth, v1, s1, v2, s2, n over reads whose id no other row has, counted in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, place, ref, alt, nth, vid = sent.value
        total = np.zeros(4 * len(place), np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                site, row, side = _sides(whole.slice(k, 2000), index, place, ref, alt)
                both = np.flatnonzero((row[1:] == row[:-1]) & (side[1:] >= 0) & (side[:-1] >= 0))
                total += np.bincount(site[both] * 4 + side[both] * 2 + side[both + 1], minlength=len(total))
        key = np.flatnonzero(total)
        at, names = key >> 2, list(index)
        chrom = pa.array(names, pa.string()).take(pa.array(place[at] >> 40))
        numbers = [nth[at], vid[at], key >> 1 & 1, vid[np.minimum(at + 1, len(vid) - 1)], key & 1, total[key]]
        yield pa.RecordBatch.from_arrays([chrom, *(pa.array(x.astype(np.int64)) for x in numbers)], ["chrom", "nth", "v1", "s1", "v2", "s2", "n"])

    own = reads.select(F.col(name).cast("string").alias("name"), F.col("pos0").cast("long").alias("pos0"), "seq")
    kinds = {c: places.schema[c].dataType.simpleString() for c in ("nth", "vid")}
    found = own.mapInArrow(run, "chrom string, nth long, v1 long, s1 long, v2 long, s2 long, n long")
    return found.select("chrom", F.col("nth").cast(kinds["nth"]).alias("nth"), F.col("v1").cast(kinds["vid"]).alias("v1"), F.col("s1").cast("int").alias("s1"), F.col("v2").cast(kinds["vid"]).alias("v2"), F.col("s2").cast("int").alias("s2"), "n")


def _sides(batch: pa.RecordBatch, index: dict, place: np.ndarray, ref: np.ndarray, alt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """site, row, side of every site that lies in a read (name, pos0, seq), in order; side is -1 for neither allele."""
    raw, off = _letters(batch.column(2))
    code = batch.column(0).dictionary_encode()
    known = np.array([index.get(x, -1) for x in code.dictionary.to_pylist()] or [-1], np.int64)[np.asarray(code.indices.fill_null(0)).astype(np.int64)]
    there = np.asarray(code.is_valid()) & np.asarray(batch.column(1).is_valid()) & (known >= 0)
    pos0 = np.asarray(batch.column(1).fill_null(0))
    start = np.where(there, known, 0) << 40 | (pos0 + 1 + _SHIFT)
    size = np.diff(off)
    low, high = np.searchsorted(place, start), np.searchsorted(place, start + size)
    n = np.where(there, high - low, 0)
    row = np.repeat(np.arange(len(n)), n)
    site = low[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    base = raw[off[row] + place[site] - start[row]]
    return site, row, np.where(base == ref[site], 0, np.where(base == alt[site], 1, -1))


def shared(reads: DataFrame, places: DataFrame, name: str = "contig") -> DataFrame:
    """chrom, nth, v1, s1, v2, s2, n: ids of reads that an allele of a site and one of the next site share, each id once; no row where there are none.

    A read sees both sites by itself, so only counts are shuffled; rows that
    share an id are brought together first. Sites are sent to every worker, or
    met by a join where they are too many.
    """
    once, more = by_id(reads.select("id", name, "pos0", "seq"))
    if (sent := _site_table(places)) is not None:
        seen = _shared_alone(once, places, sent, name)
    else:
        both = F.transform("sites", lambda x: F.struct(x.nth.alias("nth"), x.vid.alias("v1"), _side(x.pos, x.ref, x.alt).alias("s1"), x.v2.alias("v2"), _side(x.pos2, x.ref2, x.alt2).alias("s2")))
        seen = _met(once, places, name).select("chrom", F.inline(F.filter(both, lambda x: x.s1.isNotNull() & x.s2.isNotNull()))).withColumn("n", F.lit(1).cast("long"))
    t = touches(more, places, name).distinct()
    after = t.select("read", "chrom", (F.col("nth") - 1).alias("nth"), F.col("side").alias("s2"))
    again = t.withColumnsRenamed({"vid": "v1", "side": "s1"}).join(after, ["read", "chrom", "nth"])
    names = ["chrom", "nth", "v1", "s1", "v2", "s2"]
    each = seen.select(*names, "n").unionByName(again.select(*names, F.lit(1).cast("long").alias("n")))
    return each.groupBy(names).agg(F.sum("n").cast("int").alias("n"))


def named_touches(reads: DataFrame, places: DataFrame, name: str = "contig") -> DataFrame:
    """read, qname, vid, side of reads (id, qname, pos0, seq): ``touches`` joined with the names by id; an id of one row has its name at hand."""
    once, more = by_id(reads.select("id", "qname", name, "pos0", "seq"))
    again = touches(more, places, name).join(more.select(F.col("id").alias("read"), "qname"), "read")
    names = ["read", "qname", "vid", "side"]
    return touches(once, places, name, ("qname",)).select(names).unionByName(again.select(names))


def majority(reads: DataFrame, threshold: int = 20, multiplier: int = 2, name: str = "contig") -> DataFrame:
    """id, i, base, best for bases that a dominant base outvotes, at positions where some base is of low quality.

    Bases above the threshold vote; the winner must have at least
    ``multiplier`` times the votes of every other base, and a vote at all.
    Votes are summed before the shuffle; bases meet the winners by position.
    """
    best = winners(reads, threshold, multiplier, name)
    if (sent := _sent(best, name)) is None:
        each = reads.select(name, "id", F.posexplode(F.split("seq", "")).alias("i", "base"), "pos0").filter(F.col("base") != "").withColumn("pos", F.col("pos0") + F.col("i"))
        return each.join(best, [name, "pos"]).filter(F.col("base") != F.col("best")).select("id", "i", "base", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                raw, row, i, at, new = _outvoted(batch, sent.value)
                letters = [pa.array(x.view("S1").astype(str).tolist(), pa.string()) for x in (raw[at], new)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(i, pa.int32()), *letters], ["id", "i", "base", "best"])

    kind = reads.schema["id"].dataType.simpleString()
    return reads.select("id", F.col(name).cast("string").alias("name"), F.col("pos0").cast("long").alias("pos0"), "seq").mapInArrow(run, f"id {kind}, i int, base string, best string")


def winners(reads: DataFrame, threshold: int = 20, multiplier: int = 2, name: str = "contig") -> DataFrame:
    """name, pos, best: the base that outvotes others, where some base is of low quality. Votes are counted within each batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                (raw, off), (qual, qoff) = packed.buffers(batch.column(2)), packed.buffers(batch.column(3))
                code = batch.column(0).dictionary_encode()
                there = ~np.asarray(code.is_null()) & ~np.asarray(batch.column(1).is_null())
                row, i, at = _bases(off, there)
                key = np.asarray(code.indices.fill_null(0)).astype(np.int64)[row] << 40 | (np.asarray(batch.column(1).fill_null(0))[row] + i + _SHIFT)
                q = np.where(i < np.diff(qoff)[row], qual[np.minimum(qoff[row] + i, max(len(qual) - 1, 0))].astype(int) if len(qual) else 0, 0) - 33
                kind = np.where(q > threshold, _LETTER[raw[at]], 4)
                kind[~np.asarray(batch.column(3).is_valid())[row]] = 5
                places, of = np.unique(key, return_inverse=True)
                n = np.bincount(of * 6 + kind, minlength=6 * len(places)).reshape(-1, 6)
                names = code.dictionary.take(pa.array(places >> 40))
                yield pa.RecordBatch.from_arrays([names, pa.array((places & (1 << 40) - 1) - _SHIFT), *(pa.array(n[:, j]) for j in range(5))], [name, "pos", *"ACGT", "low"])

    kind = reads.schema[name].dataType.simpleString()
    votes = reads.select(name, F.col("pos0").cast("long").alias("pos0"), "seq", "qual").mapInArrow(run, f"{name} {kind}, pos long, A long, C long, G long, T long, low long")
    votes = votes.groupBy(name, "pos").agg(*[F.sum(c).alias(c) for c in (*"ACGT", "low")])
    sorted_votes = F.sort_array(F.array(*"ACGT"), False)
    most = sorted_votes[0]
    best = F.when(F.col("A") == most, "A").when(F.col("C") == most, "C").when(F.col("G") == most, "G").otherwise("T")
    return staged(votes.filter((F.col("low") > 0) & (most > 0) & (sorted_votes[1] * multiplier <= most)).select(name, "pos", best.alias("best")), "winners")


#: Positions with a winner that are sent to every worker; more are met by a join. What makes positions before 0 sort.
MOST_SENT, _SHIFT = 1 << 21, 1 << 39
_LETTER = np.full(256, 5)
_LETTER[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def _bases(off: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, i and byte of every base of the rows that are ``there``."""
    n = np.where(there, np.diff(off), 0)
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    return row, i, off[row] + i


def _sent(best: DataFrame, name: str):
    """Winners as a broadcast of names, sorted places and their bases, or nothing if there are too many."""
    if best.limit(MOST_SENT + 1).count() > MOST_SENT:
        return None
    t = best.select(F.col(name).cast("string").alias("name"), "pos", "best").toArrow().combine_chunks()
    names = {x: j for j, x in enumerate(sorted(set(t["name"].to_pylist())))}
    place = np.array([names[x] for x in t["name"].to_pylist()], np.int64) << 40 | (t["pos"].to_numpy().astype(np.int64) + _SHIFT)
    order = np.argsort(place)
    return best.sparkSession.sparkContext.broadcast((names, place[order], np.frombuffer("".join(t["best"].to_pylist()).encode(), np.uint8)[order]))


def _outvoted(batch: pa.RecordBatch, known: tuple) -> tuple:
    """Bytes of all reads (second to fourth column: name, pos0, seq), and row, i, byte and better base of each outvoted one."""
    names, places, best = known
    raw, off = packed.buffers(batch.column(3))
    code = np.array([names.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
    row, i, at = _bases(off, (code >= 0) & np.asarray(batch.column(2).is_valid()))
    if not len(places):
        row, i, at = row[:0], i[:0], at[:0]
        return raw, row, i, at, best[:0]
    key = code[row] << 40 | (np.asarray(batch.column(2).fill_null(0))[row] + i + _SHIFT)
    j = np.minimum(np.searchsorted(places, key), len(places) - 1)
    hit = np.flatnonzero((places[j] == key) & (best[j] != raw[at]))
    return raw, row[hit], i[hit], at[hit], best[j[hit]]


def repaired(reads: DataFrame, changes: DataFrame) -> DataFrame:
    """Reads with the changes of ``majority`` made."""
    by = changes.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "best"))).alias("fix"))
    fixed = F.array_join(F.transform(F.split("seq", ""), lambda b, i: F.coalesce(F.element_at("fix", i), b)), "")
    return reads.join(by, "id", "left").withColumn("seq", F.when(F.col("fix").isNull(), F.col("seq")).otherwise(fixed)).drop("fix")


def majority_repaired(reads: DataFrame, threshold: int = 20, multiplier: int = 2, name: str = "contig") -> DataFrame:
    """id, seq: reads with the changes of ``majority`` made, each in its own row; ids tell reads apart only where winners are too many to be sent."""
    best = winners(reads, threshold, multiplier, name)
    if (sent := _sent(best, name)) is None:
        return repaired(reads, majority(reads, threshold, multiplier, name)).select("id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                raw, _, _, at, new = _outvoted(batch, sent.value)
                off = packed.buffers(batch.column(3))[1]
                raw = raw[off[0] : off[-1]].copy()
                raw[at - off[0]] = new
                text = pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer((off - off[0]).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(batch.column(3).is_null(), pa.scalar(None, pa.string()), text)], ["id", "seq"])

    kind = reads.schema["id"].dataType.simpleString()
    return reads.select("id", F.col(name).cast("string").alias("name"), F.col("pos0").cast("long").alias("pos0"), "seq").mapInArrow(run, f"id {kind}, seq string")


def between_edges(variants: DataFrame, edges: DataFrame) -> DataFrame:
    """Variants with the edges whose range holds them: chrom equal, start <= pos < end.

    The range join is made an equi-join on blocks of 1,024 positions, one row
    for each block that an edge touches.
    """
    block = 1024
    e = edges.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    v = variants.withColumn("b", F.floor(F.col("pos") / block))
    return v.join(e, ["chrom", "b"]).filter((F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end"))).drop("b")


def differences(a: Column, b: Column) -> Column:
    """Array of (pos from 0, a, b) where two sequences of one length differ."""
    every = F.sequence(F.lit(1), F.length(a))
    rows = F.transform(every, lambda i: F.struct((i - 1).alias("pos"), F.substr(a, i, F.lit(1)).alias("a"), F.substr(b, i, F.lit(1)).alias("b")))
    return F.filter(rows, lambda x: x.a != x.b)


def read_edges(variants: DataFrame) -> DataFrame:
    """Overlaps of read lists between each variant and the next one of its chromosome: rr, ra, ar, aa."""
    w = Window.partitionBy("chrom").orderBy("pos", "ref", "alt")
    nxt = variants.withColumns({"pos2": F.lead("pos").over(w), "alt2": F.lead("alt").over(w), "r2": F.lead("ref_reads").over(w), "a2": F.lead("alt_reads").over(w)}).filter("pos2 is not null")
    size = lambda x, y: F.size(F.array_intersect(x, y))
    return nxt.select("chrom", "pos", "alt", "pos2", "alt2", size("ref_reads", "r2").alias("rr"), size("ref_reads", "a2").alias("ra"), size("alt_reads", "r2").alias("ar"), size("alt_reads", "a2").alias("aa"))


def site_edges(reads: DataFrame, places: DataFrame, name: str = "contig") -> DataFrame:
    """``read_edges`` of ``sites``, by looking at the reads."""
    n = shared(reads, places.withColumn("vid", F.col("nth")), name).groupBy("chrom", "nth").agg(*[F.coalesce(F.sum(F.when((F.col("s1") == i) & (F.col("s2") == j), F.col("n"))), F.lit(0)).cast("int").alias(a + b) for i, a in enumerate("ra") for j, b in enumerate("ra")])
    w = Window.partitionBy("chrom").orderBy("nth")
    nxt = places.withColumns({"pos2": F.lead("pos").over(w), "alt2": F.lead("alt").over(w)}).filter("pos2 is not null")
    return nxt.join(n, ["chrom", "nth"], "left").select("chrom", "pos", "alt", "pos2", "alt2", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rr", "ra", "ar", "aa")])


def haplotypes(calls: DataFrame, ref: DataFrame) -> DataFrame:
    """chrom, first, second: the reference (chrom, seq) with the alternates of phased calls (gt) put in, a sequence for each side of the genotypes.

    Calls of a side must not overlap. A chromosome is one value here.
    """
    at = F.struct(F.col("pos").alias("pos"), F.length("ref").alias("n"), F.col("alt").alias("alt"))
    on = lambda i: F.array_sort(F.collect_list(F.when(F.split("gt", r"[|/]")[i] == "1", at)))
    both = calls.groupBy("chrom").agg(on(0).alias("a"), on(1).alias("b"))
    none = F.array().cast("array<struct<pos:bigint,n:int,alt:string>>")

    def put(c: str) -> Column:
        start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("text"))
        step = lambda acc, v: F.struct((v.pos + v.n).cast("bigint").alias("at"), F.concat(acc["text"], F.substr("seq", acc["at"].cast("int"), (v.pos - acc["at"]).cast("int")), v.alt).alias("text"))
        return F.aggregate(F.coalesce(F.col(c), none), start, step, lambda acc: F.concat(acc["text"], F.substr("seq", acc["at"].cast("int"))))

    return ref.join(both, "chrom", "left").select("chrom", put("a").alias("first"), put("b").alias("second"))
