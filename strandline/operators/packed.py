"""K-mers as numbers: one kernel over the bytes of many sequences.

A k-mer of A, C, G and T with k up to 31 is a number of two bits a base, most
significant first, so numbers sort as strings do. Numbers of all windows of a
batch are made together with numpy, and aggregated within the batch, so what
reaches the shuffle is a partial aggregate of longs. Windows with any other
letter keep their string. A long sequence is worked off in pieces, so memory
doesn't grow with it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Windows worked on at a time, and the longest k-mer that is a number.
PIECE, MOST_K = 1 << 20, 31

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n+1 offsets into them; nulls are empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if offs is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def windows(off: np.ndarray, k: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """row, i (window of the row), and the range of bytes, for pieces of all windows of all rows."""
    per = np.maximum(np.diff(off) - k + 1, 0)
    upto = np.concatenate([[0], np.cumsum(per)])
    for s in range(0, int(upto[-1]), piece):
        e = min(s + piece, int(upto[-1]))
        a, b = int(np.searchsorted(upto, s, "right")) - 1, int(np.searchsorted(upto, e, "left"))
        row = np.repeat(np.arange(a, b), np.minimum(upto[a + 1 : b + 1], e) - np.maximum(upto[a:b], s))
        i = np.arange(s, e) - upto[row]
        yield row, i, int(off[row[0]] + i[0]), int(off[row[-1]] + i[-1]) + k


def _within(flags: np.ndarray, k: int) -> np.ndarray:
    """How many flags are set in each window."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[k:] - total[:-k]


def _joined(codes: np.ndarray, k: int, left: bool) -> np.ndarray:
    """Numbers of all windows of k codes, from those of 1, 2, 4 and so on of them; ``left``: the first code is the most significant, else the last."""
    n = len(codes) - k + 1
    out, done, power, size = np.zeros(n, np.int64), 0, codes, 1
    while True:
        if k & size:
            part = power[done : done + n]
            out = (out << 2 * size) | part if left else out | (part << 2 * done)
            done += size
        if 2 * size > k:
            return out
        one, other = power[:-size], power[size:]
        power = (one << 2 * size) | other if left else one | (other << 2 * size)
        size *= 2


def forward(codes: np.ndarray, k: int) -> np.ndarray:
    return _joined(codes, k, True)


def backward(codes: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the reverse complements."""
    return _joined(3 - codes, k, False)


def _numbered(raw: np.ndarray, off: np.ndarray, k: int, both: bool):
    """row, i, numbers, and which windows are plain, for pieces of a batch; of both strands the smaller number."""
    for row, i, lo, hi in windows(off, k):
        at = off[row] + i - lo
        codes = _CODE[raw[lo:hi]].astype(np.int64)
        plain = (_within(codes > 3, k) == 0)[at]
        codes &= 3
        number = forward(codes, k)
        if both:
            number = np.minimum(number, backward(codes, k))
        yield row, i, number[at], plain, lo + at


def text(number: Column, k: int) -> Column:
    """The string of a number."""
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def number(kmer: Column) -> Column:
    """The number of a string; null if it has other letters."""
    return F.when(~kmer.rlike("[^ACGT]"), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint"))


def _table(cols: list[tuple[str, pa.DataType, list | np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in cols], [c for c, _, _ in cols])


def counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer, n of all k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(0))
            for _, _, value, plain, at in _numbered(raw, off, k, False):
                values, n = np.unique(value[plain], return_counts=True)
                other = Counter(raw[a : a + k].tobytes().decode("utf-8", "replace") for a in at[~plain].tolist())
                yield _table([("number", pa.int64(), [*values.tolist(), *[None] * len(other)]), ("other", pa.string(), [*[None] * len(values), *other]), ("n", pa.int64(), [*n.tolist(), *other.values()])])

    each = reads.select(seq).mapInArrow(run, "number long, other string, n long").groupBy("number", "other").agg(F.sum("n").alias("n"))
    return each.select(F.coalesce(text(F.col("number"), k), "other").alias("kmer"), "n")


def canonical_counts(reads: DataFrame, k: int, min_quality: int) -> DataFrame:
    """number, n, high: strand-neutral counts of plain k-mers; high counts those whose bases all have the quality. reads: seq, qual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(0))
            quals, qoff = buffers(batch.column(1))
            for row, i, value, plain, _ in _numbered(raw, off, k, True):
                lo, hi = int(qoff[row[0]] + i[0]), int(qoff[row[-1]] + i[-1]) + k
                low = np.concatenate([[0], np.cumsum(quals[lo:hi] < 33 + min_quality)])
                at = qoff[row] + i - lo
                good = low[np.minimum(at + k, len(low) - 1)] == low[np.minimum(at, len(low) - 1)]
                key, n = np.unique(value[plain] * 2 + good[plain], return_counts=True)
                yield _table([("number", pa.int64(), key >> 1), ("n", pa.int64(), n), ("high", pa.int64(), n * (key & 1))])

    return reads.select("seq", "qual").mapInArrow(run, "number long, n long, high long").groupBy("number").agg(F.sum("n").alias("n"), F.sum("high").alias("high"))


def canonical_numbers(reads: DataFrame, k: int) -> DataFrame:
    """number, n: ``canonical_counts`` of reads of seq alone, without looking at qualities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, value, plain, _ in _numbered(*buffers(batch.column(0)), k, True):
                key, n = np.unique(value[plain], return_counts=True)
                yield _table([("number", pa.int64(), key), ("n", pa.int64(), n)])

    return reads.select("seq").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))


def canonical_windows(reads: DataFrame, k: int, key: str) -> DataFrame:
    """key, i, number (null for windows with other letters) of every k-mer of each read, strand-neutral."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            for row, i, value, plain, _ in _numbered(raw, off, k, True):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(i, pa.int32()), pa.array(value, pa.int64(), mask=~plain)], [key, "i", "number"])

    kind = reads.schema[key].dataType.simpleString()
    return reads.select(key, "seq").mapInArrow(run, f"{key} {kind}, i int, number long")


#: Known k-mers that are sent to every worker as sorted numbers (32 MB); more are met by a join.
MOST_KNOWN = 1 << 22


def known_numbers(known: DataFrame) -> np.ndarray | None:
    """The sorted numbers of the k-mers of a table (kmer), or nothing if there are more than ``MOST_KNOWN``."""
    if known.limit(MOST_KNOWN + 1).count() > MOST_KNOWN:
        return None
    return np.sort(known.select(number(F.col("kmer")).alias("number")).filter("number is not null").toArrow().column(0).to_numpy())


def _flags(raw: np.ndarray, off: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a batch are known, row after row, and where each row's begin."""
    first = np.concatenate([[0], np.cumsum(np.maximum(np.diff(off) - k + 1, 0))])
    parts = [np.zeros(0, bool)]
    for _, _, value, plain, _ in _numbered(raw, off, k, True):
        at = np.searchsorted(known, value)
        parts.append(plain & (known[np.minimum(at, len(known) - 1)] == value) if len(known) else np.zeros(len(value), bool))
    return np.concatenate(parts), first


def longest_runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each row's first longest run of flags; length 0 without one. Row r has flags[first[r]:first[r + 1]]."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    begins = flags.copy()
    begins[1:] &= ~flags[:-1] | (row[1:] != row[:-1])
    at = np.flatnonzero(begins)
    size = np.bincount(np.cumsum(begins)[flags] - 1, minlength=len(at))
    order = np.lexsort((at, -size, row[at]))
    best = order[np.flatnonzero(np.diff(row[at][order], prepend=-1))]
    start, streak = np.zeros(n, np.int64), np.zeros(n, np.int64)
    start[row[at[best]]], streak[row[at[best]]] = at[best] - first[row[at[best]]], size[best]
    return start, streak


def with_streaks(reads: DataFrame, known: np.ndarray, k: int, seq: str = "seq") -> DataFrame:
    """Reads with start and streak, each read's first longest run of known k-mers; start is null and streak 0 without one, both are null without a k-mer. Nothing is shuffled."""
    sent = reads.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, first = _flags(*buffers(batch.column(batch.schema.get_field_index(seq))), k, sent.value)
            start, streak = longest_runs(flags, first)
            more = [pa.array(start, pa.int32(), mask=streak == 0), pa.array(streak, pa.int64(), mask=np.diff(first) == 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "start", "streak"])

    return reads.mapInArrow(run, T.StructType([*reads.schema, T.StructField("start", T.IntegerType()), T.StructField("streak", T.LongType())]))


def coverage(reads: DataFrame, known: np.ndarray, k: int, key: str) -> DataFrame:
    """key, pos, cover: how many known k-mers cover each base of each read (key, seq) of k bases or more. Nothing is shuffled; Python returns one row for each read."""
    sent = reads.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                flags, first = _flags(*buffers(batch.column(1)), k, sent.value)
                n = np.diff(first)
                bases = np.where(n > 0, n + k - 1, 0)
                base = np.concatenate([[0], np.cumsum(bases + 1)])  # a place more, where a read's last k-mer ends
                row = np.repeat(np.arange(len(n)), n)
                begin = base[row] + np.arange(len(flags)) - first[row]
                steps = np.bincount(begin[flags], minlength=base[-1] + 1) - np.bincount(begin[flags] + k, minlength=base[-1] + 1)
                upto = np.concatenate([[0], np.cumsum(bases)])
                of = np.repeat(np.arange(len(n)), bases)
                cover = np.cumsum(steps)[base[of] + np.arange(len(of)) - upto[of]]
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(cover, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "covers"])

    kind = reads.schema[key].dataType.simpleString()
    rows = reads.select(key, "seq").mapInArrow(run, f"{key} {kind}, covers array<int>")
    return rows.select(key, F.posexplode("covers").alias("pos", "cover"))


def met_once(reads: DataFrame, k: int) -> DataFrame:
    """Reads (with seq) and alone: whether a read meets none of its k-mers twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(batch.schema.get_field_index("seq")))
            alone = np.ones(batch.num_rows, bool)
            parts = [(row, value, plain) for row, _, value, plain, _ in _numbered(raw, off, k, False)]
            if parts:
                row, value, plain = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((value, row))
                r, v = row[order], value[order]
                alone[r[1:][(r[1:] == r[:-1]) & (v[1:] == v[:-1])]] = False
                for x in np.unique(row[~plain]).tolist():  # other letters have no number
                    seq = raw[off[x] : off[x + 1]].tobytes()
                    alone[x] = len({seq[i : i + k] for i in range(len(seq) - k + 1)}) == len(seq) - k + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone)], [*batch.schema.names, "alone"])

    return reads.mapInArrow(run, T.StructType([*reads.schema, T.StructField("alone", T.BooleanType())]))


def step_weights(reads: DataFrame, k: int, keys: list[str], good: int) -> DataFrame:
    """keys, src, dst, weight: 100 for each step of reads (keys, seq of A, C, G and T, qual) whose new base is good, summed within each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(len(keys)))
            quals, qoff = buffers(batch.column(len(keys) + 1))
            there = np.diff(qoff)
            group = np.zeros(batch.num_rows, np.int64)
            for c in range(len(keys)):
                own = batch.column(c).dictionary_encode(null_encoding="encode")
                group = group * len(own.dictionary) + own.indices.to_numpy()
                group = np.unique(group, return_inverse=True)[1].ravel()
            for row, i, value, _, _ in _numbered(raw, off, k + 1, False):
                at = np.minimum(qoff[row] + i + k, max(len(quals) - 1, 0))
                w = 100 * ((i + k < there[row]) & (quals[at] >= good + 33)) if len(quals) else np.zeros(len(row), np.int64)
                order = np.lexsort((value, group[row]))
                r, v, w = row[order], value[order], w[order]
                first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (group[r[1:]] != group[r[:-1]])]))
                chosen = batch.take(pa.array(r[first]))
                yield pa.RecordBatch.from_arrays([*(chosen.column(c) for c in range(len(keys))), pa.array(v[first]), pa.array(np.add.reduceat(w, first), pa.int64())], [*keys, "number", "weight"])

    kinds = ", ".join(f"{c} {reads.schema[c].dataType.simpleString()}" for c in keys)
    each = reads.select(*keys, "seq", "qual").mapInArrow(run, f"{kinds}, number long, weight long").groupBy(*keys, "number").agg(F.sum("weight").alias("weight"))
    step = text(F.col("number"), k + 1)
    return each.select(*keys, F.substr(step, F.lit(1), F.lit(k)).alias("src"), F.substr(step, F.lit(2)).alias("dst"), "weight")


def step_support(reads: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """keys, src, dst, n, last_pos: how many steps of reads (keys, seq) go from one k-mer to the next, and the greatest position of a step's new base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(len(keys)))
            group = np.zeros(batch.num_rows, np.int64)
            for c in range(len(keys)):
                own = batch.column(c).dictionary_encode(null_encoding="encode")
                group = group * len(own.dictionary) + own.indices.to_numpy()
                group = np.unique(group, return_inverse=True)[1].ravel()
            for row, i, value, plain, at in _numbered(raw, off, k + 1, False):
                parts = []
                if plain.any():
                    r, v, p = row[plain], value[plain], i[plain]
                    order = np.lexsort((v, group[r]))
                    r, v, p = r[order], v[order], p[order]
                    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (group[r[1:]] != group[r[:-1]])]))
                    parts.append((r[first], pa.array(v[first]), pa.nulls(len(first), pa.string()), np.diff(first, append=len(v)), np.maximum.reduceat(p, first)))
                if not plain.all():
                    found: dict[tuple, list[int]] = {}
                    for r, p, a in zip(row[~plain].tolist(), i[~plain].tolist(), at[~plain].tolist()):
                        entry = found.setdefault((int(group[r]), raw[a : a + k + 1].tobytes().decode("utf-8", "replace")), [r, 0, 0])
                        entry[1:] = [entry[1] + 1, max(entry[2], p)]
                    r, n, p = np.array(list(found.values())).T
                    parts.append((r, pa.nulls(len(r), pa.int64()), pa.array([x[1] for x in found], pa.string()), n, p))
                for r, numbers, others, n, p in parts:
                    chosen = batch.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([*(chosen.column(c) for c in range(len(keys))), numbers, others, pa.array(n, pa.int64()), pa.array(p + k, pa.int32())], [*keys, "number", "other", "n", "last_pos"])

    kinds = ", ".join(f"{c} {reads.schema[c].dataType.simpleString()}" for c in keys)
    each = reads.select(*keys, "seq").mapInArrow(run, f"{kinds}, number long, other string, n long, last_pos int")
    each = each.groupBy(*keys, "number", "other").agg(F.sum("n").alias("n"), F.max("last_pos").alias("last_pos"))
    step = each.withColumn("step", F.coalesce(text(F.col("number"), k + 1), "other"))
    return step.select(*keys, F.substr("step", F.lit(1), F.lit(k)).alias("src"), F.substr("step", F.lit(2)).alias("dst"), "n", "last_pos")
