"""Line dedup over range-partitioned line hashes, answered by keep bitmaps.

1. Each row's lines give rows (hash of the key, doc_id, positions), for keys
   of at least the asked length; a key's repeats in one text are one row. No
   text travels.
2. A range exchange on (hash, doc_id descending) sorts these rows; a hash in
   very many documents spans several partitions, so none is overfull. The
   sorted rows are written down.
3. Each partition reports only its first and last hash, with counts and
   largest doc_id. From these few rows the driver tells every partition what
   the others hold of the hashes on its borders.
4. Each partition streams its rows: the first of a hash is the largest
   document, which keeps its lines; the rest lose theirs if the hash is in
   enough documents. The answer is compressed positions, gathered by document
   into one bitmap. Texts that lose nothing stay where they are; only those
   of documents that lose lines are picked out (``picking``: a bounded filter
   before the exchange) and meet their bitmaps.

A line's key is the line stripped of blanks and 09-0D at both ends, A-Z
lower-cased.

Defined results: null and empty texts are one empty line; rows of one doc_id
are one document, so they count once towards the documents that hold a line,
whatever their texts, and all keep a line if that doc_id is its largest; null
doc_ids are one document, the smallest; an empty table gives no rows; columns
besides doc_id and text are not looked at. Keys are compared by a 128-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.picking import marked, marks, unmarked
from strandline.llm.scratch import pinned
from strandline.session import staged

MIN_CHARS, MIN_DOCS = 40, 5
_KEY = "h1 long, h2 long, doc_id long, th long, places binary"
_FLUSH = 20_000


def text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]

        def flushed():
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["h1", "h2", "doc_id", "th", "places"])

        for batch in batches:
            for doc_id, text, th in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = (text.as_py() or "").encode("utf-8")
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(raw.split(b"\n")):
                    key = line.strip().lower()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8")) >= min_chars):
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                for h, at in found.items():
                    for col, v in zip(out, (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), doc_id, th, np.array(at, "<u4").tobytes())):
                        col.append(v)
                if len(out[0]) >= _FLUSH:
                    yield flushed()
                    out = [[], [], [], [], []]
        if out[0]:
            yield flushed()

    return run


class _Runs:
    """Runs of equal hashes in sorted batches: first rows, sizes, and how many documents each has."""

    def __init__(self, batch: pa.RecordBatch):
        self.h1, self.h2 = (batch.column(i).to_numpy() for i in (0, 1))
        ids = batch.column(2)
        self.none, self.num = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
        new = np.ones(len(self.h1), bool)
        new[1:] = (self.h1[1:] != self.h1[:-1]) | (self.h2[1:] != self.h2[:-1])
        other = new.copy()
        other[1:] |= (self.num[1:] != self.num[:-1]) | (self.none[1:] != self.none[:-1])
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(self.starts, append=len(self.h1))
        self.docs = np.add.reduceat(other.astype(np.int64), self.starts) if len(self.h1) else np.zeros(0, np.int64)

    def doc(self, i: int) -> int | None:
        return None if self.none[i] else int(self.num[i])


_EDGE = "part int, h1 long, h2 long, n long, largest long, smallest long"
_EDGE_TYPES = pa.schema([("part", pa.int32()), *[(c, pa.int64()) for c in ("h1", "h2", "n", "largest", "smallest")]])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part, its first and last hash: documents, and the first and last row's doc_id."""
    part = first = last = None

    def told():
        rows = [first] + ([last] if last is not first else [])
        return pa.RecordBatch.from_pylist([{"part": part, **dict(zip(_EDGE_TYPES.names[1:], r))} for r in rows], _EDGE_TYPES)

    for batch in batches:
        parts = batch.column(5).to_numpy()
        for p in dict.fromkeys(parts.tolist()):
            own = np.flatnonzero(parts == p)
            runs = _Runs(batch.slice(int(own[0]), len(own)))
            if p != part:
                if part is not None:
                    yield told()
                part, first, last = p, None, None
            for i in dict.fromkeys((0, len(runs.starts) - 1)):
                a = int(runs.starts[i])
                one = [int(runs.h1[a]), int(runs.h2[a]), int(runs.docs[i]), runs.doc(a), runs.doc(a + int(runs.sizes[i]) - 1)]
                if last is not None and last[:2] == one[:2]:
                    last[2] += one[2] - (last[4] == one[3])  # a document that goes on counts once
                    last[4] = one[4]
                else:
                    last = one
                    first = first or one
    if part is not None:
        yield told()


_DROP = "doc_id long, th long, places binary"


def _drops(min_docs: int, borders: dict):
    """Stream the sorted rows; ``borders`` has (documents, largest doc_id) of each hash on a border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the rows of the run that the last batch ended in
        for batch in batches:
            if kept is not None:
                batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            runs = _Runs(batch)
            end = int(runs.starts[-1])
            if (int(runs.h1[end]), int(runs.h2[end])) in borders:  # decided without its other rows, so a long run is never held
                end, kept = len(runs.h1), None
            else:
                kept = batch.slice(end)
            if end:
                yield from _answered(batch.slice(0, end), min_docs, borders)
        if kept is not None:
            yield from _answered(kept, min_docs, borders)

    return run


def _answered(rows: pa.RecordBatch, min_docs: int, borders: dict) -> Iterator[pa.RecordBatch]:
    """Drops among rows that hold whole runs, or parts of runs that ``borders`` has."""
    runs = _Runs(rows)
    lose = np.repeat(runs.docs >= min_docs, runs.sizes)
    none, num = runs.none, runs.num
    top, top_none = np.repeat(num[runs.starts], runs.sizes), np.repeat(none[runs.starts], runs.sizes)
    for s, n in zip(runs.starts, runs.sizes):
        if (b := borders.get((int(runs.h1[s]), int(runs.h2[s])))) is not None:
            lose[s : s + n] = b[0] >= min_docs
            top[s : s + n], top_none[s : s + n] = (0, True) if b[1] is None else (b[1], False)
    lose &= (num != top) | (none != top_none)
    if lose.any():
        yield pa.RecordBatch.from_arrays([rows.column(i).filter(pa.array(lose)) for i in (2, 3, 4)], ["doc_id", "th", "places"])


def _bitmap(lists: list[bytes], n: int) -> bytes:
    keep = np.ones(-(-n // 8) * 8, np.uint8)
    for x in lists:
        keep[np.frombuffer(x, "<u4")] = 0
    return zlib.compress(np.packbits(keep).tobytes())


_KEEP = "doc_id long, th long, keep binary"


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for lists in batch.column(2).to_pylist():
            most = max(int(np.frombuffer(x, "<u4").max()) for x in lists)
            maps.append(_bitmap(lists, most + 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["doc_id", "th", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, th, keep for each document that loses lines.

    ``th`` is a hash of the text, which tells rows with one doc_id apart;
    ``keep`` is a zlib-compressed bitmap of the lines that stay, up to the
    last one lost; lines after that stay.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last()]
    keys = docs.select("doc_id", "text", text_hash(F.col("text")).alias("th")).mapInArrow(_keys(min_chars), _KEY)
    # The exchange samples its input, so that input is written first: texts are read once.
    keys = staged(keys, "line-keys").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    keys = pinned(keys)  # both passes below see the same partitions
    found: dict[tuple, list] = {}
    for e in sorted(keys.mapInArrow(_edges, _EDGE).collect(), key=lambda e: e.part):  # two rows for each part at most
        if (b := found.get((e.h1, e.h2))) is None:
            found[e.h1, e.h2] = [e.n, e.largest, e.smallest]
        else:
            b[0] += e.n - (e.largest == b[2])
            b[2] = e.smallest
    drops = keys.mapInArrow(_drops(min_docs, {k: (v[0], v[1]) for k, v in found.items()}), _DROP)
    return drops.groupBy("doc_id", "th").agg(F.collect_list("places").alias("lists")).mapInArrow(_bitmaps, _KEEP)


_KEPT = "doc_id long, n_lines long, n_dropped long, text string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], []]
        for text, keep in zip(batch.column(1), batch.column(2)):
            raw = text.as_py() or ""
            n, dropped = raw.count("\n") + 1, 0
            if (keep := keep.as_py()) is not None:
                stay = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n].astype(bool)
                lines = raw.split("\n")
                lost = np.flatnonzero(~stay)
                dropped, lost = len(lost), set(lost.tolist())
                raw = "\n".join([x for i, x in enumerate(lines) if i not in lost])
            for col, v in zip(cols, (n, dropped, raw)):
                col.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def without_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what stays) for each row of doc_id and text."""
    keep = staged(keep_bitmaps(docs, min_chars, min_docs), "line-keeps")
    rows, key = docs.select("doc_id", "text"), [F.col("doc_id"), text_hash(F.col("text"))]
    bitmap = marks(keep.select("doc_id", "th"))
    losing = marked(rows, key, bitmap).select("doc_id", "text", key[1].alias("th"))
    keep = keep.withColumnsRenamed({"doc_id": "kid", "th": "kth"})
    # Texts aren't sorted: the bitmaps of a partition are its hash table.
    met = losing.join(keep.hint("shuffle_hash"), losing.doc_id.eqNullSafe(keep.kid) & (losing.th == keep.kth), "left").select("doc_id", "text", "keep")
    return met.mapInArrow(_applied, _KEPT).unionByName(unmarked(rows, key, bitmap).withColumn("keep", F.lit(None).cast("binary")).mapInArrow(_applied, _KEPT))
