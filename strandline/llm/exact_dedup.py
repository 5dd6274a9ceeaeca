"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. Each partition of the documents takes the fingerprints (48 bits) of its
   normalised texts, sorts them, and writes for each owner one message: the
   differences of the distinct ones, Golomb-Rice coded, with a bitmap of those
   that it has more than once. With it, in the same order, it keeps what is to
   come back to: doc_ids, lengths and SHA-256 digests. However often a text
   occurs in a partition, its fingerprint is sent once.
2. The messages, not the texts, are shuffled to the owners of ranges of
   fingerprints. An owner decodes all its messages, and answers each with a
   bitmap of the fingerprints that occur more than once in all.
3. Documents marked in a bitmap are suspects. Only their texts are picked out
   (``picking``: a bounded filter by doc_id before the exchange, and a join by
   doc_id after it), normalised, shuffled and grouped byte by byte; equal texts
   within a task become one row before the shuffle, so a text with very many
   copies travels once for each task.

A document's text is normalised by deleting all blanks and 09-0D.

Defined results: null texts count as empty and are equal to each other; of
equal texts the one with most code points in its original stays, then the
smallest doc_id, null first; rows that repeat one doc_id with equal normalised
texts of one length get equal answers, rows of one doc_id with different texts
are judged by their own text each; an empty table gives no rows; columns
besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.picking import every, marked, marks, met, picked, unmarked, whole
from strandline.session import staged

FINGERPRINT_BITS = 48
BLANKS = b" \t\n\x0b\x0c\r"
#: Documents a task gathers for one round of messages; bounds its memory.
BLOCK_ROWS = 200_000
_TYPES = {"owner": pa.int32(), "block": pa.int64(), "n": pa.int32(), "rice": pa.int32(), "payload": pa.binary(), "often": pa.binary(), "sizes": pa.binary(), "doc_ids": pa.list_(pa.int64()), "chars": pa.binary(), "sha": pa.binary()}
#: n counts distinct fingerprints; sizes and chars hold unsigned numbers of 4 and 8 bytes.
_MESSAGE = "owner int, block long, n int, rice int, payload binary, often binary, sizes binary, doc_ids array<bigint>, chars binary, sha binary"


def _packed(values: np.ndarray, bits: int) -> bytes:
    if not bits or not len(values):
        return b""
    planes = (values[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel()).tobytes()


def golomb_coded(sorted_values: np.ndarray, rice: int) -> bytes:
    """Differences of ascending numbers: all low parts of ``rice`` bits, then all quotients in unary."""
    gaps = np.diff(sorted_values.astype(np.uint64), prepend=np.uint64(0))
    quotient = (gaps >> np.uint64(rice)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    return _packed(gaps & np.uint64((1 << rice) - 1), rice) + np.packbits(unary).tobytes()


def golomb_decoded(payload: bytes, n: int, rice: int) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    head = (n * rice + 7) // 8
    low = np.zeros(n, np.uint64)
    if rice and n:
        planes = np.unpackbits(raw[:head], count=n * rice).reshape(n, rice).astype(np.uint64)
        low = planes @ (np.uint64(1) << np.arange(rice - 1, -1, -1, dtype=np.uint64))
    ends = np.flatnonzero(np.unpackbits(raw[head:]))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(rice)) | low, dtype=np.uint64)


def _messages(owners: int):
    """Rows of _MESSAGE for batches of (doc_id, text)."""
    shift = np.uint64(FINGERPRINT_BITS)

    def flush(block, ids, marks, chars, shas):
        every = np.array(marks, np.uint64)
        order = np.argsort(every, kind="stable")
        fp, size = np.unique(every[order], return_counts=True)
        owner = ((fp * np.uint64(owners)) >> shift).astype(np.int64) if owners < 1 << 15 else (fp.astype(object) * owners >> FINGERPRINT_BITS).astype(np.int64)
        row = np.concatenate([[0], np.cumsum(size)])
        cols: dict[str, list] = {c: [] for c in _TYPES}
        bounds = np.flatnonzero(np.diff(owner, prepend=-1)).tolist() + [len(fp)]
        for a, b in zip(bounds, bounds[1:]):
            base = np.uint64(-(-(int(owner[a]) << FINGERPRINT_BITS) // owners))
            span = max(1, (1 << FINGERPRINT_BITS) // owners)
            rice = max(0, int(span * 0.7 / (b - a)).bit_length() - 1)
            part = order[row[a] : row[b]]
            made = (int(owner[a]), block, b - a, rice, golomb_coded(fp[a:b] - base, rice), np.packbits(size[a:b] > 1).tobytes(), size[a:b].astype("<u4").tobytes(), [ids[i] for i in part], np.array([chars[i] for i in part], "<i8").tobytes(), b"".join([shas[i] for i in part]))
            for c, v in zip(cols, made):
                cols[c].append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), _TYPES.values())], list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py() or ""
                norm = raw.encode("utf-8").translate(None, BLANKS)
                held[0].append(doc_id)
                held[1].append(xxhash.xxh3_64_intdigest(norm) >> (64 - FINGERPRINT_BITS))
                held[2].append(len(raw))
                held[3].append(hashlib.sha256(norm).digest())
            if len(held[0]) >= BLOCK_ROWS:
                yield flush(block, *held)
                block, held = block + 1, ([], [], [], [])
        if held[0]:
            yield flush(block, *held)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answer every message of an owner; messages of one owner are neighbours."""
    owner, held = None, []

    def answer():
        decoded = [golomb_decoded(p, n, r) for _, n, r, p, _ in held]
        values, at, counts = np.unique(np.concatenate(decoded), return_inverse=True, return_counts=True)
        often = counts > 1
        often[at.ravel()[np.concatenate([np.unpackbits(np.frombuffer(h[4], np.uint8), count=h[1]) for h in held]).astype(bool)]] = True
        flags = np.split(often[at.ravel()], np.cumsum([len(d) for d in decoded])[:-1])
        maps = [np.packbits(f).tobytes() for f in flags]
        return pa.RecordBatch.from_arrays([pa.array([owner] * len(held), pa.int32()), pa.array([h[0] for h in held], pa.int64()), pa.array(maps, pa.binary())], ["owner", "block", "bitmap"])

    for batch in batches:
        for i in range(batch.num_rows):
            to, *message = (batch.column(c)[i].as_py() for c in ("owner", "block", "n", "rice", "payload", "often"))
            if to != owner:
                if held:
                    yield answer()
                owner, held = to, []
            held.append(message)
    if held:
        yield answer()


_DOC = "doc_id long, sha binary, chars long, suspect boolean"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back from messages and bitmaps to one row for each document."""
    for batch in batches:
        for i in range(batch.num_rows):
            own = {c: batch.column(c)[i] for c in batch.schema.names}
            n, size = own["n"].as_py(), np.frombuffer(own["sizes"].as_py(), "<u4")
            flags = np.repeat(np.unpackbits(np.frombuffer(own["bitmap"].as_py(), np.uint8), count=n).astype(bool), size)
            sha = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(flags), [None, own["sha"].as_buffer()])
            yield pa.RecordBatch.from_arrays([own["doc_ids"].values, sha.cast(pa.binary()), pa.array(np.frombuffer(own["chars"].as_py(), "<i8")), pa.array(flags)], ["doc_id", "sha", "chars", "suspect"])


def normalised(text):
    """The text, as a column, without blanks and 09-0D; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS.decode(), "")


def _sha(text):
    return F.unhex(F.sha2(normalised(text), 256))


def _judged(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, sha, chars, keep_id, group_size, kept for each row of doc_id and text."""
    spark = docs.sparkSession
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    messages = staged(docs.mapInArrow(_messages(owners), _MESSAGE), "dedup-messages")
    sent = messages.select("owner", "block", "n", "rice", "payload", "often").repartition(owners, "owner").sortWithinPartitions("owner")
    back = sent.mapInArrow(_bitmaps, "owner int, block long, bitmap binary")
    rows = staged(messages.drop("payload", "often", "rice").join(back, ["owner", "block"]).mapInArrow(_documents, _DOC), "dedup-rows")
    suspects = rows.filter("suspect")
    texts = picked(docs, [F.col("doc_id")], suspects.select("doc_id"))
    best = F.struct((-F.char_length(F.coalesce("text", F.lit("")))).alias("c"), "doc_id")
    groups = texts.select(normalised(F.col("text")).alias("norm"), best.alias("best")).groupBy("norm").agg(F.min("best").alias("best"), F.count("*").alias("group_size"))
    groups = groups.select(F.unhex(F.sha2("norm", 256)).alias("gsha"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.c")).alias("most"), "group_size").filter("group_size > 1")
    alone = lambda d: d.select("doc_id", "sha", "chars", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    judged = suspects.join(groups, suspects.sha == groups.gsha, "left")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("most"))
    copies = judged.filter("gsha is not null").select("doc_id", "sha", "chars", "keep_id", "group_size", first.alias("kept"))
    # A fingerprint may be shared by different texts; these are alone after all.
    return alone(rows.filter("not suspect")).unionByName(alone(judged.filter("gsha is null"))).unionByName(copies)


def exact_groups(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of doc_id and text."""
    return _judged(docs, owners).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, less the exact copies of others; of rows that repeat a doc_id and a text, one stays.

    Rows are judged by doc_id, digest and length, so rows of one doc_id with
    different texts don't share a verdict. Most documents have no copy; their
    doc_ids are in no bitmap, and their texts are not shuffled.
    """
    judged = staged(_judged(docs).filter("group_size > 1").select("doc_id", "sha", "chars", "kept"), "dedup-judged")
    lost = judged.filter("not kept").select("doc_id", "sha", "chars").distinct()
    twice = judged.filter("kept").groupBy("doc_id", "sha", "chars").count().filter("count > 1").select("doc_id")
    bitmap = marks(lost.select("doc_id").unionByName(twice))
    key = [F.col("doc_id"), _sha(F.col("text")), F.char_length(F.coalesce("text", F.lit(""))).cast("long")]
    rest = met(marked(docs, key[:1], bitmap), key, lost, "left_anti")
    rest = rest.select(whole(rest), *[k.alias(f"key{i}") for i, k in enumerate(key)], F.xxhash64(*every(rest)).alias("tie"))
    first = Window.partitionBy("key0", "key1", "key2").orderBy("tie")
    rest = rest.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*")
    return unmarked(docs, key[:1], bitmap).unionByName(rest)
