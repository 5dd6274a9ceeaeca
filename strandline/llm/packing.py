"""Best-fit packing planned on a histogram of lengths.

1. Each document is tokenised; token ids, then an end id, are cut into pieces
   of at most the sequence's length. A piece gets its rank among the pieces of
   its length in its partition, while the pieces are written.
2. The histogram of lengths (at most one row for each possible length) comes
   to the driver, which packs counts, not pieces: lengths from the largest
   down, each into the open sequences with the least room that fits, as many
   in one step as there are equal sequences. The plan says, for each length,
   which ranks go to which sequences and where.
3. Pieces learn their rank among all of their length from the partitions'
   counts, and look their place up in the plan.

The plan has an entry for each pair of a length and a class of equal
sequences that it filled; classes are told apart by their room, so it has at
most the square of the sequence's length, and in practice a few thousand.

Defined results: a null or empty text is one piece, the end id; repeated rows
are separate documents; only documents longer than a sequence are cut; an
empty table gives no rows; only doc_id and text are looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.lean import give_back, lean
from strandline.session import staged

LENGTH, END_ID = 2048, 0
#: Words whose ids a task remembers; more are tokenised again when they come back.
REMEMBERED = 600_000
#: Bytes of text tokenised at a time; a longer text is so by itself. Its words are a list meanwhile, ten times as large.
TEXT_BYTES = 1 << 20
_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def _kinds() -> np.ndarray:
    """For each byte: 1 ASCII letter or digit, 2 ASCII punctuation but the apostrophe, 0 anything else."""
    kinds = np.zeros(256, np.uint8)
    for i in range(33, 127):
        kinds[i] = 1 if chr(i).isalnum() else 2
    kinds[ord("'")] = 0
    return kinds


_KINDS = _kinds()


def loosened(text: bytes) -> bytes:
    """Lower-case A-Z, and put a blank between a letter or digit and the punctuation after it.

    The tokenizer lower-cases anyway, never joins letters or digits with
    punctuation, and drops blanks, so ids stay the same; the chunks between
    blanks become fewer. Letters are ASCII's and those of U+00C0 to U+00FF.
    """
    a = np.frombuffer(text.lower(), np.uint8)
    if len(a) < 2:
        return text
    kind = _KINDS[a]
    after = kind[:-1] == 1
    after[1:] |= (a[:-2] == 0xC3) & (a[1:-1] >= 0x80) & (a[1:-1] != 0x97) & (a[1:-1] != 0xB7)
    at = np.flatnonzero(after & (kind[1:] == 2)) + 1
    old = np.ones(len(a) + len(at), bool)
    old[at + np.arange(len(at))] = False
    out = np.full(len(old), 32, np.uint8)
    out[old] = a
    return out.tobytes()


#: Chunks that the tokenizer's pre-tokenizer surely leaves whole: letters, or punctuation, or one digit.
_WHOLE = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+|[0-9]")


class Ids:
    """Token ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    A tokenizer that lower-cases, turns every run of white space into a blank,
    which its pre-tokenizer removes, and marks the ends of words gives a text
    the ids of its chunks between blanks; each chunk is tokenised once while it
    is remembered. New chunks that are one word to the tokenizer are tokenised
    together, and told apart by the mark that the vocabulary has at the end of
    words; all others, and those that may hold a special token, are tokenised
    alone. Any other tokenizer gets whole texts.
    """

    MAY_BE_SPECIAL, TOGETHER, WORD_END = b"<|", 4096, "</w>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.by_chunks = self._splits_at_blanks()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}

    def _splits_at_blanks(self) -> bool:
        """Whether the tokenizer's own description says all that the chunks rely on."""
        form, before = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") != self.WORD_END or form is None or before is None:
            return False
        words = [w for w, _ in before.pre_tokenize_str(form.normalize_str("Ab \t\n cD e9"))]
        return form.normalize_str("Ab \t\n cD") == "ab cd" and words[:2] == ["ab", "cd"] and not any(" " in w for w in words)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, chunks: list[bytes]) -> None:
        ids = self._ids(b" ".join(chunks).decode("utf-8"))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(chunks):  # another vocabulary than expected
            for c in chunks:
                self.known[c] = self._ids(c.decode("utf-8")).tobytes()
            return
        raw, at = ids.tobytes(), (4 * ends).tolist()
        for c, a, b in zip(chunks, [0, *at], at):
            self.known[c] = raw[a:b]

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.by_chunks:
            for e in self.tokenizer.encode_batch([t.decode("utf-8") for t in texts], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()
            return
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        chunks = [(t if self.MAY_BE_SPECIAL in t else loosened(t)).split() for t in texts]
        new = set(filterfalse(known.__contains__, chain.from_iterable(chunks)))
        whole = [c for c in new if _WHOLE.fullmatch(c) and self.MAY_BE_SPECIAL not in c]
        for i in range(0, len(whole), self.TOGETHER):
            self._learn(whole[i : i + self.TOGETHER])
        for c in filterfalse(known.__contains__, new):
            known[c] = self._ids(c.decode("utf-8")).tobytes()
        for cs in chunks:
            yield b"".join([known[c] for c in cs])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where one of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


_KEPT: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One tokenizer and memory for all tasks of a Python worker."""
    if path not in _KEPT:
        _KEPT[path] = Ids(path)
    return _KEPT[path]


def _pieces(path: str, length: int, end_id: int, with_ids: bool):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part = ids_of(path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            at, n = 0, len(doc_ids)
            while at < n:
                texts, size, first = [], 0, at
                while at < n and size < TEXT_BYTES:
                    texts.append((batch.column(1)[at].as_py() or "").encode("utf-8"))
                    size += len(texts[-1])
                    at += 1
                cols: list[list] = [[] for _ in range(8)]
                for doc_id, own in zip(doc_ids[first:at], ids.of(texts)):
                    own += tail
                    for k, a in enumerate(range(0, len(own), 4 * length)):
                        piece = own[a : a + 4 * length]
                        m = len(piece) // 4
                        for col, v in zip(cols, (doc_id, k, a // 4, m, zlib.crc32(piece), part, int(seen[m]), piece if with_ids else None)):
                            col.append(v)
                        seen[m] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                w = 8 if with_ids else 7
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols[:w], types)], names[:w])
            give_back()

    return lean(run)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, part, nth (rank of its length in its part), and ids if asked."""
    rows = docs.select("doc_id", "text").mapInArrow(_pieces(path, length, end_id, with_ids), _PIECE + (", ids binary" if with_ids else ""))
    return staged(rows, "pieces")


def best_fit(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Entries (length, first rank, number, first sequence, number per sequence, offset).

    Ranks from the first go to ``number`` places: ``per`` to a sequence, next
    to each other from ``offset``, in consecutive sequences. Best fit
    decreasing: a sequence is filled with a length while it has room for it,
    since its room is then the least that fits.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, number)
    plan, opened = [], 0
    for size in sorted((s for s, c in histogram.items() if c), reverse=True):
        left, rank = histogram[size], 0
        while left:
            fit = min((r for r in room if r >= size), default=None)
            if fit is None:
                per = length // size
                runs, fit, number = None, length, max(1, left // per)
                first = opened
                opened += number
            else:
                runs, per = room[fit], fit // size
                first, number = runs.pop()
                if not runs:
                    del room[fit]
            use = min(number, left // per)
            if use:
                placed = use * per
            else:  # fewer are left than one sequence holds
                use, per, placed = 1, left, left
            plan.append((size, rank, placed, first, per, length - fit))
            if fit - per * size:
                room.setdefault(fit - per * size, []).append((first, use))
            if number > use:
                room.setdefault(fit, []).append((first + use, number - use))
            rank, left = rank + placed, left - placed
    return plan


_PLACED = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long"


def _placed(plan: list[tuple]):
    """Look ranks up in the plan."""
    arr = np.array(plan, np.int64).reshape(-1, 6)
    arr = arr[np.lexsort((arr[:, 1], arr[:, 0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, begins = np.unique(arr[:, 0], return_index=True)
        ends = np.append(begins[1:], len(arr))
        for batch in batches:
            size, rank = batch.column(3).to_numpy().astype(np.int64), batch.column(5).to_numpy()
            entry = np.zeros(len(size), np.int64)
            group = np.searchsorted(lengths, size)
            for g in np.unique(group):
                own = group == g
                entry[own] = begins[g] + np.searchsorted(arr[begins[g] : ends[g], 1], rank[own], "right") - 1
            e = arr[entry]
            nth = rank - e[:, 1]
            cols = [*batch.columns[:5], pa.array(e[:, 3] + nth // e[:, 4]), pa.array(e[:, 5] + nth % e[:, 4] * size)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for the rows of ``pieces``."""
    counts = staged(parts.groupBy("part", "length").agg(F.count("*").alias("c")), "piece-counts")
    histogram = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # a row for each length at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    ranked = parts.join(counts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(best_fit(histogram, length)), _PLACED)
