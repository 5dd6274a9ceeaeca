"""Quality scores from gradient-boosted trees over histograms of document statistics.

Statistics are numpy over the bytes of many whole texts at once. Trees are
trained on the driver from a bounded sample of labelled rows (``sample``),
feature values binned by quantiles, each node's split found on histograms of
gradients; they are kept as flat arrays of complete trees, through which all
rows of a batch go together, level by level. Every document is scored.

Labels are learned only from rows whose CRC-32 of the doc_id, as text, leaves
no remainder of 1 modulo 3. Only the text enters a score.

Defined results: a null text counts as empty and gets a score like any other;
a null doc_id counts as empty text in the remainder and is not learned from;
rows that repeat are scored alike; of several texts under one doc_id the one
of the smallest statistics is learned from; labels that repeat a doc_id count
by their largest value; without labels, or with labels of one kind only, every score is
their smoothed share; an empty table gives no rows; columns besides doc_id and
text are not looked at.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.lean import lean
from strandline.llm.words import SLICE_BYTES, buffers, distinct_in_text, shingle_hashes, slices, words_of

SAMPLE, TREES, DEPTH, BINS, RATE, L2, LEAST = 12_000, 120, 4, 64, 0.1, 1.0, 5.0
FOLDS, HELD_OUT = 3, 1

#: Classes of bytes; every byte is in one.
_CLASSES = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": [32, 9, 11, 12, 13], "line": [10], "stop": b".", "comma": b",;:", "shout": b"!?", "bar": b"|", "mark": b"#$%&*@^~=+_", "bracket": b"<>{}[]()/\\", "quote": b"'\"`-", "high": range(128, 256)}
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _i
_N = len(_CLASSES) + 1

FEATURES = ["bytes", "words", "word_bytes", *(f"share_{c}" for c in _CLASSES), "share_other", "upper_of_letters", "line_bytes", "distinct_words", "distinct_pairs", "distinct_fives", "repeats_next", "short_words", "long_words", "top_word", "entropy"]


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _class_counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each class each text has."""
    n, lo, hi = len(off) - 1, int(off[0]), int(off[-1])
    if n == 1:
        return sum((np.bincount(_CLASS[raw[a : min(hi, a + SLICE_BYTES)]], minlength=_N) for a in range(lo, hi, SLICE_BYTES)), np.zeros(_N, np.int64)).reshape(1, _N).astype(float)
    text = np.repeat(np.arange(n), np.diff(off))
    return np.bincount(text * _N + _CLASS[raw[lo:hi]], minlength=n * _N).reshape(n, _N).astype(float)


def _kinds_and_most(words: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different words each text has, and how often its most frequent one occurs."""
    n, most = len(per), np.zeros(len(per))
    if n == 1:
        times = np.unique(words, return_counts=True)[1]
        return np.array([float(len(times))]), np.array([float(times.max(initial=0))])
    owner = np.repeat(np.arange(n), per)
    order = np.lexsort((words, owner))
    w, o = words[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    np.maximum.at(most, o[at], np.diff(at, append=len(w)))
    return np.bincount(o[at], minlength=n).astype(float), most


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a buffer."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    counts = _class_counts(raw, off)
    words, length, per = words_of(raw, off)
    m = per.astype(float)
    owner = np.repeat(np.arange(n, dtype=np.int32), per)
    each = lambda flags: np.array([flags.sum()], float) if n == 1 else np.bincount(owner, weights=flags, minlength=n)
    kinds, top = _kinds_and_most(words, per)
    shares = []
    for k in (2, 5):
        runs, r = shingle_hashes(words, per, k)
        _, d = distinct_in_text(runs, r)
        shares.append(_ratio(d.astype(float), r.astype(float)))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    p = counts / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    names = list(_CLASSES)
    letters = counts[:, names.index("lower")] + counts[:, names.index("upper")]
    return np.column_stack(
        [np.log1p(size), np.log1p(m), _ratio(each(length), m), *p.T, _ratio(counts[:, names.index("upper")], letters), _ratio(size, counts[:, names.index("line")] + 1), _ratio(kinds, m), *shares, _ratio(each(same), m), _ratio(each(length <= 2), m), _ratio(each(length >= 16), m), _ratio(top, m), entropy]
    )


@dataclasses.dataclass
class Trees:
    """Complete trees of one depth: node i's children are 2i+1 (value <= threshold) and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(int(np.log2(self.leaf.shape[1])) if len(self.feature) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        if len(self.feature):
            total += self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def trained(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost ``trees`` trees on the logistic loss."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    f = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    nodes, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((trees, nodes), int), np.full((trees, nodes), np.inf), np.zeros((trees, leaves))
    place = binned + np.arange(f) * bins
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(y), int)  # node within its level
        for level in range(depth):
            width = 2**level
            slot = (at[:, None] * (f * bins) + place).ravel()
            g, h = (np.bincount(slot, np.repeat(v, f), width * f * bins).reshape(width, f, bins).cumsum(2) for v in (grad, hess))
            gl, hl, ga, ha = g[:, :, :-1], h[:, :, :-1], g[:, :, -1:], h[:, :, -1:]
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain[(hl < LEAST / 4) | (ha - hl < LEAST / 4)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for node in range(width):
                j, b = divmod(int(best[node]), bins - 1)
                if gain[node, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, width - 1 + node], threshold[t, width - 1 + node] = j, cuts[j][b]
            mine = width - 1 + at
            at = 2 * at + (x[np.arange(len(y)), feature[t, mine]] > threshold[t, mine])
        g, h = np.bincount(at, grad, leaves), np.bincount(at, hess, leaves)
        leaf[t] = rate * g / (h + L2)
        margin += leaf[t, at]
    return Trees(base, feature, threshold, leaf)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = buffers(batch.column(1))
        for a, b in slices(off):
            x = statistics(raw, off[a : b + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])


def _scored(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            for a, b in slices(off):
                score = model.scores(statistics(raw, off[a : b + 1]))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != 1), pa.array(score)], [*(n for i, n in enumerate(batch.schema.names) if i != 1), "score"])

    return run


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for labels of doc_id and quality. At most ``sample`` labelled rows, drawn by a hash of doc_id, come to the driver."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")  # ``sample`` rows at most
    facts = rows.mapInArrow(_statistics, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x")).toArrow()
    quality = known.toArrow()
    y_of = dict(zip(quality.column("doc_id").to_pylist(), quality.column("quality").to_pylist()))
    ids = np.array(facts.column("doc_id").to_pylist(), np.int64)
    order = np.argsort(ids, kind="stable")
    x = np.array(facts.column("x").combine_chunks().flatten().to_numpy(), float).reshape(len(ids), len(FEATURES))[order]
    return trained(x, np.array([float(y_of[i] > 0) for i in ids[order].tolist()]))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of doc_id and text."""
    rows = docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id long, score double")
    return rows.select("doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _accepted(model: Trees, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(text_at))
            good = [model.scores(statistics(raw, off[a : b + 1])) >= 0.5 for a, b in slices(off)]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return run


def accepted(docs: DataFrame, model: Trees) -> DataFrame:
    """The documents, with all their columns, that are predicted to be good. Nothing is shuffled."""
    return docs.mapInArrow(lean(_accepted(model, docs.columns.index("text"))), docs.schema)
