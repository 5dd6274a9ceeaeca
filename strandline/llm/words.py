"""Words and shingles of many texts at once, on the bytes of Arrow buffers.

A word is a run of bytes other than the blank and 09-0D; bytes of multi-byte
characters are never among those. Everything here is numpy over one buffer
that holds many texts. A text longer than a slice is worked off in pieces of
that size, with the word that a piece ends in carried on to the next, so only
eight bytes for each of its words are held, not several arrays over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text makes a slice of its own, and is worked off in pieces.
SLICE_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n+1 offsets into them; nulls are empty."""
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if offs is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words each text has. Offsets count from off[0]."""
    lo, hi = int(off[0]), int(off[-1])
    solid = np.empty(hi - lo + 2, np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~_BLANK[raw[lo:hi]]
    edge = np.diff(solid)
    cut = np.zeros(hi - lo + 1, bool)  # texts end words too
    cut[off - lo] = True
    inner = cut[1:-1] & (solid[1:-2] == 1) & (solid[2:-1] == 1)
    at = np.flatnonzero(inner) + 1
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(at):
        starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
    per = np.diff(np.searchsorted(starts, off - lo, "left"))
    return starts, ends, per


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the sum of its bytes' values times powers of the base, from its start on."""
    n = len(data)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=total[1:])
    inverse = np.full(n + 1, _BASE_INV, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    return (total[ends] - total[starts]) * inverse[starts]


def words_of(raw: np.ndarray, off: np.ndarray, lower: bool = True, piece: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash (A-Z lower-cased if asked) and the bytes of each word, and the number of words of each text."""
    lo, hi = int(off[0]), int(off[-1])
    if len(off) == 2 and hi - lo > piece:
        hashes, sizes = _words_of_long(raw[lo:hi], lower, piece)
        return hashes, sizes, np.array([len(hashes)])
    starts, ends, per = word_spans(raw, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), per
    data = raw[lo:hi]
    sizes = ends - starts
    return _mixed(_sums(_LOWER[data] if lower else data, starts, ends) + sizes.astype(np.uint64)), sizes, per


def _words_of_long(data: np.ndarray, lower: bool, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of one long text, piece by piece. A word's sum goes on in the next piece, times the base to the power of what it has."""
    hashes, lengths = [], []
    carried, size = np.zeros(1, np.uint64), 0

    def done(sums: np.ndarray, sizes: np.ndarray) -> None:
        hashes.append(_mixed(sums + sizes.astype(np.uint64)))
        lengths.append(sizes.astype(np.int32))

    for a in range(0, len(data), piece):
        part = data[a : a + piece]
        starts, ends, _ = word_spans(part, np.array([0, len(part)]))
        sums = _sums(_LOWER[part] if lower else part, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        sizes = ends - starts
        if size:
            if len(starts) and starts[0] == 0:
                sums[:1] = carried + sums[:1] * np.uint64(pow(int(_BASE), size, 1 << 64))
                sizes[0] += size
            else:
                done(carried, np.array([size]))
            size = 0
        if len(ends) and ends[-1] == len(part):
            carried, size = sums[-1:].copy(), int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        done(sums, sizes)
    if size:
        done(carried, np.array([size]))
    return np.concatenate(hashes), np.concatenate(lengths)


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and the number of words of each text."""
    hashes, _, per = words_of(raw, off, lower)
    return hashes, per


_PLACE = _mixed(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, per: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their number in each text.

    A text of fewer words, but at least one, has the whole sequence as its one run.
    """
    first = np.concatenate([[0], np.cumsum(per)])
    n = len(words)
    runs = np.where(per >= size, per - size + 1, (per > 0).astype(per.dtype))
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        full += words[k : k + len(full)] * _PLACE[k]
    full = _mixed(full + np.uint64(size))
    if len(per) == 1 and n >= size:
        return full, runs
    start = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(runs)])[:-1], runs) + np.arange(int(runs.sum()))
    out = np.zeros(len(start), np.uint64)
    short = np.repeat(per < size, runs)
    out[~short] = full[start[~short]] if len(full) else 0
    rows = np.flatnonzero((per < size) & (per > 0))
    if len(rows):
        vals = np.zeros(len(rows), np.uint64)
        for k in range(size - 1):
            has = per[rows] > k
            vals[has] += words[first[rows[has]] + k] * _PLACE[k]
        out[short] = _mixed(vals + per[rows].astype(np.uint64))
    return out, runs


def distinct_in_text(values: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted, and their number."""
    if len(per) == 1:
        v = np.unique(values)
        return v, np.array([len(v)])
    text = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return v[new], np.bincount(t[new], minlength=len(per))
