"""Rows picked out, or left out, by key, without a shuffle of all the others.

The keys are marked in a bitmap of a fixed number of bits (a Bloom filter of
one hash), kept as a table of 64-bit words, so it has at most ``WORDS`` rows of
16 bytes however many keys there are. That table is broadcast; rows whose bit
isn't set cannot be among the keys and stay where they are. Only rows whose bit
is set are shuffled to meet the keys themselves, so the result is exact. With
more keys than bits the filter lets everything through, and what remains is a
plain join by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import staged

#: Bound of the broadcast: words of 64 bits.
WORDS = 1 << 19


def every(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def whole(df: DataFrame) -> Column:
    """A row's columns as one, so that columns added beside it can't clash with them."""
    return F.struct(*every(df)).alias("row")


def _place(key: list[Column], words: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(64 * words))


def marks(keys: DataFrame, words: int = WORDS) -> DataFrame:
    """word, bits: the bitmap of the keys (all columns together are the key; null is a value like any other)."""
    bits = keys.select(_place(every(keys), words).alias("p")).select(F.expr("shiftright(p, 6)").alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    return staged(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "marks")


def _looked_up(rows: DataFrame, key: list[Column], bitmap: DataFrame, words: int, how: str) -> DataFrame:
    """row, hit."""
    met = rows.select(whole(rows), _place(key, words).alias("place")).join(F.broadcast(bitmap), F.expr("shiftright(place, 6) = word"), how)
    return met.select("row", F.coalesce(F.expr("(shiftright(bits, cast(place & 63 as int)) & 1) = 1"), F.lit(False)).alias("hit"))


def marked(rows: DataFrame, key: list[Column], bitmap: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows that may have a marked key. Nothing is shuffled."""
    return _looked_up(rows, key, bitmap, words, "inner").filter("hit").select("row.*")


def unmarked(rows: DataFrame, key: list[Column], bitmap: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows that surely have none of the marked keys. Nothing is shuffled."""
    return _looked_up(rows, key, bitmap, words, "left").filter("not hit").select("row.*")


def met(rows: DataFrame, key: list[Column], keys: DataFrame, how: str) -> DataFrame:
    """The rows with (left_semi) or without (left_anti) a key among the keys, by a join whose hash table is the keys of a partition."""
    names = [f"key{i}" for i in range(len(key))]
    known = keys.toDF(*[f"own{i}" for i in range(len(key))]).distinct()
    same = F.expr(" and ".join(f"key{i} <=> own{i}" for i in range(len(key))))
    return rows.select(whole(rows), *[k.alias(n) for k, n in zip(key, names)]).join(known.hint("shuffle_hash"), same, how).select("row.*")


def picked(rows: DataFrame, key: list[Column], keys: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows whose key is among the keys."""
    return met(marked(rows, key, marks(keys, words), words), key, keys, "left_semi")


def without(rows: DataFrame, key: list[Column], keys: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows whose key isn't among the keys."""
    bitmap = marks(keys, words)
    return unmarked(rows, key, bitmap, words).unionByName(met(marked(rows, key, bitmap, words), key, keys, "left_anti"))
