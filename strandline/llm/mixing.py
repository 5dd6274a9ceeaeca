"""Mixing sources to target weights by hash-random order and exact cuts.

Every document gets a random-looking key (the MD5 of its doc_id). Within each
source, blocks of that key are ranges of it; block totals, summed up per
source, give each block the words before it, and a window inside each block
adds the rest. So the order within a source is a distributed range sort, and
no window spans more than one block of one source, even if one source holds
most documents. The budget of a source is cut exactly on that line: all of
its words as often as the budget holds them whole (epochs), and then the first
words up to the rest, which may end inside a document.

Targets: sources by code point, null last, have weights that repeat from a
list; they share a given multiple of all words by weight; no target exceeds a
given multiple of its source's words, and what is above is shared again among
the others by weight until none is above. That level is found at once: sources
in the order of cap over weight are capped as long as the level stays above.

Whole documents. ``mixture`` keeps all columns and cuts no document. Since
each source is taken in the order of its keys up to some document, the cut is
one key for each source; documents compare their own key with it where they
are, so texts are not shuffled.

Defined results: a null text has size 0; null sources are one source, the
last; documents of size 0 take nothing; a null doc_id counts by its text; ties
of the key (a doc_id that repeats) are broken by size and a hash of the text,
and are interchangeable beyond that; an empty table gives no rows; only doc_id,
text and source are looked at, and other columns, of whatever name, stay as
they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.picking import whole as whole_row
from strandline.session import staged

WEIGHTS, SHARE, MOST_EPOCHS, SALT = (3, 1, 2), 1.5, 2, "mix-1:"
#: Blocks of the key that the largest source has at least, for each partition of a shuffle.
BLOCKS = 4
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column, salt: str = SALT) -> Column:
    return F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, rows, weight, target from rows of source, source_size, rows: one for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth + 1).cast("int")))
    cap = most * F.col("source_size").cast("double")
    by_cap = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = w.withColumns(
        {
            "cap": cap,
            "capped_before": F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_from": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
            "budget": F.lit(share) * F.sum("source_size").over(everything).cast("double"),
        }
    )
    # The level if all before are capped; the first source that stays below its cap at its level sets the level.
    w = w.withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_from"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(fits, F.struct("capped_before", "level"))).over(everything)["level"]
    return w.withColumn("found", level).select(
        "source", "source_size", "rows", "weight", F.coalesce(F.least("cap", F.col("found") * F.col("weight")), F.col("cap")).alias("target")
    )


def _placed(docs: DataFrame, weights, share: float, most: int, rows_per_block: int | None) -> DataFrame:
    """doc_id, source, size, key, text_hash, source_size, target, epochs, start (words of its source before a row) and rest (words taken after the whole epochs)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("key"), text_hash(F.col("text")).alias("text_hash"))
    rows = staged(rows, "mix-rows")
    sources = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, share, most), "mix-targets")
    # A block has a bounded share of all rows, so no window is overfull when one source has most documents.
    per_block = F.lit(rows_per_block) if rows_per_block else F.sum("rows").over(Window.partitionBy()) / F.lit(BLOCKS * parts)
    hexits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("rows") / per_block)))
    sources = sources.withColumn("hexits", hexits.cast("int")).withColumnRenamed("source", "src")
    # Spark broadcasts the sources if their table is small, and joins by key otherwise.
    rows = rows.join(sources, rows.source.eqNullSafe(sources.src)).drop("src").withColumn("block", F.substr("key", F.lit(1), F.col("hexits")))
    totals = rows.groupBy("source", "block").agg(F.sum("size").alias("b"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("src"), F.col("block").alias("blk"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("before"))
    rows = rows.join(totals, rows.source.eqNullSafe(totals.src) & (rows.block == totals.blk))
    inside = Window.partitionBy("source", "block").orderBy("key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(inside)
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    return rows.withColumns({"start": upto - F.col("size"), "epochs": epochs}).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))


#: A document is taken once more, as a whole, if the rest reaches its middle; so whoever is taken comes before whoever isn't.
_REACHED = "2 * start + size <= 2 * rest"


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, whole: bool = False, rows_per_block: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, and a hash of the text, for each row of doc_id, text and source.

    With ``whole``, documents aren't cut: each is taken as many times as the
    cuts reach its middle, and ``taken`` is that number of times its size.
    """
    rows = _placed(docs, weights, share, most, rows_per_block)
    if whole:
        taken = (F.col("epochs") + F.when(F.expr(_REACHED), 1).otherwise(0)) * F.col("size")
    else:
        taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start")))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_hash")


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, rows_per_block: int | None = None) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns; documents aren't cut."""
    placed = _placed(docs, weights, share, most, rows_per_block)
    last = F.max(F.when(F.expr(_REACHED) & (F.col("size") > 0), F.struct("key", "size", "text_hash")))
    cuts = placed.groupBy("source").agg(F.first("epochs").alias("epochs"), last.alias("last")).withColumnRenamed("source", "src")
    cuts = staged(cuts, "mix-cuts")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.filter(text.rlike(WORD)).select(whole_row(docs), "source", key_of(F.col("doc_id"), F.col("text")).alias("key"), text.alias("t"))
    met = rows.join(cuts, rows.source.eqNullSafe(cuts.src))
    # Size and hash are needed where keys tie with the cut only.
    tie = F.struct(word_count(F.col("t")).alias("size"), text_hash(F.col("t")).alias("text_hash")) <= F.struct("last.size", "last.text_hash")
    once_more = F.coalesce((F.col("key") < F.col("last.key")) | ((F.col("key") == F.col("last.key")) & tie), F.lit(False))
    times = (F.col("epochs") + once_more.cast("int")).cast("int")
    return met.select("row", times.alias("times")).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
