"""Contiguous shards of near-equal bytes from global prefix sums.

Native: DataFrame functions only. A range exchange puts rows in the order of
doc_id and the other columns and numbers the partitions. Per-partition
totals, summed up over the few partitions, give each one the bytes and rows
before it; a window inside each partition adds the rest. No window over rows
spans more than one partition of the range exchange.

Defined results: a null text has size 1 and the checksum of the empty text;
null doc_ids come first; rows that repeat are separate rows, told apart by
nothing and so interchangeable; an empty table gives no rows. Columns that
the input has besides doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import staged

ROWS_PER_BLOCK = 500_000


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32. The text goes no further than the scan."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def balanced_shards(rows: DataFrame, shards: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add shard (0 to shards-1) and slot (gapless from 0) to rows that have doc_id and size.

    A row goes where the middle of its bytes falls on the line of all bytes,
    so each cut is within half a row of its target. Ties of doc_id are broken
    by the other columns.
    """
    spark = rows.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in rows.columns if c != "doc_id"]]
    rows = staged(rows, "shard-rows")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // rows_per_block)
    # Written down, so that block numbers hold even if a partition has to be made again.
    blocked = staged(rows.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()), "shard-blocks")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    everything = Window.partitionBy()
    totals = (
        blocked.groupBy("block").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
        .select("block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("rows0"), F.sum("b").over(everything).alias("all_bytes"))
    )
    inside = Window.partitionBy("block").orderBy(*order)
    placed = blocked.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(inside)})
    placed = placed.join(F.broadcast(totals), "block")  # as many rows as the exchange has partitions
    twice = 2 * (F.col("bytes0") + F.col("upto")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor((twice * F.lit(shards)) / (2 * F.col("all_bytes")))).cast("int")
    placed = staged(placed.select(*rows.columns, shard.alias("shard"), (F.col("rows0") + F.col("n") - 1).alias("place")), "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(*rows.columns, "shard", (F.col("place") - F.col("first")).alias("slot"))
