"""op5: shards of `documents`."""

from pyspark.sql import functions as F

from strandline.llm.registry import register
from strandline.llm.sharding import balanced_shards, measured
from strandline.session import table

SHARDS = 8


@register("op5_byte_shards")
def op5(spark, sf_dir):
    """No SQL: DuckDB has no CRC-32. The tests hold it against a brute-force version."""
    placed = balanced_shards(measured(table(spark, sf_dir, "documents")), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
