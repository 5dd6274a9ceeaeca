"""Structured Streaming: overlapping event windows, and read filtering and coverage on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import reads as R


def event_windows(events: DataFrame, width: str = "2000 seconds", step: str = "1500 seconds", late: str | None = "1 hour") -> DataFrame:
    """start, event_type, n, total of overlapping windows, on a table or a stream with a watermark."""
    if events.isStreaming and late:
        events = events.withWatermark("ts", late)
    by = events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def good_read_counts(reads: DataFrame, min_mapq: int = R.MIN_MAPQ) -> DataFrame:
    """contig, reads, bases of good reads; runs on a table and on a stream alike."""
    return R.good_reads(reads, min_mapq).groupBy("contig").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over what is there now, and give its table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
