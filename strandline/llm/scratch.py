"""Frozen partitions for operators that pass over them more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandline.session import scratch_root


def pinned(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: the same rows in the same order and partitions each time."""
    root = scratch_root(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return df.checkpoint()
