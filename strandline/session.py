"""Session and scratch-space helpers shared by the operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def local_session(app: str = "strandline", cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session may do
    without the setting; it then gets a temporary folder of this machine.
    """
    root = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_CHECKPOINT} must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="strandline-")
    spark.conf.set(_CHECKPOINT, root)
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Paths made since each open ``scratch`` began, the innermost last.
_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path below the shared folder. With ``keep`` it outlives the innermost ``scratch``."""
    path = f"{scratch_root(spark)}/strandline/{label}-{uuid.uuid4().hex[:12]}"
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what is staged inside, but for what is staged with ``keep``.

    A DataFrame is read when it is used, so use it up, or stage it with
    ``keep``, before the end. Without this, staged tables stay in the shared
    folder until whoever owns that folder removes them.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _OPEN.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows no longer depends on shuffle files or
    on the executors that made the rows, and rows that a non-deterministic
    layout numbered keep their numbers. ``keep``: see ``scratch``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label, keep)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
