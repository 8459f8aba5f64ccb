"""Session helpers shared by all operators: table access, shared scratch space, skew-aware sizing."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: set[tuple[int, str]] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local one is set only where none is configured (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has already ended: the folder's owner clears it
        pass


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, removed when the session's process ends."""
    path = f"{scratch_root(spark)}/{name}"
    if not _SCRATCH:
        atexit.register(lambda: [_remove(spark, p) for _, p in list(_SCRATCH)])
    _SCRATCH.add((os.getpid(), path))
    return path


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut lineage by writing df once to the shared folder and reading it back.

    Unlike checkpoint() this computes df a single time, and unlike localCheckpoint the copy outlives any executor.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession, least: int = 1) -> int:
    """Partitions to use where a repartition must be explicit."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a file scan the bytes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """True when df has at most most_rows rows; reads no more than most_rows + 1 of them."""
    return df.limit(most_rows + 1).count() <= most_rows


def maybe_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """broadcast(df) when its row count is checked to be small, else df for a shuffle join."""
    return F.broadcast(df) if small_enough(df, most_rows) else df
