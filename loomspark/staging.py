"""Tables that an operator writes on its way: they cut lineage, fix what isn't repeatable and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes an action's shuffle files once it has ended, rather than when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths staged within each open scratch(), innermost last.
_SCRATCH: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomspark-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read again: lineage is cut and later readers prune columns.

    `keep`: an open scratch() leaves the table alone.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append((spark, path))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path in any store that Spark knows; one that is gone is none to delete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark knows; none if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(p)) if files.exists(p) else []


def unstage(*frames: DataFrame | None) -> None:
    """Deletes what staged() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: plans, broadcasts and shuffles of finished jobs go, and the heap can shrink. For jobs of
    very many plans, whose driver would else grow to its limit before it collects."""
    spark._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[None]:
    """What is staged within goes at the end, but for tables to keep: for a step whose result is itself written by then."""
    made: list[tuple[SparkSession, str]] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for spark, path in made:
            remove(spark, path)
        if made:
            release(made[0][0])
