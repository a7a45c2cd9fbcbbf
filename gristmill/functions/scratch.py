"""Intermediate tables in storage that every executor can reach.

``cut`` ends a lineage by writing a Parquet table below ``spark.checkpoint.dir``; a lost executor
then costs a re-read, never a recomputation of everything before it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()  # folders of applications
_scopes: ContextVar[tuple[set[str], ...]] = ContextVar("scopes", default=())  # of this thread's open ``released`` blocks


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session. Local runs without one get a temporary folder; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='gristmill-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path; what is left below it goes when the driver's JVM ends, however the session stops."""
    own = f"{scratch_root(spark)}/gristmill-{spark.sparkContext.applicationId}"
    if own not in _made:
        where, fs = _file_system(spark, own)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _made.add(own)
    path = f"{own}/{label}-{uuid.uuid4().hex}"
    for scope in _scopes.get():
        scope.add(path)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)
    for scope in _scopes.get():
        scope.discard(path)


def drop(*frames: DataFrame) -> None:
    """Delete the tables behind frames made by ``cut`` once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            remove_path(df.sparkSession, path)


@contextmanager
def released() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end all tables that this thread made meanwhile but those passed to the function it gives."""
    made, kept = set(), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch_path)
        return df

    token = _scopes.set((*_scopes.get(), made))
    try:
        yield keep
    finally:
        _scopes.reset(token)
    for path in made - kept:
        remove_path(SparkSession.active(), path)
