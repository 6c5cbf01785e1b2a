"""Tables in the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes an execution's shuffle files at its end if this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _state = threading.Lock(), {"depth": 0, "before": "false"}


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tallyspan-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this process only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_folder()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{folder(spark)}/tallyspan-{name}-{uuid.uuid4().hex}"


@contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """The setting is a session's, so of writes that overlap the first one sets it and the last one restores it."""
    with _lock:
        if not _state["depth"]:
            _state["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _state["depth"] += 1
    try:
        yield
    finally:
        with _lock:
            _state["depth"] -= 1
            if not _state["depth"]:
                spark.conf.set(_CLEANUP, _state["before"])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The shuffle files of the write go at its end; nothing refers to them any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _cleaned_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
