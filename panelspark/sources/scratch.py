"""Scratch tables in the shared folder, and when they go."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Of the process, and of each open scope: sessions and paths of what was written.
_PROCESS: list[tuple[SparkSession, str]] = []
_SCOPE: ContextVar[list] = ContextVar("scratch", default=_PROCESS)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in a session of one machine that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder. What is written there goes with the scope that is open, or with the process."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _SCOPE.get().append((spark, path))
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(path: str) -> None:
    """The path was deleted already."""
    held = _SCOPE.get()
    held[:] = [x for x in held if x[1] != path]


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Tables that operators write to the shared folder inside the scope are deleted at its end: for sessions that live
    long. Results that still have to be computed from them must be written or collected before."""
    held: list[tuple[SparkSession, str]] = []
    token = _SCOPE.set(held)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        _clear(held)


def _clear(held: list[tuple[SparkSession, str]]) -> None:
    while held:
        spark, path = held.pop()
        delete(spark, path)


def _at_exit() -> None:
    """What no scope has deleted, while the session's process can still be asked; else the folder's owner clears it."""
    try:
        _clear(_PROCESS)
    except Exception:  # noqa: BLE001  the other process may have gone in any way
        _PROCESS.clear()


atexit.register(_at_exit)
