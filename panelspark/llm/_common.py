"""What the operators of this subpackage share: scratch tables, words, digests and worker set-up."""

from __future__ import annotations

import ctypes
import gc
import os
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.sources import scratch

#: White space of the word and line contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when the session was started without it on their path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def scratch_path(spark: SparkSession, what: str) -> str:
    return scratch.scratch_path(spark, what)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that lost executors cost no upstream work. The table goes with
    the open scratch scope or with the process, if it isn't discarded before."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


#: Where materialised tables lie.
_PATHS: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in tables:
        held, path = _PATHS.pop(id(df), (None, None))
        if held is not None and held() is df:
            scratch.delete(df.sparkSession, path)
            scratch.forget(path)


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str) -> tuple:
    p = hadoop_path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str, what: str, total: str | None = None) -> DataFrame:
    """rows with their place from 0 on in the order of their group, and the group's number of rows as `total`.

    Rows are dealt over tasks by ranges of (group, order), written, and counted by group and task; the counts (a row for
    each task and for each group) give what comes before. Null is a group of its own. Rows with all keys equal are
    numbered freely among themselves. A group of any size is spread over tasks.
    """
    spark = rows.sparkSession
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order]
    dealt = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    dealt = materialise(dealt, what)
    task = F.shiftright("_row", 33)
    counts = materialise(dealt.groupBy(*group, task.alias("_task")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")), f"{what}-counts")
    own = Window.partitionBy(*[F.col(c) for c in group])
    offset = (F.sum("_n").over(own.orderBy("_task")) - F.col("_n") - F.col("_first")).alias("_offset")
    offsets = counts.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.col("_task"), offset, F.sum("_n").over(own).alias("_total"))
    same = F.lit(True)
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    joined = dealt.join(offsets, same & (task == F.col("_task")))
    return joined.select(*rows.columns, (F.col("_row") + F.col("_offset")).alias(name), *([F.col("_total").alias(total)] if total else []))


def key128(*columns: Column | str) -> Column:
    """Two seeds of xxhash64 over the columns, as 32 hex digits: a key for groups within one run."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0") for seed in (1, 2)])


def sha256(text: Column) -> Column:
    """SHA-256 of a text as binary(32): a key that lasting tables can rely on."""
    return F.unhex(F.sha2(text, 256))


def runs_of(batches, *keys: str):
    """Tables of the rows of one key each, from batches sorted by it; null is a key of its own. Keys are integers."""
    held: list[pa.RecordBatch] = []
    of = lambda b, k: tuple(b.column(c)[k].as_py() for c in keys)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n - 1, bool)
        for c in keys:
            x = batch.column(c)
            for v in (x.fill_null(0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False)):
                new |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and of(held[-1], 0) != of(batch, a):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


_HOLDER: list = [None, None]


def take_turn(owner: str, forget) -> None:
    """Called where a worker begins a task that remembers words: what another operator remembers there is let go, so
    that one worker process holds the memory of one operator at a time."""
    if _HOLDER[0] != owner:
        if _HOLDER[1] is not None:
            _HOLDER[1]()
            _give_back()
        _HOLDER[:] = [owner, forget]


def _give_back() -> None:
    """Return freed memory to the system, which a reused worker process would keep otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
