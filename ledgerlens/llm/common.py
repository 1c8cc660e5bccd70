"""Helpers shared by the operators: shared-folder tables, Arrow batches, words."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every operator here sees it: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: The six characters of SPACE, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local master, whose executors live in the driver's process, gets a
    temporary folder where the setting is absent.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


#: A key with more than one in so many rows is hot: there are fewer of them than this.
HOT_SHARE = 1000


def joined(rows: DataFrame, keyed: DataFrame, by: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key in ``by`` and in ``n`` how many rows have it.

    Keys of over a thousandth of all ``total`` rows are under a thousand, whatever the table: they are
    broadcast and their rows stay where they are; the other rows are shuffled, and no key has many of
    them. Both sides are read twice: give written tables.
    """
    hot = F.broadcast(keyed.where(F.col(n) > total / HOT_SHARE))
    cold = keyed.where(F.col(n) <= total / HOT_SHARE)
    columns = [*rows.columns, *[c for c in keyed.columns if c not in by]]
    return rows.join(hot, by).select(columns).unionByName(rows.join(hot.select(by), by, "left_anti").join(cold, by).select(columns))


#: Keys that are broadcast at most: 8 MB.
BROADCAST_KEYS = 1_000_000


def chosen(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The ``rows`` whose ``key`` is among ``keys``, a written column of longs, or with ``left_anti`` is not.

    Keys that are counted and few are broadcast, so that texts stay where they are; more are joined by a shuffle.
    """
    keys = keys.select(key)
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, how)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches, after which the worker gives memory that it no longer needs back to the system.

    Workers outlive tasks, and several share an executor's memory: what allocators keep would add up.
    """

    def work(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return work


def small_batches(spark: SparkSession, rows: int = 1024, size: str = "4m") -> None:
    """Whole texts travel in Arrow batches of so many rows and bytes at most (or of one row)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once for a row.

    A lambda that refers to a long expression recomputes it for each element;
    bound as a lambda variable it is a plain reference.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; an empty one for a text without words."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def chunks_of(texts: list[str], limit: int = 1 << 21):
    """Index ranges of consecutive texts with at most ``limit`` characters together (or one text)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
