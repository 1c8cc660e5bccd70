"""Numbered versions under a folder of the shared store: written aside, then published by a small table that comes last.

A reader takes the highest whole version and so never sees half of one. Of two writers
that publish the same number one fails, as the folder is there already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession

from .storage import scratch_path


class Conflict(RuntimeError):
    """Another writer published this version first."""


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def numbers(spark: SparkSession, root: str, name: str) -> list[int]:
    """Whole versions, the latest first."""
    fs, p = hadoop(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = sorted((int(n.rsplit("-", 1)[1]) for n in names if n.rsplit("-", 1)[0] == name and n.rsplit("-", 1)[1].isdigit()), reverse=True)
    return [n for n in found if whole(spark, f"{root}/{name}-{n}")]


def latest(spark: SparkSession, root: str, name: str, schema: str) -> tuple[int, list[Row]]:
    """The number of the last version and its rows, which are few; (0, []) for none."""
    n = next(iter(numbers(spark, root, name)), 0)
    return n, spark.read.schema(schema).parquet(f"{root}/{name}-{n}").collect() if n else []


def publish(rows: DataFrame, root: str, name: str, n: int) -> None:
    """Version ``n`` appears at once, whole, or not at all: its table is written aside and moved into place.

    The move claims a marker that only one writer can make.
    """
    spark, aside = rows.sparkSession, scratch_path(rows.sparkSession, "version")
    rows.coalesce(1).write.parquet(aside)
    fs, claim = hadoop(spark, f"{root}/_{name}-{n}.claim")
    fs.mkdirs(claim.getParent())
    if not fs.createNewFile(claim):
        raise Conflict(f"{name} {n} was published by another writer")
    if not fs.rename(hadoop(spark, aside)[1], hadoop(spark, f"{root}/{name}-{n}")[1]):
        raise OSError(f"{name} {n} could not be moved into place")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)
