"""Appending to logs that exist: new entries are chained to the tails, and published by whoever is first.

A log store is a folder of written lines, the tails of all its logs, and a numbered
manifest that names both. An append reads the last version, writes its lines and the new
tails aside, and publishes the next number: of two that started from the same version one
wins, and the other chains its entries anew to the tails that the winner left.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain
from ..sources.versions import Conflict, latest, publish

LINES = "log string, pos long, seq long, hash_prev string, self_hash string, raw string"
TAILS = "log string, seq long, hash string"
MANIFEST = "folders array<string>, tails string, entries long"
ATTEMPTS = 5


@dataclass
class Logs:
    """A version of a log store."""

    version: int
    folders: list[str]
    lines: DataFrame
    tails: DataFrame
    entries: int


def read(spark: SparkSession, root: str) -> Logs:
    """The last version under ``root``; version 0 without lines where there is none."""
    n, rows = latest(spark, root, "manifest", MANIFEST)
    if not n:
        return Logs(0, [], spark.createDataFrame([], LINES), spark.createDataFrame([], TAILS), 0)
    folders, tails, entries = rows[0]
    return Logs(n, list(folders), spark.read.schema(LINES).parquet(*folders), spark.read.schema(TAILS).parquet(tails), entries)


@dataclass
class Staged:
    """Lines that are written and chained to a version's tails, and not yet published."""

    base: Logs
    folder: str
    tails: str
    entries: int


def stage(entries: DataFrame, root: str, base: Logs) -> Staged:
    """Entries (log, pos, type, intent_id, principal, ts, payload) as lines after the tails of ``base``."""
    spark, name = entries.sparkSession, uuid.uuid4().hex
    folder, tails = f"{root}/lines-{name}", f"{root}/tails-{name}"
    chain.written(entries, base.tails).write.parquet(folder)
    new = spark.read.schema(LINES).parquet(folder)
    ends = new.groupBy("log").agg(F.max("seq").alias("seq"), F.max_by("self_hash", "seq").alias("hash"))
    base.tails.unionByName(ends).groupBy("log").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash")).write.parquet(tails)
    return Staged(base, folder, tails, new.count())


def commit(spark: SparkSession, root: str, staged: Staged) -> Logs:
    """Publish staged lines as the version after their base; ``Conflict`` if another was first."""
    base = staged.base
    row = ([*base.folders, staged.folder], staged.tails, base.entries + staged.entries)
    publish(spark.createDataFrame([row], MANIFEST), root, "manifest", base.version + 1)
    return read(spark, root)


def append(entries: DataFrame, root: str) -> Logs:
    """Chain entries to the logs under ``root``; after a conflict they are chained to the tails as they are then."""
    spark = entries.sparkSession
    for attempt in range(ATTEMPTS):
        staged = stage(entries, root, read(spark, root))
        try:
            return commit(spark, root, staged)
        except Conflict:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError
