"""Projections as files: one for each topic, made anew only where the log has something new, and published at once.

A version is a table of names with each file's hash and the folder that holds its text. An
update looks at the entries after the last version's head, makes the files of the topics
they name, and publishes their names over the old ones: a reader sees the last whole
version or the one before, never some files of each. Files whose hash didn't change keep
the folder they were written to.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projection import topic_files
from ..sources.versions import latest, publish

INDEX = "slug string, sha256 string, bytes long, folder string, since long"
TEXTS = "slug string, text string"
MANIFEST = "head long, index string, made long, changed long"


@dataclass
class Published:
    version: int
    head: int  # position of the last entry that the files know
    index: DataFrame
    made: int  # files made anew for this version
    changed: int  # of those, files that are other than before

    def texts(self) -> DataFrame:
        """(slug, text) of all files."""
        spark = self.index.sparkSession
        folders = [r.folder for r in self.index.select("folder").distinct().collect()]  # one for each version that still has files
        if not folders:
            return spark.createDataFrame([], TEXTS)
        held = spark.read.schema(TEXTS).parquet(*folders).select("slug", "text", F.regexp_extract("_metadata.file_path", r"/(texts-[0-9a-f]+)/", 1).alias("folder_name"))
        wanted = self.index.select("slug", F.regexp_extract(F.concat("folder", F.lit("/")), r"/(texts-[0-9a-f]+)/", 1).alias("folder_name"))
        return held.join(wanted, ["slug", "folder_name"]).select("slug", "text")


def load(spark: SparkSession, root: str) -> Published:
    """The last version; version 0, without files, where there is none."""
    n, rows = latest(spark, root, "manifest", MANIFEST)
    if not n:
        return Published(0, -1, spark.createDataFrame([], INDEX), 0, 0)
    head, index, made, changed = rows[0]
    return Published(n, head, spark.read.schema(INDEX).parquet(index), made, changed)


def update(log: DataFrame, root: str) -> Published:
    """Bring the files under ``root`` up to date with ``log`` (pos, slug, ..) and return them."""
    spark, before = log.sparkSession, load(log.sparkSession, root)
    number, name = before.version + 1, uuid.uuid4().hex
    new = log.where(F.col("pos") > before.head)
    touched = new.select("slug").distinct()
    head = new.agg(F.max("pos")).first()[0]
    folder, at = f"{root}/texts-{name}", f"{root}/index-{name}"
    made = topic_files(log.join(touched, "slug", "left_semi")).withColumn("sha256", F.sha2("text", 256))
    held = before.index.select("slug", F.col("sha256").alias("old"))
    staged = f"{root}/staged-{name}"
    made.join(held, "slug", "left").write.parquet(staged)
    rows = spark.read.parquet(staged)
    other = rows.where(F.col("old").isNull() | (F.col("old") != F.col("sha256")))
    other.select("slug", "text").write.parquet(folder)
    entries = other.select("slug", "sha256", F.octet_length("text").cast("long").alias("bytes"), F.lit(folder).alias("folder"), F.lit(number).cast("long").alias("since"))
    # files that were made again as they were stay where they are; topics that have no file any more go
    gone = touched.join(rows.select("slug"), "slug", "left_anti")
    kept = before.index.join(entries.select("slug"), "slug", "left_anti").join(gone, "slug", "left_anti")
    kept.unionByName(entries).write.parquet(at)
    row = (before.head if head is None else head, at, rows.count(), other.count())
    publish(spark.createDataFrame([row], MANIFEST), root, "manifest", number)
    return load(spark, root)


def exported(published: Published, path: str) -> None:
    """Write every file as plain text under ``path``: a folder for each topic, ``topic=<slug>``."""
    published.texts().select(F.col("slug").alias("topic"), F.regexp_replace("text", r"\n\z", "").alias("text")).write.partitionBy("topic").text(path)
