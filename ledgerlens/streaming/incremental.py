"""Topic state kept up to date by a stream: each micro-batch is summed and merged with the last snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import log
from ..sources.storage import scratch_path

STATE = "slug string, n_writes long, last_seq long, tags array<string>"


def summed(entries: DataFrame) -> DataFrame:
    """(slug, n_writes, last_seq, tags): sums, maxima and sets, which merge."""
    w = entries.where(F.col("type") == "write_event")
    return w.groupBy("slug").agg(F.count("*").alias("n_writes"), F.max("seq").alias("last_seq"), F.array_sort(F.collect_set("tag")).alias("tags"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return (
        a.unionByName(b)
        .groupBy("slug")
        .agg(F.sum("n_writes").alias("n_writes"), F.max("last_seq").alias("last_seq"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    )


def _snapshots(spark: SparkSession, root: str) -> dict[int, object]:
    """Whole snapshots under ``root`` by batch number."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("snapshot-")]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return {int(p.getName().split("-")[1]): p for p in found if fs.exists(done(p, "_SUCCESS"))}


def run(spark: SparkSession, events_path: str, files_per_batch: int = 1, root: str | None = None) -> DataFrame:
    """Stream the event files that were not read before and return the latest snapshot.

    Snapshots and the stream's progress lie under ``root``, in the shared folder: a later run with the
    same root goes on where the last one stopped. A batch that is run again after a failure starts
    from the snapshot of the batch before it, so it counts once; older snapshots are deleted.
    """
    root = root or scratch_path(spark, "topic-stream")
    schema = spark.read.parquet(events_path).schema
    at = lambda n: f"{root}/snapshot-{n}"

    def merge(batch: DataFrame, n: int) -> None:
        session, new = batch.sparkSession, summed(log(batch))
        held = _snapshots(session, root)
        before = max((k for k in held if k < n), default=None)
        if before is not None:
            new = merged(new, session.read.schema(STATE).parquet(at(before)))
        new.write.mode("overwrite").parquet(at(n))
        for k, path in held.items():
            if k < n - 1:
                path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    query = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(events_path)
        .writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    held = _snapshots(spark, root)
    if not held:
        return summed(log(spark.createDataFrame([], schema)))
    return spark.read.schema(STATE).parquet(at(max(held)))
