"""Token ids in ORC: written in ascending document order, read back in parallel by stripe.

Ids are an ``array<int>`` column, which ORC stores as run-length encoded
integers. Row indexes and Bloom filters on ``doc_id`` let a reader skip stripes
and row groups. Each row also holds where it stands in its file, so offsets over
all documents need only the files' totals.

Null texts count as empty (the end id alone). Rows with equal ids, or none, lie
next to each other, ordered by a hash of their text, then by place; ranges are cut
between any two rows, so an id with very many rows fills as many files as it needs.
An empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import lean, small_batches, text_or_empty

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 0,
    doc_col="doc_id",
    text_col="text",
    stripe_bytes: int = 16 << 20,
    row_group: int = 1000,
) -> None:
    """Write every document of ``docs`` to ORC files under ``path``, ranges of doc_id in order."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<i4")

    def run(batches):
        from pyspark import TaskContext

        enc, part, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = enc.encode(batch.column(1))
            n = np.array([len(x) + 1 for x in ids], dtype=np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            flat = np.concatenate([x for own in ids for x in (own, end)]) if ids else end[:0]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(ids), part, dtype=np.int32)),
                    pa.array(start + ends[:-1]),
                    pa.array(n),
                    lists,
                ],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )
            start += int(ends[-1])

    (
        docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
        .withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
        .repartitionByRange("doc_id", "h", "place")
        .sortWithinPartitions("doc_id", "h", "place")
        .select("doc_id", "text")
        .mapInArrow(lean(run), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(row_group))
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, start_in_part, n_tokens, ids); filters on doc_id prune stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def with_start(store: DataFrame) -> DataFrame:
    """``store`` with start: the ids of all documents before a row. Sums one number for each file."""
    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return store.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def with_crc32(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum of the ids as little-endian unsigned 32-bit numbers."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            raw = memoryview(np.asarray(lists.values, dtype="<i4")).cast("B") if len(lists.values) else b""
            ends = (np.asarray(lists.offsets).astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return store.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
