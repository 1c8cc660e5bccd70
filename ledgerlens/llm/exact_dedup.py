"""Exact duplicates by deterministic block naming.

A normalised text is cut into fixed-size blocks. Distinct blocks are sorted and
numbered, so equal blocks, and only those, share a name. Then adjacent names are
paired, distinct pairs sorted and numbered, and so on: each round halves a
document's names until one is left. Two texts are equal if and only if they have
the same number of rounds and the same last name; no hash decides anything
(hashes only deal blocks out to buckets, within which contents are sorted).

A text block crosses the network once for each map task that holds it: within a
task equal blocks point to the first one. Later rounds move integers only. Names
that over a thousandth of all rows bear, as of a text with very many copies, reach
them by broadcast, so such rows aren't gathered in one task.

Null texts count as empty and equal one another. Rows are told apart by their
place, so repeated rows and repeated ids are documents of their own; among rows
with the smallest id of a group the first read stays. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, joined, lean, materialize, small_batches, text_or_empty

BLOCK_BYTES = 4096
#: Names that one bucket sorts: about this many.
BUCKET_ROWS = 5_000
#: Bytes of block contents that a task remembers at a time.
REMEMBERED_BYTES = 16 << 20
#: A run of white space that differs from one space.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text_col: str = "text") -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text_or_empty(text_col), _RUN, " ")


def _blocks(docs: DataFrame, doc_col: str, text_col: str, block_bytes: int, key_col: str | None = None) -> DataFrame:
    """Rows (row_id, idx, n_blocks, first_equal, content, doc_id, sha256).

    ``row_id`` is ``key_col``, or the row's place. ``content`` is null where an earlier block of the task, ``first_equal``, has it;
    ``doc_id`` and ``sha256`` stand in a document's first row only.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        place = block_id = TaskContext.get().partitionId() << 40
        seen: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            rows = []
            for doc, sha, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row_id = place if key is None else key
                n = max(1, -(-len(text) // block_bytes))
                for i in range(n):
                    block = text[i * block_bytes : (i + 1) * block_bytes]
                    first = seen.get(block)
                    new = first is None
                    if new:
                        if held > REMEMBERED_BYTES:
                            seen.clear()
                            held = 0
                        first = seen[block] = block_id
                        held += len(block) + 100
                        block_id += 1
                    rows.append((row_id, i, n, first, block if new else None, None if i else doc, None if i else sha))
                place += 1
            names = ["row_id", "idx", "n_blocks", "first_equal", "content", "doc_id", "sha256"]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    text = normalized(text_col)
    key = (F.col(key_col) if key_col else F.lit(None)).cast("long").alias("key")
    return docs.select(
        F.col(doc_col).cast("long").alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha256"), F.encode(text, "UTF-8"), key
    ).mapInArrow(lean(run), "row_id long, idx int, n_blocks int, first_equal long, content binary, doc_id long, sha256 string")


def _named(rows: DataFrame, by: list[str], count: int) -> DataFrame:
    """``rows`` with a positive integer ``name``: equal ``by``, equal name. Numbers follow the sort order in a bucket."""
    buckets = max(16, -(-count // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*by))
    return rows.withColumn("bucket", bucket).withColumn("name", rank.cast("long") * buckets + F.col("bucket"))


def identities(docs: DataFrame, doc_col="doc_id", text_col="text", block_bytes: int = BLOCK_BYTES, key_col: str | None = None) -> DataFrame:
    """(row_id, doc_id, sha256, rounds, name) for each row: equal (rounds, name), equal normalised text."""
    blocks = materialize(_blocks(docs, doc_col, text_col, block_bytes, key_col), "dedup-blocks")
    fat = blocks.where(F.col("content").isNotNull()).select("first_equal", "content")
    uses = blocks.groupBy("first_equal").agg(F.count("*").alias("uses"))
    names = materialize(_named(fat, ["content"], fat.count()).select("first_equal", "name").join(uses, "first_equal"), "dedup-block-names")
    pieces = blocks.select("row_id", "idx", "n_blocks", "first_equal")
    level = materialize(joined(pieces, names, ["first_equal"], "uses", blocks.count()).drop("first_equal", "uses"), "dedup-names")
    heads = materialize(blocks.where("idx = 0").select("row_id", "doc_id", "sha256"), "dedup-heads")
    discard(names)
    discard(blocks)  # contents are needed no more
    done, longest, rounds = [], level.agg(F.max("n_blocks")).first()[0] or 0, 0
    while True:
        done.append(level.where("n_blocks = 1").select("row_id", F.lit(rounds).alias("rounds"), "name"))
        if longest <= 1:
            break
        # names are positive: 0 stands for no right neighbour
        side = lambda k: F.coalesce(F.max(F.when(F.col("idx") % 2 == k, F.col("name"))), F.lit(0))
        pairs = materialize(
            level.where("n_blocks > 1")
            .groupBy("row_id", F.floor(F.col("idx") / 2).cast("int").alias("idx"), "n_blocks")
            .agg(side(0).alias("a"), side(1).alias("b"))
            .withColumn("n_blocks", F.ceil(F.col("n_blocks") / 2).cast("int")),
            "dedup-pairs",
        )
        total = pairs.count()
        distinct = pairs.groupBy("a", "b").agg(F.count("*").alias("uses"))
        names = materialize(_named(distinct, ["a", "b"], total).select("a", "b", "name", "uses"), "dedup-pair-names")
        level = materialize(joined(pairs, names, ["a", "b"], "uses", total).drop("a", "b", "uses"), "dedup-names")
        discard(pairs)
        discard(names)
        longest, rounds = -(-longest // 2), rounds + 1
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return heads.join(found, "row_id")


def _with_first(ids: DataFrame) -> DataFrame:
    """Rows of ``identities`` with ``group_size`` and ``first``, the (doc_id, row_id) that stays of those with equal text."""
    ids = materialize(ids, "dedup-identities")
    groups = ids.groupBy("rounds", "name").agg(F.min(F.struct("doc_id", "row_id")).alias("first"), F.count("*").alias("group_size"))
    return joined(ids, materialize(groups, "dedup-groups"), ["rounds", "name"], "group_size", ids.count())


def repeated(docs: DataFrame, key_col: str, doc_col="doc_id", text_col="text") -> DataFrame:
    """(row_id): keys of the rows whose text an earlier row has."""
    return _with_first(identities(docs, doc_col, text_col, key_col=key_col)).where("row_id <> first.row_id").select("row_id")


def dedup(docs: DataFrame, doc_col="doc_id", text_col="text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``."""
    return _with_first(identities(docs, doc_col, text_col, block_bytes)).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )
