"""Best-fit packing planned on the histogram of piece lengths.

A document is its token ids and an end id. One longer than ``max_tokens`` is cut
into full pieces after a shorter first one. Which lengths share a sequence is
planned from the counts of each length alone - at most ``max_tokens`` numbers,
however many documents - and pieces then take the planned slots by their rank
within their length. Ranks come from counts by (length, bucket), so no length,
however common, is ranked by one task.

Null texts count as empty: a document of the end id alone. Repeated rows and
repeated ids are packed as rows of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import lean, materialize, small_batches, text_or_empty

#: Pieces that one task ranks: a bucket of one length holds about this many at most.
BUCKET_ROWS = 20_000


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int | None, doc_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit numbers, the end id included."""
    small_batches(docs.sparkSession)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            ids = [x.tobytes() + end for x in enc.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        lean(run), "doc_id long, n_tokens long, ids binary"
    )


def cut(tokens: DataFrame, max_tokens: int) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids, ids_crc32."""
    n, m = F.col("n_tokens"), F.lit(max_tokens)
    first = F.when(n == 0, F.lit(0)).otherwise((n - 1) % m + 1)
    rows = tokens.withColumn("first", first).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / m) - 1, F.lit(0)).cast("int")))
    )
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("first") + (F.col("piece") - 1) * m).cast("long")
    length = F.when(F.col("piece") == 0, F.col("first")).otherwise(m).cast("long")
    part = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
    return rows.select(
        "doc_id", "piece", start.alias("start"), length.alias("length"), part.alias("ids"), F.crc32(part).alias("ids_crc32")
    )


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, rank_from, pieces, per_sequence, sequence_from, offset).

    Sequences with the same room left stand together as one range of numbers, so
    one step places a length into a whole range. Ranks ``rank_from`` and on take
    the range's sequences in turn, ``per_sequence`` pieces to each.
    """
    room: list[tuple[int, int, int]] = []  # (room, first sequence, sequences), sorted
    slots, used = [], 0
    for length in sorted((k for k, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(room, (length, -1, -1))
            if at == len(room):
                per = capacity // length
                r, first, n = capacity, used, -(-left // per)
                used += n
            else:
                r, first, n = room.pop(at)
            per = r // length
            full = min(n, left // per)  # sequences of the range that take all they can
            if full:
                slots.append((length, rank, full * per, per, first, capacity - r))
                rank, left = rank + full * per, left - full * per
                if r - per * length:
                    bisect.insort(room, (r - per * length, first, full))
                first, n = first + full, n - full
            if left and n:  # the rest of this length fits one more of them
                slots.append((length, rank, left, left, first, capacity - r))
                if r - left * length:
                    bisect.insort(room, (r - left * length, first, 1))
                first, n, left = first + 1, n - 1, 0
            if n:
                bisect.insort(room, (r, first, n))
    return slots


def assign(pieces: DataFrame, max_tokens: int) -> DataFrame:
    """``pieces`` with sequence_id and offset. Reads ``pieces`` twice: give it a written table."""
    spark = pieces.sparkSession
    total = pieces.count()
    buckets = max(16, -(-total // BUCKET_ROWS))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = materialize(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, max_tokens),
        "slot_length long, rank_from long, pieces long, per_sequence long, sequence_from long, slot_offset long",
    )
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = (
        rows.withColumn("in_bucket", F.row_number().over(in_bucket) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("in_bucket"))
    )
    # as many slots as the plan has ranges: bounded by max_tokens, not by the documents
    fits = (F.col("length") == F.col("slot_length")) & F.col("rank").between(
        F.col("rank_from"), F.col("rank_from") + F.col("pieces") - 1
    )
    k = F.col("rank") - F.col("rank_from")
    return ranked.join(F.broadcast(slots), fits).select(
        *[F.col(c) for c in pieces.columns],
        (F.col("sequence_from") + F.floor(k / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("slot_offset") + k % F.col("per_sequence") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = 1024, doc_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset) for every piece of every document."""
    tokens = materialize(token_table(docs, tokenizer_path, end_id, doc_col, text_col), "packing-tokens")
    return assign(cut(tokens, max_tokens), max_tokens)
