"""Chat formatting after collapsing cumulative snapshots, in built-in functions alone.

A logged conversation often holds an earlier log of itself as a prefix. Each turn
gets a hash of its place, role and text; the XOR of the hashes so far names the
prefix that ends there (128 bits, two seeds). A conversation whose whole name is
that of a proper prefix of another goes by anti-join; of equal ones the smallest
id stays, with the number of copies. The rest are rendered with a role template.

Prefixes are built from chunks of turns, so a conversation of any length is
spread over tasks, and every conversation is rendered in parts of ``PART_TURNS``
turns, of which an ordinary one has one. Null texts count as empty, a null role
as ``unknown``, null turns come first. A row without conv_id is a conversation of
that one turn: equal ones are counted before anything is shuffled by a key.
Repeated turns stay, ordered by role and text. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CHUNK_TURNS = 256
PART_TURNS = 512


def _clean(turns: DataFrame) -> DataFrame:
    return turns.select(
        "conv_id",
        F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` (rank, role, text) with the two halves of each turn's hash."""
    return rows.withColumn("ha", F.xxhash64(F.lit(1), "rank", "role", "text")).withColumn("hb", F.xxhash64(F.lit(2), "text", "role", "rank"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(key, conv_id, rank, n_turns, role, text, pa, pb): each turn with the hash of the prefix it ends."""
    t = _clean(turns.where("conv_id is not null")).withColumn("key", F.col("conv_id").cast("string")).withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS))
    so_far = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = t.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    places = counts.select(
        "key",
        "chunk",
        F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("key")).alias("n_turns"),
    )
    in_chunk = Window.partitionBy("key", "chunk").orderBy("turn", "role", "text")
    ranked = _named(t.withColumn("rn", F.row_number().over(in_chunk) - 1).join(places, ["key", "chunk"]).withColumn("rank", F.col("before") + F.col("rn")))
    ranked = materialize(ranked.select("key", "chunk", "conv_id", "rank", "n_turns", "role", "text", "ha", "hb"), "chat-turns")
    whole = ranked.groupBy("key", "chunk").agg(F.bit_xor("ha").alias("ca"), F.bit_xor("hb").alias("cb"))
    earlier = whole.select(
        "key",
        "chunk",
        F.coalesce(F.bit_xor("ca").over(so_far), F.lit(0)).alias("ea"),
        F.coalesce(F.bit_xor("cb").over(so_far), F.lit(0)).alias("eb"),
    )
    up_to = Window.partitionBy("key", "chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("xa", F.bit_xor("ha").over(up_to))
        .withColumn("xb", F.bit_xor("hb").over(up_to))
        .join(earlier, ["key", "chunk"])
        .select(
            "key", "conv_id", "rank", "n_turns", "role", "text",
            F.col("xa").bitwiseXOR(F.col("ea")).alias("pa"),
            F.col("xb").bitwiseXOR(F.col("eb")).alias("pb"),
        )
    )


def loners(turns: DataFrame) -> DataFrame:
    """(role, text, copies, n_turns, pa, pb) of the different turns without conv_id, each a conversation of its own."""
    alone = _clean(turns.where("conv_id is null")).groupBy("role", "text").agg(F.count("*").alias("copies"))
    rows = _named(alone.withColumn("rank", F.lit(0).cast("long")))
    return rows.select("role", "text", "copies", F.lit(1).cast("long").alias("n_turns"), F.col("ha").alias("pa"), F.col("hb").alias("pb"))


def maximal(p: DataFrame, alone: DataFrame) -> DataFrame:
    """(key, copies, role, text) of the conversations that no other extends, one for each set of equal ones.

    ``key`` is null where only turns without conv_id make up the set; role and text are those of such a turn.
    """
    whole = p.where("rank + 1 = n_turns").select(
        "n_turns", "pa", "pb", F.struct("conv_id", "key").alias("own"), F.lit(1).cast("long").alias("copies"), F.lit(None).cast("struct<role:string,text:string>").alias("turn")
    )
    lone = alone.select("n_turns", "pa", "pb", F.lit(None).cast(whole.schema["own"].dataType).alias("own"), "copies", F.struct("role", "text").alias("turn"))
    sets = whole.unionByName(lone).groupBy("n_turns", "pa", "pb").agg(F.min("own").alias("first"), F.sum("copies").alias("copies"), F.max("turn").alias("turn"))
    proper = p.where("rank + 1 < n_turns").select((F.col("rank") + 1).alias("n_turns"), "pa", "pb").distinct()
    kept = sets.join(proper, ["n_turns", "pa", "pb"], "left_anti")
    return kept.select(F.col("first.key").alias("key"), "copies", "turn.role", "turn.text")


def _segment():
    return F.concat(F.lit("<|"), F.lower("role"), F.lit("|>\n"), F.trim("text"), F.lit("\n<|end|>"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, rendered) of the maximal conversations."""
    p = materialize(prefixes(turns), "chat-prefixes")
    kept = materialize(maximal(p, loners(turns)), "chat-maximal")
    own = (
        p.join(kept.where("key is not null").select("key", "copies"), "key")
        .groupBy("conv_id", F.floor(F.col("rank") / PART_TURNS).alias("part"), "n_turns", "copies")
        .agg(F.sort_array(F.collect_list(F.struct("rank", _segment().alias("s")))).alias("turns"))
        .select("conv_id", "part", "n_turns", "copies", F.array_join(F.col("turns.s"), "\n").alias("rendered"))
    )
    one = lambda n: F.lit(n).cast("long")
    lone = kept.where("key is null").select(F.lit(None).cast(own.schema["conv_id"].dataType).alias("conv_id"), one(0).alias("part"), one(1).alias("n_turns"), "copies", _segment().alias("rendered"))
    return own.unionByName(lone)
