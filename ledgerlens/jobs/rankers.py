"""Sessions ranked for questions: by the words of their turns, by the vectors of their texts, and by both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalized
from ..operators import blocks, retrieval
from ..sources.storage import materialize
from .evals import collapsed
from .vector_store import Model, embedded

#: Ranks have no limit here: every session counts for a mean reciprocal rank.
ALL = 1 << 31


def own_turns(turns: DataFrame) -> DataFrame:
    """(session, turn, text) of what users said; a turn without a role counts."""
    said = F.col("role").isNull() | (F.col("role") == "user")
    return turns.where(said).select(F.col("conv_id").cast("string").alias("session"), "turn", F.coalesce("text", F.lit("")).alias("text"))


def lexical(turns: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, session, rank): sessions by their best turn; all words of the question, or any where no turn has all."""
    rows = own_turns(turns).select(F.concat_ws(":", "session", "turn").alias("key"), F.lit("content").alias("field"), "text", "session")
    rows = materialize(rows, "turns")
    hits = retrieval.lexical(retrieval.index(rows.drop("session")), queries, {"content": 1.0}, retrieval.UNIT_FUZZY, "auto", ALL)
    return collapsed(hits.select("qid", F.regexp_extract("key", r"^(.*):", 1).alias("session"), "rank"))


def semantic(turns: DataFrame, queries: DataFrame, passages: Model, asked: Model) -> DataFrame:
    """(qid, session, rank): sessions by the cosine of their users' text, embedded whole, with the question."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    sessions = own_turns(turns).groupBy("session").agg(text.alias("content")).withColumnRenamed("session", "vector_key")
    unit = lambda df, name: df.withColumn("vector", normalized(F.col("vector"))).withColumnRenamed("vector", name)
    held = unit(embedded(sessions, passages), "embedding").withColumnRenamed("vector_key", "key")
    q = unit(embedded(queries.select(F.col("qid").cast("string").alias("vector_key"), F.col("text").alias("content")), asked), "vector")
    q = q.select(F.col("vector_key").cast("long").alias("qid"), "vector")
    found = blocks.nearest(materialize(held.select("key", "embedding"), "session-vectors"), materialize(q, "asked-vectors"), -2.0, ALL)
    return found.select("qid", F.col("key").alias("session"), "rank")


def hybrid(by_words: DataFrame, by_vectors: DataFrame) -> DataFrame:
    """(qid, session, rank): both rankings fused, words at half weight."""
    arms = {name: arm.withColumnRenamed("session", "key") for name, arm in (("L", by_words), ("S", by_vectors))}
    found = blocks.top(retrieval.fused(arms, {"L": retrieval.LEXICAL_WEIGHT, "S": 1.0}), ALL)
    return found.select("qid", F.col("key").alias("session"), "rank")


def rank_all(turns: DataFrame, queries: DataFrame, passages: Model, asked: Model) -> dict[str, DataFrame]:
    """Each ranker's written ranking."""
    words = materialize(lexical(turns, queries), "ranking")
    vectors = materialize(semantic(turns, queries, passages, asked), "ranking")
    return {"lexical": words, "semantic": vectors, "hybrid": materialize(hybrid(words, vectors), "ranking")}
