"""Transcripts: new turns worth reading, their text, and an estimate of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_MESSAGE = 2000
TOKENS_PER_WORD = 0.75
PING = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"


def worth_reading(role: Column, text: Column) -> Column:
    """User and assistant turns other than commands, envelopes, tool results and pings."""
    t = text
    noise = (
        t.rlike(r"^[/<]") | (t.rlike(PING) & (F.length(t) < 30)) | F.contains(t, F.lit("<tool_result>"))
        | F.contains(t, F.lit("</tool_result>")) | F.startswith(t, F.lit("System:")) | F.startswith(t, F.lit("[system]"))
    )
    return F.coalesce(role.isin("user", "assistant") & (t != "") & ~noise, F.lit(False))


def cut(text: str) -> Column:
    """A text cut at 2,000 characters, which it then says."""
    t = F.col(text)
    return F.when(F.length(t) > MAX_MESSAGE, F.concat(F.substring(t, 1, MAX_MESSAGE), F.lit("...[truncated]"))).otherwise(t)


def delta(turns: DataFrame, after_turn: int = -1) -> DataFrame:
    """Turns worth reading after ``after_turn``, each cut at 2,000 characters."""
    own = turns.where((F.col("turn") > after_turn) & worth_reading(F.col("role"), F.col("text")))
    return own.select("conv_id", "turn", "role", cut("text").alias("text"))


def body(messages: DataFrame) -> DataFrame:
    """(conv_id, text): ``role: text`` joined by blank lines."""
    items = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return messages.groupBy("conv_id").agg(items.alias("items")).select("conv_id", F.array_join("items.line", "\n\n").alias("text"))


def estimate(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, token_estimate)."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.round(F.sum(words) * TOKENS_PER_WORD).cast("long").alias("token_estimate"))


def advanced(turns: DataFrame, offsets: DataFrame, min_tokens: int = 200) -> DataFrame:
    """(conv_id, last_turn, token_estimate, ready): sessions with turns after their offset (conv_id, last_turn).

    The offset moves on whether or not there is enough to read, so a short stretch isn't read again.
    """
    new = turns.join(offsets.withColumnRenamed("last_turn", "done"), "conv_id", "left").where(F.col("turn") > F.coalesce("done", F.lit(-1)))
    ends = new.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    text = estimate(delta(new.select(*turns.columns)))
    found = ends.join(text.select("conv_id", "token_estimate"), "conv_id", "left").withColumn("token_estimate", F.coalesce("token_estimate", F.lit(0)))
    return found.withColumn("ready", F.col("token_estimate") >= min_tokens)
