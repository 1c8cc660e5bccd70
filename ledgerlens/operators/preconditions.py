"""What must hold before an operation on topics is written: each asked operation with the first code that forbids it.

Asked operations are tables, so any number is judged in one plan; state comes from the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug_key, slug_ok
from .state import cooldowns, retired_seqs, suggestions, topics, writes

DEFERRAL_WRITES = 50


def _typed(log: DataFrame) -> DataFrame:
    """(slug, typed): topics with metadata."""
    return topics(log).where(F.col("meta_k").isNotNull()).select("slug", F.lit(True).alias("typed"))


def retire_seqs(asked: DataFrame, log: DataFrame) -> DataFrame:
    """(ask_id, seq, code) for each distinct number that is to be retired from a topic; asked is (ask_id, topic, seqs)."""
    each = asked.select("ask_id", "topic", F.explode(F.array_distinct("seqs")).alias("seq"))
    held = writes(log).select("seq", F.col("slug").alias("held"), "tag")
    gone = retired_seqs(log).select(F.col("slug").alias("topic"), "seq", F.lit(True).alias("gone"))
    rows = each.join(held, "seq", "left").join(gone, ["topic", "seq"], "left")
    code = (
        F.when(F.col("seq") < 1, "INVALID_RETIRE_SEQ")
        .when(F.col("held").isNull(), "SEQ_NOT_FOUND")
        .when(F.col("held") != F.col("topic"), "SEQ_NOT_ON_TOPIC")
        .when(F.coalesce(F.col("tag") != "CURATED", F.lit(True)), "SEQ_NOT_CURATED")
        .when(F.col("gone"), "SEQ_ALREADY_RETIRED")
    )
    return rows.select("ask_id", "seq", code.alias("code"))


def retire(asked: DataFrame, log: DataFrame) -> DataFrame:
    """(ask_id, code, n, n_invalid): all or nothing. One number's own code, or a common one for several."""
    c = retire_seqs(asked, log).groupBy("ask_id").agg(
        F.count("*").alias("n"), F.count("code").alias("n_invalid"), F.max(F.col("seq") < 1).alias("bad"), F.min("code").alias("only")
    )
    rows = asked.select("ask_id", "topic").join(c, "ask_id", "left")
    code = (
        F.when(F.col("bad"), "INVALID_RETIRE_SEQ")
        .when(F.coalesce("n", F.lit(0)) == 0, "EMPTY_SEQ_SET")
        .when(~F.coalesce(slug_ok(F.col("topic")), F.lit(False)), "INVALID_SLUG")
        .when(F.col("n_invalid") == 0, None)
        .when(F.col("n") == 1, F.col("only"))
        .otherwise("RETIRE_INVALID_SEQS")
    )
    return rows.select("ask_id", code.alias("code"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"))


def still_active(asked: DataFrame, log: DataFrame) -> DataFrame:
    """(ask_id, seqs): the asked numbers that are live curated writes of their topic, ascending."""
    good = retire_seqs(asked, log).where("code is null")
    return good.groupBy("ask_id").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))


def accept(asked: DataFrame, log: DataFrame, supports: DataFrame, scan: DataFrame) -> DataFrame:
    """(ask_id, code): asked (ask_id, suggestion_seq, slug) names the topic to be made; supports (suggestion_seq, seq), scan (slug)."""
    s = suggestions(log).select("suggestion_seq", "status")
    held = writes(log).select("seq", F.col("slug").alias("held"))
    inside = scan.select(F.col("slug").alias("held"), F.lit(True).alias("inside")).distinct()
    wrong = F.when(F.col("held").isNull(), "SUPPORTING_SEQ_NOT_FOUND").when(F.col("inside").isNull(), "SUPPORTING_SEQ_WRONG_SLUG")
    cited = supports.select("suggestion_seq", "seq").join(held, "seq", "left").join(inside, "held", "left").withColumn("wrong", wrong)
    first = cited.groupBy("suggestion_seq").agg(F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("seq"))).alias("cited"))
    rows = asked.join(s, "suggestion_seq", "left").join(_typed(log), "slug", "left").join(first, "suggestion_seq", "left")
    code = (
        F.when(F.col("status").isNull(), "SUGGESTION_NOT_FOUND")
        .when(F.col("status") != "pending", "SUGGESTION_NOT_PENDING")
        .when(~F.coalesce(slug_ok(F.col("slug")), F.lit(False)), "INVALID_SLUG")
        .when(F.col("typed"), "SLUG_COLLISION")
        .otherwise(F.col("cited"))
    )
    return rows.select("ask_id", code.alias("code"))


def dismiss(asked: DataFrame, log: DataFrame) -> DataFrame:
    """(ask_id, code, n, invalid): asked is (ask_id, seqs); ``invalid`` names the offenders, all or nothing."""
    each = asked.select("ask_id", F.explode(F.array_distinct("seqs")).alias("suggestion_seq"))
    rows = each.join(suggestions(log).select("suggestion_seq", "status"), "suggestion_seq", "left")
    reason = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "pending", F.concat(F.lit("not_pending_"), "status"))
    bad = F.when(reason.isNotNull(), F.struct("suggestion_seq", reason.alias("reason")))
    found = rows.groupBy("ask_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(bad)).alias("bad"))
    out = asked.select("ask_id").join(found, "ask_id", "left")
    code = F.when(F.col("n").isNull(), "INVALID_SUGGESTION_SEQS").when(F.size("bad") > 0, "DISMISS_INVALID_SEQS")
    named = F.array_join(F.transform("bad", lambda b: F.concat_ws(":", b["suggestion_seq"].cast("string"), b["reason"])), ",")
    return out.select("ask_id", code.alias("code"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(named, F.lit("")).alias("invalid"))


def create(asked: DataFrame, log: DataFrame, now_ms: int) -> DataFrame:
    """(ask_id, code): asked is (ask_id, slug); slugs that differ in case and hyphens alone count as one for suggestions and cooldowns."""
    waiting = suggestions(log).where("status = 'pending'").select(slug_key(F.col("slug")).alias("slug_key"), F.lit(True).alias("waiting")).distinct()
    cooling = cooldowns(log).where(F.col("until_ms") > now_ms).select("slug_key", F.lit(True).alias("cooling"))
    rows = asked.withColumn("slug_key", slug_key(F.col("slug"))).join(_typed(log), "slug", "left").join(waiting, "slug_key", "left").join(cooling, "slug_key", "left")
    code = (
        F.when(~F.coalesce(slug_ok(F.col("slug")), F.lit(False)), "INVALID_SLUG")
        .when(F.col("typed"), "SLUG_COLLISION")
        .when(F.col("waiting"), "PENDING_SUGGESTION_EXISTS")
        .when(F.col("cooling"), "COOLDOWN_ACTIVE")
    )
    return rows.select("ask_id", code.alias("code"))


def deferred(log: DataFrame, scan: DataFrame, marker: str = "first run deferred", most: int = DEFERRAL_WRITES) -> DataFrame:
    """(had_suggestion, marked, n, deferred), one row: a first run waits once it is marked so, or where the scanned topics (slug) have many writes."""
    w = writes(log).join(scan.select("slug", F.lit(True).alias("scanned")).distinct(), "slug", "left").select(
        F.lit(False).alias("suggestion"), ((F.col("slug") == "system") & F.contains(F.col("content"), F.lit(marker))).alias("marked"), F.col("scanned").isNotNull().alias("scanned")
    )
    made = log.where(F.col("type") == "TOPIC_SUGGESTED").select(F.lit(True).alias("suggestion"), F.lit(False).alias("marked"), F.lit(False).alias("scanned"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    row = w.unionByName(made).agg(any_("suggestion"), any_("marked"), F.count_if("scanned").alias("n"))
    waits: Column = ~F.col("suggestion") & (F.col("marked") | (F.col("n") > most))
    return row.select(F.col("suggestion").alias("had_suggestion"), "marked", "n", waits.alias("deferred"))
