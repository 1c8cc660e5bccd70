"""State of a log as relations: windows, ordered aggregates and temporal joins in place of a sequential fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug_key

DAY_MS = 86_400_000


def _earlier() -> Window:
    return Window.partitionBy("slug").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def writes(log: DataFrame) -> DataFrame:
    return log.where(F.col("type") == "write_event")


def latest(log: DataFrame, value: Column, when: Column) -> Column:
    """Of the rows for which ``when`` holds the value of the last, as an aggregate."""
    return F.max_by(F.when(when, value), F.when(when, F.col("pos")))


def topics(log: DataFrame) -> DataFrame:
    """One row for each topic that a write or metadata entry names: latest values win, field by field."""
    kind, write = F.col("type"), F.col("type") == "write_event"
    named = log.where(kind.isin("write_event", "TOPIC_METADATA_SET", "TOPIC_CURATED", "TOPIC_VERIFIED"))
    return named.groupBy("slug").agg(
        F.coalesce(F.max(F.when(write, F.col("seq"))), F.min("seq")).alias("last_updated_seq"),
        F.count_if(write).alias("n_writes"),
        latest(log, F.col("k"), kind == "TOPIC_METADATA_SET").alias("meta_k"),
        F.max(F.when(kind == "TOPIC_CURATED", F.col("seq"))).alias("curated_seq"),
        F.max(F.when(kind == "TOPIC_VERIFIED", F.col("seq"))).alias("verified_seq"),
    )


def history(log: DataFrame) -> DataFrame:
    """(slug, place, seq, tag, principal, ts, content): each topic's writes in order, a row each, so no topic is gathered."""
    place = F.row_number().over(Window.partitionBy("slug").orderBy("pos"))
    return writes(log).withColumn("place", place.cast("long")).select("slug", "place", "seq", "tag", "principal", "ts", "content")


def latest_writes(log: DataFrame, n: int = 50) -> DataFrame:
    """(slug, place, seq, tag, content): each topic's last ``n`` writes that aren't curated ones, the latest first; the bound is the feature."""
    place = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("pos")))
    own = writes(log).where(F.col("tag") != "CURATED").withColumn("place", place.cast("long"))
    return own.where(F.col("place") <= n).select("slug", "place", "seq", "tag", "content")


def ordered_tags(log: DataFrame) -> DataFrame:
    """Each topic's tags in order of first use: first uses are reduced before they are gathered."""
    first = writes(log).groupBy("slug", "tag").agg(F.min("pos").alias("first"))
    tags = F.sort_array(F.collect_list(F.struct("first", "tag")))
    return first.groupBy("slug").agg(tags.alias("t")).select("slug", F.array_join("t.tag", ",").alias("tags"))


def first_write_acl(log: DataFrame) -> DataFrame:
    """Readers that a topic's first write seeds: its principal and the operator."""
    first = writes(log).groupBy("slug").agg(F.min_by("principal", "pos").alias("principal"))
    return first.select("slug", F.array_join(F.array_distinct(F.array("principal", F.lit("operator"))), ",").alias("readers"))


def retirements(log: DataFrame) -> DataFrame:
    """(pos, slug, superseded_seq, effective): a retired number counts if an earlier curated write of the topic bears it."""
    curated = F.max(F.when(F.col("tag") == "CURATED", F.col("seq"))).over(_earlier())
    named = log.withColumn("last_curated", curated).where(F.col("type") == "TOPIC_BULLETS_RETIRED")
    asked = named.select("pos", "slug", F.explode(F.array_distinct(F.array(F.coalesce("last_curated", F.lit(0)), F.col("seq") - 1))).alias("superseded_seq"))
    held = writes(log).where(F.col("tag") == "CURATED").select("slug", F.col("seq").alias("superseded_seq"), F.col("pos").alias("w_pos"))
    found = asked.join(held, ["slug", "superseded_seq"], "left")
    return found.select("pos", "slug", "superseded_seq", F.coalesce(F.col("w_pos") < F.col("pos"), F.lit(False)).alias("effective"))


def retire_asks(log: DataFrame) -> DataFrame:
    """(ask_id, topic, seqs): the numbers that each retirement names - the topic's last curated write, the entry before, and one more."""
    curated = F.max(F.when(F.col("tag") == "CURATED", F.col("seq"))).over(_earlier())
    named = log.withColumn("last_curated", curated).where(F.col("type") == "TOPIC_BULLETS_RETIRED")
    return named.select(F.col("pos").alias("ask_id"), F.col("slug").alias("topic"), F.array(F.coalesce("last_curated", F.lit(0)), F.col("seq") - 1, "k").alias("seqs"))


def with_last_suggested(log: DataFrame) -> DataFrame:
    """``log`` with last_suggested: the number of the topic's latest earlier suggestion."""
    return log.withColumn("last_suggested", F.max(F.when(F.col("type") == "TOPIC_SUGGESTED", F.col("seq"))).over(_earlier()))


def retired_seqs(log: DataFrame) -> DataFrame:
    return retirements(log).where("effective").select("slug", F.col("superseded_seq").alias("seq")).distinct()


def suggestions(log: DataFrame) -> DataFrame:
    """(suggestion_seq, slug, ts, status, resolver_seq, resolved_pos, cooldown_days, resolved_ts): the first resolver wins."""
    last = F.max(F.when(F.col("type") == "TOPIC_SUGGESTED", F.col("seq"))).over(_earlier())
    resolvers = (
        log.withColumn("suggestion_seq", last)
        .where(F.col("type").isin("TOPIC_SUGGESTION_ACCEPTED", "TOPIC_SUGGESTION_DISMISSED") & F.col("suggestion_seq").isNotNull())
        .groupBy("suggestion_seq")
        .agg(F.min_by(F.struct("type", "seq", "pos", "cooldown_days", "ts"), "pos").alias("r"))
    )
    made = log.where(F.col("type") == "TOPIC_SUGGESTED").select(F.col("seq").alias("suggestion_seq"), "slug", "ts", "k")
    status = F.when(F.col("r").isNull(), "pending").when(F.col("r.type") == "TOPIC_SUGGESTION_ACCEPTED", "accepted").otherwise("dismissed")
    return made.join(resolvers, "suggestion_seq", "left").select(
        "suggestion_seq", "slug", "ts", "k", status.alias("status"), F.col("r.seq").alias("resolver_seq"),
        F.col("r.pos").alias("resolved_pos"), F.col("r.cooldown_days").alias("cooldown_days"), F.col("r.ts").alias("resolved_ts"),
    )


def dismissals(log: DataFrame) -> DataFrame:
    """(slug_key, suggestion_seq, dismissal_seq, until_ms, cleared_by_accept_seq): cleared by the first later accept of the slug."""
    return dismissed(suggestions(log))


def dismissed(suggested: DataFrame) -> DataFrame:
    """``dismissals`` of resolved suggestions: numbers grow along the log, so the least number of the accepts that follow in a slug's order is the first one's."""
    s = suggested.where("status <> 'pending'").withColumn("slug_key", slug_key(F.col("slug")))
    following = Window.partitionBy("slug_key").orderBy("resolved_pos").rowsBetween(1, Window.unboundedFollowing)
    s = s.withColumn("cleared_by_accept_seq", F.min(F.when(F.col("status") == "accepted", F.col("resolver_seq"))).over(following))
    return s.where("status = 'dismissed'").select(
        "slug_key",
        "suggestion_seq",
        F.col("resolver_seq").alias("dismissal_seq"),
        (F.unix_millis(F.col("resolved_ts").cast("timestamp")) + F.col("cooldown_days") * DAY_MS).alias("until_ms"),
        "cleared_by_accept_seq",
    )


def cooldowns(log: DataFrame) -> DataFrame:
    """Each slug's uncleared dismissal that lasts longest, the first of equal ones."""
    return longest_open(dismissals(log))


def longest_open(gone: DataFrame) -> DataFrame:
    open_ = gone.where(F.col("cleared_by_accept_seq").isNull())
    longest = F.max_by(F.struct("dismissal_seq", "until_ms"), F.struct("until_ms", -F.col("dismissal_seq")))
    return open_.groupBy("slug_key").agg(longest.alias("x")).select("slug_key", "x.dismissal_seq", "x.until_ms")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Entries before the first, by position, whose number is over ``seq``."""
    beyond = log.where(F.col("seq") > seq).agg(F.min("pos").alias("stop"))
    return log.join(F.broadcast(beyond), F.col("stop").isNull() | (F.col("pos") < F.col("stop"))).drop("stop")  # one row


def principals(log: DataFrame) -> DataFrame:
    """First entry declares a principal; the last later access entry sets its status."""
    declared = log.groupBy("principal").agg(F.min("pos").alias("declared_pos"))
    status = F.when(F.col("k") % 10 == 0, "tombstoned").when(F.col("k") % 2 == 0, "active").otherwise("disabled")
    access = log.where(F.col("type") == "TOPIC_VERIFIED").withColumn("status", status)
    last = (
        access.join(declared, "principal").where(F.col("pos") > F.col("declared_pos")).groupBy("principal").agg(F.max_by("status", "pos").alias("status"))
    )
    return declared.join(last, "principal", "left").select("principal", "declared_pos", F.coalesce("status", F.lit("active")).alias("status"))


def flags(control: DataFrame) -> DataFrame:
    """(feature, active): the last entry about a feature decides."""
    own = control.where(F.col("type").isin("FEATURE_ACTIVE", "FEATURE_ROLLED_BACK"))
    return own.groupBy("feature").agg((F.max_by("type", "pos") == "FEATURE_ACTIVE").alias("active"))


def mode(control: DataFrame) -> DataFrame:
    """(mode), one row: recovery from an entry into it to one out of it, else normal."""
    own = control.where(F.col("type").isin("RECOVERY_MODE_ENTERED", "RECOVERY_MODE_EXITED"))
    last = F.max_by("type", "pos")
    return own.agg(F.when(last == "RECOVERY_MODE_ENTERED", "recovery").otherwise("normal").alias("mode"))


def tail(log: DataFrame) -> DataFrame:
    return log.agg(F.max("pos").alias("pos"), F.max_by("seq", "pos").alias("last_seq"))


def witnesses(log: DataFrame, limit: int = 100_000) -> DataFrame:
    """Last entry for each intent, the ``limit`` intents first seen last: the bounded set is the feature."""
    intent = F.concat_ws(":", "slug", "k")
    seen = log.groupBy(intent.alias("intent_id")).agg(F.min("pos").alias("first_pos"), F.max("seq").alias("last_seq"))
    return seen.orderBy(F.desc("first_pos"), "intent_id").limit(limit)
