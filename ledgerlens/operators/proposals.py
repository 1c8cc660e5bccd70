"""Cluster proposals: scanning events, sampling them, and validating what is proposed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug_key, slug_ok, support_fingerprint
from ..sources.storage import materialize
from .admission import MAX_SUPPORT
from .similarity import alike, both_ways, named_sets
from .state import cooldowns, dismissals, suggestions, topics, writes

OVERLAP = 0.65
LINE_CHARS = 32


def scan(log: DataFrame, slugs: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Writes of these topics (slug) within the last ``days``."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    recent = writes(log).where(ms >= now_ms - days * 86_400_000)
    return recent.join(slugs.select("slug").distinct(), "slug", "left_semi").select("seq", "slug", "tag", "content", "ts")


def sampled(events: DataFrame, max_chars: int) -> DataFrame:
    """Each topic's events if they fit ``max_chars``, else the first, the last and evenly spaced ones between."""
    w = Window.partitionBy("slug")
    n, chars = F.count("*").over(w), F.sum(F.length("content") + LINE_CHARS).over(w)
    e = events.withColumn("n", n).withColumn("chars", chars).withColumn("i", F.row_number().over(w.orderBy("seq")) - 1)
    target = F.greatest(F.floor(F.lit(max_chars) / (F.col("chars") / F.col("n"))), F.lit(2))
    e = e.withColumn("need", target - 2).withColumn("step", (F.col("n") - 2) / (target - 2))
    # position i - 1 of the middle is picked if some (j + 0.5) * step rounds down to it
    j = F.ceil((F.col("i") - 1) / F.col("step") - 0.5)
    picked = (j >= 0) & (j < F.col("need")) & (F.floor((j + 0.5) * F.col("step")) == F.col("i") - 1)
    whole = (F.col("chars") <= max_chars) | (F.col("n") <= 2) | (target >= F.col("n"))
    ends = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    return e.where(whole | ends | ((F.col("need") > 0) & picked)).select("seq", "slug")


def proposals(log: DataFrame) -> DataFrame:
    """One proposal for each topic that asks for a cluster: its first writes as support, as many as a suggestion may cite."""
    first = F.row_number().over(Window.partitionBy("slug").orderBy("pos"))
    support = writes(log).withColumn("rn", first).where(F.col("rn") <= MAX_SUPPORT).groupBy("slug").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    text = F.concat(F.lit("About "), F.col("slug"))
    return support.select(
        F.concat("slug", F.lit("-x")).alias("slug"), text.alias("name"), text.alias("description"), text.alias("rationale"), "seqs", F.col("slug").alias("origin")
    )


def _similar(own: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """(slug, suggestion_seq, overlap) of sets of numbers (slug, n, seq) and (suggestion_seq, m, seq), by equi-join on shared numbers."""
    both = own.join(other, "seq").groupBy("slug", "suggestion_seq", "n", "m").agg(F.count("*").alias("both"))
    return both.withColumn("overlap", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).where(F.col("overlap") >= threshold).select("slug", "suggestion_seq", "overlap")


def validated(proposed: DataFrame, log: DataFrame, now_ms: int, scan: DataFrame, detector: DataFrame | None = None, threshold: float = OVERLAP) -> DataFrame:
    """(slug, reason): the first rule that a proposal (slug, name, description, rationale, seqs) breaks, or null.

    Slugs tell proposals apart. Support must be writes of the scanned topics (slug) that are not the ``detector``'s own
    (seq), and must not largely repeat that of a pending suggestion or of one dismissed not long ago.
    """
    known = topics(log).where(F.col("meta_k").isNotNull()).select("slug", F.lit(True).alias("taken"))
    cooling = cooldowns(log).where(F.col("until_ms") > now_ms).select("slug_key", F.lit(True).alias("cooling"))
    each = proposed.select("slug", F.posexplode("seqs").alias("i", "seq"))
    each = each.withColumn("again", F.row_number().over(Window.partitionBy("slug", "seq").orderBy("i")) > 1)
    held = writes(log).select("seq", F.col("slug").alias("held"))
    inside = scan.select(F.col("slug").alias("held"), F.lit(True).alias("inside")).distinct()
    own = (detector if detector is not None else held.select("seq").limit(0)).select("seq", F.lit(True).alias("own")).distinct()
    wrong = (
        F.when(F.col("seq") < 1, "supporting_seq_invalid")
        .when(F.col("again"), "supporting_seq_duplicate")
        .when(F.col("held").isNull(), "supporting_seq_not_found")
        .when(F.col("inside").isNull(), "supporting_seq_wrong_slug")
        .when(F.col("own"), "supporting_seq_self_citation")
    )
    cited = each.join(held, "seq", "left").join(inside, "held", "left").join(own, "seq", "left").withColumn("wrong", wrong)
    first = cited.groupBy("slug").agg(F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("i"))).alias("cited"))
    sets = proposed.select("slug", F.size("seqs").alias("n"), F.explode("seqs").alias("seq"))
    made = supports(log)
    pending = made.join(suggestions(log).where("status = 'pending'").select("suggestion_seq"), "suggestion_seq", "left_semi")
    repeats = _similar(sets, pending, threshold).groupBy("slug").agg(F.min("suggestion_seq").alias("repeats"))
    open_ = dismissals(log).where(F.col("cleared_by_accept_seq").isNull() & (F.col("until_ms") > now_ms)).select("slug_key", "suggestion_seq", "dismissal_seq")
    gone = _similar(sets, made.join(open_.select("suggestion_seq"), "suggestion_seq", "left_semi"), threshold).join(open_, "suggestion_seq")
    gone = gone.groupBy("slug").agg(F.min_by("slug_key", "dismissal_seq").alias("gone"))
    rows = proposed.withColumn("slug_key", slug_key(F.col("slug"))).join(known, "slug", "left").join(cooling, "slug_key", "left")
    for found in (first, repeats, gone):
        rows = rows.join(found, "slug", "left")
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    reason = (
        F.when(F.col("slug").isNull(), "slug_missing")
        .when(blank("name"), "name_missing")
        .when(blank("description"), "description_missing")
        .when(blank("rationale"), "rationale_missing")
        .when(F.coalesce(F.size("seqs"), F.lit(0)) <= 0, "supporting_seqs_missing")
        .when(~slug_ok(F.col("slug")), "slug_invalid_regex")
        .when(F.col("taken"), "slug_collision_with_topic_index")
        .when(F.col("cooling"), "cooldown_active")
        .when(F.col("cited").isNotNull(), F.col("cited"))
        .when(F.col("repeats").isNotNull(), F.concat(F.lit("support_overlap_pending_seq_"), F.col("repeats").cast("string")))
        .when(F.col("gone").isNotNull(), F.concat(F.lit("support_overlap_cooldown_active_"), F.col("gone")))
    )
    return rows.select("slug", reason.alias("reason"))


def emitted(verdicts: DataFrame, order: DataFrame, most: int = 3) -> DataFrame:
    """(slug, place): the first ``most`` proposals without a reason, in the order (slug, place) in which they were made; the bound is the feature."""
    return verdicts.where("reason is null").join(order, "slug").orderBy("place").limit(most).select("slug", "place")


def intents(made: DataFrame, day: str = "day", job: str = "detect") -> DataFrame:
    """(intent_id, ..): suggestions (day, seqs, ..) under an id that their day and support give; of equal ones the first by ``place``."""
    intent = F.concat(F.lit(f"intent:{job}:"), F.col(day), F.lit(":cluster-"), support_fingerprint(F.col("seqs")))
    first = F.row_number().over(Window.partitionBy("intent_id").orderBy("place"))
    return made.withColumn("intent_id", intent).withColumn("rn", first).where("rn = 1").drop("rn")


def supports(log: DataFrame) -> DataFrame:
    """(suggestion_seq, m, seq): the writes that each suggestion cites - its topic's latest before it, as many as it may - and how many they are."""
    own = Window.partitionBy("slug").orderBy("pos")
    numbered = log.withColumn("wn", F.count_if(F.col("type") == "write_event").over(own))
    held = numbered.where(F.col("type") == "write_event").select("slug", "wn", "seq")
    asked = numbered.where((F.col("type") == "TOPIC_SUGGESTED") & (F.col("wn") > 0)).select("slug", F.col("seq").alias("suggestion_seq"), F.col("wn").alias("last"))
    first = F.greatest(F.col("last") - MAX_SUPPORT + 1, F.lit(1))
    cited = asked.select("slug", "suggestion_seq", (F.col("last") - first + 1).alias("m"), F.explode(F.sequence(first, F.col("last"))).alias("wn"))
    return cited.join(held, ["slug", "wn"]).select("suggestion_seq", "m", "seq")


def overlapping(proposed: DataFrame, log: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """(slug, suggestion_seq, overlap): proposals whose support overlaps a pending suggestion's, by equi-join on support."""
    own = proposed.select("slug", F.size("seqs").alias("n"), F.explode("seqs").alias("seq"))
    other = supports(log).join(suggestions(log).where("status = 'pending'").select("suggestion_seq"), "suggestion_seq", "left_semi")
    return _similar(own, other, threshold)


def curate_targets(log: DataFrame, now_ms: int, days: int = 7, min_events: int = 3) -> DataFrame:
    """(slug, n): topics with metadata and at least ``min_events`` recent writes that aren't curated ones."""
    recent = F.unix_millis(F.col("ts").cast("timestamp")) >= now_ms - days * 86_400_000
    n = writes(log).where(recent & (F.col("tag") != "CURATED")).groupBy("slug").agg(F.count("*").alias("n")).where(F.col("n") >= min_events)
    return n.join(topics(log).where(F.col("meta_k").isNotNull()).select("slug"), "slug", "left_semi")


def bootstrap_eligible(log: DataFrame, now_ms: int, max_days: int = 60) -> DataFrame:
    """Topics with metadata and a recently accepted suggestion, but no curated write that is still live."""
    from .state import retired_seqs

    accepted = suggestions(log).where("status = 'accepted'").groupBy("slug").agg(F.max(F.unix_millis(F.col("resolved_ts").cast("timestamp"))).alias("ms"))
    young = accepted.where(F.col("ms") >= now_ms - max_days * 86_400_000)
    curated = writes(log).where(F.col("tag") == "CURATED").select("slug", "seq").join(retired_seqs(log), ["slug", "seq"], "left_anti")
    typed = topics(log).where(F.col("meta_k").isNotNull()).select("slug")
    return young.join(typed, "slug", "left_semi").join(curated, "slug", "left_anti").select("slug")


def repeated_bullets(log: DataFrame, threshold: float = 0.35, least: int = 3) -> DataFrame:
    """(slug, seq): curated writes that a later write of the topic, not a curated one, resembles.

    Texts meet as sets of words, each set of a topic once, with the last write that has it.
    """
    from ..functions.text import tokens

    w = writes(log).select("slug", "seq", (F.col("tag") == "CURATED").alias("bullet"), F.array_distinct(tokens(F.col("content"))).alias("terms"))
    rows = materialize(named_sets(w.where((F.size("terms") > 0) & (~F.col("bullet") | (F.size("terms") >= least))), ["slug"]), "bullet-sets")
    sets = materialize(rows.groupBy("slug", "name").agg(F.max(F.when(~F.col("bullet"), F.col("seq"))).alias("last"), F.first("terms").alias("terms")), "bullet-names")
    near = both_ways(alike(sets, ["slug"], threshold), sets)
    last = near.join(sets.where("last is not null").select(F.col("name").alias("b"), "last"), "b").groupBy("a").agg(F.max("last").alias("last"))
    return rows.where("bullet").join(last.withColumnRenamed("a", "name"), "name").where(F.col("last") > F.col("seq")).select("slug", "seq").distinct()


# The grammar of extracted entries.
ENTRY = r"^\[AUTO-(FACT|DECISION|CHANGED|PROCEDURE|TODO|EVENT):(CONFIRMED|TENTATIVE|CONTEXT)\]\s+([a-z0-9]+(?:-[a-z0-9]+)*)\s*:\s*(.+)$"


def extracted(lines: DataFrame, line: str = "line") -> DataFrame:
    """(.., tag, confidence, slug, content) of the lines that are well-formed entries."""
    t = F.trim(F.col(line))
    part = lambda i: F.regexp_extract(t, ENTRY, i)
    rows = lines.where(t.rlike(ENTRY)).select("*", part(1).alias("tag"), part(2).alias("confidence"), part(3).alias("slug"), F.trim(part(4)).alias("content"))
    return rows.where(slug_ok(F.col("slug")))
