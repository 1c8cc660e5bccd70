"""Liveness of recurring runs: failures since the last success, and a verdict with hysteresis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heartbeat(runs: DataFrame) -> DataFrame:
    """(slug, last_kind, last_success_seq, consecutive_failures) from runs (slug, seq, kind)."""
    success = runs.where("kind = 'complete'").groupBy("slug").agg(F.max("seq").alias("last_success_seq"))
    since = runs.join(success, "slug", "left")
    failed = (F.col("kind") == "failed") & (F.col("seq") > F.coalesce("last_success_seq", F.lit(-1)))
    return since.groupBy("slug", "last_success_seq").agg(F.max_by("kind", "seq").alias("last_kind"), F.count_if(failed).alias("consecutive_failures"))


# What runs report in their entries.
STARTED, COMPLETE, FAILED, DEFERRED, IDLE = "run started", "run complete", "run failed", "first run deferred", "insufficient events"
DAY_MS, GRACE_DAYS, MONITOR_DAYS, EMIT_HOURS = 86_400_000, 2, 3, 6


def status(entries: DataFrame, job: str, own_source: bool) -> DataFrame:
    """(last_run_ms, last_success_ms, consecutive_failures, last_failure, last_kind, deferred) of a job's entries (seq, ms, content, source), one row; none where it never ran.

    With ``own_source`` (the curator's) entries must also bear the job as source; without (the detector's) a run with too
    few events is a success and a deferred one a run.
    """
    e = entries.where(F.startswith("content", F.lit(job)) & (F.coalesce(F.col("source") == job, F.lit(False)) if own_source else F.lit(True)))
    has = lambda mark: F.contains("content", F.lit(mark))
    kind = F.when(has(STARTED), "started").when(has(COMPLETE), "complete").when(has(FAILED), "failed")
    if not own_source:
        kind = kind.when(has(DEFERRED), "deferred").when(has(IDLE), "idle")
    e = e.withColumn("kind", kind).where("kind is not null")
    good = F.col("kind").isin("complete", "idle")
    success = e.agg(F.max(F.when(good, F.col("seq"))).alias("good_seq"))
    since = F.col("seq") > F.coalesce("good_seq", F.lit(-1))
    failed = (F.col("kind") == "failed") & since
    return (
        e.join(F.broadcast(success))  # one row
        .agg(
            F.max_by("ms", "seq").alias("last_run_ms"), F.max_by(F.when(good, F.col("ms")), F.when(good, F.col("seq"))).alias("last_success_ms"),
            F.count_if(failed).alias("consecutive_failures"), F.max_by(F.when(failed, F.col("content")), F.when(failed, F.col("seq"))).alias("last_failure"),
            F.max_by("kind", "seq").alias("last_kind"), F.coalesce(F.bool_or(F.col("kind") == "deferred"), F.lit(False)).alias("deferred"),
        )
        .where("last_run_ms is not null")
    )


def verdict(statuses: DataFrame, now_ms: int, set_over: float = 3.0, clear_up_to: float = 1.0) -> DataFrame:
    """``statuses`` (last_success_ms, last_kind, was_stale, first_seen_ms, ..) with days_since_success, in_progress, is_stale and first_observed_ms."""
    days = (F.lit(now_ms) - F.col("last_success_ms")) / DAY_MS
    stale = F.when(days.isNull() | (days < 0), False).when(F.coalesce("was_stale", F.lit(False)), days > clear_up_to).otherwise(days > set_over)
    return statuses.select(
        "*", days.alias("days_since_success"), (F.col("last_kind") == "started").alias("in_progress"), stale.alias("is_stale"),
        F.coalesce("first_seen_ms", F.lit(now_ms)).alias("first_observed_ms"),
    )


def notices(verdicts: DataFrame, now_ms: int) -> DataFrame:
    """(job, kind) to be shown: a monitor gone quiet, a job that never succeeded after its grace, a stale one; each at most once in six hours.

    Of (job, is_stale, last_success_ms, first_observed_ms, computed_ms, emitted_ms).
    """
    quiet = F.lit(now_ms) - F.col("computed_ms") > MONITOR_DAYS * DAY_MS
    kind = (
        F.when(quiet, "curate_monitor_stale")
        .when(F.col("last_success_ms").isNull() & (F.lit(now_ms) - F.col("first_observed_ms") > GRACE_DAYS * DAY_MS), "curate_never_succeeded")
        .when(F.col("is_stale"), "curate_liveness_stale")
    )
    free = F.col("emitted_ms").isNull() | (F.lit(now_ms) - F.col("emitted_ms") >= EMIT_HOURS * 3_600_000)
    return verdicts.where(free).select("job", kind.alias("kind")).where("kind is not null")


def hysteresis(gaps: DataFrame, set_over: float = 3.0, clear_up_to: float = 1.0) -> DataFrame:
    """(slug, flips, is_stale): each key's gaps folded in order; the verdict lights over ``set_over``, clears at ``clear_up_to``.

    A gap over the upper or up to the lower bound decides by itself, so the verdict is that of
    the last decisive gap, and flips are changes between decisive ones: no key is gathered.
    """
    from pyspark.sql import Window

    sure = F.when(F.col("gap") > set_over, True).when(F.col("gap") <= clear_up_to, False)
    w = Window.partitionBy("slug").orderBy("seq")
    now = F.coalesce(F.last(sure, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    state = gaps.withColumn("now", now).withColumn("was", F.coalesce(F.lag("now").over(w), F.lit(False)))
    return state.groupBy("slug").agg(F.count_if(F.col("now") != F.col("was")).alias("flips"), F.max_by("now", "seq").alias("is_stale"))
