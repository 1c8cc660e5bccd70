"""Streams whose state is kept by key: verdicts with hysteresis, notices with timers, read offsets.

Each processor holds a few numbers for a key in the state store and changes them row by
row, in the order of the rows' numbers within a micro-batch. Progress and state lie in
the stream's folder, so a stream that is stopped goes on where it was; a batch that is
run again writes the same rows to the same place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..jobs.liveness import DAY_MS, EMIT_HOURS, GRACE_DAYS
from ..jobs.transcripts import cut, worth_reading

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMIT_MS = EMIT_HOURS * 3_600_000


class Hysteresis(StatefulProcessor):
    """(slug, flips, is_stale) after each batch of gaps: lit over the upper bound, dark again up to the lower."""

    OUT = "slug string, flips long, is_stale boolean"

    def __init__(self, set_over: float = 3.0, clear_up_to: float = 1.0):
        self.set_over, self.clear_up_to = set_over, clear_up_to

    def init(self, handle):
        self.state = handle.getValueState("verdict", "flips long, is_stale boolean, seq long")

    def handleInputRows(self, key, rows, timerValues):
        flips, stale, last = tuple(self.state.get()) if self.state.exists() else (0, False, None)
        for r in sorted(rows, key=lambda r: r.seq):
            if last is not None and r.seq <= last:
                continue  # came before
            now = r.gap > (self.clear_up_to if stale else self.set_over)
            flips, stale, last = flips + (now != stale), now, r.seq
        self.state.update((flips, stale, last))
        yield Row(slug=key[0], flips=flips, is_stale=stale)

    def close(self):
        pass


class Watch:
    """What is known of a job: when it was first seen and last succeeded, whether its light is on, when a notice was last shown, when to look again."""

    FIELDS = "first long, success long, stale boolean, emitted long, deadline long, seq long"

    def __init__(self, first=None, success=None, stale=False, emitted=None, deadline=None, seq=None):
        self.first, self.success, self.stale, self.emitted, self.deadline, self.seq = first, success, stale, emitted, deadline, seq

    def values(self) -> tuple:
        return self.first, self.success, self.stale, self.emitted, self.deadline, self.seq

    def look(self, now: int) -> str | None:
        """The notice due at ``now``, if any: one in six hours at most."""
        never = self.success is None and now - self.first > GRACE_DAYS * DAY_MS
        self.stale = self.success is not None and now >= self.success and now - self.success > (1 if self.stale else 3) * DAY_MS
        kind = "curate_never_succeeded" if never else "curate_liveness_stale" if self.stale else None
        if kind is None or self.emitted is not None and now - self.emitted <= EMIT_MS:
            return None
        self.emitted = now
        return kind

    def run(self, ms: int, complete: bool) -> list[tuple[str, int]]:
        """Notices up to a run's entry at ``ms``, the one of a deadline that has passed included."""
        found = self.expire() if self.deadline is not None and self.deadline < ms else []
        self.first = ms if self.first is None else self.first
        self.success = ms if complete else self.success
        if kind := self.look(ms):
            found.append((kind, ms))
        due = self.first + GRACE_DAYS * DAY_MS + 1 if self.success is None else self.success + 3 * DAY_MS + 1
        self.deadline = due if due > ms else None
        return found

    def expire(self) -> list[tuple[str, int]]:
        at, self.deadline = self.deadline, None
        kind = self.look(at)
        return [(kind, at)] if kind else []


class Notices(StatefulProcessor):
    """(slug, kind, at_ms): notices of jobs that never succeeded or went stale, at entries and, where there are none, at timers."""

    OUT = "slug string, kind string, at_ms long"

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("watch", Watch.FIELDS)

    def _watch(self) -> Watch:
        return Watch(*self.state.get()) if self.state.exists() else Watch()

    def handleInputRows(self, key, rows, timerValues):
        watch = self._watch()
        before = watch.deadline
        for r in sorted(rows, key=lambda r: r.seq):
            if watch.seq is not None and r.seq <= watch.seq:
                continue
            watch.seq = r.seq
            for kind, at in watch.run(r.ms, r.complete):
                yield Row(slug=key[0], kind=kind, at_ms=at)
        if watch.deadline != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if watch.deadline is not None:
                self.handle.registerTimer(watch.deadline)
        self.state.update(watch.values())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watch = self._watch()
        if watch.deadline == expiredTimerInfo.getExpiryTimeInMs():
            for kind, at in watch.expire():
                yield Row(slug=key[0], kind=kind, at_ms=at)
            self.state.update(watch.values())

    def close(self):
        pass


class Offsets(StatefulProcessor):
    """(conv_id, last_turn, n_messages, words) of sessions: turns that were read are not read again."""

    OUT = "conv_id long, last_turn long, n_messages long, words long"

    def init(self, handle):
        self.state = handle.getValueState("offset", "last_turn long, n_messages long, words long")

    def handleInputRows(self, key, rows, timerValues):
        done, n, words = tuple(self.state.get()) if self.state.exists() else (-1, 0, 0)
        last = done
        for r in rows:  # in any order: only what lies beyond the offset that held before this batch counts
            if r.turn > done:
                last = max(last, r.turn)
                n += r.counts
                words += r.words
        self.state.update((last, n, words))
        yield Row(conv_id=key[0], last_turn=last, n_messages=n, words=words)

    def close(self):
        pass


def _advance(rows: DataFrame, by: str, processor: StatefulProcessor, time_mode: str, root: str) -> None:
    """Run a processor over what its source has that wasn't read before; each batch is written under its number."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    try:
        out = rows.groupBy(by).transformWithState(processor, processor.OUT, "Update", time_mode)
        query = out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _written(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(f"{root}/out")


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """The last batch's row of each key."""
    others = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(key, "x.*")


def hysteresis(gaps: DataFrame, root: str) -> DataFrame:
    """Verdicts by slug of a stream (slug, seq, gap), as far as it has come."""
    _advance(gaps, "slug", Hysteresis(), "None", root)
    return _latest(_written(gaps.sparkSession, root, Hysteresis.OUT), "slug")


def notices(runs: DataFrame, root: str, delay: str = "0 seconds") -> DataFrame:
    """Notices of a stream (slug, seq, ts, complete), as far as it has come; ``delay``: how late entries may be."""
    timed = runs.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    _advance(timed, "slug", Notices(), "EventTime", root)
    return _written(runs.sparkSession, root, Notices.OUT).drop("batch")


def offsets(turns: DataFrame, root: str) -> DataFrame:
    """How far each session of a stream (conv_id, turn, role, text) was read, and the words worth reading."""
    has = F.size(F.filter(F.split(cut("text"), r"\s+"), lambda w: w != "")).cast("long")
    rows = turns.select("conv_id", "turn", worth_reading(F.col("role"), F.col("text")).cast("long").alias("counts"), has.alias("words"))
    rows = rows.withColumn("words", F.when(F.col("counts") == 1, F.col("words")).otherwise(0))
    _advance(rows, "conv_id", Offsets(), "None", root)
    return _latest(_written(turns.sparkSession, root, Offsets.OUT), "conv_id")


def in_parts(rows: DataFrame, parts: list, path: str, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows reach a stream's folder part by part, and the stream is started anew after each: its last result."""
    spark, found = rows.sparkSession, None
    for k, part in enumerate(parts):
        rows.where(part).write.parquet(f"{path}/part={k}")
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)
        found = stream(source)
    return found
