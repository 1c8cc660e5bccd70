"""Hash chains: entries written in order, and which entries of a log its chain accepts.

An entry's hash covers the whole entry, ``hash_prev`` included. A log is walked from
genesis: an entry is accepted if its ``hash_prev`` is the hash of the last accepted one.
Entries that chain to the one just before form runs, found by windows over hashes alone.
From a run's end the walk jumps to the first later entry that names the end's hash, an
equi-join; which runs the walk meets is found by doubling the jumps.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import of_json
from ..sources.storage import materialize

GENESIS = "0" * 64
VERSION = "v12.5.0"
#: Rows of a range that a log is cut into for its windows, about, and ranges at least.
PART_ROWS, PARTS = 1_000_000, 64


def written(entries: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """(log, pos, seq, hash_prev, self_hash, raw): entries (log, pos, type, intent_id, principal, ts, payload) as canonical lines, chained.

    A log goes on where ``tails`` (log, seq, hash) says it ended, or begins. A chain is made one
    entry after another, so a log's new entries are written by one task; logs are written side by
    side. ``payload`` is JSON.
    """

    def write(log: pd.DataFrame) -> pd.DataFrame:
        rows, first = [], log.iloc[0]
        before, start = (GENESIS, 1) if pd.isna(first.tail_hash) else (first.tail_hash, int(first.tail_seq) + 1)
        for seq, e in enumerate(log.sort_values("pos").itertuples(), start):
            entry = {
                "type": e.type, "schema_version": VERSION, "is_state_bearing": True, "seq": seq, "hash_prev": before,
                "intent_id": e.intent_id, "principal": e.principal, "ts": e.ts, "payload": json.loads(e.payload or "{}"),
            }
            raw = of_json(json.dumps(entry))
            own = hashlib.sha256(raw.encode()).hexdigest()
            rows.append((e.log, e.pos, seq, before, own, raw))
            before = own
        return pd.DataFrame(rows, columns=["log", "pos", "seq", "hash_prev", "self_hash", "raw"])

    columns = entries.select("log", "pos", "type", "intent_id", "principal", "ts", "payload")
    if tails is None:
        columns = columns.withColumns({"tail_seq": F.lit(None).cast("long"), "tail_hash": F.lit(None).cast("string")})
    else:
        columns = columns.join(tails.select("log", F.col("seq").alias("tail_seq"), F.col("hash").alias("tail_hash")), "log", "left")
    return columns.groupBy("log").applyInPandas(write, "log string, pos long, seq long, hash_prev string, self_hash string, raw string")


def previous(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` (log, pos, ..) with the value of the log's row before, without one task for all rows of a log.

    A log's positions are cut into ranges, as many as rows ask for; a range's first row takes the last
    value of the ranges before. The rows are written first, as they are read for their bounds, for the
    ranges and for the carried values.
    """
    rows = materialize(rows, "chain-rows")
    ends = rows.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).first()
    width = max(1, ((ends["hi"] or 0) - (ends["lo"] or 0)) // max(PARTS, ends["n"] // PART_ROWS) + 1)
    cut = rows.withColumn("part", F.floor((F.col("pos") - F.lit(ends["lo"] or 0)) / width))
    last = cut.groupBy("log", "part").agg(F.max_by(value, "pos").alias("last"))
    carried = last.select("log", "part", F.lag("last").over(Window.partitionBy("log").orderBy("part")).alias("carried"))
    inside = F.lag(value).over(Window.partitionBy("log", "part").orderBy("pos"))
    return cut.withColumn("inside", inside).join(carried, ["log", "part"]).withColumn(name, F.coalesce("inside", "carried")).drop("inside", "carried")


def runs(rows: DataFrame) -> DataFrame:
    """``rows`` (log, pos, hash_prev, self_hash) with their run's number: a new one begins where an entry does not name the one before."""
    r = previous(rows, "self_hash", "before")
    r = materialize(r.withColumn("head", (~F.coalesce(F.col("hash_prev") == F.col("before"), F.lit(False))).cast("long")), "chain-heads")
    heads = r.groupBy("log", "part").agg(F.sum("head").alias("heads"))
    earlier = Window.partitionBy("log").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = heads.select("log", "part", F.coalesce(F.sum("heads").over(earlier), F.lit(0)).alias("earlier"))
    within = F.sum("head").over(Window.partitionBy("log", "part").orderBy("pos"))
    numbered = r.withColumn("within", within).join(before, ["log", "part"])
    return numbered.withColumn("run", F.col("earlier") + F.col("within")).select("log", "pos", "run", "hash_prev", "self_hash")


def accepted(rows: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(log, pos): the rows (log, pos, hash_prev, self_hash) that each log's chain accepts; give rows of good shape.

    A walk begins at genesis, or goes on from ``anchors`` (log, pos, hash), the last row accepted by an
    earlier one: then only rows after it are looked at and returned.
    """
    if anchors is not None:
        known = anchors.select("log", F.col("pos").alias("anchor"), "hash")
        rows = rows.join(known, "log", "left").where(F.col("anchor").isNull() | (F.col("pos") > F.col("anchor"))).select(*rows.columns)
    r = materialize(runs(rows), "chain-runs")
    tails = r.groupBy("log", "run").agg(F.max("pos").alias("tail"), F.max_by("self_hash", "pos").alias("hash_prev"))
    later = r.select("log", F.col("pos").alias("land"), F.col("run").alias("to"), "hash_prev")
    jumps = tails.join(later, ["log", "hash_prev"]).where("land > tail").groupBy("log", "run").agg(F.min_by(F.struct("to", "land"), "land").alias("j"))
    jumps = materialize(jumps.select("log", "run", F.col("j.to").alias("to"), F.col("j.land").alias("land")), "chain-jumps")
    begin = F.lit(GENESIS)
    from_ = r
    if anchors is not None:
        from_, begin = r.join(anchors.select("log", "hash"), "log", "left"), F.coalesce("hash", F.lit(GENESIS))
    start = from_.where(F.col("hash_prev") == begin).groupBy("log").agg(F.min_by(F.struct("run", "pos"), "pos").alias("s"))
    # the runs met so far, with where they are entered, and jumps of 1, 2, 4 .. runs
    met = materialize(start.select("log", F.col("s.run").alias("run"), F.col("s.pos").alias("entered")), "chain-met")
    far = jumps
    while not far.isEmpty():
        reached = met.join(far, ["log", "run"]).select("log", F.col("to").alias("run"), F.col("land").alias("entered"))
        met = materialize(met.unionByName(reached).groupBy("log", "run").agg(F.min("entered").alias("entered")), "chain-met")
        next_ = far.select("log", F.col("run").alias("to"), F.col("to").alias("onward"), F.col("land").alias("landed"))
        far = materialize(far.join(next_, ["log", "to"]).select("log", "run", F.col("onward").alias("to"), F.col("landed").alias("land")), "chain-far")
    return r.join(met, ["log", "run"]).where("pos >= entered").select("log", "pos")


def anchors(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(log, pos, hash): where a walk over rows (log, pos, self_hash) that accepted ``held`` (log, pos) can go on."""
    own = rows.join(held, ["log", "pos"], "left_semi")
    return own.groupBy("log").agg(F.max("pos").alias("pos"), F.max_by("self_hash", "pos").alias("hash"))


def skipped(rows: DataFrame, shape_ok: str = "shape_ok") -> DataFrame:
    """(log, pos, reason): malformed_entry_shape, or hash_chain_break for rows of good shape that the chain doesn't accept."""
    good = rows.where(F.col(shape_ok))
    held = accepted(good.select("log", "pos", "hash_prev", "self_hash"))
    broken = good.select("log", "pos").join(held, ["log", "pos"], "left_anti").withColumn("reason", F.lit("hash_chain_break"))
    return rows.where(~F.col(shape_ok)).select("log", "pos", F.lit("malformed_entry_shape").alias("reason")).unionByName(broken)


def strict(skips: DataFrame) -> DataFrame:
    """(log, n, refused): whether a log may not be projected, as some entry of it was skipped."""
    return skips.groupBy("log").agg(F.count("*").alias("n")).withColumn("refused", F.col("n") > 0)


def tail_safe(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(log, last_seq, tail_seq, safe): whether the last physical row (log, pos, seq) is the last one accepted (log, pos)."""
    physical = rows.groupBy("log").agg(F.max_by("seq", "pos").alias("tail_seq"))
    folded = rows.join(held, ["log", "pos"], "left_semi").groupBy("log").agg(F.max_by("seq", "pos").alias("last_seq"))
    both = physical.join(folded, "log", "left").withColumn("last_seq", F.coalesce("last_seq", F.lit(0)))
    return both.select("log", "last_seq", "tail_seq", (F.col("last_seq") == F.col("tail_seq")).alias("safe"))
