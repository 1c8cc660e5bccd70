"""Asked rows against all rows, tile by tile.

Both sides are dealt to blocks of bounded size and meet in tiles, one block of each:
an equi-join on the two block numbers. No side is broadcast or collected, a tile fits
a task whatever the tables' sizes, and a tile's result can be cut down where it arises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, ASKED = 16_384, 512


def dealt(rows: DataFrame, asked: DataFrame, by: str, asked_by: str, per_rows: int = ROWS, per_asked: int = ASKED) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tiles' numbers ``row_block`` and ``asked_block``; counts both, so give written tables."""
    r, a = max(1, -(-rows.count() // per_rows)), max(1, -(-asked.count() // per_asked))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return (
        rows.withColumn("row_block", block(by, r)).withColumn("asked_block", every(a)),
        asked.withColumn("asked_block", block(asked_by, a)).withColumn("row_block", every(r)),
    )


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, padded with zeros, and their lengths; null ones have length 0."""
    lists = [np.asarray(x, dtype=float) if x is not None else np.zeros(0) for x in column.to_pylist()]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    out = np.zeros((len(lists), int(sizes.max()) if len(sizes) else 0))
    for i, x in enumerate(lists):
        out[i, : len(x)] = np.nan_to_num(x)
    return out, sizes


def _similarities(rows: pa.Table, asked: pa.Table) -> np.ndarray:
    """Dot product of each row's vector with each asked one; 0 where their lengths differ."""
    x, n = _matrix(rows["embedding"])
    q, m = _matrix(asked["vector"])
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, q))
    return np.where(n[:, None] == m[None, :], x @ q.T, 0.0)


def nearest(vectors: DataFrame, asked: DataFrame, floor: float, limit: int) -> DataFrame:
    """(qid, key, score, rank): for each asked (qid, vector) the best ``limit`` of (key, embedding) with a dot product of ``floor`` or more."""
    left, right = dealt(vectors.select("key", "embedding"), asked.select("qid", "vector"), "key", "qid")

    def tile(rows: pa.Table, some: pa.Table) -> pa.Table:
        keys, found = rows["key"].to_pylist(), []
        sims = _similarities(rows, some)
        for j, qid in enumerate(some["qid"].to_pylist()):
            at = np.flatnonzero(sims[:, j] >= floor)
            if len(at) > limit:  # the tile's best: all that may tie with the last of them, then by key
                last = np.partition(sims[at, j], len(at) - limit)[len(at) - limit]
                at = at[sims[at, j] >= last - 2e-9]
                at = np.array(sorted(at.tolist(), key=lambda i: (-round(sims[i, j], 9), keys[i]))[:limit])
            found += [(qid, keys[i], float(sims[i, j])) for i in at.tolist()]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], ["qid", "key", "score"])

    by = ["row_block", "asked_block"]
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, "qid long, key string, score double")
    return top(best, limit)


def top(scored: DataFrame, limit: int) -> DataFrame:
    """(.., rank): the best ``limit`` rows of each qid by score, then key."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "key"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def best_of_groups(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, session, key, score): for each asked (qid, vector) the best of each session's (key, session, embedding), a row's own key aside."""
    left, right = dealt(vectors.select("key", "session", "embedding"), asked.select("qid", "vector"), "key", "qid")

    def tile(rows: pa.Table, some: pa.Table) -> pa.Table:
        keys, sessions = np.array(rows["key"].to_pylist()), np.array(rows["session"].to_pylist())
        sims, found = np.round(_similarities(rows, some), 9), []
        for j, qid in enumerate(some["qid"].to_pylist()):
            order = np.lexsort((keys, -sims[:, j]))
            order = order[keys[order] != qid]
            _, first = np.unique(sessions[order], return_index=True)
            found += [(qid, int(sessions[i]), int(keys[i]), float(sims[i, j])) for i in order[first].tolist()]
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["qid", "session", "key", "score"])

    by = ["row_block", "asked_block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, "qid long, session long, key long, score double")
    best = F.max(F.struct("score", (-F.col("key")).alias("k"))).alias("best")
    return found.groupBy("qid", "session").agg(best).select("qid", "session", (-F.col("best.k")).alias("key"), F.col("best.score").alias("score"))
