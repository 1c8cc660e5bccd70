"""One JSON array in a file of any size, read by many tasks.

The file is cut at closing braces, wherever they stand, so every task gets whole records of
its byte range without knowing whether they begin inside a string, or how deep. What a
range does to that is a function of how it begins: it turns strings on or off as often as
it has quotes that aren't escaped, and changes the depth by one of two amounts. These
functions are composed along the file, a row for each range; then each range knows where it
begins and cuts its elements. An element that goes on in later ranges is put together from
its pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize

SPLIT = "spark.sql.files.maxPartitionBytes"
PIECE = "file string, block long, index long, lead boolean, tail boolean, raw string"
QUOTE, BACKSLASH, COMMA = (ord(c) for c in '"\\,')
OPEN, CLOSE = np.frombuffer(b"[{", dtype=np.uint8), np.frombuffer(b"]}", dtype=np.uint8)


def _records(spark: SparkSession, path: str) -> DataFrame:
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "block"))]
    return spark.read.option("lineSep", "}").text(path).select(*meta, F.col("value").cast("binary").alias("value"))


def _stretches(batches):
    """(file, block, first, bytes, rest of the batch's row): records of one range that follow one another, the brace before each put back."""
    before = None
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i < batch.num_rows and (files[i], blocks[i]) == (files[start], blocks[start]):
                continue
            own, values = (files[start], blocks[start]), batch.column(2)[start:i].to_pylist()
            new = own != before
            data = b"}".join(values) if new and own[1] == 0 else b"}" + b"}".join(values)  # only a file's first record has none before it
            yield *own, new, np.frombuffer(data, dtype=np.uint8), batch, start
            before, start = own, i


def _toggles(data: np.ndarray) -> np.ndarray:
    """Where strings begin or end: quotes after an even number of backslashes. A stretch begins with a brace, so no run of them comes from before."""
    at = np.flatnonzero(data == QUOTE)
    plain = np.maximum.accumulate(np.where(data != BACKSLASH, np.arange(len(data)), -1)) if len(data) else data
    run = at - 1 - np.where(at > 0, plain[np.maximum(at - 1, 0)], -1)
    out = np.zeros(len(data), dtype=np.int8)
    out[at[run % 2 == 0]] = 1
    return out


def _steps(data: np.ndarray) -> np.ndarray:
    return np.isin(data, OPEN).astype(np.int64) - np.isin(data, CLOSE).astype(np.int64)


def _summaries(batches):
    """A row for each range: how often strings are turned on or off, and the change of depth if it begins outside or inside one."""
    held = None
    for file, block, new, data, _, _ in _stretches(batches):
        if new:
            if held:
                yield _summary(*held)
            held = [file, block, 0, 0, 0]
        toggle, step = _toggles(data), _steps(data)
        inside = (np.cumsum(toggle) + held[2]) % 2 == 1
        held[2] += int(toggle.sum())
        held[3] += int(step[~inside].sum())
        held[4] += int(step[inside].sum())
    if held:
        yield _summary(*held)


def _summary(file: str, block: int, toggles: int, outside: int, inside: int) -> pa.RecordBatch:
    columns = [pa.array([file]), pa.array([block], pa.int64()), pa.array([toggles], pa.int64()), pa.array([outside], pa.int64()), pa.array([inside], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["file", "block", "toggles", "outside", "inside"])


def _elements(batches):
    """Elements that lie within a range, and the pieces of those that don't."""
    state = None
    for file, block, new, data, batch, row in _stretches(batches):
        if new:
            if state:
                yield from _rest(state)
            text, depth = batch.column(3)[row].as_py(), batch.column(4)[row].as_py()
            state = {"file": file, "block": block, "in": text, "depth": depth, "index": 0, "lead": depth > 0, "held": []}
        inside = (np.cumsum(_toggles(data)) + state["in"]) % 2 == 1
        depth = state["depth"] + np.cumsum(np.where(inside, 0, _steps(data)))
        before = np.concatenate(([state["depth"]], depth[:-1])) if len(data) else depth
        # an element begins after the array's bracket or a comma of the array, and ends before the next of them
        edge = np.flatnonzero(~inside & ((data == COMMA) & (depth == 1) | (before == 0) & (depth == 1) | (before == 1) & (depth == 0)))
        raw, at, rows = data.tobytes(), 0, []
        for e in edge.tolist():
            if before[e] > 0:
                state["held"].append(raw[at:e])
                rows.append(_row(state, tail=False))
            state["held"], state["lead"], at = [], False, e + 1
        if len(data):
            state["in"], state["depth"] = int((state["in"] + _toggles(data).sum()) % 2), int(depth[-1])
            if state["depth"] > 0:
                state["held"].append(raw[at:])
        if rows:
            yield _piece_rows([r for r in rows if r])
    if state:
        yield from _rest(state)


def _row(state: dict, tail: bool) -> tuple | None:
    text = b"".join(state["held"])
    lead = state["lead"]
    if not lead and not tail:
        text = text.strip()
        if not text:  # an empty array
            return None
    out = (state["file"], state["block"], state["index"], lead, tail, text.decode("utf-8", "replace"))
    state["index"] += 1
    return out


def _rest(state: dict):
    """What a range has of an element that ends in a later one."""
    if state["depth"] > 0:
        yield _piece_rows([_row(state, tail=True)])


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "block", "index", "lead", "tail", "raw"])


def read(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(file, block, index, raw): the elements of the array in the file, or in each file, at ``path``, as a written table.

    ``block`` and ``index`` order a file's elements. ``split_bytes``: how many bytes a task gets; by default
    what the session says. Raises ``ValueError`` where brackets don't match.
    """
    before = spark.conf.get(SPLIT)
    if split_bytes:
        spark.conf.set(SPLIT, str(split_bytes))
    try:
        records = _records(spark, path)
        parts = materialize(records.mapInArrow(_summaries, "file string, block long, toggles long, outside long, inside long"), "json-ranges")
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        text = parts.withColumn("text", F.coalesce(F.sum("toggles").over(earlier), F.lit(0)) % 2)
        step = text.withColumn("step", F.when(F.col("text") == 0, F.col("outside")).otherwise(F.col("inside")))
        begins = step.select("file", "block", "text", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("depth"), "step", "toggles")
        begins = materialize(begins, "json-begins")
        bad = begins.groupBy("file").agg(F.sum("step").alias("depth"), (F.sum("toggles") % 2).alias("text")).where("depth <> 0 or text <> 0")
        if not bad.isEmpty():
            raise ValueError(f"no whole JSON: {bad.first().file}")
        # a row of some 100 bytes for each range of many megabytes; the records stay in order
        known = records.join(F.broadcast(begins.select("file", "block", "text", "depth")), ["file", "block"], "left")
        pieces = materialize(known.select("file", "block", "value", "text", "depth").mapInArrow(_elements, PIECE), "json-pieces")
    finally:
        spark.conf.set(SPLIT, before)
    whole = pieces.where("not lead and not tail").select("file", "block", "index", "raw")
    cut = pieces.where("lead or tail")
    # a piece that goes on belongs to the last element that began before: the one cut off in the last range where one begins
    begun = F.when(~F.col("lead"), F.struct("block", "index"))
    along = Window.partitionBy("file").orderBy("block", "index").rowsBetween(Window.unboundedPreceding, 0)  # two rows at most for each range
    owned = cut.withColumn("owner", F.last(begun, ignorenulls=True).over(along))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "index", "raw"))), lambda x: x["raw"]), "")
    joined = owned.groupBy("file", "owner").agg(F.regexp_replace(text, r"^\s+|\s+$", "").alias("raw"))
    return whole.unionByName(joined.where("raw <> ''").select("file", "owner.block", "owner.index", "raw"))


def write(rows: DataFrame, order: str, path: str) -> None:
    """Rows as one JSON array in one file, in order: what others expect. One task writes it."""
    line = F.to_json(F.struct(*[c for c in rows.columns]), {"ignoreNullFields": "false"})
    last = F.row_number().over(Window.orderBy(F.desc(order))) == 1
    body = rows.select(F.lit(1).alias("k"), F.col(order).alias("o"), F.concat(line, F.when(last, "").otherwise(",")).alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, "["), (2, "]")], "k int, value string").select("k", F.lit(None).cast(dict(rows.dtypes)[order]).alias("o"), "value")
    body.unionByName(ends).coalesce(1).sortWithinPartitions("k", "o").select("value").write.text(path)
