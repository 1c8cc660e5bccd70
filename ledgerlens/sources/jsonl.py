"""Operation logs as JSON lines: month files in order, torn tails left out.

A month is one file ``YYYY-MM.jsonl``, or a folder ``log_file=YYYY-MM.jsonl`` of parts in order,
as ``write`` makes it. Lines end with a line feed; a carriage return before it is part of the line.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import entry_hash
from .storage import materialize

ENTRY = "type string, schema_version string, is_state_bearing boolean, seq long, hash_prev string, intent_id string, principal string, ts string"
LINES = "log_file string, place struct<file:string, block:long, line:long>, raw string, torn boolean"
MONTH_FILE = r"(?:^|/)(?:log_file=)?(\d{4}-\d{2}\.jsonl)(?:/[^/]*)?$"


def month_files(spark: SparkSession, path: str) -> dict[str, list[tuple[str, int, int]]]:
    """Files under ``path`` by month, ``YYYY-MM``: (file, bytes, time of its last change), in order.

    Only names and sizes are asked for. Months are few; a month's parts are as many as its writer's tasks.
    """
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[tuple[str, int, int]]] = {}
    if fs.exists(top):
        files = fs.listFiles(top, True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            month = re.search(MONTH_FILE, name)
            if month and not os.path.basename(name).startswith(("_", ".")):
                found.setdefault(month[1][:7], []).append((name, f.getLen(), f.getModificationTime()))
    return {m: sorted(v) for m, v in sorted(found.items())}


def _lines(spark: SparkSession, path: str, months: list[str] | None) -> DataFrame:
    """(log_file, place, raw, torn): every line, written once so that places stay; of given months only their files are read.

    A file's last line lacks its line feed exactly if the file is one byte shorter than its
    lines and their line feeds.
    """
    if months is not None:
        files = month_files(spark, path)
        path = [name for m in months for name, _, _ in files.get(m, [])]
        if not path:
            return spark.createDataFrame([], LINES)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select(
        F.regexp_extract("_metadata.file_path", MONTH_FILE, 1).alias("log_file"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("raw"),
    ).where("log_file <> ''")
    lines = materialize(lines, "log-lines")
    files = lines.groupBy("place.file").agg(F.max("size").alias("bytes"), F.sum(F.octet_length("raw") + 1).alias("read"), F.max("place").alias("place"))
    torn = files.where("read > bytes").select("place", F.lit(True).alias("torn"))
    return lines.join(torn, "place", "left").select("log_file", "place", "raw", F.coalesce("torn", F.lit(False)).alias("torn"))


def read(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """(log_file, place, raw) of the lines of month files under ``path``; blank lines and a last line without line feed are dropped."""
    return _lines(spark, path, months).where("not torn and raw <> ''").select("log_file", "place", "raw")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines as entries, with ``payload_raw``, ``self_hash`` and ``shape_ok``; lines that are no JSON are dropped."""
    rows = lines.where(F.try_parse_json("raw").isNotNull()).withColumn("e", F.from_json("raw", ENTRY))
    rows = rows.select("log_file", "place", "raw", "e.*", F.get_json_object("raw", "$.payload").alias("payload_raw"), entry_hash(F.col("raw")).alias("self_hash"))
    ok = F.col("seq").isNotNull() & F.col("type").isNotNull() & F.col("principal").isNotNull() & F.col("intent_id").isNotNull() & (F.length("hash_prev") == 64)
    return rows.withColumn("shape_ok", F.coalesce(ok, F.lit(False)))


def tail(spark: SparkSession, path: str) -> DataFrame:
    """(log_file, seq, self_hash) of the last line that is an entry with a number, one without its line feed included; no row for none."""
    seq = F.expr("try_cast(get_json_object(raw, '$.seq') as long)")
    valid = _lines(spark, path, None).withColumn("seq", seq).where(F.try_parse_json("raw").isNotNull() & (F.col("seq") >= 1))
    last = valid.agg(F.max_by(F.struct("log_file", "seq", "raw"), F.struct("log_file", "place")).alias("l")).where("l is not null")
    return last.select("l.log_file", "l.seq", entry_hash(F.col("l.raw")).alias("self_hash"))


def write(entries: DataFrame, path: str, line: str | None = None) -> None:
    """Entries (ts, seq and the fields of a line, or the line itself in ``line``) as month files, ordered by seq within each.

    Rows are dealt out by ranges of month and seq, so a large month is several parts in order.
    """
    raw = F.col(line) if line else F.to_json(F.struct(*entries.columns))
    month = F.concat(F.substring(F.col("ts").cast("string"), 1, 7), F.lit(".jsonl"))
    rows = entries.select(month.alias("log_file"), "seq", raw.alias("value"))
    rows.repartitionByRange("log_file", "seq").sortWithinPartitions("log_file", "seq").drop("seq").write.partitionBy("log_file").text(path)
