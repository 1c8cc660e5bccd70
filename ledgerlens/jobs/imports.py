"""Imported markdown as log entries: topic files and dated logs, each file's entries in the order in which they are written.

Entries: (source_file, at, type, slug, principal, ts, tag, content, field, detail, socket). A file that can't be
read as a topic gives one row of ``errors`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import markdown

COLUMNS = ("source_file", "at", "type", "slug", "principal", "ts", "tag", "content", "field", "detail", "socket")
TOPIC_FILE = r"^[^/]*\.md$"


def _named(files: DataFrame) -> DataFrame:
    """``files`` (path, text) with their name."""
    return files.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))


def topics(files: DataFrame) -> DataFrame:
    """Topic files (path, text) taken apart; names without ``.md`` or with ``archive`` are left out."""
    own = _named(files).where(F.col("name").rlike(TOPIC_FILE) & ~F.contains("name", F.lit("archive")))
    t = markdown.topic_files(own)
    return t.withColumn("slug", F.coalesce("topic", F.regexp_replace("name", r"\.md$", "")))


def errors(files: DataFrame) -> DataFrame:
    """(path, error) of topic files that have no front matter."""
    return topics(files).where("error is not null").select("path", "error")


def topic_entries(files: DataFrame, principal: str, now: str) -> DataFrame:
    """Entries of topic files: metadata, verified, curated, summary, each section, each source block, and a seal for private ones."""
    t = topics(files).where("error is null")
    created = F.coalesce(markdown.iso_timestamp(F.col("created")), F.lit(now))
    summary = F.coalesce("summary", "slug")

    def entry(kind: str, ts: Column, tag=None, content=None, field=None, detail=None, who: str = principal, socket: str = "standard") -> Column:
        text = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c.cast("string")
        values = {
            "type": F.lit(kind), "principal": F.lit(who), "ts": ts, "tag": text(tag), "content": text(content), "field": text(field), "detail": text(detail), "socket": F.lit(socket),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    about = F.to_json(F.struct(F.coalesce("kind", F.lit("reference")).alias("type"), "tags", "entities", F.coalesce("status", F.lit("active")).alias("status"), "sensitivity", "created", summary.alias("summary"), F.col("trailing_blank").alias("summary_trailing_blank")))
    first = [
        entry("TOPIC_METADATA_SET", created, detail=about),
        F.when(markdown.iso_timestamp(F.col("last_verified")).isNotNull(), entry("TOPIC_VERIFIED", markdown.iso_timestamp(F.col("last_verified")))),
        F.when(markdown.iso_timestamp(F.col("last_curated")).isNotNull(), entry("TOPIC_CURATED", markdown.iso_timestamp(F.col("last_curated")))),
        entry("write_event", created, "FACT", summary, "summary"),
    ]
    heading = F.when(F.col("heading").isNull(), F.col("content")).otherwise(F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.col("content")))
    sections = markdown.sections(t.select("path", "curated")).where("content <> ''").groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("idx", "heading", heading.alias("content")))).alias("sections")
    )
    block = F.concat(F.lit("### "), F.col("date"), F.lit(" — "), F.col("title"), F.lit("\n"), F.col("content"))
    blocks = markdown.source_blocks(t.select("path", "source")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "date", block.alias("content")))).alias("blocks"))
    sealed = F.array(F.when(F.col("sensitivity") == "private", entry("ACL_SEALED", created, detail=F.to_json(F.struct(F.array(F.lit(principal), F.lit("operator")).alias("readers"))), who="operator", socket="admin")))
    empty = lambda c, of: F.coalesce(c, of)
    curated = F.transform("sections", lambda x: entry("write_event", created, "CURATED", x["content"], "curated", x["heading"]))
    source = F.transform("blocks", lambda x: entry("write_event", F.concat(x["date"], F.lit("T00:00:00Z")), "SOURCE", x["content"], "source", x["date"]))
    none = F.array_compact(F.array(F.when(F.lit(False), first[0])))
    whole = F.concat(F.array_compact(F.array(*first)), empty(curated, none), empty(source, none), F.array_compact(sealed))
    rows = t.join(sections, "path", "left").join(blocks, "path", "left").select(F.col("path").alias("source_file"), "slug", F.posexplode(whole).alias("at", "e"))
    return rows.select("source_file", "at", "e.type", "slug", "e.principal", "e.ts", "e.tag", "e.content", "e.field", "e.detail", "e.socket")


def log_entries(files: DataFrame, admissible: DataFrame, principal: str = "operator") -> DataFrame:
    """Entries of dated logs ``YYYY-MM-DD.md`` (path, text): topics that are not admissible (slug) yet, then the lines' writes.

    ``detail`` holds what brings a line back as it was: its number and text, the comment it
    stands under, blank lines before it, and the date's header for the first.
    """
    dated = _named(files).where(F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}\.md$")).withColumn("date", F.substring("name", 1, 10))
    events = markdown.with_context(markdown.event_lines(markdown.lines(dated.select("path", "date", "text"))), "path", "date")
    detail = F.to_json(F.struct(
        (F.col("line_no") + 1).alias("source_line"), "date", "auto_extracted", "confidence", "context_comment", F.col("principal").isNotNull().alias("principal_was_prefixed"),
        F.rtrim(F.regexp_replace("line", r"\s+$", "")).alias("raw_line"), "prefix_blanks", (F.col("ordinal") == 0).alias("first_of_date"), F.when(F.col("ordinal") == 0, F.col("date_header")).alias("date_header"),
    ))
    null = F.lit(None).cast("string")
    writes = events.select(
        F.col("path").alias("source_file"), (F.col("ordinal") + 1_000_000).alias("at"), F.lit("write_event").alias("type"), "slug", F.coalesce("principal", F.lit(principal)).alias("principal"),
        "ts", "tag", "content", F.lit("events").alias("field"), detail.alias("detail"), F.lit("standard").alias("socket"),
    )
    # an earlier file makes the topic for later ones
    missing = events.join(admissible.select("slug"), "slug", "left_anti").groupBy("slug").agg(F.min(F.struct("date", "ordinal", "path")).alias("f"))
    made = missing.select(
        F.col("f.path").alias("source_file"), F.col("f.ordinal").alias("at"), F.lit("TOPIC_METADATA_SET").alias("type"), "slug", F.lit(principal).alias("principal"),
        F.concat(F.col("f.date"), F.lit("T12:00:00Z")).alias("ts"), null.alias("tag"), null.alias("content"), null.alias("field"),
        F.lit('{"type":"reference","status":"active"}').alias("detail"), F.lit("standard").alias("socket"),
    )
    return made.unionByName(writes)


def counts(files: DataFrame) -> DataFrame:
    """(path, events, unrecognized) of dated logs."""
    lines = markdown.event_lines(markdown.lines(files.select("path", "text")))
    return lines.groupBy("path").agg(F.count_if(F.col("kind") == "event").alias("events"), F.count_if(F.col("kind") == "unrecognized").alias("unrecognized"))


def directory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(topic files, dated logs) under a folder, each (path, text): its ``topics`` and ``events`` folders, or topic files in the folder itself."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    is_dir = lambda p: fs.exists(hadoop(p)) and fs.getFileStatus(hadoop(p)).isDirectory()
    whole = lambda p: spark.read.text(p, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    none = spark.createDataFrame([], "path string, text string")
    parted = is_dir(f"{path}/topics")
    return whole(f"{path}/topics" if parted else path), whole(f"{path}/events") if parted and is_dir(f"{path}/events") else none
