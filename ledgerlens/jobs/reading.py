"""Reading a store by its files: topic index, dated logs by range, topics by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug_ok
from ..sources import markdown

# The grammar of dated lines as readers see it, and of ids.
EVENT_LINE = r"^\[(?:AUTO-)?(DECISION|FACT|CHANGED|PROCEDURE|TODO|EVENT|SECURITY|CURATION)(?::(CONFIRMED|TENTATIVE|CONTEXT))?\]\s+([a-z0-9-]+):\s+(?:\[([^\]]+)\]\s+)?(.+)$"
TOPIC_ID = r"^topic:([a-z0-9]+(?:-[a-z0-9]+)*)(?:#layer-([12]))?$"
EVENT_ID = r"^event:(\d{4}-\d{2}-\d{2}):(\d+)$"
HANDOFF_ID = r"^handoff:([A-Za-z0-9._-]+\.md)$"


def index_rows(lines: DataFrame) -> DataFrame:
    """(slug, kind, tags, status, summary) of index lines (line) with five fields; headings, fences and notes are no rows."""
    t = F.trim("line")
    own = lines.where((t != "") & ~t.rlike("^(?:#|`|Last generated|Auto-generated)"))
    parts = F.transform(F.split(F.regexp_replace(F.regexp_replace(t, r"^\|", ""), r"\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = own.select(parts.alias("p")).where((F.size("p") >= 5) & (F.get("p", F.lit(0)) != ""))
    tags = F.filter(F.transform(F.split(F.get("p", F.lit(2)), ","), lambda x: F.trim(x)), lambda x: x != "")
    at = lambda i: F.get("p", F.lit(i))
    return rows.select(at(0).alias("slug"), at(1).alias("kind"), tags.alias("tags"), at(3).alias("status"), at(4).alias("summary"))


def index_error(rows: DataFrame) -> DataFrame:
    """(code), one row: INDEX_PARSE_ERROR where an index has no row."""
    return rows.agg(F.when(F.count("*") == 0, "INDEX_PARSE_ERROR").alias("code"))


def events(logs: DataFrame, until: str, days: int = 1, exclude_source: str | None = None, slug: str | None = None) -> DataFrame:
    """(date, line_no, tag, confidence, slug, source, content) of dated logs (date, text), the ``days`` up to ``until``.

    Dates are compared before any text is taken apart.
    """
    if not 1 <= days <= 30:
        raise ValueError("1 to 30 days")
    first = F.date_format(F.date_sub(F.lit(until).cast("date"), days - 1), "yyyy-MM-dd")
    rows = markdown.lines(logs.where(F.col("date").between(first, F.lit(until))).select("date", "text"))
    t = F.trim("line")
    part = lambda i: F.nullif(F.regexp_extract(t, EVENT_LINE, i), F.lit(""))
    names = ("tag", "confidence", "slug", "source", "content")
    found = rows.where(~F.startswith(t, F.lit("<!--")) & t.rlike(EVENT_LINE)).select("date", "line_no", *[part(i).alias(n) for i, n in enumerate(names, 1)])
    if exclude_source is not None:
        found = found.where(F.col("source").isNull() | (F.col("source") != exclude_source))
    return found if slug is None else found.where(F.col("slug") == slug)


def fetched(asked: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """(ask_id, id, title, text, url, code) of asked ids (ask_id, id): a topic's layer, or the code that says why not.

    ``files`` is (slug, text), ``index`` the known topics (slug). Layer 1 is the front matter's fields, layer 2 the curated text.
    """
    topic, layer = F.regexp_extract("id", TOPIC_ID, 1), F.coalesce(F.nullif(F.regexp_extract("id", TOPIC_ID, 2), F.lit("")), F.lit("2"))
    a = asked.select("ask_id", "id", F.nullif(topic, F.lit("")).alias("slug"), layer.alias("layer"))
    known = index.select("slug", F.lit(True).alias("known")).distinct()
    t = markdown.topic_files(files)
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.col(c)) for k, c in (("type", "kind"), ("status", "status"), ("created", "created"), ("summary", "summary"))])
    own = t.select("slug", head.alias("one"), F.col("curated").alias("two"))
    rows = a.join(known, "slug", "left").join(own, "slug", "left")
    deferred = F.col("id").rlike(EVENT_ID) | F.col("id").rlike(HANDOFF_ID)
    code = (
        F.when(F.coalesce(deferred, F.lit(False)), "FETCH_KIND_DEFERRED")
        .when(F.col("slug").isNull() | ~slug_ok(F.col("slug")), "FETCH_UNKNOWN_ID")
        .when(F.col("known").isNull(), "FETCH_NOT_FOUND")
        .when(F.col("two").isNull(), "FETCH_FILE_MISSING")
    )
    full = F.concat(F.lit("topic:"), F.col("slug"), F.lit("#layer-"), F.col("layer"))
    good = lambda c: F.when(F.col("code").isNull(), c)
    return rows.withColumn("code", code).select(
        "ask_id", F.coalesce(good(full), "id").alias("id"), good(F.concat(F.col("slug"), F.lit(" (layer "), F.col("layer"), F.lit(")"))).alias("title"),
        good(F.when(F.col("layer") == "1", F.col("one")).otherwise(F.col("two"))).alias("text"), good(F.concat(F.lit("topic/"), F.col("slug"), F.lit("#layer-"), F.col("layer"))).alias("url"), "code",
    )


def handoffs(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, modified) of the files in a folder, their contents unread."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
