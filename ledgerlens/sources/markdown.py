"""Topic files and event logs in markdown, taken apart with regular expressions in the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The line grammar of event logs and the markers of topic files.
TAG_LINE = r"^\[(AUTO-)?([A-Z]+)(?::([A-Z]+))?\]\s+([a-z0-9][a-z0-9_-]*)\s*:\s*(.*)$"
COMMENT_LINE = r"^<!--\s*(.*?)\s*-->$"
HEADER_LINE = r"^#+\s+.+$"
PRINCIPAL = r"^\[([a-zA-Z0-9._-]+)\]\s*(.*)$"
MARKERS = {"curated": ("<!-- CURATED_START -->", "<!-- CURATED_END -->"), "source": ("<!-- SOURCE_START -->", "<!-- SOURCE_END -->")}


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """Every line of each file's text with its number from 0."""
    return files.select(*[c for c in files.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def event_lines(rows: DataFrame, line: str = "line") -> DataFrame:
    """``rows`` with kind (event, comment, header, unrecognized, blank), tag, auto, confidence, slug, principal, content."""
    t = F.trim(F.col(line))
    kind = (
        F.when(t == "", "blank").when(t.rlike(COMMENT_LINE), "comment").when(t.rlike(HEADER_LINE), "header").when(t.rlike(TAG_LINE), "event").otherwise("unrecognized")
    )
    part = lambda i: F.regexp_extract(t, TAG_LINE, i)
    event, rest = kind == "event", part(5)
    prefixed = rest.rlike(PRINCIPAL)
    return rows.select(
        "*",
        kind.alias("kind"),
        F.when(event, part(2)).alias("tag"),
        F.when(event, part(1) != "").alias("auto_extracted"),
        F.when(event & (part(3) != ""), part(3)).alias("confidence"),
        F.when(event, part(4)).alias("slug"),
        F.when(event & prefixed, F.regexp_extract(rest, PRINCIPAL, 1)).alias("principal"),
        F.when(event, F.trim(F.when(prefixed, F.regexp_extract(rest, PRINCIPAL, 2)).otherwise(rest))).alias("content"),
        F.when(kind == "comment", F.regexp_extract(t, COMMENT_LINE, 1)).alias("comment"),
    )


def with_context(parsed: DataFrame, file: str = "date", date: str = "date") -> DataFrame:
    """Events with the comment they stand under, the blank lines before them, the file's first header, their place and a time by it.

    Blank lines before a comment count for the event after it; a header or an unrecognized line ends them.
    """
    w = Window.partitionBy(file).orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    blank, stop = F.col("kind") == "blank", F.col("kind").isin("event", "header", "unrecognized")
    blanks = F.count_if(blank).over(before)
    rows = (
        parsed.withColumn("context_comment", F.last("comment", ignorenulls=True).over(w))
        .withColumn("blanks", blanks)
        .withColumn("prefix_blanks", blanks - F.coalesce(F.last(F.when(stop, F.col("blanks")), ignorenulls=True).over(before), F.lit(0)))
        .withColumn("date_header", F.first(F.when(F.col("kind") == "header", F.trim("line")), ignorenulls=True).over(before))
        .where("kind = 'event'")
        .drop("blanks")
    )
    rows = rows.withColumn("ordinal", F.row_number().over(w) - 1)
    minute, second = F.least(F.floor(F.col("ordinal") / 60), F.lit(23)), F.col("ordinal") % 60
    ts = F.concat(F.col(date), F.lit("T12:"), F.lpad(minute.cast("string"), 2, "0"), F.lit(":"), F.lpad(second.cast("string"), 2, "0"), F.lit("Z"))
    return rows.withColumn("ts", ts)


def between(text: Column, layer: str) -> Column:
    """The trimmed text between a layer's markers; to the end where the end marker is missing."""
    start, end = MARKERS[layer]
    at = F.instr(text, start)
    after = F.substr(text, at + F.lit(len(start)))
    stop = F.instr(after, end)
    inner = F.when(stop > 0, F.substr(after, F.lit(1), stop - 1)).otherwise(after)
    return F.when(at > 0, F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise("")


def scalar(value: Column) -> Column:
    """A YAML scalar without its quotes."""
    inner = F.regexp_extract(value, r'^"(.*)"$', 1)
    plain = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(value.rlike(r'^".*"$'), plain).when(value.rlike("^'.*'$"), F.regexp_extract(value, "^'(.*)'$", 1)).otherwise(value)


def inline(value: Column) -> Column:
    """The items of an inline list ``[a, "b, c"]``."""
    items = F.regexp_extract_all(F.regexp_extract(value, r"^\[(.*)\]$", 1), F.lit(r'"(?:[^"\\]|\\.)*"|[^,\s][^,]*'), 0)
    return F.transform(items, lambda x: scalar(F.trim(x)))


def iso_timestamp(value: Column) -> Column:
    """A date as midnight UTC, a longer time as it is in UTC; null where it is neither."""
    whole = F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(value, F.lit("T00:00:00Z"))).otherwise(whole)


def topic_files(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with the fields of their front matter, the layers of their text, and ``error`` where there is no front matter.

    The summary keeps its lines as written; ``trailing_blank`` says whether an empty line follows it.
    """
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    has = F.col(text).rlike(r"(?s)\A---\n.*?\n---\n")
    field = lambda k: scalar(F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{k}: *(.*)$", 1)), F.lit("")))
    block = F.regexp_extract(F.concat(front, F.lit("\n")), r"(?m)^summary: *[>|][-+]? *\n((?:[ \t]+[^\n]*\n?)*)", 1)
    body = F.regexp_replace(F.regexp_replace(block, r"(?m)^(?:  |\t)", ""), r"^\n+|\n+$", "")
    summary = F.when(front.rlike(r"(?m)^summary: *[>|][-+]? *$"), body).otherwise(field("summary"))
    blank = F.regexp_extract(text, r"(?m)^summary: *[>|][-+]? *\n(?:[ \t]+[^\n]*\n)+(\n?)---\n", 0)
    names = ["status", "sensitivity", "created", "last_verified", "last_curated"]
    return files.select(
        *[c for c in files.columns if c != text],
        field("topic").alias("topic"),
        field("type").alias("kind"),
        inline(F.regexp_extract(front, r"(?m)^tags: *(.*)$", 1)).alias("tags"),
        inline(F.regexp_extract(front, r"(?m)^entities: *(.*)$", 1)).alias("entities"),
        *[field(k).alias(k) for k in names],
        summary.alias("summary"),
        ((blank == "") | blank.rlike(r"\n\n---\n$")).alias("trailing_blank"),
        between(F.col(text), "curated").alias("curated"),
        between(F.col(text), "source").alias("source"),
        F.when(~has, "no front matter").alias("error"),
    )


def sections(rows: DataFrame, layer: str = "curated") -> DataFrame:
    """(.., idx, heading, content) of a curated layer's ``##`` sections; the whole text where it has none."""
    cut = F.filter(F.split(layer, r"(?m)(?=^## )"), lambda s: s.startswith("## "))
    whole = F.when(F.trim(layer) == "", F.array().cast("array<string>")).otherwise(F.array(F.col(layer)))
    parts = rows.select(*[c for c in rows.columns if c != layer], F.posexplode(F.when(F.size(cut) > 0, cut).otherwise(whole)).alias("idx", "s"))
    heading = F.when(F.startswith("s", F.lit("## ")), F.trim(F.regexp_extract("s", r"^## (.+)", 1)))
    return parts.select(*[c for c in parts.columns if c != "s"], heading.alias("heading"), F.regexp_replace(F.regexp_replace("s", r"^## [^\n]*", ""), r"^\s+|\s+$", "").alias("content"))


def source_blocks(rows: DataFrame, layer: str = "source") -> DataFrame:
    """(.., idx, date, title, content) of a source layer's dated blocks."""
    head = r"^### (\d{4}-\d{2}-\d{2})\s*[—-]\s*([^\n]+)"
    cut = F.filter(F.split(layer, r"(?m)(?=^### \d{4}-\d{2}-\d{2}\s*[—-])"), lambda s: s.rlike(head))
    parts = rows.select(*[c for c in rows.columns if c != layer], F.posexplode(cut).alias("idx", "s"))
    return parts.select(
        *[c for c in parts.columns if c != "s"],
        F.regexp_extract("s", head, 1).alias("date"),
        F.trim(F.regexp_extract("s", head, 2)).alias("title"),
        F.regexp_replace(F.regexp_replace("s", head, ""), r"^\s+|\s+$", "").alias("content"),
    )
