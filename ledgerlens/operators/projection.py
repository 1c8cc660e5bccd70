"""Projections of state as readable texts: topic layers, topic index, dated logs, pending suggestions, vector store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_sentence
from .retrieval import own_tag
from .state import retired_seqs, suggestions, topics, writes


def _joined(rows: DataFrame, by: list, line, *order, sep: str = "\n\n") -> DataFrame:
    """Each group's lines in order, as one text."""
    items = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    return rows.groupBy(*by).agg(items.alias("items")).select(*by, F.array_join("items.line", sep).alias("text"))


def _tagged(log: DataFrame, tag: str) -> DataFrame:
    """Writes with a tag; those imported from another part of a file than the tag's don't count, where the log says so."""
    own = writes(log).where(F.col("tag") == tag)
    return own.where(own_tag(F.col("tag"), F.col("imported_field"))) if "imported_field" in log.columns else own


def layer2(log: DataFrame) -> DataFrame:
    """(slug, text): a topic's curated writes that are not retired, in log order."""
    own = _tagged(log, "CURATED")
    kept = own.join(retired_seqs(log), ["slug", "seq"], "left_anti").where(F.trim("content") != "")
    return _joined(kept, ["slug"], F.trim("content"), F.col("pos"))


def layer3(log: DataFrame) -> DataFrame:
    """(slug, text): a topic's source writes, newest first."""
    own = _tagged(log, "SOURCE").where(F.trim("content") != "")
    return _joined(own, ["slug"], F.trim("content"), -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("seq"))


def mechanical(layer: DataFrame) -> DataFrame:
    """(slug, lines, kb) of a layer's text."""
    return layer.select(
        "slug", F.size(F.split("text", "\n")).alias("lines"), F.round(F.octet_length("text") / 1024, 1).alias("kb")
    )


def topic_index(log: DataFrame) -> DataFrame:
    """(slug, line) for topics with metadata that aren't archived: slug, kind, tags, status, first sentence of the summary."""
    t = metadata(log).where("status <> 'archived'")
    return t.select("slug", F.concat_ws(" | ", "slug", "kind", F.array_join("tags", ", "), "status", first_sentence(F.col("summary"))).alias("line"))


def written_line(tag: Column, slug: Column, content: Column, auto=None, confidence=None, principal=None) -> Column:
    """An entry as a tagged one-liner; line feeds in it are shown. ``auto`` (boolean), ``confidence`` and ``principal`` (null for none) are said if given."""
    nothing = F.lit("")
    said = lambda c, before, after: nothing if c is None else F.coalesce(F.concat(F.lit(before), c, F.lit(after)), nothing)
    marked = nothing if auto is None else F.when(auto, "AUTO-").otherwise("")
    flat = F.regexp_replace(F.coalesce(content, nothing), r"\r?\n", " ⏎ ")
    return F.concat(F.lit("["), marked, F.coalesce(tag, F.lit("EVENT")), said(confidence, ":", ""), F.lit("] "), F.coalesce(slug, F.lit("general")), F.lit(": "), said(principal, "[", "] "), flat)


def event_lines(log: DataFrame) -> DataFrame:
    """Writes as tagged one-liners with their UTC date."""
    line = written_line(F.col("tag"), F.col("slug"), F.col("content"))
    return writes(log).select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "seq", "principal", line.alias("line"))


def event_logs(log: DataFrame) -> DataFrame:
    """(date, text): each day's lines by number, ended by a line feed."""
    return _joined(event_lines(log), ["date"], F.col("line"), F.col("seq"), sep="\n").select("date", F.concat("text", F.lit("\n")).alias("text"))


def with_comment_changes(rows: DataFrame) -> DataFrame:
    """``rows`` (date, seq, comment, ..) with changed: whether a row's comment is another than the last one of its day; empty ones are none."""
    comment = F.when(F.col("comment") != "", F.col("comment"))
    shown = F.last(comment, ignorenulls=True).over(Window.partitionBy("date").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("changed", F.coalesce(comment != F.coalesce(shown, F.lit("")), F.lit(False)))


def context_changes(rows: DataFrame) -> DataFrame:
    """(date, changes): how often a day's lines (date, seq, comment) come under another comment."""
    return with_comment_changes(rows).groupBy("date").agg(F.count_if("changed").alias("changes"))


#: What an import keeps of a dated log's line, so that it can be written again as it was.
HINTS = "raw_line string, context_comment string, prefix_blanks int, date_header string, auto_extracted boolean, confidence string, principal_was_prefixed boolean"


def regenerated(entries: DataFrame) -> DataFrame:
    """(date, text): dated logs of entries (date, seq, tag, slug, principal, content, hints), as their author laid them out.

    ``hints`` (a struct of HINTS, null for entries that were not imported) gives an entry's line, the comment
    it stands under, blank lines before it and the day's header; without them lines are made from their parts,
    and a comment that changes is set off by a blank line. Entries of a topic file's parts don't belong here.
    """
    h = F.col("hints")
    by_day = Window.partitionBy("date").orderBy("seq")
    own = with_comment_changes(entries.withColumn("comment", h["context_comment"]))
    own = own.withColumn("first", F.row_number().over(by_day) == 1).withColumn("header", F.first(h["date_header"]).over(by_day))
    blanks = F.coalesce(h["prefix_blanks"], F.when(F.col("first"), F.col("header").isNotNull().cast("int")).otherwise(F.col("changed").cast("int")))
    principal = F.when(F.coalesce(h["principal_was_prefixed"], F.lit(False)), F.col("principal"))
    made = written_line(F.col("tag"), F.col("slug"), F.col("content"), F.coalesce(h["auto_extracted"], F.lit(False)), h["confidence"], principal)
    line = F.coalesce(F.when(h["raw_line"] != "", h["raw_line"]), made)
    comment = F.when(F.col("changed"), F.concat(F.lit("<!-- "), "comment", F.lit(" -->\n"))).otherwise("")
    whole = F.concat(F.when(F.col("first") & F.col("header").isNotNull(), F.concat("header", F.lit("\n"))).otherwise(""), F.repeat(F.lit("\n"), blanks), comment, line)
    return _joined(own, ["date"], whole, F.col("seq"), sep="\n").select("date", F.concat("text", F.lit("\n")).alias("text"))


def pending(log: DataFrame, now_ms: int, cap: int = 10) -> DataFrame:
    """(suggestion_seq, slug, age_days) of the oldest pending suggestions; the cap is the feature."""
    age = F.floor((F.lit(now_ms) - F.unix_millis(F.col("ts").cast("timestamp"))) / 86_400_000)
    return suggestions(log).where("status = 'pending'").orderBy("ts", "suggestion_seq").limit(cap).select("suggestion_seq", "slug", age.alias("age_days"))


def vector_delta(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(action, n) for bringing a content-addressed vector store up to date: embed, reuse, prune."""
    w, h = wanted.select("vector_key").distinct(), held.select("vector_key").distinct()
    return (
        w.withColumn("w", F.lit(1)).join(h.withColumn("h", F.lit(1)), "vector_key", "full_outer")
        .groupBy(F.when(F.col("h").isNull(), "embed").when(F.col("w").isNull(), "prune").otherwise("reuse").alias("action"))
        .agg(F.count("*").alias("n"))
    )


def quoted(value):
    """A YAML scalar, in double quotes where it holds special characters or outer spaces."""
    special = value.rlike(r"[:\[\]{},&*#?|<>=!%@`\"']") | value.rlike(r"^\s|\s$") | (value == "")
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(special, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)


def _section(start: str, body, end: str):
    text = F.coalesce(body, F.lit(""))
    return F.when(text == "", F.lit(f"{start}\n\n{end}")).otherwise(F.concat(F.lit(f"{start}\n\n"), text, F.lit(f"\n\n{end}")))


def _inline(items):
    """An array as an inline list of scalars."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def metadata(log: DataFrame) -> DataFrame:
    """(slug, n_writes, kind, tags, entities, status, sensitivity, created, last_verified, last_curated, summary) of topics with metadata.

    Dates fall back: created to the first write's, last_verified to created, last_curated to the last entry's.
    """
    from .admission import KINDS

    day = lambda when: F.date_format(F.max_by(F.when(when, F.col("ts")), F.when(when, F.col("pos"))), "yyyy-MM-dd")
    named = log.where(F.col("type").isin("write_event", "TOPIC_METADATA_SET", "TOPIC_CURATED", "TOPIC_VERIFIED"))
    write = F.col("type") == "write_event"
    first = F.date_format(F.min_by(F.when(write, F.col("ts")), F.when(write, F.col("pos"))), "yyyy-MM-dd")
    dates = named.groupBy("slug").agg(first.alias("first"), day(F.col("type") == "TOPIC_VERIFIED").alias("verified"), day(F.col("type") == "TOPIC_CURATED").alias("curated"), day(F.lit(True)).alias("last"))
    t = topics(log).where(F.col("meta_k").isNotNull()).join(dates, "slug")
    number = lambda n: (F.col("meta_k") % n).cast("string")
    created = F.coalesce("first", F.lit("2026-04-22"))
    return t.select(
        "slug",
        "n_writes",
        F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("meta_k") % len(KINDS)).cast("int")).alias("kind"),
        F.array(F.lit("user"), F.concat(F.lit("tag-"), number(3))).alias("tags"),
        F.array(F.concat(F.lit("Entity: "), number(4))).alias("entities"),
        F.when(F.col("meta_k") % 5 == 0, "archived").otherwise("active").alias("status"),
        F.when(F.col("meta_k") % 9 == 0, "private").alias("sensitivity"),
        created.alias("created"),
        F.coalesce("verified", created).alias("last_verified"),
        F.coalesce("curated", "last", created).alias("last_curated"),
        F.concat(F.lit("Topic "), F.col("slug"), F.lit(" has "), F.col("n_writes").cast("string"), F.lit(" entries.")).alias("summary"),
    )


def topic_files(log: DataFrame) -> DataFrame:
    """(slug, text) of every topic with metadata: front matter, curated layer, source layer. One pass for all topics."""
    from ..sources.markdown import MARKERS

    two, three = layer2(log).withColumnRenamed("text", "two"), layer3(log).withColumnRenamed("text", "three")
    rows = metadata(log).join(two, "slug", "left").join(three, "slug", "left")
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(c, "\n"))).cast("string")
    kb = F.format_string("%.1f", F.round(F.octet_length(F.coalesce("three", F.lit(""))) / 1024, 1))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    front = F.concat_ws(
        "\n",
        field("topic", quoted(F.col("slug"))),
        field("type", quoted(F.col("kind"))),
        field("tags", _inline("tags")),
        field("entities", _inline("entities")),
        field("status", quoted(F.col("status"))),
        field("sensitivity", quoted(F.col("sensitivity"))),  # left out where there is none
        field("created", F.col("created")),
        field("last_verified", F.col("last_verified")),
        field("last_curated", F.col("last_curated")),
        field("curated_lines", count("two")),
        field("source_lines", count("three")),
        field("source_kb", kb),
        F.concat(F.lit("summary: >\n"), F.regexp_replace("summary", r"(?m)^", "  ")),
        F.lit(""),
    )
    text = F.concat_ws(
        "\n", F.lit("---"), front, F.lit("---"), F.lit(""),
        _section(MARKERS["curated"][0], F.col("two"), MARKERS["curated"][1]), F.lit(""),
        _section(MARKERS["source"][0], F.col("three"), MARKERS["source"][1]), F.lit(""),
    )
    return rows.select("slug", text.alias("text"))
