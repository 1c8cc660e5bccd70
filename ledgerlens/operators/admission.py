"""Admission of entries: capability matrix, payload rules, slug existence - each a reject code column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug_ok
from ..schema import MODES

# Tags and lengths of write payloads.
EVENT_TAGS = ("FACT", "DECISION", "CHANGED", "PROCEDURE", "TODO", "EVENT", "SECURITY", "CURATION")
LAYER_TAGS = ("CURATED", "SOURCE")
CONFIDENCES = ("CONFIRMED", "TENTATIVE", "CONTEXT")
MAX_EVENT, MAX_CURATED, MAX_SOURCE, MAX_ORIGIN = 500, 50_000, 200_000, 60
RESERVED = ("general", "system")
ORIGIN_MARK = "retrieval_origin"


def by_matrix(log: DataFrame, matrix: DataFrame) -> DataFrame:
    """Every entry with each socket and mode it might be written in: admitted or the reason why not."""
    places = F.array(*[F.struct(F.lit(socket).alias("socket"), F.lit(mode).alias("mode")) for socket in ("standard", "admin") for mode in MODES])
    # the matrix is fixed: under a thousand rows, one for each type, socket and mode
    found = log.select("seq", "type", F.inline(places)).join(F.broadcast(matrix), ["type", "socket", "mode"], "left")
    code = F.when(F.col("admissible").isNull(), "UNKNOWN_EVENT_TYPE_NOT_REGISTERED").when(~F.col("admissible"), "EVENT_NOT_ADMISSIBLE")
    return found.withColumn("reject_code", code)


def tainted(payload: Column, mark: str = ORIGIN_MARK) -> Column:
    """Whether the mark that search results bear stands anywhere in a payload's JSON: in a key, in a nested value, inside a text."""
    return F.coalesce(F.contains(payload, F.lit(mark)), F.lit(False))


def write_payload_reason(slug: Column, content: Column, tag: Column, confidence: Column, source: Column, payload: Column | None = None, mark: str = ORIGIN_MARK) -> Column:
    """``field:reason`` of the first rule that a write payload breaks; null where it breaks none.

    ``payload`` is the whole payload as JSON, searched for ``mark``; without it the content alone is.
    """
    effective = F.coalesce(tag, F.lit("FACT"))
    cap = F.when(effective == "SOURCE", MAX_SOURCE).when(effective == "CURATED", MAX_CURATED).otherwise(MAX_EVENT)
    return (
        F.when(slug.isNull(), "slug:required")
        .when(~slug_ok(slug), "slug:invalid_slug")
        .when(content.isNull() | (content == ""), "content:required")
        .when(tainted(content if payload is None else payload, mark), "payload:retrieval_origin")
        .when(~effective.isin(*EVENT_TAGS, *LAYER_TAGS), "tag:enum_violation")
        .when(F.length(content) > cap, "content:length_out_of_range")
        .when(effective.isin(*EVENT_TAGS) & content.rlike(r"[\r\n]"), "content:must_be_single_line_for_tag")
        .when(confidence.isNotNull() & ~confidence.isin(*CONFIDENCES), "confidence:enum_violation")
        .when(F.length(source) > MAX_ORIGIN, "source:length_out_of_range")
    )


def slug_admissible(log: DataFrame) -> DataFrame:
    """Writes with whether their slug was admissible then: reserved, written before, or given metadata before."""
    before = Window.partitionBy("slug").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    known = F.count_if(F.col("type").isin("write_event", "TOPIC_METADATA_SET")).over(before) > 0
    return (
        log.withColumn("known", F.coalesce(known, F.lit(False)) | F.col("slug").isin(*RESERVED))
        .where(F.col("type") == "write_event")
        .select("seq", "slug", F.when(~F.col("known"), "SLUG_NOT_ADMITTED").alias("reject_code"))
    )


def admissible_slugs(log: DataFrame) -> DataFrame:
    """Slugs with a write or metadata; a union of distinct parts, so it merges over sealed and active files."""
    return log.where(F.col("type").isin("write_event", "TOPIC_METADATA_SET")).select("slug").distinct()


def rerouted(writes: DataFrame, admissible: DataFrame, fallback: str = "general") -> DataFrame:
    """Writes whose slug isn't admitted go to ``fallback``."""
    known = admissible.select(F.col("slug").alias("known"))
    out = writes.join(known, F.col("slug") == F.col("known"), "left")
    return out.withColumn("rerouted", F.col("known").isNull()).withColumn("slug", F.coalesce("known", F.lit(fallback))).drop("known")


# Bounds and enumerations of topic payloads.
KINDS = ("reference", "project", "feedback", "personal", "archive", "business", "hobby")
STATUSES = ("active", "paused", "archived", "reference", "deferred")
MAX_TAGS, MAX_ENTITIES, MAX_SUPPORT, MAX_DISMISSED, MAX_RETIRED = 20, 20, 100, 50, 256


def _slug_reason(slug: Column, field: str) -> Column:
    return (
        F.when(slug.isNull(), f"{field}:required")
        .when(~F.length(slug).between(2, 40), f"{field}:length_out_of_range")
        .when(~slug_ok(slug), f"{field}:slug_regex_mismatch")
    )


def _line_reason(value: Column, field: str, most: int) -> Column:
    return (
        F.when(value.isNull(), f"{field}:required")
        .when(F.trim(value) == "", f"{field}:must_be_nonblank")
        .when(F.length(value) > most, f"{field}:length_out_of_range")
        .when(value.rlike(r"[\r\n]"), f"{field}:must_be_single_line")
    )


def _seqs_reason(seqs: Column, field: str, most: int, max_known: Column | None = None) -> Column:
    bad = F.when(seqs.isNull(), f"{field}:required").when(~F.size(seqs).between(1, most), f"{field}:length_out_of_range")
    bad = bad.when(F.exists(seqs, lambda s: s < 1), f"{field}:item_must_be_safe_positive_integer")
    if max_known is not None:
        bad = bad.when(F.exists(seqs, lambda s: s > max_known), f"{field}:future_or_unknown_seq")
    return bad.when(F.size(F.array_distinct(seqs)) < F.size(seqs), f"{field}:must_be_strictly_ascending").when(
        F.array_sort(seqs) != seqs, f"{field}:must_be_strictly_ascending"
    )


def suggested_reason(slug, name, description, rationale, seqs, max_known=None) -> Column:
    """First rule that a cluster suggestion breaks."""
    return F.coalesce(
        _slug_reason(slug, "slug"),
        _line_reason(name, "name", 80),
        _line_reason(description, "description", 240),
        _line_reason(rationale, "rationale", 500),
        _seqs_reason(seqs, "supporting_seqs", MAX_SUPPORT, max_known),
    )


def metadata_reason(topic, kind, status, tags, created, summary) -> Column:
    """First rule that a topic's metadata breaks; null fields are absent."""
    return F.coalesce(
        _slug_reason(topic, "topic"),
        F.when(kind.isNotNull() & ~kind.isin(*KINDS), "type:enum_violation"),
        F.when(status.isNotNull() & ~status.isin(*STATUSES), "status:enum_violation"),
        F.when(F.size(tags) > MAX_TAGS, "tags:length_out_of_range")
        .when(F.exists(tags, lambda t: (F.length(t) == 0) | (F.length(t) > 30)), "tags:item_length_out_of_range")
        .when(F.exists(tags, lambda t: ~t.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$")), "tags:item_slug_regex_mismatch"),
        F.when(created.isNotNull() & ~created.rlike(r"^\d{4}-\d{2}-\d{2}$"), "created:must_be_iso_date_yyyy_mm_dd"),
        F.when(F.length(summary) > 1000, "summary:length_out_of_range").when(summary.rlike("\r"), "summary:must_not_contain_cr"),
    )


def accepted_reason(payload: Column, max_known: Column | None = None) -> Column:
    """First rule that the payload of an accepted suggestion, as JSON, breaks: known fields alone, a number that exists, a slug.

    ``max_known`` is the highest number given out when it is offered.
    """
    v = F.try_parse_json(payload)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    has = lambda name: F.array_contains(F.json_object_keys(payload), name)
    other = F.get(F.filter(F.json_object_keys(payload), lambda k: ~k.isin("suggestion_seq", "accepted_slug")), F.lit(0))
    number = F.try_variant_get(v, "$.suggestion_seq", "double")
    whole = kind("$.suggestion_seq").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number)) & number.between(1, 2**53 - 1)
    slug = F.when(kind("$.accepted_slug") == "STRING", F.try_variant_get(v, "$.accepted_slug", "string"))
    found = (
        F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "payload:must_be_object")
        .when(other.isNotNull(), F.concat(other, F.lit(":unknown_field")))
        .when(~has("suggestion_seq"), "suggestion_seq:required")
        .when(~F.coalesce(whole, F.lit(False)), "suggestion_seq:must_be_safe_positive_integer")
    )
    if max_known is not None:
        found = found.when(number > max_known, "suggestion_seq:future_or_unknown_seq")
    return found.when(~has("accepted_slug"), "accepted_slug:required").when(slug.isNull(), "accepted_slug:must_be_string").otherwise(_slug_reason(slug, "accepted_slug"))


def dismissed_reason(seqs, cooldown_days, reason, max_known=None) -> Column:
    """First rule that a dismissal breaks."""
    return F.coalesce(
        _seqs_reason(seqs, "suggestion_seqs", MAX_DISMISSED, max_known),
        F.when(cooldown_days.isNull() | ~cooldown_days.between(1, 365), "cooldown_days:out_of_range"),
        F.when(reason.isNotNull(), _line_reason(reason, "reason", 120)),
    )


def retired_reason(topic, seqs, reason, max_known=None) -> Column:
    """First rule that a retirement breaks."""
    return F.coalesce(
        _slug_reason(topic, "topic"),
        _seqs_reason(seqs, "superseded_seqs", MAX_RETIRED, max_known),
        F.when(reason.isNotNull(), _line_reason(reason, "reason", 120)),
    )


def batch(entries: DataFrame, matrix: DataFrame, admissible: DataFrame, tail_safe: bool = True) -> DataFrame:
    """(batch, i, code): what a writer says to entries (batch, i, type, socket, mode, slug, typed) offered in order; null admits.

    A write goes to a reserved topic, an admissible one (slug), or one that an earlier entry of its batch gives metadata
    (``typed``). A batch is written whole or not at all: see ``whole``.
    """
    known = matrix.select("type").distinct().withColumn("known", F.lit(True))
    normal = matrix.where("mode = 'normal' and admissible").select("type", F.col("socket").alias("at"), F.lit(True).alias("may"))
    held = admissible.select("slug", F.lit(True).alias("held")).distinct()
    socket = F.coalesce("socket", F.lit("standard"))
    # the matrix is fixed: under a thousand rows
    rows = entries.withColumn("at", socket).join(F.broadcast(known), "type", "left").join(F.broadcast(normal), ["type", "at"], "left").join(held, "slug", "left")
    before = Window.partitionBy("batch", "slug").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    staged = F.coalesce(F.max((F.col("type") == "TOPIC_METADATA_SET") & F.col("typed")).over(before), F.lit(False))
    code = (
        F.when(~F.lit(tail_safe), "LOG_TAIL_NOT_INTERPRETABLE")
        .when(F.col("mode").isNotNull() & (F.col("mode") != "normal"), "INVALID_WRITER_MODE")
        .when(F.col("known").isNull(), "UNKNOWN_EVENT_TYPE_NOT_REGISTERED")
        .when(F.col("may").isNull(), "EVENT_NOT_ADMISSIBLE")
        .when((F.col("type") == "write_event") & F.col("held").isNull() & ~F.col("slug").isin(*RESERVED) & ~F.col("staged"), "SLUG_NOT_ADMITTED")
    )
    return rows.withColumn("staged", staged).select("batch", "i", code.alias("code"))


def whole(codes: DataFrame) -> DataFrame:
    """(batch, i, code): the first entry that keeps its batch from being written, or nulls."""
    first = F.min_by(F.struct("i", "code"), F.when(F.col("code").isNotNull(), F.col("i")))
    return codes.groupBy("batch").agg(first.alias("f")).select("batch", "f.i", "f.code")
