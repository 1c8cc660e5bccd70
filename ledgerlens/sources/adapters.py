"""Tables as the canonical relations: an operation log, search units, access lists, transcripts.

``log``    pos, seq, slug, principal, ts, value, k, type, tag, content, cooldown_days
``units``  key, slug, seq, tag, retired, content: one searchable entry each
``acl``    slug, readers
``turns``  conv_id, turn, role, text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(events: DataFrame) -> DataFrame:
    """Events as log entries: writes, topic metadata, retirements and the suggestion lifecycle."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = events.withColumn("k", k)
    meta = F.when(F.col("k") % 3 == 0, "TOPIC_METADATA_SET").when(F.col("k") % 3 == 1, "TOPIC_CURATED").otherwise("TOPIC_VERIFIED")
    life = (
        F.when(F.col("k") < 50, "TOPIC_BULLETS_RETIRED")
        .when(F.col("k") < 70, "TOPIC_SUGGESTED")
        .when(F.col("k") < 85, "TOPIC_SUGGESTION_ACCEPTED")
        .otherwise("TOPIC_SUGGESTION_DISMISSED")
    )
    kind = F.when(F.col("event_type").isin("purchase", "view", "click"), "write_event").when(F.col("event_type") == "signup", meta).otherwise(life)
    tag = F.when(F.col("event_type") == "purchase", "CURATED").when(F.col("event_type") == "view", "SOURCE").when(F.col("event_type") == "click", "FACT")
    return e.select(
        F.col("event_id").alias("pos"),
        (F.col("event_id") + 1).alias("seq"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("slug"),
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("principal"),
        "ts",
        "value",
        "k",
        kind.alias("type"),
        tag.alias("tag"),
        F.concat(F.col("event_type"), F.lit(" number "), F.col("k").cast("string"), F.lit(".")).alias("content"),
        (1 + F.col("k") % 30).alias("cooldown_days"),
    )


def control(events: DataFrame) -> DataFrame:
    """(pos, seq, type, feature): entries about features and modes, and some of a type that nobody registered."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = events.where("event_type = 'signup'").withColumn("k", k)
    kinds = F.array(*[F.lit(x) for x in ("FEATURE_ACTIVE", "FEATURE_ROLLED_BACK", "RECOVERY_MODE_ENTERED", "RECOVERY_MODE_EXITED", "NOVEL")])
    return e.select(
        F.col("event_id").alias("pos"),
        (F.col("event_id") + 1).alias("seq"),
        F.get(kinds, (F.col("k") % 5).cast("int")).alias("type"),
        F.concat(F.lit("feature-"), F.col("k").cast("string")).alias("feature"),
    )


def units(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as searchable entries: labelled good ones are curated, other labelled ones notes, the rest source."""
    tag = F.when(F.col("quality") == 1, "CURATED").when(F.col("quality") == 0, "FACT").otherwise("SOURCE")
    return documents.join(labels, "doc_id", "left").select(
        F.concat_ws("::", "source", (F.col("doc_id") + 1).cast("string"), F.lit("0")).alias("key"),
        F.col("source").alias("slug"),
        (F.col("doc_id") + 1).alias("seq"),
        tag.alias("tag"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("retired"),
        F.coalesce("text", F.lit("")).alias("content"),
        "doc_id",
    )


def acl(units: DataFrame) -> DataFrame:
    """Readers of each topic: one principal by the topic's number, and the operator."""
    n = F.regexp_extract("slug", r"(\d+)", 1).cast("long")
    return units.select("slug").distinct().select(
        "slug", F.array(F.concat(F.lit("p"), (n % 3).cast("string")), F.lit("operator")).alias("readers")
    )
