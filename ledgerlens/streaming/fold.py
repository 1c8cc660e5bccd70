"""The state of a log kept month by month, so that an append costs the newest month only.

Each month's lines are folded into partial aggregates that carry positions: what a key
(a topic, a curated number, a suggestion) met first and last there, and how often. Such
parts merge in any order by least and greatest position: resolvers wait for suggestions
of earlier months, retirements for curated numbers of earlier months. A month that
isn't the newest is sealed: its part is written once and used as long as its files keep
their names, sizes and times; the parts of all sealed months are also merged once. The
newest month is folded anew each time. A month whose files change while they are folded
is folded again, and nothing is kept of it if it doesn't settle.

What is kept lies under one folder and is published by a numbered manifest that is
written last: a reader takes the last whole one, so it never sees half a fold.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import dismissed, longest_open
from ..sources import jsonl
from ..sources.storage import materialize
from ..sources.versions import exists, latest, publish, whole

#: What a line of the log says, as far as state depends on it.
LINE = (
    "type string, seq long, ts string, payload struct<slug:string, topic:string, tag:string, k:long, superseded_seqs:array<long>,"
    " suggestion_seq:long, suggestion_seqs:array<long>, cooldown_days:long>"
)
_POS = "struct<log_file:string, file:string, block:long, line:long>"
_INFO = "struct<type:string, seq:long, ts:string, k:long, cooldown_days:long>"
PART = f"kind string, slug string, key long, first_pos {_POS}, last_pos {_POS}, n long, last_seq long, first {_INFO}, last {_INFO}"
MANIFEST = "month string, fingerprint string, content string, path string"
ATTEMPTS = 3


def contributions(lines: DataFrame) -> DataFrame:
    """(log_file, kind, slug, key, pos, info) of lines (log_file, place, raw): what each entry says about which key.

    Lines that are no entries say nothing. A resolver that names its own or a later number is no resolver.
    """
    e = lines.withColumn("e", F.from_json("raw", LINE)).select(
        "log_file", F.struct("log_file", "place.file", "place.block", "place.line").alias("pos"), "e.*", F.coalesce("e.payload.topic", "e.payload.slug").alias("slug")
    )
    none, kind, p = F.lit(None).cast("long"), F.col("type"), F.col("payload")
    says = lambda name, keys: F.transform(keys, lambda k: F.struct(F.lit(name).alias("kind"), k.alias("key")))
    one, no = F.array(none), F.array().cast("array<struct<kind:string,key:bigint>>")
    resolved = F.filter(F.when(kind == "TOPIC_SUGGESTION_ACCEPTED", F.array(p.suggestion_seq)).otherwise(F.coalesce(p.suggestion_seqs, F.array(p.suggestion_seq))), lambda x: x < F.col("seq"))
    parts = F.concat(
        F.when(kind.isin("write_event", "TOPIC_METADATA_SET"), says("slug", one)).otherwise(no),
        F.when(kind == "write_event", says("write", one)).otherwise(no),
        F.when((kind == "write_event") & (p.tag == "CURATED"), says("curated", F.array("seq"))).otherwise(no),
        F.when(kind == "TOPIC_METADATA_SET", says("meta", one)).otherwise(no),
        F.when(kind == "TOPIC_BULLETS_RETIRED", says("ask", F.coalesce(p.superseded_seqs, F.array().cast("array<bigint>")))).otherwise(no),
        F.when(kind == "TOPIC_SUGGESTED", says("made", F.array("seq"))).otherwise(no),
        F.when(kind.isin("TOPIC_SUGGESTION_ACCEPTED", "TOPIC_SUGGESTION_DISMISSED"), says("resolver", resolved)).otherwise(no),
        says("tail", one),
    )
    said = e.where("type is not null and seq is not null").select("log_file", "slug", "pos", F.struct("type", "seq", "ts", p.k.alias("k"), p.cooldown_days.alias("cooldown_days")).alias("info"), F.explode(parts).alias("x"))
    # a resolver is found by the suggestion's number alone, the tail by nothing
    own = F.when(~F.col("x.kind").isin("resolver", "tail"), F.col("slug"))
    return said.select("log_file", F.col("x.kind").alias("kind"), own.alias("slug"), F.col("x.key").alias("key"), "pos", "info")


def folded(rows: DataFrame, by: list[str]) -> DataFrame:
    """Contributions as a part: for each key the first and the last, how many, and the highest number."""
    return rows.groupBy(*by, "kind", "slug", "key").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"), F.max("info.seq").alias("last_seq"),
        F.min_by("info", "pos").alias("first"), F.max_by("info", "pos").alias("last"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Parts of several months as one; the order they come in is of no account."""
    return parts.groupBy("kind", "slug", "key").agg(
        F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum("n").alias("n"), F.max("last_seq").alias("last_seq"),
        F.min_by("first", "first_pos").alias("first"), F.max_by("last", "last_pos").alias("last"),
    )


# ---- relations of a part ---------------------------------------------------


def admissible(part: DataFrame) -> DataFrame:
    """(slug): topics that a write may name."""
    return part.where("kind = 'slug' and slug is not null").select("slug")


def topics(part: DataFrame) -> DataFrame:
    """(slug, n_writes, last_seq, meta_k): writes, the number of the last, and what the last metadata entry says."""
    own = part.where("kind in ('write', 'meta') and slug is not null")
    write, meta = F.col("kind") == "write", F.col("kind") == "meta"
    return own.groupBy("slug").agg(
        F.coalesce(F.max(F.when(write, F.col("n"))), F.lit(0)).alias("n_writes"), F.max(F.when(write, F.col("last_seq"))).alias("last_seq"), F.max(F.when(meta, F.col("last.k"))).alias("meta_k")
    )


def suggestions(part: DataFrame) -> DataFrame:
    """(suggestion_seq, slug, status, resolver_seq, resolved_pos, cooldown_days, resolved_ts): the first resolver wins, in whichever month it stands."""
    made = part.where("kind = 'made'").select("slug", F.col("key").alias("suggestion_seq"))
    resolver = part.where("kind = 'resolver'").select(F.col("key").alias("suggestion_seq"), F.col("first").alias("r"), F.col("first_pos").alias("resolved_pos"))
    status = F.when(F.col("r").isNull(), "pending").when(F.col("r.type") == "TOPIC_SUGGESTION_ACCEPTED", "accepted").otherwise("dismissed")
    return made.join(resolver, "suggestion_seq", "left").select(
        "suggestion_seq", "slug", status.alias("status"), F.col("r.seq").alias("resolver_seq"), "resolved_pos", F.col("r.cooldown_days").alias("cooldown_days"),
        F.to_timestamp("r.ts").alias("resolved_ts"),
    )


def retired(part: DataFrame) -> DataFrame:
    """(slug, seq): curated numbers that a later retirement of their topic names."""
    held = part.where("kind = 'curated'").select("slug", F.col("key").alias("seq"), F.col("first_pos").alias("held_pos"))
    asked = part.where("kind = 'ask'").select("slug", F.col("key").alias("seq"), F.col("last_pos").alias("asked_pos"))
    return held.join(asked, ["slug", "seq"]).where("held_pos < asked_pos").select("slug", "seq")


def cooldowns(part: DataFrame) -> DataFrame:
    """(slug_key, dismissal_seq, until_ms)."""
    return longest_open(dismissed(suggestions(part)))


def tail(part: DataFrame) -> DataFrame:
    """(pos, last_seq) of the last entry; no row for none."""
    return part.where("kind = 'tail'").select(F.col("last_pos").alias("pos"), F.col("last.seq").alias("last_seq"))


# ---- what is kept ----------------------------------------------------------


@dataclass
class Fold:
    part: DataFrame
    folded: list[str]  # months whose lines were read
    kept: list[str]  # months whose part was there
    sealed_anew: bool  # whether the sealed months' parts were merged again
    published: bool


def fingerprint(files: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256("\n".join(f"{name}\t{size}\t{time}" for name, size, time in files).encode()).hexdigest()


def _contents(spark: SparkSession, log_path: str, months: list[str]) -> dict[str, str]:
    """A sum of each month's lines' hashes."""
    lines = jsonl.read(spark, log_path, months)
    return {r.month: r.content for r in _content_of(lines).collect()}


def _content_of(lines: DataFrame) -> DataFrame:
    total = F.concat_ws(":", F.count("*"), F.sum(F.xxhash64("raw").cast("decimal(38,0)")).cast("string"))
    return lines.groupBy(F.substring("log_file", 1, 7).alias("month")).agg(total.alias("content"))


def fold(spark: SparkSession, log_path: str, root: str, verify: bool = False) -> Fold:
    """The state of the month files under ``log_path``, with what is kept of them under ``root``.

    ``verify`` also reads the sealed months and compares their lines with those that were folded: it
    finds a rewrite that left sizes and times as they were.
    """
    for attempt in range(ATTEMPTS):
        files = jsonl.month_files(spark, log_path)
        months = list(files)
        if not months:
            return Fold(spark.createDataFrame([], PART), [], [], False, False)
        number, rows = latest(spark, root, "manifest", MANIFEST)  # a row for each month
        held = {r.month: r for r in rows}
        prints = {m: fingerprint(files[m]) for m in months}
        stale = {m for m in months[:-1] if m not in held or held[m]["fingerprint"] != prints[m]}
        if verify and (sealed := [m for m in months[:-1] if m not in stale]):
            found = _contents(spark, log_path, sealed)
            stale |= {m for m in sealed if held[m]["content"] != found.get(m, "")}
        anew = sorted({*stale, months[-1]})
        lines = materialize(jsonl.read(spark, log_path, anew), "fold-lines")
        path = f"{root}/part-{uuid.uuid4().hex}"
        month = F.substring("log_file", 1, 7).alias("month")
        folded(contributions(lines).withColumn("month", month), ["month"]).write.partitionBy("month").parquet(path)
        contents = {r.month: r.content for r in _content_of(lines).collect()}  # a row for each month folded
        now = jsonl.month_files(spark, log_path)
        if all(fingerprint(now.get(m, [])) == prints[m] for m in months):
            break
        if attempt == ATTEMPTS - 1:  # it doesn't settle: the whole log once more, nothing kept
            lines = jsonl.read(spark, log_path)
            return Fold(folded(contributions(lines), []), list(now), [], False, False)
    rows = [(m, prints[m], contents.get(m, ""), f"{path}/month={m}") if m in anew else (m, prints[m], held[m]["content"], held[m]["path"]) for m in months]
    sealed = [r for r in rows if r[0] != months[-1]]
    part, again = _read_parts(spark, [rows[-1][3]]), False
    if sealed:
        name = hashlib.sha256("\n".join(r[3] for r in sealed).encode()).hexdigest()[:32]
        at = f"{root}/sealed-{name}"
        if not whole(spark, at):
            merged(_read_parts(spark, [r[3] for r in sealed])).write.mode("overwrite").parquet(at)
            again = True
        part = merged(spark.read.schema(PART).parquet(at).unionByName(part))
    publish(spark.createDataFrame(rows, MANIFEST), root, "manifest", number + 1)
    return Fold(part, anew, [m for m in months if m not in anew], again, True)


def _read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    there = [p for p in paths if exists(spark, p)]  # a month without entries has no part
    return spark.read.schema(PART).parquet(*there) if there else spark.createDataFrame([], PART)
