"""What language models answered, taken apart: clusters, curation, bootstrap bullets; and near-duplicate candidates left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import near_texts
from ..sources.storage import materialize

CLUSTER = "array<struct<slug:string,name:string,description:string,rationale:string,supporting_seqs:array<bigint>>>"
MAX_BULLET, MAX_REASON, MAX_BULLETS = 200, 120, 12


def clusters(answers: DataFrame) -> DataFrame:
    """(.., i, slug, name, description, rationale, supporting_seqs) of answers (raw): the first fenced JSON block, or the whole; no array gives no rows."""
    t = F.trim("raw")
    block = F.regexp_extract(t, r"(?is)```json\s*(.+?)```", 1)
    found = F.from_json(F.when(block != "", F.trim(block)).otherwise(t), CLUSTER)
    rest = [c for c in answers.columns if c != "raw"]
    rows = answers.where((t != "") & (t != "NOTHING_TO_PROPOSE")).select(*rest, F.posexplode(found).alias("i", "p")).where("p is not null")
    return rows.select(*rest, "i", "p.*")


def _lines(answers: DataFrame) -> tuple[list[str], DataFrame]:
    rest = [c for c in answers.columns if c != "raw"]
    return rest, answers.select(*rest, F.posexplode(F.split("raw", "\n")).alias("i", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def _bullet():
    return F.trim(F.substring(F.col("line"), 3, 1 << 30))


def curation(answers: DataFrame, active: DataFrame, key: str = "answer_id") -> tuple[DataFrame, DataFrame]:
    """((key, superseded_seqs, reason), (key, i, bullet)) of answers (key, raw): ``RETIRE: n`` by place, a first ``REASON:``, and bullets.

    ``active`` is (key, n, seq): the live curated entries that the answer's numbers stand for; other numbers count for nothing.
    """
    _, lines = _lines(answers.select(key, "raw"))
    retire, reason = r"(?i)^RETIRE:\s*(\d+)\s*$", r"(?i)^REASON:\s*(.*)$"
    n = lines.where(F.col("line").rlike(retire)).select(key, F.regexp_extract("line", retire, 1).try_cast("long").alias("n"))
    seqs = n.join(active, [key, "n"]).groupBy(key).agg(F.array_sort(F.collect_set("seq")).alias("superseded_seqs"))
    text = F.trim(F.regexp_extract("line", reason, 1))
    why = lines.where(F.col("line").rlike(reason) & ~F.col("line").rlike(retire) & (F.length(text) > 0) & (F.length(text) <= MAX_REASON)).groupBy(key).agg(F.min_by(text, "i").alias("reason"))
    gone = answers.select(key).join(seqs, key, "left").join(why, key, "left").withColumn("superseded_seqs", F.coalesce("superseded_seqs", F.array().cast("array<bigint>")))
    bullets = lines.where(F.startswith("line", F.lit("- "))).select(key, "i", _bullet().alias("bullet"))
    return gone, bullets.where((F.col("bullet") != "") & (F.length("bullet") <= MAX_BULLET))


def bootstrap(answers: DataFrame, key: str = "answer_id", most: int = MAX_BULLETS) -> DataFrame:
    """(key, place, bullet): an answer's first ``most`` bullets; the bound is the feature. NOTHING_TO_ADD gives none."""
    _, lines = _lines(answers.where(F.trim("raw") != "NOTHING_TO_ADD").select(key, "raw"))
    b = lines.where(F.startswith("line", F.lit("- "))).select(key, "i", _bullet().alias("bullet")).where((F.col("bullet") != "") & (F.length("bullet") <= MAX_BULLET))
    place = F.row_number().over(Window.partitionBy(key).orderBy("i"))
    return b.withColumn("place", place.cast("long")).where(F.col("place") <= most).select(key, "place", "bullet")


def survivors(candidates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(batch, i) of candidates (batch, i, content), each batch taken in order, that resemble no earlier one that survives.

    Texts without tokens resemble nothing. Of equal sets of tokens the first stands for all: whatever becomes of
    it, the others resemble an earlier survivor. Rounds then decide all whose earlier likenesses are decided.
    """
    pairs, again = near_texts.near(candidates.select("batch", "i", F.col("content").alias("text")), ["batch"], threshold)
    like = pairs.select("batch", F.col("a").alias("a_i"), F.col("b").alias("b_i"))
    copies = again.where(F.col("i") > F.col("first")).select("batch", "i")
    # only candidates that some likeness touches wait for a decision
    open_ = materialize(like.select("batch", F.col("a_i").alias("i")).union(like.select("batch", "b_i")).distinct(), "candidate-open")
    dropped = None
    while not open_.isEmpty():
        waits = like.join(open_.withColumnRenamed("i", "a_i"), ["batch", "a_i"], "left_semi").select("batch", F.col("b_i").alias("i")).distinct()
        kept = materialize(open_.join(waits, ["batch", "i"], "left_anti"), "candidate-kept")  # all its earlier likenesses are dropped
        gone = like.join(kept.withColumnRenamed("i", "a_i"), ["batch", "a_i"], "left_semi").select("batch", F.col("b_i").alias("i")).distinct()
        gone = materialize(gone.join(open_, ["batch", "i"], "left_semi"), "candidate-gone")
        dropped = gone if dropped is None else materialize(dropped.unionByName(gone), "candidate-dropped")
        open_ = materialize(open_.join(kept, ["batch", "i"], "left_anti").join(gone, ["batch", "i"], "left_anti"), "candidate-open")
    gone = copies if dropped is None else copies.unionByName(dropped)
    return candidates.select("batch", "i").join(gone, ["batch", "i"], "left_anti")


def error_code(message):
    """(code, status, retryable) of a provider's error message ``Name 429: ..``, as a struct."""
    low = F.lower(message)
    status = F.regexp_extract(message, r"^[A-Za-z]+\s+(\d{3}):", 1).try_cast("int")
    has = lambda pattern: low.rlike(pattern)
    code = (
        F.when(has("timed out|etimedout"), "request_timeout")
        .when(has("econnreset|enotfound|econnrefused|eai_again|getaddrinfo"), "network_error")
        .when((F.coalesce(status, F.lit(0)) == 401) | has("invalid x-api-key|incorrect api key|authentication"), "auth_invalid")
        .when((F.coalesce(status, F.lit(0)) == 402) | has("credit balance|quota|insufficient.*credit|billing|payment required"), "quota_exceeded")
        .when(status == 429, "rate_limited")
        .when(status.isin(400, 404), "request_invalid")
        .when(status >= 500, "server_error")
        .otherwise("unknown")
    )
    retryable = code.isin("request_timeout", "network_error", "rate_limited", "server_error")
    return F.struct(code.alias("code"), F.when(code.isin("request_timeout", "network_error"), None).otherwise(status).alias("status"), retryable.alias("retryable"))


def curation_prompts(bullets: DataFrame, recent: DataFrame) -> DataFrame:
    """(slug, text): what a curator is asked about a topic - its live bullets (slug, n, content), numbered, and its recent writes (slug, place, day, tag, content).

    Give bounded lists: the latest writes, not all.
    """
    lines = lambda rows, line, order: rows.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))).alias("x")).select("slug", F.array_join("x.line", "\n").alias("text"))
    one = lines(bullets, F.concat_ws(". ", F.col("n").cast("string"), "content"), F.col("n")).withColumnRenamed("text", "held")
    two = lines(recent, F.format_string("[%s] [%s] %s", "day", F.coalesce("tag", F.lit("EVENT")), "content"), -F.col("place")).withColumnRenamed("text", "new")
    rows = two.join(one, "slug", "left")
    text = F.concat_ws("\n", F.concat(F.lit("Topic: "), "slug"), F.lit("Current bullets:"), F.coalesce("held", F.lit("(none)")), F.lit("Recent entries:"), "new")
    return rows.select("slug", text.alias("text"))
