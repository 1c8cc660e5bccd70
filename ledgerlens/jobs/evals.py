"""Retrieval quality over rankings (qid, key, session, rank) and gold (qid, session)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapsed(rankings: DataFrame) -> DataFrame:
    """Each session's best hit, ranked anew."""
    best = rankings.groupBy("qid", "session").agg(F.min("rank").alias("rank"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "session")).cast("long"))


def recall(sessions: DataFrame, gold: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """One row: recall_any, recall_all for each k, and mean reciprocal rank."""
    hits = gold.join(sessions, ["qid", "session"], "left").groupBy("qid").agg(F.count("*").alias("n"), F.min("rank").alias("best"), F.collect_list("rank").alias("ranks"))
    out = [F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr")]
    for k in ks:
        within = F.size(F.expr(f"filter(ranks, r -> r <= {k})"))
        out += [F.avg((within > 0).cast("double")).alias(f"recall_any_{k}"), F.avg((within == F.col("n")).cast("double")).alias(f"recall_all_{k}")]
    return hits.agg(*out)


def ndcg(sessions: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg) with binary gains."""
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    found = gold.join(sessions, ["qid", "session"], "left").groupBy("qid").agg(F.sum(F.coalesce(gain, F.lit(0.0))).alias("dcg"), F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return found.select("qid", (F.col("dcg") / ideal).alias("ndcg"))


def precision_by_tier(hits: DataFrame, k: int = 5) -> DataFrame:
    """(tier, n, precision) over hits (qid, rank, tier, relevant) within the first ``k``."""
    return hits.where(F.col("rank") <= k).groupBy("tier").agg(F.count("*").alias("n"), F.avg(F.col("relevant").cast("double")).alias("precision"))


def gold_of(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, session) from turns (qid, session, has_answer): sessions with a marked turn; the stated answers (qid, session) where no turn is marked either way."""
    marked = turns.groupBy("qid").agg(F.count("has_answer").alias("marks"))
    own = turns.where("has_answer").select("qid", "session").distinct()
    without = marked.where("marks = 0").select("qid")
    return own.unionByName(answers.select("qid", "session").distinct().join(without, "qid", "left_semi"))


def recall_by_type(sessions: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(type, n, recall_all) over gold (qid, type, session): the share of questions whose every gold session is among the first ``k``."""
    hits = gold.join(sessions, ["qid", "session"], "left").groupBy("qid", "type").agg(F.bool_and(F.coalesce(F.col("rank") <= k, F.lit(False))).alias("whole"))
    return hits.groupBy("type").agg(F.count("*").alias("n"), F.avg(F.col("whole").cast("double")).alias("recall_all"))


def regressions(lexical: DataFrame, hybrid: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(n), one row: gold (qid, slug) that the lexical arm has among its first ``k`` and the fused ranking hasn't."""
    first = lambda hits: gold.join(hits.where(F.col("rank") <= k).select("qid", "slug").distinct(), ["qid", "slug"], "left_semi")
    return first(lexical).join(first(hybrid), ["qid", "slug"], "left_anti").agg(F.count("*").alias("n"))


def advisory_precision(hits: DataFrame, k: int = 5) -> DataFrame:
    """(precision), one row: over queries and advisory tiers with a hit (qid, tier, rank, relevant) among the first ``k``, the mean of their precision."""
    each = hits.where((F.col("rank") <= k) & (F.col("tier") != "curated")).groupBy("qid", "tier").agg(F.avg(F.col("relevant").cast("double")).alias("p"))
    return each.agg(F.avg("p").alias("precision"))


#: Tiers that an answer must not be written from.
NO_WRITE = ("note", "source")


def compliance(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(compliance), one row, in per cent of cases (qid, correct_slug, wrong_tier): the right topic's curated entry is among hits (qid, slug, tier), and the wrong tier is none to write from.

    Without cases there is nothing to comply with: 100.
    """
    right = hits.where("tier = 'curated'").select("qid", F.col("slug").alias("correct_slug")).distinct().withColumn("found", F.lit(True))
    each = cases.join(right, ["qid", "correct_slug"], "left").select((F.col("found").isNotNull() & F.col("wrong_tier").isin(*NO_WRITE)).alias("ok"))
    return each.agg(F.coalesce(100 * F.avg(F.col("ok").cast("double")), F.lit(100.0)).alias("compliance"))


def promotion(metrics: DataFrame, gain: float = 5, precision: float = 0.5, trust: float = 95) -> DataFrame:
    """The pre-registered bar over one row of percentages (lexical_recall, hybrid_recall, advisory_precision, compliance, regressions)."""
    criteria = {
        "recall_gain": F.col("hybrid_recall") >= F.col("lexical_recall") + gain,
        "advisory_precision_ok": F.col("advisory_precision").isNull() | (F.col("advisory_precision") >= precision),
        "trust_compliance": F.col("compliance") >= trust,
        "no_regression": F.col("regressions") == 0,
    }
    rows = metrics.select(*[c.alias(n) for n, c in criteria.items()])
    return rows.withColumn("promote", F.col("recall_gain") & F.col("advisory_precision_ok") & F.col("trust_compliance") & F.col("no_regression"))


def remaining(asked: DataFrame, done: DataFrame) -> DataFrame:
    """Questions (qid, ..) that an earlier run hasn't answered (qid)."""
    return asked.join(done.select("qid").distinct(), "qid", "left_anti")
