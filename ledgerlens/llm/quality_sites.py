"""Quality by hierarchical empirical Bayes: a document's evidence, and what its site is like.

A logistic classifier over a text's form (symbols, shouting, separators, repeated
words, sentence ends) gives each document a probability of being good. Grouped
aggregation turns these into host means and, below them, path means; each is a
Beta posterior whose prior is the level above, with a strength estimated from how
much sites differ (method of moments), so sparse sites shrink toward the global
mean. A document's posterior odds are its own odds times its path's odds over the
global odds.

The classifier is fitted on at most ``max_per_class`` labelled documents of each
class; everything else covers all rows. Null hosts and paths form a site of their
own; null and empty texts get the evidence of an empty text. Labels that are null
or belong to no document are not learned from; without any of one class evidence
is 0.5 throughout. Rows are rated one by one; an empty table gives an empty
result. ``rated`` passes other columns through unless they bear a result's name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, joined, materialize, text_or_empty
from .toxicity import sample


def form(text: Column) -> list[Column]:
    """Features of a text's form, each a rate bounded by 1 or the logarithm of a length.

    Frequent characters are counted by what is left without the others, rare matches one by one.
    """
    length = F.length(text)
    n = F.greatest(length, F.lit(1))
    spaces = F.size(F.split(text, SPACE))  # runs of white space, and one
    left = lambda others: F.length(F.regexp_replace(text, others, ""))
    gone = lambda mark: length - F.length(F.replace(text, F.lit(mark)))
    rate = lambda count, over: F.least(count / over, F.lit(1.0))
    return [
        rate(left("[^#*$%&<>]+"), n),
        rate(gone("!!") / 2, spaces),
        rate(gone("|"), spaces),
        rate(left(r"\P{Lu}+"), n),
        rate(F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D](?=\1(?![^\x20\x09-\x0D]))")), spaces),
        rate(F.regexp_count(text, F.lit(r"[.!?](?![^\x20\x09-\x0D])")), spaces),
        F.log1p(length) / 10,
    ]


@dataclass
class Evidence:
    """A logistic classifier over ``form``."""

    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float

    def column(self, text: Column) -> Column:
        z = F.lit(self.intercept)
        for x, m, s, w in zip(form(text), self.means, self.scales, self.weights, strict=True):
            z = z + (x - m) / s * w
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_per_class: int = 4000, penalty: float = 1e-3, doc_col="doc_id", text_col="text") -> Evidence:
    """Newton's method on a bounded sample of labelled documents, weighted back to the classes' shares."""
    labelled = labels.select("doc_id", F.col(label).cast("int").alias(label)).where(F.col(label).isin(0, 1))
    total = {r[label]: r["count"] for r in labelled.groupBy(label).count().collect()}
    ids = F.broadcast(sample(labelled, label, max_per_class))  # 2 * max_per_class rows at most
    text = text_or_empty(text_col)
    rows = (
        docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col))
        .join(ids, "doc_id")
        .select(label, *[f.alias(f"f{i}") for i, f in enumerate(form(text))])
        .collect()
    )
    if len({r[0] for r in rows}) < 2:
        k = len(form(text))
        return Evidence([0.0] * k, [1.0] * k, [0.0] * k, 0.0)
    data = np.array([tuple(r) for r in rows], dtype=float)
    y, x = data[:, 0], data[:, 1:]
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.hstack([(x - means) / scales, np.ones((len(x), 1))])
    share = np.array([total[int(k)] / (y == k).sum() for k in y])
    share /= share.mean()
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty * len(x)] * (x.shape[1] - 1) + [1e-9])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge
        w += np.linalg.solve(h, x.T @ (share * (y - p)) - ridge @ w)
    return Evidence(means.tolist(), scales.tolist(), w[:-1].tolist(), float(w[-1]))


def site_keys(host: str, path: str) -> list[Column]:
    return [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path")]


def strength(mean: float, between: float, within: float) -> float:
    """Rows that a level's prior counts for: large where sites hardly differ."""
    if between <= 0:
        return 1e6
    return float(min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)) if within >= 0 else 1e6


def _between(groups: DataFrame, mean: str) -> tuple[float, float]:
    """Variance of site means around ``mean`` beyond what their sizes explain, and the mean variance within."""
    d = F.col("s") / F.col("n") - F.col(mean)
    r = groups.agg(
        F.sum(F.col("n") * d * d).alias("d2"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("w")
    ).first()
    if not r["n"] or r["k"] < 2:
        return 0.0, 0.0
    within = max(r["w"] / max(r["n"] - r["k"], 1), 0.0)
    return max((r["d2"] - (r["k"] - 1) * within) / r["n"], 0.0), within


def sites(evidence: DataFrame) -> tuple[DataFrame, float, int]:
    """((host, path, n, host_mean, path_mean), global mean, rows) from rows of (host, path, evidence)."""
    sums = [F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("q")]
    paths = materialize(evidence.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    row = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(row["s"] / row["n"], 1e-4), 1 - 1e-4) if row["n"] else 0.5
    k_host = strength(mean, *_between(hosts.withColumn("m", F.lit(mean)), "m"))
    host_means = hosts.select("host", ((F.lit(k_host * mean) + F.col("s")) / (F.lit(k_host) + F.col("n"))).alias("host_mean"))
    under = paths.join(host_means, "host")
    k_path = strength(mean, *_between(under, "host_mean"))
    path_mean = (F.lit(k_path) * F.col("host_mean") + F.col("s")) / (F.lit(k_path) + F.col("n"))
    means = under.select("host", "path", F.col("n").alias("site_rows"), "host_mean", path_mean.alias("path_mean"))
    return materialize(means, "quality-sites"), mean, row["n"] or 0


def posterior(mean: float) -> Column:
    """The document's probability of being good: the odds of its evidence times what the site's odds are of all rows' odds."""
    odds = lambda p: p / (1 - p)
    held = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-4)), F.lit(1e-4))
    o = odds(held(F.col("evidence"))) * odds(held(F.col("path_mean"))) / odds(mean)
    return o / (1 + o)


#: Columns that ``rated`` adds.
RESULTS = ("evidence", "host_mean", "path_mean", "posterior", "kept")


def rated(
    docs: DataFrame, labels: DataFrame, host="source", path="lang", text_col="text", doc_col="doc_id", threshold: float = 0.5,
    columns: list[str] | None = None,
) -> DataFrame:
    """``docs``, or those ``columns`` of it, with evidence, host_mean, path_mean, posterior and kept.

    With ``columns`` evidence is written with them and texts are read for it once. Without, texts pass
    through: they are read again, not copied, and sites join by their keys as the engine sees fit.
    """
    model = fit(docs, labels, doc_col=doc_col, text_col=text_col)
    rest = [c for c in (docs.columns if columns is None else columns) if c not in RESULTS]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), *site_keys(host, path), model.column(text_or_empty(text_col)).alias("evidence"))
    if columns is not None:
        own = materialize(own, "quality-evidence")
    means, mean, total = sites(own.select("host", "path", "evidence"))
    both = own.join(means, ["host", "path"]) if columns is None else joined(own, means, ["host", "path"], "site_rows", total)
    out = both.withColumn("posterior", posterior(mean))
    return out.withColumn("kept", F.col("posterior") >= threshold).select("row.*", *RESULTS)
