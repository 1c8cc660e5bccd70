"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a lower-cased text in which
everything but letters counts as a space, hashed to ``2 ** BITS`` buckets. A
bucket's ratio is log P(bucket | toxic) / P(bucket | clean), from the number of
training documents that hold it; logistic regression is fitted on features scaled
by their ratios, and the product of weight and ratio scores a text.

Training takes a bounded sample - ``max_per_class`` labelled documents of each
class, by hash of their id - and counts it on the executors; the driver sees a
ratio for each bucket and the sample's features. Every n-gram of the sample has a
weight. Scoring reads every whole text, cut into stretches of bounded length, so a
very long text takes its characters and one table of buckets. Null and empty texts have no features and get the score of the
intercept. Labels that are null or belong to no document are not learned from;
without any of one class every text scores 0. Rows are scored one by one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, lean, materialize, small_batches, text_or_empty

BITS = 21
SIZES = (3, 4, 5, 6)
#: Spaces after each text, so that each of its places begins n-grams of all sizes.
GAP = max(SIZES)
#: Squared standard errors at which a ratio counts half, and steps of the regression.
DOUBT, STEPS = 50.0, 40
#: Characters of a stretch of a text, whose n-grams are looked at together.
STRETCH = 1 << 18

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """By code point: itself if a letter, else a space."""
    if not _letters:
        points = np.arange(0x110000, dtype=np.uint32)
        keep = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        _letters.append(np.where(keep, points, 32).astype(np.uint32))
    return _letters[0]


def _grams(text: str):
    """The distinct buckets of each stretch of a text, ordered; the last n-grams begin with the space after the text."""
    low = " " + text.lower() + " " * GAP
    starts = len(low) - GAP + 1
    for a in range(0, starts, STRETCH):
        points = _letter_table()[np.frombuffer(low[a : a + STRETCH + GAP - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        h, n, found = points.copy(), min(STRETCH, starts - a), []
        for size in range(2, GAP + 1):
            h = h[:-1] * np.uint32(0x01000193) + points[size - 1 :]
            if size in SIZES:
                found.append(((h[:n] ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
        buckets = np.sort(np.concatenate(found))
        yield buckets[np.append(True, buckets[1:] != buckets[:-1])], starts <= STRETCH


def new_buckets(text: str):
    """The distinct buckets of a text, part by part."""
    seen = None
    for buckets, whole in _grams(text):
        if not whole:
            seen = np.zeros(1 << BITS, dtype=bool) if seen is None else seen
            buckets = buckets[~seen[buckets]]
            seen[buckets] = True
        yield buckets


def buckets_of(text: str) -> np.ndarray:
    """The distinct buckets of a text, ordered."""
    return np.sort(np.concatenate(list(new_buckets(text)))).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, each once, ordered."""
    sets = [buckets_of(t) for t in texts]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(x) for x in sets])
    return doc, np.concatenate([np.zeros(0, np.int64), *sets])


@dataclass
class Model:
    """A weight for each bucket and an intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of toxicity, for each text: of its distinct buckets the weights are summed."""
        out = np.full(len(texts), self.intercept)
        for i, text in enumerate(texts):
            for new in new_buckets(text):
                out[i] += self.weights[new].sum(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def sample(labelled: DataFrame, label: str, max_per_class: int) -> DataFrame:
    """At most ``max_per_class`` rows of each class, those of the smallest hash of doc_id."""
    one = lambda k: labelled.where(F.col(label) == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
    return one(1).unionByName(one(0))


def fitted(rows: list[tuple[int, np.ndarray]], ratios: np.ndarray, prior_shift: float, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features scaled by ``ratios``: (weights times ratios, intercept)."""
    y = np.array([r[0] for r in rows], dtype=float)
    # the rarer class counts for more, by the square root of the odds
    share = np.where(y == 1, np.sqrt((len(y) - y.sum()) / y.sum()), 1.0)
    counts = np.array([len(r[1]) for r in rows])
    cols = np.concatenate([r[1] for r in rows])
    ends = np.concatenate(([0], np.cumsum(counts)))
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], 1 << 22)), len(rows)))
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))  # of rows, with about so many features each
    w, b = np.zeros(len(ratios)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        scaled, z, g = w * ratios, np.full(len(rows), b), np.zeros_like(w)
        for i, j in parts:
            d = np.repeat(np.arange(j - i), counts[i:j])
            z[i:j] += np.bincount(d, weights=scaled[cols[ends[i] : ends[j]]], minlength=j - i)
        e = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / share.sum()
        for i, j in parts:
            g += np.bincount(cols[ends[i] : ends[j]], weights=np.repeat(e[i:j], counts[i:j]), minlength=len(w))
        g = g * ratios + penalty * w
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * (1 - t / (steps + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w * ratios, b + prior_shift


def ratios(texts: DataFrame, n1: int, n0: int, label: str = "toxic") -> DataFrame:
    """(bucket, ratio, sure) of every bucket that some of ``texts`` (label, text) have; n1 and n0 are how many there are of each class.

    ``sure`` is the ratio over its standard error.
    """

    def count(batches):
        counts = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            y, ts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for a, b in chunks_of(ts):
                doc, bucket = features(ts[a:b])
                for k in (0, 1):
                    counts[k] += np.bincount(bucket[y[a:b][doc] == k], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(counts.sum(axis=0))
        for i in range(0, len(some), 1 << 16):
            part = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(counts[1][part]), pa.array(counts[0][part])], ["bucket", "c1", "c0"]
            )

    r = F.log(((F.col("c1") + 1) / (n1 + 2)) / ((F.col("c0") + 1) / (n0 + 2)))
    sure = F.abs("ratio") / F.sqrt(1 / (F.col("c1") + 1) + 1 / (F.col("c0") + 1))
    sums = texts.select(label, "text").mapInArrow(lean(count), "bucket int, c1 int, c0 int").groupBy("bucket").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    return sums.withColumn("ratio", r).withColumn("sure", sure).select("bucket", "ratio", "sure")


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    max_per_class: int = 1500,
    doubt: float = DOUBT,
    penalty: float = 1e-4,
    steps: int = STEPS,
    doc_col="doc_id",
    text_col="text",
) -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id and ``label``).

    Ratios are shrunk toward 0 by what their standard error says: to half where the
    ratio is sqrt(``doubt``) standard errors, hardly where it is many.
    """
    small_batches(docs.sparkSession)
    labelled = labels.select(F.col("doc_id"), F.col(label).cast("int").alias(label)).where(F.col(label).isin(0, 1))
    total = {r[label]: r["count"] for r in labelled.groupBy(label).count().collect()}
    ids = F.broadcast(sample(labelled, label, max_per_class))  # 2 * max_per_class rows at most
    texts = materialize(
        docs.select(F.col(doc_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
        .join(ids, "doc_id")
        .select(label, "text")
        .repartition(8),
        "toxicity-sample",
    )
    n = {r[label]: r["count"] for r in texts.groupBy(label).count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(1 << BITS, dtype=np.float32), -40.0)

    trust = F.col("sure") * F.col("sure") / (F.col("sure") * F.col("sure") + F.lit(doubt))
    shrunk = ratios(texts, n1, n0, label).select("bucket", (F.col("ratio") * trust).alias("ratio")).toArrow().sort_by("bucket")
    buckets = np.asarray(shrunk["bucket"]).astype(np.int64)  # 2 ** BITS at most

    def extract(batches):
        for batch in batches:
            rows = [buckets_of(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], [label, "cols"])

    number = np.zeros(1 << BITS, dtype=np.int32)
    number[buckets] = np.arange(len(buckets))
    found = texts.mapInArrow(lean(extract), f"{label} int, cols binary").toLocalIterator()
    rows = [(x[label], number[np.frombuffer(bytes(x["cols"]), dtype="<i4")]) for x in found]
    shift = np.log((total[1] / total[0]) / (n1 / n0))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[buckets], intercept = fitted(rows, np.asarray(shrunk["ratio"]), float(shift), penalty, steps)
    return Model(weights, float(intercept))


def score(docs: DataFrame, model: Model, doc_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score) for every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            scores = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        lean(run), "doc_id long, score double"
    )
