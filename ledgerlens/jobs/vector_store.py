"""A content-addressed store of vectors: each distinct text is embedded once, whoever holds it.

A build needs the vectors of all live chunks, embeds those that the store lacks, and drops
those that no chunk needs any more. Embedders are loaded once a worker, by a function that
is passed in, and get texts in batches. A store made by another model, or with other
settings of it, is not used: all is embedded anew. Vectors, the chunks that hold them and
the manifest are written as a new version that is published last; folders that it doesn't
name are deleted when the version after it is published.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators.retrieval import chunked, live
from ..sources.storage import materialize
from ..sources.versions import latest, numbers, publish, remove

VECTORS = "vector_key string, vector array<double>"
OCCURRENCES = "slug string, seq long, chunk_index int, tier string, vector_key string, char_start int, char_end int"
MANIFEST = (
    "identity string, identity_digest string, log_head_seq long, log_head_hash string, folders array<string>, occurrences string,"
    " vectors long, chunks long, embedded_new long, reused long, pruned long, per_tier map<string,long>"
)
BATCH = 64

Embedder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Model:
    """What tells models apart, and how to load one: ``load`` runs in the workers."""

    identity: dict
    load: Callable[[], Embedder] = field(compare=False)
    prefix: str = ""

    @property
    def digest(self) -> str:
        return hashlib.sha256(canonical.text({**self.identity, "doc_prefix": self.prefix}).encode()).hexdigest()


def occurrences(units: DataFrame) -> DataFrame:
    """Chunks of live units with their tier and the key of their text."""
    c = chunked(live(units))
    return c.select("slug", "seq", F.col("chunk_index").cast("int"), "tier", canonical.key_of(F.col("content")).alias("vector_key"), F.col("char_start").cast("int"), F.col("char_end").cast("int"), "content")


def embedded(texts: DataFrame, model: Model) -> DataFrame:
    """(vector_key, vector) of texts (vector_key, content)."""

    def run(batches):
        embed = None
        for batch in batches:
            if embed is None:
                embed = _loaded(model)
            keys, own = batch.column(0), batch.column(1).to_pylist()
            for i in range(0, len(own), BATCH):
                vectors = embed([model.prefix + t for t in own[i : i + BATCH]])
                yield pa.RecordBatch.from_arrays([keys[i : i + BATCH], pa.array(vectors, pa.list_(pa.float64()))], ["vector_key", "vector"])

    return texts.select("vector_key", "content").mapInArrow(run, VECTORS)


_models: dict[str, Embedder] = {}


def _loaded(model: Model) -> Embedder:
    if model.digest not in _models:
        _models.clear()
        _models[model.digest] = model.load()
    return _models[model.digest]


@dataclass
class Store:
    version: int
    manifest: dict
    vectors: DataFrame
    occurrences: DataFrame


def load(spark: SparkSession, root: str) -> Store | None:
    """The last published version; none where there is none."""
    n, rows = latest(spark, root, "manifest", MANIFEST)
    if not n:
        return None
    m = rows[0].asDict()
    vectors = spark.read.schema(VECTORS).parquet(*m["folders"]) if m["folders"] else spark.createDataFrame([], VECTORS)
    return Store(n, m, vectors, spark.read.schema(OCCURRENCES).parquet(m["occurrences"]))


def build(units: DataFrame, root: str, model: Model, log_head_seq: int = 0, log_head_hash: str | None = None) -> Store:
    """Bring the store under ``root`` up to date with ``units`` (key, slug, seq, tag, retired, content) and return it."""
    spark, before = units.sparkSession, load(units.sparkSession, root)
    number = (before.version if before else 0) + 1
    own = materialize(occurrences(units), "chunks")
    at = f"{root}/occurrences-of-{number}"
    own.drop("content").write.mode("overwrite").parquet(at)
    needed = materialize(own.groupBy("vector_key").agg(F.min("content").alias("content")), "needed")
    same = before is not None and before.manifest["identity_digest"] == model.digest
    held = before.vectors.select("vector_key") if same else spark.createDataFrame([], "vector_key string")
    folder = f"{root}/vectors-of-{number}"
    embedded(needed.join(held, "vector_key", "left_anti"), model).write.mode("overwrite").parquet(folder)
    new = spark.read.schema(VECTORS).parquet(folder).count()
    folders, wanted, orphans = [folder], needed.count(), 0
    if same:
        orphans = held.join(needed, "vector_key", "left_anti").count()
        if orphans:  # what is still needed is written without the rest
            kept = f"{root}/vectors-kept-of-{number}"
            before.vectors.join(needed, "vector_key", "left_semi").write.mode("overwrite").parquet(kept)
            folders = [kept, folder]
        else:
            folders = [*before.manifest["folders"], folder]
    tiers = {r.tier: r.n for r in own.groupBy("tier").agg(F.count("*").alias("n")).collect()}  # three
    row = (
        json.dumps(model.identity, sort_keys=True), model.digest, log_head_seq, log_head_hash, folders, at, wanted, sum(tiers.values()), new, wanted - new,
        orphans if same else (before.vectors.count() if before else 0), tiers,
    )
    publish(spark.createDataFrame([row], MANIFEST), root, "manifest", number)
    _forget(spark, root, before)
    return load(spark, root)


def _forget(spark: SparkSession, root: str, before: Store | None) -> None:
    """Delete what only versions older than the last but one name; a reader of that one is not disturbed."""
    for n in numbers(spark, root, "manifest")[2:]:
        old = spark.read.schema(MANIFEST).parquet(f"{root}/manifest-{n}").first()
        named = {f for k in numbers(spark, root, "manifest")[:2] for f in spark.read.schema(MANIFEST).parquet(f"{root}/manifest-{k}").first().folders}
        for path in [*[f for f in old.folders if f not in named], old.occurrences, f"{root}/manifest-{n}"]:
            remove(spark, path)


def status(store: Store | None, units: DataFrame, model: Model) -> DataFrame:
    """(missing, orphaned, status), one row: missing, other_model, partial, stale or fresh."""
    needed = occurrences(units).select("vector_key").distinct()
    if store is None or store.manifest["identity_digest"] != model.digest:
        name = "missing" if store is None else "other_model"
        return needed.agg(F.count("*").alias("missing"), F.lit(0).cast("long").alias("orphaned"), F.lit(name).alias("status"))
    both = needed.withColumn("n", F.lit(1)).join(store.vectors.select("vector_key", F.lit(1).alias("h")), "vector_key", "full_outer")
    counts = both.agg(F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("n").isNull()).alias("orphaned"))
    return counts.withColumn("status", F.when(F.col("missing") > 0, "partial").when(F.col("orphaned") > 0, "stale").otherwise("fresh"))


def counting(_: int = 0) -> Embedder:
    """A stand-in for a model: a text's length, spaces, and letters e."""
    return lambda texts: [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


COUNTING = Model({"model_id": "counting", "model_revision": "1", "dtype": "double", "chunk_size": 256, "chunk_overlap": 64}, counting, "passage: ")
