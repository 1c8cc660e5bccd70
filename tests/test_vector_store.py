"""The vector store: what is embedded, kept, dropped and found again."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.jobs import vector_store as vs
from ledgerlens.sources import versions
from ledgerlens.sources.storage import scratch_path

SCHEMA = "key string, slug string, seq long, tag string, retired boolean, content string"
LONG = " ".join(f"word{i}" for i in range(1200))


def units(spark, rows):
    return spark.createDataFrame([(f"{s}::{i}::0", s, i, tag, gone, text) for s, i, tag, gone, text in rows], SCHEMA)


ROWS = [("a", 1, "CURATED", False, "one fact"), ("a", 2, "FACT", False, "one fact"), ("b", 3, "SOURCE", False, LONG), ("b", 4, "CURATED", True, "retired"), ("c", 5, "FACT", False, "Café \"quoted\"\n")]


def test_texts_are_embedded_once(spark):
    root = scratch_path(spark, "t")
    first = vs.build(units(spark, ROWS), root, vs.COUNTING, 5, "h")
    assert first.manifest["embedded_new"] == first.manifest["vectors"] == first.vectors.count() and first.manifest["log_head_seq"] == 5
    assert first.manifest["chunks"] == first.occurrences.count() == first.manifest["vectors"] + 1
    got = {r.vector_key: r.vector for r in first.vectors.collect()}
    key = lambda t: hashlib.sha256(json.dumps(t, ensure_ascii=False).encode()).hexdigest()
    assert got[key("one fact")] == [len("passage: one fact"), 2.0, 2.0] and key("Café \"quoted\"\n") in got and key("retired") not in got
    again = vs.build(units(spark, ROWS), root, vs.COUNTING, 6)
    assert (again.manifest["embedded_new"], again.manifest["reused"], again.manifest["pruned"]) == (0, len(got), 0)
    assert {r.vector_key: r.vector for r in again.vectors.collect()} == got


def test_new_and_dropped_texts(spark):
    root = scratch_path(spark, "t")
    vs.build(units(spark, ROWS), root, vs.COUNTING)
    rows = [*ROWS[1:2], ("d", 9, "FACT", False, "new")]
    assert vs.status(vs.load(spark, root), units(spark, rows), vs.COUNTING).first().status == "partial"
    found = vs.build(units(spark, rows), root, vs.COUNTING)
    assert found.manifest["embedded_new"] == 1 and found.manifest["reused"] == 1 and found.vectors.count() == 2 and found.manifest["pruned"] > 3
    assert vs.status(found, units(spark, rows), vs.COUNTING).first().status == "fresh"
    assert vs.status(found, units(spark, rows[:1]), vs.COUNTING).first().status == "stale"
    for _ in range(3):
        found = vs.build(units(spark, rows), root, vs.COUNTING)
    assert found.vectors.count() == 2 and versions.numbers(spark, root, "manifest") == [5, 4]


def test_another_model_embeds_all_anew(spark):
    root = scratch_path(spark, "t")
    first = vs.build(units(spark, ROWS), root, vs.COUNTING)
    other = vs.Model({**vs.COUNTING.identity, "model_revision": "2"}, vs.counting, "passage: ")
    assert vs.status(first, units(spark, ROWS), other).first().status == "other_model"
    second = vs.build(units(spark, ROWS), root, other)
    assert second.manifest["embedded_new"] == first.manifest["vectors"] and second.manifest["identity_digest"] != first.manifest["identity_digest"]
    assert vs.status(None, units(spark, ROWS), other).first().status == "missing"


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(os.path.join(folder, f"{os.getpid()}-{os.urandom(4).hex()}"), "w").close()
        return lambda texts: [[1.0] for _ in texts]

    model = vs.Model({"model_id": "marks", "run": folder}, load)
    texts = spark.range(400).select(F.col("id").cast("string").alias("vector_key"), F.lit("x").alias("content")).repartition(12)
    assert vs.embedded(texts, model).count() == 400
    loads = [n.split("-")[0] for n in os.listdir(folder)]
    assert loads and len(loads) == len(set(loads))


def test_two_writers_of_one_version(spark):
    root, row = scratch_path(spark, "t"), spark.createDataFrame([(1,)], "a int")
    versions.publish(row, root, "v", 1)
    with pytest.raises(versions.Conflict):
        versions.publish(row, root, "v", 1)
    assert versions.latest(spark, root, "v", "a int") == (1, [(1,)]) and versions.latest(spark, root, "other", "a int") == (0, [])
    spark.createDataFrame([], "a int").write.parquet(f"{root}/v-2")
    versions.remove(spark, f"{root}/v-2/_SUCCESS")
    assert versions.numbers(spark, root, "v") == [1]


def test_nothing_live(spark):
    found = vs.build(units(spark, []), scratch_path(spark, "t"), vs.COUNTING)
    assert found.vectors.count() == 0 == found.occurrences.count()
