"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat, exact_dedup, packing, pieces, quality_rules, quality_sites, secret_scan, simhash, token_store, toxicity
from ledgerlens.llm.common import scratch_path

BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} and" for i in range(9000))
ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "a  b\tc"), (5, "a  b\tc"), (6, LONG), (7, "One 😀 café. Two lines!\nnext"), (8, LONG),
    (9, "x" * 5000), (None, "no id here"),
]
CLASH = "ids kept fp rank length piece label part n name row_id bucket host path evidence h w lines good text_sha256 key conv_id chunk spans".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in ROWS], "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact_dedup(docs, none):
    rows = exact_dedup.dedup(docs, block_bytes=64).collect()
    assert len(rows) == len(ROWS)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    sizes = {}
    for i, t in ROWS:
        sizes.setdefault(norm(t), []).append(i)
    smallest = lambda v: min(v, key=lambda x: (x is not None, x))
    want = Counter((len(v), smallest(v)) for v in sizes.values() for _ in v)
    assert Counter((r.group_size, r.keep_id) for r in rows) == want
    assert sum(r.kept for r in rows) == len(sizes)
    assert exact_dedup.dedup(none).count() == 0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and {r.fp for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in rows if r.doc_id in (6, 8)} == {6}
    assert simhash.near_duplicates(none).count() == 0
    assert {r.group_id for r in simhash.groups(docs).collect() if r.doc_id in (6, 8)} == {6}
    assert simhash.groups(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, BPE).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert packing.pack(none, BPE).count() == 0


def test_token_store(spark, docs, none):
    path = scratch_path(spark, "t")
    token_store.write(docs, path, BPE)
    rows = sorted(token_store.with_start(token_store.read(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ROWS), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 0
        at += r.n_tokens
    assert token_store.read(spark, path).where("doc_id = 7").count() == 1
    empty = scratch_path(spark, "t")
    token_store.write(none, empty, BPE)
    assert token_store.read(spark, empty).count() == 0


def test_pieces(docs, none):
    rows = pieces.encode(docs, SPM).collect()
    assert len(rows) == len(ROWS) and all(r.agrees for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert pieces.encode(none, SPM).count() == 0


def test_secrets(docs, none):
    rows = secret_scan.scan(docs).collect()
    assert len(rows) == len(ROWS) and not any(r.spans for r in rows)
    assert secret_scan.scan(none).count() == 0 and secret_scan.redact(none).count() == 0
    assert [r.text for r in secret_scan.redact(docs).where("doc_id = 1").collect()] == [None]


def test_quality_rules(docs, none):
    rows = {r.doc_id: r for r in quality_rules.rated(docs).collect()}
    assert rows[1].n_words == rows[2].n_words == rows[3].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[4].n_words == 3 and rows[6].n_words == 18000 and rows[6].n_repeat_words == 18000
    assert quality_rules.rated(none).count() == 0 and quality_rules.cleaned(docs).columns == docs.columns


def test_quality_sites(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, 1, 0), (99, 1, 1), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = quality_sites.rated(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.posterior <= 1 for r in rows)
    assert quality_sites.rated(none, labels).count() == 0
    assert all(r.evidence == 0.5 for r in quality_sites.rated(docs, labels.limit(0)).collect())


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(4, 0), (6, 0), (7, 1), (99, 1), (None, 0), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(none, model).count() == 0
    rows = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert all(r.score < 1e-9 for r in rows)


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, None, None, None), (None, 0, "user", "z"), (5, 7, "user", "q"), (5, 7, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("x"))
    rows = {r.conv_id: r for r in chat.render(df).collect()}
    assert set(rows) == {1, 4, None, 5}
    assert rows[1].copies == 2 and rows[1].rendered == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>"
    assert rows[5].n_turns == 2 and rows[4].rendered == "<|unknown|>\n\n<|end|>"
    assert chat.render(df.limit(0)).count() == 0
    assert rows[None].rendered == "<|user|>\nz\n<|end|>" and rows[None].n_turns == 1


def test_turns_without_a_conversation(spark):
    turns = [(None, 3, "user", "a"), (None, 0, "user", "a"), (None, 1, "user", "b"), (None, 2, "user", "c"), (7, 0, "user", "b"), (8, 0, "user", "c"), (8, 1, "user", "d"), (9, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id or 0), r.copies, r.n_turns, len(r.rendered)) for r in chat.render(df).collect())
    assert got == [(0, 2, 1, 18), (7, 2, 1, 18), (8, 1, 2, 37), (9, 1, 1, 300_017)]  # c begins the conversation 8
    assert chat.render(df.where("conv_id is null")).count() == 3 and chat.render(df.where("conv_id is not null")).count() == 3


def test_long_conversations_are_rendered_in_parts(spark):
    df = spark.range(1300).selectExpr("9L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text")
    rows = sorted(chat.render(df).collect(), key=lambda r: r.part)
    assert [r.part for r in rows] == [0, 1, 2] and all(r.n_turns == 1300 for r in rows)
    assert rows[2].rendered.endswith("1299\n<|end|>")
