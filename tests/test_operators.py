"""Small cases of operators that the tables exercise little."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as T
from ledgerlens.functions import vectors
from ledgerlens.jobs import answers, evals, imports
from ledgerlens.operators import admission, blocks, preconditions, proposals, retrieval
from ledgerlens.schema import matrix


def test_tiles_find_what_comparing_all_finds(spark, monkeypatch):
    import random

    monkeypatch.setattr(blocks, "dealt", lambda rows, asked, by, asked_by, a=7, b=3, plain=blocks.dealt: plain(rows, asked, by, asked_by, 7, 3))
    r = random.Random(2)
    vec = lambda n: [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(n)]
    rows = [(f"k{i:02}", vec(3)) for i in range(40)] + [("short", [1.0]), ("none", None), ("empty", [])]
    asked = [(q, vec(3)) for q in range(8)] + [(9, [1.0])]
    got = blocks.nearest(spark.createDataFrame(rows, "key string, embedding array<double>"), spark.createDataFrame(asked, "qid long, vector array<double>"), 0.5, 5)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) if a and len(a) == len(b) else 0.0
    want = set()
    for q, v in asked:
        best = sorted(((-round(dot(x, v), 9), k) for k, x in rows if dot(x, v) >= 0.5))[:5]
        want |= {(q, k, -s, i) for i, (s, k) in enumerate(best, 1)}
    assert {(r.qid, r.key, round(r.score, 9), r.rank) for r in got.collect()} == want
    empty = spark.createDataFrame([], "qid long, vector array<double>")
    assert blocks.nearest(spark.createDataFrame(rows, "key string, embedding array<double>"), empty, 0.5, 5).count() == 0


def test_writer_codes_in_order(spark):
    rows = [
        ("a", 1, "write_event", None, None, "new", False), ("a", 2, "TOPIC_METADATA_SET", None, None, "new", True), ("a", 3, "write_event", "standard", "normal", "new", False), ("a", 4, "write_event", None, None, "general", False),
        ("b", 1, "NOVEL", None, "recovery", "x", False), ("b", 2, "NOVEL", None, None, "x", False), ("b", 3, "ACL_SEALED", None, None, "x", False), ("b", 4, "ACL_SEALED", "admin", None, "x", False), ("c", 1, "write_event", None, None, "held", False),
    ]
    df = spark.createDataFrame(rows, "batch string, i int, type string, socket string, mode string, slug string, typed boolean")
    ok = spark.createDataFrame([("held",)], "slug string")
    got = {(r.batch, r.i): r.code for r in admission.batch(df, matrix(spark), ok).collect()}
    assert got == {
        ("a", 1): "SLUG_NOT_ADMITTED", ("a", 2): None, ("a", 3): None, ("a", 4): None, ("b", 1): "INVALID_WRITER_MODE", ("b", 2): "UNKNOWN_EVENT_TYPE_NOT_REGISTERED", ("b", 3): "EVENT_NOT_ADMISSIBLE", ("b", 4): None, ("c", 1): None,
    }
    whole = {r.batch: (r.i, r.code) for r in admission.whole(admission.batch(df, matrix(spark), ok)).collect()}
    assert whole == {"a": (1, "SLUG_NOT_ADMITTED"), "b": (1, "INVALID_WRITER_MODE"), "c": (None, None)}
    assert {r.code for r in admission.batch(df, matrix(spark), ok, tail_safe=False).collect()} == {"LOG_TAIL_NOT_INTERPRETABLE"}


def test_payload_rules(spark):
    df = spark.createDataFrame([([1, 2], 7, "why"), ([2, 1], 7, None), ([1], 0, None), ([], 7, None), ([9], 7, None), ([1], 7, "two\nlines"), (None, 7, None)], "seqs array<long>, days int, reason string")
    got = [r.r for r in df.select(admission.dismissed_reason(F.col("seqs"), F.col("days"), F.col("reason"), F.lit(5)).alias("r")).collect()]
    assert got == [None, "suggestion_seqs:must_be_strictly_ascending", "cooldown_days:out_of_range", "suggestion_seqs:length_out_of_range", "suggestion_seqs:future_or_unknown_seq", "reason:must_be_single_line", "suggestion_seqs:required"]
    t = df.select(admission.retired_reason(F.lit("a-topic"), F.col("seqs"), F.col("reason"), F.lit(5)).alias("r")).collect()
    assert [r.r for r in t][:2] == [None, "superseded_seqs:must_be_strictly_ascending"]


LOG = "pos long, seq long, slug string, principal string, ts timestamp, k long, type string, tag string, content string, cooldown_days long"


def log_of(spark, *rows):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, i + 1, slug, "p", t0 + timedelta(days=i), k, kind, tag, "text", 5) for i, (slug, kind, tag, k) in enumerate(rows)], LOG)


def test_deferral(spark):
    scan = spark.createDataFrame([("general",)], "slug string")
    few = log_of(spark, *[("general", "write_event", "FACT", 0)] * 3)
    assert preconditions.deferred(few, scan, most=2).first().deferred and not preconditions.deferred(few, scan, most=3).first().deferred
    made = few.unionByName(log_of(spark, ("general", "TOPIC_SUGGESTED", None, 0)))
    assert not preconditions.deferred(made, scan, most=2).first().deferred
    told = few.limit(1).withColumn("slug", F.lit("system")).withColumn("content", F.lit("job first run deferred (n=60)"))
    assert preconditions.deferred(told, scan, most=2).first().deferred and not preconditions.deferred(few.limit(0), scan).first().deferred


def test_retire_codes(spark):
    log = log_of(spark, ("a", "write_event", "CURATED", 0), ("a", "write_event", "FACT", 0), ("b", "write_event", "CURATED", 0), ("a", "write_event", "CURATED", 0), ("a", "TOPIC_BULLETS_RETIRED", None, 0), ("a", "TOPIC_METADATA_SET", None, 3))
    asks = [(1, "aa", [1]), (2, "a", [1]), (3, "a", [2]), (4, "a", [3]), (5, "a", [6]), (6, "a", [1, 99]), (7, "a", []), (8, "a", [0]), (9, "a", [4])]
    asked = spark.createDataFrame(asks, "ask_id int, topic string, seqs array<long>")
    got = {r.ask_id: r.code for r in preconditions.retire(asked, log).collect()}
    assert got[7] == "EMPTY_SEQ_SET" and got[8] == "INVALID_RETIRE_SEQ" and got[1] == "SEQ_NOT_ON_TOPIC"
    # slugs have two letters at least: 'a' itself can't be a topic's name
    assert got[2] == got[3] == got[4] == "INVALID_SLUG"
    seqs = {(r.ask_id, r.seq): r.code for r in preconditions.retire_seqs(asked, log).collect()}
    assert (seqs[2, 1], seqs[3, 2], seqs[4, 3], seqs[5, 6], seqs[6, 99], seqs[9, 4]) == (None, "SEQ_NOT_CURATED", "SEQ_NOT_ON_TOPIC", "SEQ_NOT_FOUND", "SEQ_NOT_FOUND", "SEQ_ALREADY_RETIRED")
    assert {r.ask_id: r.seqs for r in preconditions.still_active(asked, log).collect()} == {2: [1], 6: [1]}


def test_proposals_cite_once_and_not_themselves(spark):
    log = log_of(spark, *[("general", "write_event", "FACT", 0)] * 4, ("other", "write_event", "FACT", 0))
    rows = [("one-x", "n", "d", "r", [1, 2]), ("two-x", "n", "d", "r", [1, 1]), ("three-x", "n", "d", "r", [3]), ("four-x", "n", "d", "r", [5]), ("five-x", "n", None, "r", [1]), ("six-x", "n", "d", "r", None), ("Bad", "n", "d", "r", [1])]
    p = spark.createDataFrame(rows, "slug string, name string, description string, rationale string, seqs array<long>")
    got = {r.slug: r.reason for r in proposals.validated(p, log, 0, spark.createDataFrame([("general",)], "slug string"), spark.createDataFrame([(3,)], "seq long")).collect()}
    assert got == {
        "one-x": None, "two-x": "supporting_seq_duplicate", "three-x": "supporting_seq_self_citation", "four-x": "supporting_seq_wrong_slug", "five-x": "description_missing", "six-x": "supporting_seqs_missing", "Bad": "slug_invalid_regex",
    }


def test_search_modes(spark):
    units = spark.createDataFrame([("aa::1::0", "aa", 1, "CURATED", False, "alpha"), ("bb::2::0", "bb", 2, "CURATED", False, "alpha")], "key string, slug string, seq long, tag string, retired boolean, content string")
    acl = spark.createDataFrame([("aa", ["me"]), ("bb", ["you"])], "slug string, readers array<string>")
    asked = spark.createDataFrame([(0, "alpha")], "qid long, text string")
    assert [r.slug for r in retrieval.search("exact_lookup", units, acl, "me", asked).collect()] == ["aa"]
    assert [r.slug for r in retrieval.search("orientation_view", units, acl, "me").collect()] == ["aa"]
    assert [r.key for r in retrieval.search("context_retrieval", units, acl, "me", asked).collect()] == ["aa::1::0"]
    for bad in (lambda: retrieval.search("other", units, acl, "me"), lambda: retrieval.search("exact_lookup", units, acl, "")):
        with pytest.raises(ValueError):
            bad()
    live = retrieval.live(units).select("key")
    assert retrieval.cache_status(live, None).first().status == "missing" and retrieval.cache_status(live, live).first().status == "fresh"


def test_evaluation_parts(spark):
    hits = spark.createDataFrame([(1, "aa", 1), (1, "bb", 2), (2, "cc", 6)], "qid long, slug string, rank int")
    fused = spark.createDataFrame([(1, "bb", 1), (2, "cc", 1)], "qid long, slug string, rank int")
    gold = spark.createDataFrame([(1, "aa"), (1, "bb"), (2, "cc")], "qid long, slug string")
    assert evals.regressions(hits, fused, gold).first().n == 1
    row = spark.createDataFrame([(50.0, 56.0, None, 95.0, 0)], "lexical_recall double, hybrid_recall double, advisory_precision double, compliance double, regressions int")
    assert evals.promotion(row).first().promote and not evals.promotion(row.withColumn("regressions", F.lit(1))).first().promote


def test_second_tokenizer_and_likeness(spark):
    row = spark.createDataFrame([("The a-b, x YES; yes é!", "")], "t string, e string").select(T.reader_tokens(F.col("t")).alias("t"), T.jaccard(T.reader_tokens(F.col("e")), T.reader_tokens(F.col("e")), 1.0).alias("one"), T.jaccard(T.tokens(F.col("e")), T.tokens(F.col("e"))).alias("zero")).first()
    assert row.t == ["yes"] and row.one == 1.0 and row.zero == 0.0


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<double>, z array<double>").select(vectors.normalized(F.col("v")).alias("v"), vectors.normalized(F.col("z")).alias("z"), vectors.prefixed(F.lit("x"), "query", "e5-small").alias("q"), vectors.prefixed(F.lit("x"), "query", "novel").alias("n")).first()
    assert row.v == [0.6, 0.8] and row.z == [0.0, 0.0] and row.q == "query: x" and row.n == "x"


def test_folders_are_told_apart(spark, tmp_path):
    (tmp_path / "topics").mkdir()
    (tmp_path / "events").mkdir()
    (tmp_path / "topics/pets.md").write_text("---\ntopic: pets\n---\n")
    (tmp_path / "topics/x.txt").write_text("no")
    (tmp_path / "events/2024-01-01.md").write_text("[FACT] pets: a\n")
    topics, logs = imports.directory(spark, str(tmp_path))
    assert topics.count() == 1 and logs.count() == 1
    flat, none = imports.directory(spark, str(tmp_path / "topics"))
    assert flat.count() == 1 and none.count() == 0


def test_bullets_of_a_bootstrap(spark):
    df = spark.createDataFrame([(1, "- a\n -  b \n-c\n- " + "x" * 201 + "\n- \n- d"), (2, "NOTHING_TO_ADD"), (3, "")], "answer_id int, raw string")
    assert sorted((r.answer_id, r.place, r.bullet) for r in answers.bootstrap(df).collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d")]
