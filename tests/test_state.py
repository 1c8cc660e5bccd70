"""Set-based state relations against a plain sequential fold."""

import random
from datetime import datetime, timedelta

import pytest

from ledgerlens.functions import text as T
from ledgerlens.operators import retrieval, state

SCHEMA = "pos long, seq long, slug string, principal string, ts timestamp, value double, k long, type string, tag string, content string, cooldown_days long"
KINDS = ["write_event", "TOPIC_SUGGESTED", "TOPIC_SUGGESTION_ACCEPTED", "TOPIC_SUGGESTION_DISMISSED", "TOPIC_BULLETS_RETIRED", "TOPIC_METADATA_SET"]


def random_log(seed, n=120):
    r, t = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for i in range(n):
        t += timedelta(minutes=r.randrange(500))
        kind = r.choice(KINDS)
        tag = r.choice(["CURATED", "SOURCE", "FACT"]) if kind == "write_event" else None
        out.append((i, i + 1, f"s-{r.randrange(4)}", f"p{r.randrange(3)}", t, 0.0, r.randrange(100), kind, tag, "x", r.randrange(1, 30)))
    return out


def fold(rows):
    """Suggestions and cooldown clearing, entry by entry."""
    made, last, history = {}, {}, []
    for pos, seq, slug, _, ts, _, _, kind, _, _, days in rows:
        if kind == "TOPIC_SUGGESTED":
            made[seq] = [slug, "pending", None]
            last[slug] = seq
        elif kind.startswith("TOPIC_SUGGESTION_") and slug in last:
            s = made[last[slug]]
            if s[1] != "pending":
                continue
            s[1:] = ["accepted" if kind.endswith("ACCEPTED") else "dismissed", seq]
            key = slug.replace("-", "")
            if s[1] == "accepted":
                for h in history:
                    if h["key"] == key and h["cleared"] is None and seq > h["seq"]:
                        h["cleared"] = seq
            else:
                history.append({"key": key, "seq": seq, "cleared": None})
    return made, history


@pytest.mark.parametrize("seed", range(4))
def test_suggestions_and_cooldowns(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, SCHEMA)
    made, history = fold(rows)
    got = {r.suggestion_seq: [r.slug, r.status, r.resolver_seq] for r in state.suggestions(log).collect()}
    assert got == made
    cleared = {r.dismissal_seq: r.cleared_by_accept_seq for r in state.dismissals(log).collect()}
    assert cleared == {h["seq"]: h["cleared"] for h in history}


def test_retired_only_where_an_earlier_curated_write_bears_the_number(spark):
    for seed in range(3):
        rows = random_log(seed)
        curated, gone = {}, set()
        last = {}
        for pos, seq, slug, *_, kind, tag, _, _ in rows:
            if kind == "TOPIC_BULLETS_RETIRED":
                for s in {last.get(slug, 0), seq - 1}:
                    if curated.get(s) == slug:
                        gone.add(s)
            if tag == "CURATED":
                curated[seq], last[slug] = slug, seq
        log = spark.createDataFrame(rows, SCHEMA)
        assert {r.seq for r in state.retired_seqs(log).collect()} == gone


def test_rrf_leaves_absent_arms_out(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1)], "qid long, key string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "qid long, key string, rank int")
    got = {(r.qid, r.key): r.score for r in retrieval.fused({"L": a, "S": b}, {"L": 0.5, "S": 1.0}).collect()}
    assert got[1, "x"] == got[2, "x"] == pytest.approx(0.5 / 61) and got[1, "y"] == pytest.approx(0.5 / 62 + 1 / 61)


UNITS = "key string, slug string, seq long, tag string, retired boolean, content string"


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def test_hidden_units_shape_no_rank(spark):
    units = spark.createDataFrame([("a::1::0", "a", 1, "CURATED", False, "alpha beta gamma"), ("b::2::0", "b", 2, "CURATED", False, "alpha alpha alpha")], UNITS)
    acl = spark.createDataFrame([("a", ["me"]), ("b", ["you"])], "slug string, readers array<string>")
    got = retrieval.retrieve(units, acl, "me", asked(spark, "the alpha", "none")).collect()
    assert [(r.qid, r.key, r.rank, r.tier_outranks_curated) for r in got] == [(0, "a::1::0", 1, False)]


def test_fields_prefixes_and_misspellings(spark):
    rows = [
        ("health::1::0", "health", 1, "CURATED", False, "notes about running"), ("other::2::0", "other", 2, "CURATED", False, "health appears in the text"),
        ("other::3::0", "other", 3, "FACT", True, "runnning twice"), ("other::4::0", "other", 4, "CURATED", True, "running retired"), ("other::5::0", "other", 5, "SOURCE", False, ""),
    ]
    units = spark.createDataFrame(rows, UNITS)
    live = retrieval.live(units)
    assert {r.key: r.tier for r in live.collect()} == {"health::1::0": "curated", "other::2::0": "curated", "other::3::0": "note", "other::5::0": "source"}
    found = retrieval.lexical(retrieval.index(retrieval.fields(live)), asked(spark, "health", "runn", "runing"))
    keys = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r.rank)):
        keys.setdefault(r.qid, []).append(r.key)
    assert keys[0] == ["health::1::0", "other::2::0"]  # a slug counts twice
    assert set(keys[1]) == {"health::1::0", "other::3::0"} and set(keys[2]) == {"health::1::0", "other::3::0"}
    both = retrieval.lexical(retrieval.index(retrieval.fields(live)), asked(spark, "health running", "appears twice"), fuzzy=None)
    assert sorted((r.qid, r.key) for r in both.collect()) == [(0, "health::1::0"), (1, "other::2::0"), (1, "other::3::0")]  # all terms, or any where none has all


def test_chunks_keep_their_text_and_places(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(4)
    texts = ["", "  ", "short text", " \n" + " ".join(f"w{i}," for i in range(700)) + "  ", "".join(r.choice(["ab ", "c,d\n", "é_1  ", "日"]) for _ in range(900))]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", F.inline(T.chunks(F.col("t")))).collect()
    import regex

    for i, t in enumerate(texts):
        own = sorted((x for x in got if x.i == i), key=lambda x: x.chunk_index)
        places = [m.span() for m in regex.finditer(r"[\p{L}\p{N}_]+|[^\s]", t)]
        n = len(places)
        if n <= 512:
            assert [(x.char_start, x.char_end, x.content) for x in own] == [(0, len(t), t)]
            continue
        spans = [(k, min(k + 256, n)) for k in range(0, n, 192) if k == 0 or k - 192 + 256 < n]
        assert [(x.char_start, x.char_end) for x in own] == [(places[a][0], places[b - 1][1]) for a, b in spans]
        assert all(t[x.char_start : x.char_end] == x.content for x in own)


def test_text_functions(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("The Cat-sat, on É mats! de",)], "t string").select(
        T.tokens(F.col("t")).alias("a"), T.slug_ok(F.lit("ab-c")).alias("b"), T.slug_ok(F.lit("a_b")).alias("c"), T.first_sentence(F.lit("One. Two.")).alias("d")
    ).first()
    assert row.a == ["cat", "sat", "mats"] and row.b and not row.c and row.d == "One."
