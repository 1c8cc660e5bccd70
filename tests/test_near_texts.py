"""Near token sets by groups of tokens, against comparing all; and the tokens themselves."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as T
from ledgerlens.operators import near_texts


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    kinds = [r.sample(vocabulary, size) for size in (3, 8, 20, 60, 150) for _ in range(3)]
    rows = []
    for i in range(n):
        own = list(r.choice(kinds)) if r.random() < 0.7 else r.sample(vocabulary, r.randrange(0, 80))
        rate = r.choice([0, 0.02, 0.08])
        own = [w for w in own if r.random() >= rate] + r.sample(vocabulary, int(len(own) * rate))
        r.shuffle(own)
        rows.append((r.choice(["x", "y", None]), i, " ".join([*own, *own[:2]]) + r.choice(["", " everywhere"])))
    return rows


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.93, 1.0])
def test_near_texts_are_all_found(spark, threshold, monkeypatch):
    monkeypatch.setattr(near_texts, "TILE", 16)  # dense groups of several tiles
    monkeypatch.setattr(near_texts, "ROUND", 3000)  # and classes in several rounds
    rows = texts(1, 260)
    got, again = near_texts.near(spark.createDataFrame(rows, "g string, i long, text string"), ["g"], threshold)
    sets, first, want, copies = {}, {}, {}, set()
    for g, i, text in rows:
        if terms := frozenset(text.split()):
            if (g, terms) in first:
                copies.add((g, i, first[g, terms]))
            else:
                first[g, terms], sets[i] = i, (g, terms)
    for i, (g, s) in sets.items():
        for j, (h, t) in sets.items():
            if i < j and g == h and jaccard(s, t) >= threshold:
                want[g, i, j] = jaccard(s, t)
    found = [((r.g, r.a, r.b), r.similarity) for r in got.collect()]
    assert dict(found) == want and len(found) == len(want) and (threshold == 1.0) == (not want)
    assert {(r.g, r.i, r["first"]) for r in again.collect()} == copies and len(copies) > 5


def test_few_sets_meet_that_are_not_near(spark):
    """Every set has 60 of 300 common words: single words bring all together, groups hardly any."""
    r = random.Random(7)
    rows = [(i, 0, [hash_ for hash_ in r.sample(range(10**6, 10**6 + 300), 60)]) for i in range(600)]
    rows.append((600, 0, rows[0][2][:-2]))
    sets = spark.createDataFrame(rows, "id long, g long, codes array<int>")
    met = [(x.a, x.b) for x in near_texts.candidates(sets, near_texts._weights(sets), 0.8).collect()]
    assert (0, 600) in met and len(met) < 200


def test_a_set_of_a_dense_group_is_not_copied_for_each_pair(spark):
    """Nothing as wide as the sets is made for each pair: 60 near sets of 1,770 pairs."""
    rows = [(0, i, " ".join(f"word{j}" for j in range(40) if j != i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g long, i long, text string")
    sets = near_texts.materialize(near_texts.term_sets(df, []).select(F.col("i").alias("id"), "terms"), "t")
    pairs = near_texts.materialize(sets.select(F.col("id").alias("a")).crossJoin(sets.select(F.col("id").alias("b"))).where("a < b"), "t")
    found = near_texts._verified(pairs, sets, 0.8)
    assert found.count() == 780
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "terms_a" not in plan and "array_intersect" not in plan


def test_shuffles_go_when_a_query_ends(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with near_texts.cleaned(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before


def test_size_classes():
    for t in (0.5, 0.6, 0.8, 0.9, 1.0):
        c = near_texts.classes(t, 3000)
        n = np.arange(1, 3001)
        own, last = np.searchsorted(c, n), np.searchsorted(c, np.floor(n / t + 1e-9))
        assert (last - own <= 1).all() and len(c) > own.max() + 1


def test_rounds_cover_all_classes():
    sizes = {1: 5, 7: 100, 8: 100, 300: 40, 5000: 1}
    for most in (1, 2000, 1 << 40):
        found = near_texts.rounds(sizes, 0.8, most)
        assert [c for low, high, *_ in found for c in range(low, high + 1)] == list(range(len(near_texts.classes(0.8, 5000))))
    assert len(found) == 1 and near_texts.rounds({}, 0.8, 5)


def test_tokens_word_by_word(spark):
    """The pattern whose characters are listed one by one takes texts apart as the SQL's does."""
    stop = set(T.PT_STOP + T.EN_STOP)
    r = random.Random(2)
    pieces = [chr(c) for c in [*range(0, 0x180), 0x2028, 0x3000, 0x1F600, 0x130, 0x212A]] + ["The", "ação", "Über", "x_1", "não"]
    rows = [None, "", " ", "É isso", *["".join(r.choices(pieces, k=60)) for _ in range(300)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, text string")
    lower = {x.i: x.l for x in df.select("i", F.lower(F.coalesce("text", F.lit(""))).alias("l")).collect()}
    for x in df.select("i", T.tokens(F.col("text")).alias("t")).collect():
        clean = re.sub(rf"[^{T.WORD_CHARS} \t\n\x0b\f\r]", " ", lower[x.i])
        assert x.t == [w for w in re.split(r"[ \t\n\x0b\f\r]+", clean) if len(w) > 2 and w not in stop]
