"""Joins of sets by length, prefix and places against comparing all."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.jobs import answers
from ledgerlens.operators import similarity


def sets_of(seed, n, common=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = r.choice([list(range(20)), list(range(10, 35)), list(range(30, 36))]) if r.random() < 0.7 else r.sample(range(60), r.randrange(1, 25))
        terms = {f"t{x}" for x in base if r.random() > 0.1} or {"t0"}
        rows.append((f"g{r.randrange(3)}", i, sorted(terms | ({"everywhere"} if common else set()))))
    return rows


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_alike_sets(spark, threshold):
    rows = sets_of(1, 120)
    df = similarity.named_sets(spark.createDataFrame(rows, "g string, i long, terms array<string>"), ["g"])
    names = {r.i: r.name for r in df.collect()}
    sets = df.groupBy("g", "name").agg(F.first("terms").alias("terms"))
    got = {(r.a, r.b): r.similarity for r in similarity.alike(sets, ["g"], threshold).collect()}
    want = {}
    for g, i, a in rows:
        for h, j, b in rows:
            if g == h and names[i] < names[j] and jaccard(a, b) >= threshold:
                want[names[i], names[j]] = jaccard(a, b)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert threshold == 1.0 or len(want) > 10


def test_a_common_term_makes_no_pairs(spark):
    r = random.Random(3)
    rows = [("g", f"n{i}", ["everywhere", *[f"w{r.randrange(10 ** 6)}" for _ in range(9)]]) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, name string, terms array<string>")
    rare_first = df.withColumn("terms", F.reverse("terms"))
    assert similarity.candidate_pairs(rare_first, ["g"], 0.8).count() < 40
    assert similarity.alike(df, ["g"], 0.8).count() == 0


def test_survivors(spark):
    r, words = random.Random(5), [f"word{i}" for i in range(40)]
    rows = []
    for i in range(150):
        text = " ".join(r.sample(words[:12], 10) if r.random() < 0.6 else r.sample(words, r.randrange(0, 9)))
        rows.append((r.randrange(3), i, text + (" everywhere" if r.random() < 0.9 else "")))
    got = {(x.batch, x.i) for x in answers.survivors(spark.createDataFrame(rows, "batch long, i long, content string")).collect()}
    want = set()
    for b in range(3):
        held = []
        for _, i, text in (x for x in rows if x[0] == b):
            t = set(text.split())
            if t and any(jaccard(t, h) >= 0.8 for h in held):
                continue
            want.add((b, i))
            if t:
                held.append(t)
    assert got == want and 20 < len(want) < 140
