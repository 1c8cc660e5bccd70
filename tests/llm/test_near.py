"""The near-duplicate stage against comparing all pairs."""

import random
import re

from pyspark.sql import functions as F

from ledgerlens.llm import simhash


def sets_of(text, width=5):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def jaccard(u, v):
    return len(u & v) / len(u | v)


def plain_groups(rows, similarity=0.8):
    """Smallest id of each document's component over all pairs compared in full."""
    label = {i: i for i, _ in rows}
    sets = [(i, sets_of(t)) for i, t in rows]
    for k, (i, u) in enumerate(sets):
        for j, v in sets[:k]:
            if jaccard(u, v) >= similarity and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {x: new if y == old else y for x, y in label.items()}
    return label


def got_groups(spark, rows):
    return {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def some_words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def changed(rng, words, n):
    """``words`` with ``n`` of them replaced, far from one another: each takes five shingles."""
    words = list(words)
    for k in range(n):
        words[(2 * k + 1) * len(words) // (2 * n)] = f"x{rng.randrange(10**9)}"
    return words


def test_no_pair_at_the_bound_is_lost(spark):
    rng, rows = random.Random(1), []
    for i in range(150):
        words = some_words(rng, 240)
        if i % 3 == 0:  # a passage that stands many times counts once
            words += some_words(rng, 8) * 40
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed(rng, words[:240], 5) + words[240:]))]
    want = plain_groups(rows)
    assert sum(i != g for i, g in want.items()) == 150
    assert got_groups(spark, rows) == want


def test_links_of_joined_documents_count(spark):
    rng, rows = random.Random(2), []
    for i in range(60):  # A like B, B like C, A unlike C: a chain of three
        a = some_words(rng, 400)
        b = a[:-40] + some_words(rng, 40)
        rows += [(10 * i, " ".join(a)), (10 * i + 1, " ".join(b)), (10 * i + 2, " ".join(some_words(rng, 40) + b[40:]))]
    want = plain_groups(rows)
    assert jaccard(sets_of(rows[0][1]), sets_of(rows[2][1])) < 0.7
    assert all(want[i] == i // 10 * 10 for i in want)
    assert got_groups(spark, rows) == want


def test_equal_fingerprints_of_different_sets_join_nothing(spark, monkeypatch):
    # 200 x 'spam' outweighs the rest where repeats count; sets of one and the same fingerprint are forced by a constant one
    rng = random.Random(3)
    rows = [(i, " ".join(["spam"] * 200 + some_words(rng, 90))) for i in range(4)]
    near = rows[0][1].split()
    rows.append((4, " ".join([*near, "last"])))
    want = plain_groups(rows)
    assert want == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    assert got_groups(spark, rows) == want
    monkeypatch.setattr(simhash, "simhash", lambda hashes: 0)
    assert simhash.fingerprint(b"a b c d e f", 5) == 0
    assert got_groups(spark, rows) == want


def test_parities_never_rule_out_a_similar_pair(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows, want = [], []
    for i in range(400):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(0, 900), dtype=np.uint64))
        b = np.unique(np.concatenate((a[: int(len(a) * rng.uniform(0.5, 1))], rng.integers(0, 1 << 63, rng.integers(0, 120), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        rows.append((i, -i, len(a), len(b), simhash.parities(a), simhash.parities(b)))
        want.append(both >= 0.8 * (len(a) + len(b) - both))
    got = {r.a_id for r in simhash.possible(spark.createDataFrame(rows, "a_id long, b_id long, na int, nb int, pa binary, pb binary"), 0.8).collect()}
    assert got >= {i for i, w in enumerate(want) if w} and 40 < len(got) < sum(want) + 60


def joined_up(ids, pairs):
    """Smallest id of each component."""
    label = {i: i for i in ids}
    for i, j in pairs:
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = {x: new if y == old else y for x, y in label.items()}
    return label


def test_probes_alone_find_every_similar_pair_within_their_bits(spark, monkeypatch):
    """Without spokes and without the exact search: the pigeonhole's links, verified, and no others."""
    rng, rows = random.Random(6), []
    for i in range(60):
        words = some_words(rng, 240)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed(rng, words, 1 + i % 5)))]
    sets, fps = {i: sets_of(t) for i, t in rows}, {i: simhash.simhash(simhash.shingle_set(t.encode(), 5)) for i, t in rows}
    near = lambda i, j: ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 6 and jaccard(sets[i], sets[j]) >= 0.8
    want = joined_up(sets, [(i, j) for i in sets for j in range(i) if near(i, j)])
    assert 15 < sum(i != g for i, g in want.items()) < 60
    monkeypatch.setattr(simhash, "prefix_links", lambda *_: spark.createDataFrame([], "a_id long, b_id long"))
    monkeypatch.setattr(simhash, "discard", lambda _: None)
    found = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), stars=0)
    assert {r.doc_id: r.group_id for r in found.collect()} == want


def test_hub_of_a_dense_group_is_its_centre(spark):
    rng = random.Random(7)
    bits = [list(range(k, k + 16)) for k in (0, 16, 32, 48)]
    centre = rng.getrandbits(63)
    rows = [(i, centre ^ sum(1 << b for b in rng.sample(range(48, 63), 5))) for i in range(40) if i != 20] + [(20, centre)]
    rows += [(100 + i, rng.getrandbits(63)) for i in range(40)]
    plan = [(simhash.mask_of(b), b, 0) for b in bits]
    got = simhash.central_spokes(spark.createDataFrame(rows, "doc_id long, fp long"), 5, plan).collect()
    assert {(r.a_id, r.b_id) for r in got if r.a_id == 20} == {(20, i) for i in range(40) if i != 20}
    assert len(got) <= 4 * len(rows)


def test_exact_search_lists_no_pair_that_shares_too_little_from_its_first_common_shingle(spark):
    rng, words = random.Random(8), some_words(random.Random(9), 150)

    def other(n):  # places of its own: copies are less like one another than like the text
        ws = list(words)
        for k in rng.sample(range(2, 29), n):
            ws[5 * k] = f"x{rng.randrange(10**9)}"
        return " ".join(ws)

    rows = [(i, other(1 + i // 30 * 4)) for i in range(60)]  # 30 with one word replaced, 30 with five
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.col("doc_id").alias("label"))
    got = {(r.a_id, r.b_id) for r in simhash.prefix_links(docs, labels, 5, 0.8).collect()}
    sets = [sets_of(t) for _, t in rows]
    assert got >= {(i, j) for j in range(60) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}
    assert {x for pair in got for x in pair} == set(range(30))  # five words take 25 of 146 shingles, over (1 - s) / (1 + s) of them


def test_recall_on_the_given_documents(spark):
    """Every document that comparing all sets removes is removed, and no other."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets, held, shared = {i: sets_of(t) for i, t in rows}, {}, {}
    for i, s in sets.items():
        for x in s:
            for j in held.setdefault(x, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            held[x].append(i)
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (i, j), n in shared.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    empty = [i for i, s in sets.items() if s == sets_of("")]
    want = {i: find(i) for i in sets if i not in empty} | {i: min(empty) for i in empty}
    assert sum(i != g for i, g in want.items()) > 20
    assert got_groups(spark, rows) == want


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, long texts, clashing columns and empty tables, written and reread as the stages are."""
    import corpus_pipeline

    long = " ".join(f"word{i % 977} and" for i in range(9000))
    some = [(1, None), (2, ""), (3, " \t"), (4, "a b c d e f"), (4, "a b c d e f"), (5, long), (6, long + " end"), (None, "no id"), (None, "no id"), (7, "my token=abcdefgh12 here")]
    clash = "row_key row_key_ kept evidence host_mean label name rounds path_mean posterior first ids fp content lead node".split()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit("own").alias(c) for c in clash])
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, table in (("some", docs), ("none", docs.limit(0))):
        read = table
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{n}")
            out = stage(spark, read, str(tmp_path))
            if n < 4:
                assert out.columns == docs.columns
            out.write.parquet(path)
            before, read = read, spark.read.parquet(path)
            if n < 4 and name == "some":
                assert {r[c] for r in read.collect() for c in clash} <= {"own"}
            if n == 1 and name == "some":
                assert read.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in before.collect()})
        assert (read.count() == 0) == (name == "none")


def test_pipeline_decides_by_row(spark):
    import corpus_pipeline

    rng = random.Random(4)
    a, b, c, d = (some_words(rng, 200) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (2, b), (3, [*b, "last"]), (3, c), (4, d), (4, d)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    found = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    one = lambda *want: sorted((i, " ".join(t)) for i, t in want)
    exact = corpus_pipeline.exact(spark, docs, "")
    assert exact.columns == docs.columns
    assert found(exact) == one((1, a), (2, b), (3, [*b, "last"]), (3, c), (4, d))
    assert found(corpus_pipeline.near(spark, exact, "")) == one((1, a), (2, b), (3, c), (4, d))
    assert found(corpus_pipeline.near(spark, docs, "")) == one((1, a), (2, b), (3, c), (4, d))
