"""Whole queries and operators against plain computations in Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import common, components, exact_dedup, queries, quality_sites, simhash, token_store, toxicity
from ledgerlens.llm.common import scratch_path

D = "/root/testdata/sf0.001"


def bitwise_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def joined_up(nodes, edges):
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_simhash_query_is_the_plain_one(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    fp = {i: bitwise_fingerprint(t) for i, t in rows}
    edges = [(i, j) for i in fp for j in fp if i < j and (fp[i] ^ fp[j]).bit_count() <= 3]
    want = {(i, f"{fp[i]:016x}", c) for i, c in joined_up(fp, edges).items()}
    assert len(edges) > 5
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, D).collect()} == want


def test_dense_and_chained_fingerprints(spark, monkeypatch):
    r = random.Random(8)
    fps = {f := r.getrandbits(64)}
    for a in range(40):  # a dense group around one
        fps.add(f ^ (1 << a) ^ (1 << r.randrange(64)))
    g = r.getrandbits(64)
    for k in range(0, 60, 2):  # a chain, two bits a step
        g ^= 3 << k
        fps.add(g)
    fps |= {r.getrandbits(64) for _ in range(60)}
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: docs)
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    want = joined_up(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if near(fps[i], fps[j])])
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("shape", ["path", "star", "comb"])
def test_components_take_few_rounds(spark, monkeypatch, shape):
    n, writes = 1000, Counter()
    edges = {
        "path": [(i, i + 1) for i in range(n)],
        "star": [(n, i) for i in range(n)],
        "comb": [(i, i + 1) for i in range(n)] + [(i, 10_000 - i) for i in range(n)],
    }[shape]
    plain = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: (writes.update([label]), plain(df, label))[1])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({x for e in edges for x in e}) and {x.label for x in got} == {0}
    assert writes["cc-edges"] <= 4 and writes["cc-parents"] <= 24
    assert components.components(spark.createDataFrame([(None, 1), (2, None)], "a long, b long")).count() == 0


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}", None) for i in range(3000)], "i long, k string, extra string")
    keyed = common.materialize(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least")), "t")
    rows = common.materialize(rows, "t")
    got = common.joined(rows, keyed, ["k"], "n", 3000)
    assert got.columns == ["i", "k", "extra", "n", "least"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in rows.join(keyed, "k").select(*got.columns).collect())


def test_many_copies_of_long_and_short_texts(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, "short" if i % 2 else long) for i in range(600)] + [(1000 + i, f"own {i}") for i in range(300)]
    got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=512).collect()
    assert len(got) == 900 and Counter(r.keep_id for r in got)[0] == Counter(r.keep_id for r in got)[1] == 300
    assert sum(r.kept for r in got) == 302 and all(r.kept == (r.doc_id == r.keep_id) for r in got)


def plain_sites(rows):
    """Global mean, host and path means by loops over (host, path, evidence)."""
    mean = min(max(sum(e for *_, e in rows) / len(rows), 1e-4), 1 - 1e-4)

    def strength(groups, center):
        n, k = sum(map(len, groups.values())), len(groups)
        if k < 2:
            return 1e6
        avg = {g: sum(v) / len(v) for g, v in groups.items()}
        within = max(sum((e - avg[g]) ** 2 for g, v in groups.items() for e in v) / max(n - k, 1), 0)
        between = max((sum(len(v) * (avg[g] - center(g)) ** 2 for g, v in groups.items()) - (k - 1) * within) / n, 0)
        return 1e6 if between <= 0 else min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)

    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, e in rows:
        hosts[h].append(e)
        paths[h, p].append(e)
    kh = strength(hosts, lambda g: mean)
    host_mean = {h: (kh * mean + sum(v)) / (kh + len(v)) for h, v in hosts.items()}
    kp = strength(paths, lambda g: host_mean[g[0]])
    return mean, host_mean, {g: (kp * host_mean[g[0]] + sum(v)) / (kp + len(v)) for g, v in paths.items()}


def test_site_posteriors_are_the_plain_ones(spark):
    found = queries.op3_quality_sites(spark, D).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert len(found) == len(docs)
    mean, host_mean, path_mean = plain_sites([(docs[r.doc_id].source, docs[r.doc_id].lang, r.evidence) for r in found])
    odds = lambda p: p / (1 - p)
    held = lambda p: max(min(p, 1 - 1e-4), 1e-4)
    for r in found:
        h, p = docs[r.doc_id].source, docs[r.doc_id].lang
        assert r.host_mean == pytest.approx(host_mean[h]) and r.path_mean == pytest.approx(path_mean[h, p])
        o = odds(held(r.evidence)) * odds(held(path_mean[h, p])) / odds(mean)
        assert r.posterior == pytest.approx(o / (1 + o)) and r.kept == (r.posterior >= 0.5)


def test_quality_of_documents_whose_labels_were_not_learned(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = quality_sites.rated(docs, labels.where(~held_out), columns=["doc_id"]).join(labels.where(held_out), "doc_id").collect()
    good, bad = ([r for r in found if r.quality == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 3
    above = sum((g.posterior > b.posterior) + 0.5 * (g.posterior == b.posterior) for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.9
    assert sum(r.kept for r in good) >= 0.95 * len(good) and sum(not r.kept for r in bad) >= 0.6 * len(bad)


def test_form_counts_by_characters(spark):
    texts = ["", "A b!!! C| $5 the the the. End", "no marks at all", "ÉCOLE é #tag a  a", " lead and trail. ", "x x\nx y y"]
    names = [f"f{i}" for i in range(7)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", *[c.alias(n) for c, n in zip(quality_sites.form(F.col("text")), names, strict=True)]).collect()
    import regex

    space = "[\\x20\\x09-\\x0D]"
    for r in rows:
        t = texts[r.i]
        n, s = max(len(t), 1), len(regex.findall(f"{space}+", t)) + 1
        count = lambda pattern, t=t: len(regex.findall(pattern, t))
        words = [w for w in regex.split(space, t)]
        repeats = sum(a == b and a != "" for a, b in zip(words, words[1:], strict=False))
        want = [count(r"[#*$%&<>]") / n, count("!!") / s, count(r"\|") / s, count(r"\p{Lu}") / n, repeats / s, count(r"[.!?](?![^\x20\x09-\x0D])") / s, math.log1p(len(t)) / 10]
        assert [r[k] for k in names] == pytest.approx([min(x, 1.0) for x in want[:6]] + want[6:])


def test_token_store_holds_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want, at = {}, 0
    for r in sorted(spark.read.parquet(f"{D}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_token_store(spark, D).collect()} == want


def test_a_hot_id_fills_several_files_in_order(spark):
    path = scratch_path(spark, "t")
    docs = spark.createDataFrame([(7 if i % 2 else i, f"text {i % 10}") for i in range(4000)], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), row_group=1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(token_store.with_start(token_store.read(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(7 if i % 2 else i for i in range(4000))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    assert len({r.part for r in rows if r.doc_id == 7}) > 1
    plan = token_store.read(spark, path).where("doc_id = 12")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,12)]" in plan


def test_pieces_of_cut_documents_hold_their_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in spark.read.parquet(f"{D}/documents.parquet").collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        for piece, a in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[a : first if not piece else a + 1024]
            want[r.doc_id, piece] = (a, len(own), zlib.crc32(own.tobytes()))
    got = queries.op5_best_fit_packing(spark, D).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert max(p for _, p in want) > 2


def test_agenda_agrees_with_the_library_on_whole_tables(spark):
    for d in (D, "/root/testdata/sf0.01"):
        found = queries.op2_sentencepiece(spark, d)
        assert found.where("not agrees or agrees is null").count() == 0 and found.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_log_count_ratios_are_the_plain_ones(spark):
    texts = [(1, "You fool, FOOL!"), (1, "fool me"), (0, "nice and calm"), (0, "calm fool"), (0, "")]
    held = [Counter({0: 0}) for _ in range(2)]
    for y, t in texts:
        low = "".join(c if c.isalpha() else " " for c in t.lower())
        padded = " " + low + " " * toxicity.GAP  # n-grams begin up to the space after the text
        for g in {padded[i : i + n] for n in toxicity.SIZES for i in range(len(low) + 2)}:
            held[y][bucket_of(g)] += 1
    n1, n0 = 2, 3
    want = {b: math.log((held[1][b] + 1) / (n1 + 2) / ((held[0][b] + 1) / (n0 + 2))) for b in {*held[0], *held[1]} if held[0][b] + held[1][b]}
    found = toxicity.ratios(spark.createDataFrame(texts, "toxic int, text string"), n1, n0).collect()
    assert {r.bucket for r in found} == set(want)
    assert all(r.ratio == pytest.approx(want[r.bucket]) for r in found)


def bucket_of(gram):
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
    return ((h ^ (len(gram) * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - toxicity.BITS)


def test_fit_follows_its_gradient():
    r = np.random.default_rng(3)
    rows = [(int(y), np.flatnonzero(r.random(30) < (0.5 if y else 0.2)).astype("<i4")) for y in r.random(200) < 0.4]
    ratios = r.normal(size=30)
    w, b = toxicity.fitted(rows, ratios, 0.0, 1e-4, 1500)
    y = np.array([k for k, _ in rows])
    share = np.where(y == 1, np.sqrt((y == 0).sum() / (y == 1).sum()), 1.0)

    x = np.array([np.bincount(c, minlength=30) for _, c in rows]) * ratios

    def loss(u, b):
        z = x @ u + b
        return (share * (np.logaddexp(0, z) - y * z)).sum() / share.sum() + 5e-5 * (u**2).sum()

    u, best_b = np.zeros(30), 0.0
    for _ in range(20_000):  # plain gradient descent
        e = share * (1 / (1 + np.exp(-(x @ u + best_b))) - y) / share.sum()
        u, best_b = u - 0.5 * (x.T @ e + 1e-4 * u), best_b - 0.5 * e.sum()
    assert loss(w / ratios, b) <= loss(u, best_b) * 1.02 < loss(np.zeros(30), 0.0) * 0.9
