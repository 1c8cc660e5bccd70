"""Deep-shallow sorting and the removal of repeated bytes against plain computations."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import deep_shallow, queries, suffixes


def plain_order(groups, strings):
    order = sorted(range(len(strings)), key=lambda i: (groups[i], strings[i]))
    shared = []
    for k, i in enumerate(order):
        j = order[k - 1]
        if not k or groups[i] != groups[j]:
            shared.append(-1)
            continue
        n = 0
        while n < min(len(strings[i]), len(strings[j])) and strings[i][n] == strings[j][n]:
            n += 1
        shared.append(n)
    return [(groups[i], strings[i]) for i in order], shared


@pytest.mark.parametrize("shallow", [8, 16, 32])
def test_deep_shallow_order(shallow):
    r = random.Random(shallow)
    for _ in range(60):
        base = bytes(r.choice(b"ab\0") for _ in range(120))
        strings = []
        for _ in range(r.randrange(1, 80)):
            s = bytearray(base[: r.randrange(1, 120)])
            if r.random() < 0.7:
                s[r.randrange(len(s))] = r.choice(b"abc\0\xff")
            strings.append(bytes(s))
        groups = np.array([r.randrange(3) for _ in strings])
        order, shared = deep_shallow.sort(groups, strings, shallow)
        assert sorted(order.tolist()) == list(range(len(strings)))
        assert ([(groups[i], strings[i]) for i in order], shared.tolist()) == plain_order(groups.tolist(), strings)


def plain(rows, size=100):
    """(id, bytes, removed, spans, digest) by a set of all strings of ``size`` bytes seen so far; rows in order."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            s = data[p : p + size]
            if s in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def planted():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, hot = text(60), text(40)
    rows = [(i, text(r.randrange(1, 120))) for i in range(60)]
    rows += [(100 + i, f"{text(r.randrange(9))} {passage[r.randrange(40):]} {text(r.randrange(30))}") for i in range(20)]
    rows += [(200 + i, f"{text(3)}{hot}{text(3)}") for i in range(40)]
    rows += [(300 + i, rows[5][1] + " " + rows[6][1]) for i in range(5)]  # copies
    rows += [(400, "a" * 1000), (401, "ab" * 300), (402, "x" * 99), (403, "x" * 100), (404, "x" * 100), (405, None), (406, ""), (407, "x" * 101), (408, passage * 3)]
    near = rows[5][1].split()
    for i in range(30):
        near[r.randrange(len(near))] = r.choice(words)
        rows.append((500 + i, " ".join(near)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("unit", "part", "at", "ends", "start")])
    return rows, df.repartition(5)


def test_planted_repeats(docs):
    rows, df = docs
    want = plain(rows)
    assert sum(r[2] > 0 for r in want) > 60
    assert got(suffixes.deduplicated(df)) == want
    assert got(suffixes.deduplicated(df.limit(0))) == []


def test_hot_strings_and_joins_by_shuffle(docs):
    rows, df = docs
    assert got(suffixes.deduplicated(df, hot=8, fan_in=2, broadcast_bytes=-1, unit_rows=16)) == plain(rows)


def test_many_parts(docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(suffixes, "PART_BYTES", 4096)
    monkeypatch.setattr(suffixes, "COUNTED", 16)
    assert got(suffixes.deduplicated(df)) == plain(rows)


@pytest.mark.parametrize("piece", [1 << 17, 128, 1])
def test_equal_strings_have_equal_anchors(monkeypatch, piece):
    texts = [(t or "").encode() for _, t in planted()]
    monkeypatch.setattr(suffixes, "PIECE", piece)
    data, ends = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts])
    if piece == 1:
        data, ends = data[: ends[3]], ends[:4]
    whole, found, strings = data.tobytes(), {}, []
    for h, anchor, first, last in zip(*(x.tolist() for x in suffixes.anchors(data, ends)), strict=True):
        for p in range(first, last + 1):
            assert found.setdefault(whole[p : p + 100], (h, anchor - p)) == (h, anchor - p)
            strings.append(p)
    starts = [0, *ends[:-1].tolist()]
    assert strings == [p for a, b in zip(starts, ends.tolist(), strict=True) for p in range(a, b - 99)]


def test_repeated_and_missing_ids(spark):
    own = " ".join(f"w{i}" for i in range(60))
    rows = [(None, own), (7, own), (7, own), (3, "short"), (None, None)]
    found = suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), with_text=True).collect()
    assert sorted((r.doc_id is None, r.n_removed > 0) for r in found) == [(False, False), (False, True), (False, True), (True, False), (True, False)]
    assert {bytes(r.kept) for r in found} == {own.encode(), b"", b"short"}


def test_query_is_the_plain_one(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    want = plain(rows)
    assert sum(r[2] > 0 for r in want) > 5
    assert got(queries.op13_suffix_dedup(spark, d)) == want


def test_hashes_of_anchors_are_even():
    data = np.random.default_rng(1).integers(0, 256, 400_000).astype(np.uint8)
    h = suffixes.anchors(data, np.array([len(data)]))[0]
    parts = np.bincount((h >> np.uint64(61)).astype(np.int64), minlength=8)
    assert parts.min() > 0.8 * parts.mean() and parts.max() < 1.2 * parts.mean()
