"""The manifest against a plain tree of nested lists, and its copied paths."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle, queries

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, i):
    """Root of ``nodes``, and the siblings of ``i`` as (stands left, hash or nothing)."""
    path = []
    while len(nodes) > 1:
        j = i ^ 1
        path.append((i & 1, nodes[j] if j < len(nodes) else None))
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        i >>= 1
    return nodes[0], path


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text), equal ids apart by their leaves."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = {n: climb([leaf(r) for r in trees[n]], 0)[0] for n in names}
    out = []
    for k, n in enumerate(names):
        root, upper = climb([subroots[m] for m in names], k)
        for i, r in enumerate(trees[n]):
            path = climb([leaf(x) for x in trees[n]], i)[1] + upper
            now = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                now[3] += 1
            fold = leaf(now)
            for left, other in path:
                fold = h(*([other, fold] if left else [fold] + [other] * (other is not None)))
            out.append((r[0], leaf(r), subroots[n], root, h(*(o for _, o in path if o)), fold, fold == root))
    return sorted(out, key=repr)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def got(df):
    return sorted((tuple(r) for r in df.select(F.col(df.columns[0]), *COLUMNS[1:]).collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ROWS = [
    (1, "s", "en", 3, "abc"), (2, None, "en", None, None), (7, "s", "en", 0, ""), (None, "s", "en", 1, "x"), (9, "é", None, 2, "ü1"), (10, "s", "", 1, "y"), (11, "s", "-", 1, "z"), (11, "s", "ß", 1, "long " * 50_000),
    (12, "t", "en", 4, "1:ab"), (12, "t1", "en", 4, ":ab"), (13, "u", "fr", 1, "q"), (13, "u", "fr", 1, "q"), *((100 + i, f"s{i}", "de", i, f"text {i}") for i in range(37)),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in ("tree", "pos", "size", "node", "changed", "id", "path", "at", "range", "rows", "place")]).repartition(3)


@pytest.mark.parametrize("bits", [10, 2, 1])
def test_manifest(docs, bits):
    assert got(merkle.manifest(docs, tampered(), bits=bits)) == plain(ROWS)


def test_versions_share_all_but_a_path(docs):
    rows = merkle.manifest(docs, tampered()).collect()
    changed = [r for r in rows if r.copied is not None]
    assert changed and all(not r.verified and r.copied[-1] == r.folded_root for r in changed)
    for r in changed:
        assert len(r.copied) == len(list(merkle.steps_of(r.path))) and len(set(r.copied)) == len(r.copied)
    assert all(r.verified for r in rows if r.copied is None)


def test_small_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), tampered()).count() == 0
    for rows in (ROWS[:1], ROWS[4:5] * 3, ROWS[:2]):
        assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA), tampered())) == plain(rows)


def test_query_is_the_plain_one(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(queries.op12_merkle_manifest(spark, d)) == plain(rows)
