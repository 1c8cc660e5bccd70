"""Alignment against a plain computation with both libraries; the perfect hash; both ways to look counts up."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import alignment, mphf, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "  \n", "a", "a\n  b", "x's y'll 'tis\t\tz", "two  spaces   three", "\n\nlines\n \n end ", "<|endoftext|> as text<|endoftext|>", "a mark ▁ inside",
    "中文字符 and café 😀😀 ok", "<0x41> </s> <unk>", "\x00 zero", "naïve Straße œuvre ñandú", "aaaa" * 300, "YWJjZGVmZ2hpamtsbW5vcA==" * 20, "a mark ▁ inside", "trailing  ",
]


def plain(rows):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto
    from tokenizers import Tokenizer

    tok, sp, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), proto.ModelProto()
    tok.encode_special_tokens = True
    with open(B, "rb") as f:
        model.ParseFromString(f.read())
    # the published byte-to-character table of byte-level vocabularies
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    chars, n = {chr(b): b for b in kept}, 0
    for b in range(256):
        if b not in kept:
            chars[chr(256 + n)] = b
            n += 1
    a_bytes = lambda i: bytes(chars[c] for c in tok.id_to_token(i))

    def b_bytes(i):
        p = model.pieces[i]
        return bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode()

    docs = []
    for i, text in rows:
        a = b = []
        if text:
            a, b, want = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text), (" " + text).encode()
            if b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
                a = b = []
        ends = lambda ids, size: np.cumsum([len(size(x)) for x in ids]).tolist()
        ea, eb = ends(a, a_bytes), ends(b, b_bytes)
        groups, common = [], sorted(set(ea) & set(eb))
        ia = ib = 0
        for e in common:
            ja, jb = ea.index(e, ia) + 1, eb.index(e, ib) + 1
            groups.append((a[ia:ja], b[ib:jb]))
            ia, ib = ja, jb
        docs.append((i, a, b, groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    counts = Counter(p for *_, links in docs for p in set(links))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for i, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(counts[p] == highest[p[0]] for p in links)
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*enumerate(ODD), (3, "again"), (None, "no id a b c"), (50, " ".join(f"word{i % 977}, and" for i in range(9000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("key", "n", "part", "groups", "a", "row")])
    return rows, df.repartition(3)


def test_query_is_the_plain_one(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(queries.op11_token_alignment(spark, d)) == plain(rows)


def test_odd_texts_broadcast_and_joined(spark, odd):
    rows, df = odd
    want = plain(rows)
    assert sum(r[1] > 0 for r in want) > 12 and all(r[1] == 0 for r in want if r[0] in (0, 1, 10, 17))
    assert got(alignment.aligned(df, A, B)) == want
    assert got(alignment.aligned(df, A, B, lookup_pairs=0)) == want
    assert got(alignment.aligned(df.limit(0), A, B)) == [] == got(alignment.aligned(df.limit(0), A, B, lookup_pairs=-1))


def test_small_parts_are_like_large_ones(odd, monkeypatch):
    rows, _ = odd
    own, texts = alignment.aligner(A, B), [t or "" for _, t in rows]
    import pyarrow as pa

    want = own.align(pa.array(texts)).distinct()
    monkeypatch.setattr(alignment, "PART_LINKS", 50)
    found = own.align(pa.array(texts)).distinct()
    assert all((x == y).all() for x, y in zip(want, found, strict=True))


def test_many_shards_and_rounds_of_sums(spark):
    rows = [(k * 7919, k, p) for k in range(3000) for p in range(12) if (k + p) % 3]
    df = spark.createDataFrame([(k, int(alignment._spread(np.array([k]))[0]), n, p) for k, n, p in rows], "key long, spread long, n long, part long")
    dense = alignment.dense_counts(df, shard_pairs=500, vector_rows=300)
    assert dense.count() >= 5
    want = Counter()
    for k, n, _ in rows:
        want[k] += n
    assert {r.key: r.n for r in alignment.lexicon(dense).collect()} == want


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 100, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
        at = mphf.Hash(*mphf.built(keys))(keys)
        assert sorted(at.tolist()) == list(range(len(keys)))
