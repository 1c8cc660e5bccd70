"""Tokens of two tokenizers aligned by bytes, with corpus-wide counts of linked id pairs.

A text, a space before it, is encoded byte-level (A) and by pieces (B). Where tokens
of both end, a group ends; within a group every token of A is linked with every token
of B. How many documents hold a pair linked is counted over the whole table:

1. the first pass aligns the documents, and each task adds up, for the pairs it
   meets, the documents that hold them;
2. the distinct pairs, in shards by hash, get a minimal perfect hash each (``mphf``);
   the tasks' counts become dense vectors indexed by it, which are summed as a tree;
3. the second pass aligns the documents again and looks its pairs up: each number is
   confirmed by the key kept there. Up to ``lookup_pairs`` pairs (16 bytes each) are
   broadcast; more stay where they are, and the documents' pairs are joined to them,
   pairs of very many documents apart.

Neither tokenizer looks past a place where a stretch of B and a word of A begin, so a
text is cut there, and each distinct cut of a batch is aligned once. Texts with
characters whose class the cut doesn't know are aligned whole. Links of a long cut are
made in parts of bounded size.

Null and empty texts, and texts whose tokens' bytes aren't the text's own, have no
tokens: zeros and an empty digest. Repeated rows are documents of their own, and so
count each; ids, null or repeated, are carried along only. Texts of any length are
aligned whole. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import SLICE_BYTES, WordEncoder, byte_classes, word_starts
from .byte_bpe import ODD as UNKNOWN
from .common import joined, lean, materialize, small_batches, text_or_empty
from .mphf import Hash, built, mixed
from .pieces import Agenda
from .word_ids import placed, raw, runs, slices

#: Links made at a time, and pairs that a task holds before it hands them on.
PART_LINKS, HELD_PAIRS = 2_000_000, 1_000_000
#: Pairs of a shard, about, and rows that become one vector.
SHARD_PAIRS, VECTOR_ROWS, FAN_IN = 1 << 18, 1 << 20, 8
#: Pairs that are broadcast at most: 64 MB.
LOOKUP_PAIRS = 4_000_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a character: printable ones as themselves, the others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def _summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``ends``."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[ends])


@dataclass
class Aligned:
    """Texts of a slice, each a run of cuts, and what each cut holds."""

    cut_of: np.ndarray  # the cuts of all texts, one text after another
    ends: np.ndarray  # where each text's cuts end
    good: np.ndarray  # texts whose bytes are their tokens'
    a: np.ndarray  # ids of A, cut by cut
    b: np.ndarray
    a_ends: np.ndarray  # where each cut's ids end
    b_ends: np.ndarray
    group_a: np.ndarray  # the group of each token
    a_sizes: np.ndarray  # tokens of each group
    b_sizes: np.ndarray
    group_ends: np.ndarray  # where each cut's groups end

    def per_text(self, of_cut: np.ndarray) -> np.ndarray:
        return np.where(self.good, _summed(of_cut[self.cut_of], self.ends), 0)

    def links(self):
        """(cut, pair) of all links, in parts of bounded size; pairs as ids of A in the upper half, of B in the lower."""
        times = self.b_sizes[self.group_a]
        first_b = (_ends(self.b_sizes)[:-1])[self.group_a]
        cut_of_a = np.repeat(np.arange(len(self.a_ends) - 1), np.diff(self.a_ends))
        made, start = np.cumsum(times), 0
        while start < len(times):
            stop = max(start + 1, int(np.searchsorted(made, (made[start - 1] if start else 0) + PART_LINKS, side="right")))
            n = times[start:stop]
            pairs = np.repeat(self.a[start:stop].astype(np.int64), n) << 32 | self.b[runs(first_b[start:stop], n)].astype(np.int64)
            yield np.repeat(cut_of_a[start:stop], n), pairs
            start = stop

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair, documents of this slice that hold it)."""
        some = [_unique_rows(c, p) for c, p in self.links()]
        if not some:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        cuts, pairs = _unique_rows(np.concatenate([c for c, _ in some]), np.concatenate([p for _, p in some]))
        keys, number = np.unique(pairs, return_inverse=True)
        pair_ends = np.searchsorted(cuts, np.arange(len(self.a_ends)))  # a cut's pairs lie together
        text = np.repeat(np.arange(len(self.good)), np.diff(self.ends))
        keep = self.good[text]
        text, cut = _unique_rows(text[keep], self.cut_of[keep])
        counts, n = np.zeros(len(keys), dtype=np.int64), np.diff(pair_ends)[cut]
        made, start = np.cumsum(n), 0
        while start < len(text):  # whole texts at a time
            stop = int(np.searchsorted(made, (made[start - 1] if start else 0) + PART_LINKS, side="right"))
            stop = int(np.searchsorted(text, text[min(max(stop, start), len(text) - 1)], side="left"))
            if stop <= start:
                stop = int(np.searchsorted(text, text[start], side="right"))
            held = np.unique(np.repeat(text[start:stop], n[start:stop]) * len(keys) + number[runs(pair_ends[cut[start:stop]], n[start:stop])])
            counts += np.bincount(held % len(keys), minlength=len(keys))
            start = stop
        return keys, counts

    def held(self) -> tuple[pa.Array, pa.Array]:
        """For each text its distinct pairs, and how often it has each linked."""
        some = list(self.links())
        cuts, pairs = (np.concatenate([x[i] for x in some]) if some else np.zeros(0, dtype=np.int64) for i in (0, 1))
        ends = np.searchsorted(cuts, np.arange(len(self.a_ends)))
        text = np.repeat(np.arange(len(self.good)), np.diff(self.ends))
        text, cut = text[self.good[text]], self.cut_of[self.good[text]]
        n = np.diff(ends)[cut]
        text, pairs = np.repeat(text, n), pairs[runs(ends[cut], n)]
        order = np.lexsort((pairs, text))
        text, pairs = text[order], pairs[order]
        first = np.ones(len(text), dtype=bool)
        first[1:] = (text[1:] != text[:-1]) | (pairs[1:] != pairs[:-1])
        at = np.flatnonzero(first)
        ends = np.searchsorted(text[at], np.arange(len(self.good) + 1))
        return _lists(ends, pa.array(pairs[at])), _lists(ends, pa.array(np.diff(np.append(at, len(text)))))


def _unique_rows(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.ones(len(left), dtype=bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    return left[first], right[first]


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = WordEncoder(a_path), Agenda(b_path)
        if any(not t.special for t in self.a.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("a vocabulary whose added tokens are all special is needed")
        self.a.tokenizer.encode_special_tokens, self.a.special = True, []  # their strings in texts are plain text
        byte_of = _byte_of_char()
        entries = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.tokenizer.get_vocab_size())]
        own = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in entries]
        self.a_bytes, self.a_decimal = pa.array(own, pa.binary()), pa.array([str(i) for i in range(len(own))], pa.binary())
        self.a_size = np.array([len(x) for x in own], dtype=np.int64)
        of_byte = self.b.byte_of
        own = [bytes([of_byte[i]]) if i in of_byte else s for i, s in enumerate(self.b.surface.to_pylist())]
        self.b_bytes, self.b_decimal = pa.array(own, pa.binary()), self.b.decimal
        self.b_size = np.array([len(x) for x in own], dtype=np.int64)

    def _cuts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Places where a stretch of B and a word of A begin, as cuts, and how many each text has."""
        data, at = raw(texts)
        kind = byte_classes(data)
        first = np.zeros(len(data), dtype=bool)
        if self.b.cuts_at_space:
            space = data == 0x20
            first[1:] = space[1:] & ~space[:-1]
            words = np.zeros(len(data), dtype=bool)
            words[word_starts(data, kind, at)] = True
            first &= words
            odd = np.diff(np.concatenate(([0], np.cumsum(kind == UNKNOWN)))[at]) > 0
            if odd.any():  # aligned whole
                first[runs(at[:-1][odd], np.diff(at)[odd])] = False
        first[at[:-1]] = True
        starts = np.flatnonzero(first)
        return slices(data, np.append(starts, len(data))), np.diff(np.searchsorted(starts, at))

    def _a_ids(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = raw(cuts)
        kind = byte_classes(data)
        odd = np.diff(np.concatenate(([0], np.cumsum(kind == UNKNOWN)))[at]) > 0
        if odd.any():
            whole = self.a._whole([x.decode() for x in cuts.filter(pa.array(odd)).to_pylist()])
            by_library = (np.flatnonzero(odd), np.concatenate(whole), np.array([len(x) for x in whole]))
            return placed(len(cuts), [by_library, (np.flatnonzero(~odd), *self._a_ids(cuts.filter(pa.array(~odd))))])
        if not len(cuts):
            return np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64)
        starts = word_starts(data, kind, at)
        index, ids, sizes = self.a.words.distinct(slices(data, np.append(starts, len(data))))
        n = sizes[index]
        return ids[runs((np.cumsum(sizes) - sizes)[index], n)], _summed(n, np.searchsorted(starts, at))

    def _b_ids(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, counts = self.b._cut(cuts)  # a cut may hold several stretches, as a text that is aligned whole does
        index, ids, sizes = self.b.words.distinct(_after_space(words, counts))
        n = sizes[index]
        return ids[runs((np.cumsum(sizes) - sizes)[index], n)], _summed(n, _ends(counts))

    def slices_of(self, texts: pa.Array):
        """``texts``, without nulls, as slices of a bounded size: (from, to, Aligned)."""
        _, at = raw(texts)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES // 2, side="right")) - 1)
            yield a, b, self.align(texts[a:b])
            a = b

    def align(self, texts: pa.Array) -> Aligned:
        empty = np.diff(raw(texts)[1]) == 0
        led = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        cuts, counts = self._cuts(led)
        coded = cuts.dictionary_encode()
        cuts, cut_of = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        a, a_n = self._a_ids(cuts)
        b, b_n = self._b_ids(cuts)
        same = pc.and_(
            pc.equal(pc.binary_join(_lists(_ends(a_n), self.a_bytes.take(pa.array(a))), b""), cuts),
            pc.equal(pc.binary_join(_lists(_ends(b_n), self.b_bytes.take(pa.array(b))), b""), cuts),
        )
        same, ends = np.asarray(same), _ends(counts)
        good = ~empty & (_summed(~same[cut_of], ends) == 0)
        a, b = a[np.repeat(same, a_n)], b[np.repeat(same, b_n)]
        a_n, b_n = np.where(same, a_n, 0), np.where(same, b_n, 0)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])  # both count the bytes of the same cuts
        both = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, dtype=bool)
        both[a_end] = True
        group_end = b_end[both[b_end]]
        group_a, group_b = np.searchsorted(group_end, a_end), np.searchsorted(group_end, b_end)
        cut_bytes = np.cumsum(np.where(same, np.diff(raw(cuts)[1]), 0))
        return Aligned(
            cut_of, ends, good, a, b, _ends(a_n), _ends(b_n), group_a, np.bincount(group_a, minlength=len(group_end)),
            np.bincount(group_b, minlength=len(group_end)), np.concatenate(([0], np.searchsorted(group_end, cut_bytes, side="right"))),
        )

    def written(self, found: Aligned) -> pa.Array:
        """Each text's groups: ids of A, a bar, ids of B, a semicolon between groups."""
        of_a = pc.binary_join(_lists(_ends(found.a_sizes), self.a_decimal.take(pa.array(found.a))), b",")
        of_b = pc.binary_join(_lists(_ends(found.b_sizes), self.b_decimal.take(pa.array(found.b))), b",")
        groups = pc.binary_join_element_wise(of_a, of_b, b"|")
        cuts = pc.binary_join(_lists(found.group_ends, groups), b";")
        return pc.binary_join(_lists(found.ends, cuts.take(pa.array(found.cut_of))), b";")


def _after_space(words: pa.Array, counts: np.ndarray) -> pa.Array:
    """Stretches without the space that leads them: the first of each cut still has it, the others never do."""
    data, at = raw(words)
    led = np.zeros(len(words), dtype=np.int64)
    led[_ends(counts)[:-1]] = 1
    sizes = np.diff(at) - led
    return slices(data[runs(at[:-1] + led, sizes)], _ends(sizes))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner; the words it knows outlive a task."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


# ---- counts ----------------------------------------------------------------


def _spread(keys: np.ndarray) -> np.ndarray:
    """Numbers that tell a pair's shard."""
    return (mixed(keys, 97) >> np.uint64(1)).astype(np.int64)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, index = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), dtype=np.int64)
    np.add.at(n, index, np.concatenate([n for _, n in parts]))
    return keys, n


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """(key, spread, n, part): the documents that hold each pair linked, added up task by task."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        own, part, parts = aligner(a_path, b_path), TaskContext.get().partitionId(), []

        def told():
            keys, n = _added(parts)
            parts.clear()
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                columns = [k, _spread(k), n[i : i + 100_000], np.full(len(k), part, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "spread", "n", "part"])

        for batch in batches:
            for _, _, found in own.slices_of(batch.column(0)):
                parts.append(found.distinct())
                if sum(len(k) for k, _ in parts) > HELD_PAIRS:
                    parts[:] = [_added(parts)]
                    if len(parts[0][0]) > HELD_PAIRS // 2:
                        yield from told()
        if parts:
            yield from told()

    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(lean(run), "key long, spread long, n long, part long")


def _hashed(table: pa.Table) -> pa.Table:
    keys = np.asarray(table["key"])
    sizes, words = built(keys)
    at = Hash(sizes, words)(keys)
    kept = np.empty_like(keys)
    kept[at] = keys
    return pa.table(
        {
            "shard": table["shard"][:1], "sizes": pa.array([sizes], pa.list_(pa.int64())), "words": pa.array([words.tobytes()], pa.binary()),
            "keys": pa.array([kept.astype("<i8").tobytes()], pa.binary()),
        }
    )


def _vector(rows: pa.Table, hashes: pa.Table) -> pa.Table:
    """A dense vector of counts, indexed by the shard's hash."""
    kept = np.frombuffer(hashes["keys"][0].as_py(), dtype="<i8")
    counts = np.zeros(len(kept), dtype="<i8")
    if len(rows):
        keys = np.asarray(rows["key"])
        at = Hash(hashes["sizes"][0].as_py(), np.frombuffer(hashes["words"][0].as_py(), dtype="<u8"))(keys)
        if (at < 0).any() or (kept[at] != keys).any():
            raise ValueError("a pair that its shard's hash doesn't know")
        np.add.at(counts, at, np.asarray(rows["n"]))
    return pa.table({"shard": hashes["shard"][:1], "chunk": hashes["chunk"][:1], "counts": pa.array([counts.tobytes()], pa.binary())})


def _vector_sum(table: pa.Table) -> pa.Table:
    total = np.zeros(len(table["counts"][0].as_py()) // 8, dtype="<i8")
    for x in table["counts"]:
        total += np.frombuffer(x.as_py(), dtype="<i8")
    return pa.table({"shard": table["shard"][:1], "chunk": table["up"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def dense_counts(pairs: DataFrame, shard_pairs: int = SHARD_PAIRS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """(shard, sizes, words, keys, counts) of (key, spread, n, part), a written table: a hash, and the keys and counts in order of its numbers."""
    rows, about = pairs.agg(F.count("*"), F.approx_count_distinct("key")).first()
    shards = max(1, -(-about // shard_pairs))
    chunks = max(1, -(-rows // (shards * vector_rows)))
    placed = pairs.withColumn("shard", F.pmod(F.col("spread"), F.lit(shards)))
    hashes = placed.select("shard", "key").distinct().groupBy("shard").applyInArrow(_hashed, "shard long, sizes array<long>, words binary, keys binary")
    hashes = materialize(hashes, "pair-hashes")
    for_chunks = hashes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    placed = placed.withColumn("chunk", F.pmod(F.col("part"), F.lit(chunks)).cast("long"))
    vectors = placed.groupBy("shard", "chunk").cogroup(for_chunks.groupBy("shard", "chunk")).applyInArrow(_vector, "shard long, chunk long, counts binary")
    while chunks > 1:
        chunks = -(-chunks // FAN_IN)
        vectors = vectors.withColumn("up", F.floor(F.col("chunk") / FAN_IN)).groupBy("shard", "up").applyInArrow(_vector_sum, "shard long, chunk long, counts binary")
    return materialize(hashes.join(vectors.drop("chunk"), "shard"), "pair-vectors")


def lexicon(dense: DataFrame) -> DataFrame:
    """(key, a, b, n): pairs and how many documents hold them."""

    def run(batches):
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1), strict=True):
                keys, n = (np.frombuffer(x.as_py(), dtype="<i8") for x in (keys, n))
                for i in range(0, len(keys), 100_000):
                    k = keys[i : i + 100_000]
                    columns = [k, (k >> 32).astype(np.int32), (k & 0xFFFFFFFF).astype(np.int32), n[i : i + 100_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "a", "b", "n"])

    return dense.select("keys", "counts").mapInArrow(run, "key long, a int, b int, n long")


class Counts:
    """Counts of pairs, and the highest of each id of A, as a worker holds them."""

    def __init__(self, shards: list[tuple], highest: np.ndarray):
        self.highest = highest
        self.n_shards = max((x[0] for x in shards), default=0) + 1
        self.shards = {x[0]: (Hash(x[1], np.frombuffer(x[2], dtype="<u8")), *(np.frombuffer(y, dtype="<i8") for y in x[3:])) for x in shards}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each pair, confirmed by the key at its number."""
        out, shard = np.zeros(len(keys), dtype=np.int64), _spread(keys) % self.n_shards
        for k, (hashed, kept, n) in self.shards.items():
            own = np.flatnonzero(shard == k)
            at = hashed(keys[own])
            if (at < 0).any() or (kept[at] != keys[own]).any():
                raise ValueError("a pair that its shard's hash doesn't know")
            out[own] = n[at]
        return out


_held: dict[str, Counts] = {}


def _counts(broadcast) -> Counts:
    if broadcast.value["name"] not in _held:
        _held.clear()
        _held[broadcast.value["name"]] = Counts(broadcast.value["shards"], broadcast.value["highest"])
    return _held[broadcast.value["name"]]


_BASE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_col="doc_id", text_col="text", with_groups: bool = True, lookup_pairs: int = LOOKUP_PAIRS, dense: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) for every row.

    ``groups`` has the ids of each group, as ``a1,a2|b1;a3|b2,b3`` (null without ``with_groups``).
    ``dense``: counts of pairs as ``dense_counts`` gives them; by default those of ``docs`` itself.
    """
    spark = docs.sparkSession
    if dense is None:
        dense = dense_counts(materialize(pair_counts(docs, a_path, b_path, text_col), "pairs"))
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    n_pairs = dense.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
    small_batches(spark)

    def base(own: Aligner, found: Aligned):
        per = lambda ends: found.per_text(np.diff(ends))
        links = found.per_text(_summed(found.a_sizes * found.b_sizes, found.group_ends))
        written = [x if g else b"" for x, g in zip(own.written(found).to_pylist(), found.good.tolist(), strict=True)]
        digests = [hashlib.sha256(x).hexdigest() if x else "" for x in written]
        columns = [per(found.a_ends), per(found.b_ends), per(found.group_ends), links]
        return [pa.array(c) for c in columns] + [pa.array(digests, pa.string()), pa.array([x.decode() if with_groups else None for x in written], pa.string())]

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    if n_pairs <= lookup_pairs:
        # at most a row for each id of A
        highest = lexicon(dense).groupBy("a").agg(F.max("n").alias("n")).collect()
        best = np.zeros(max((r.a for r in highest), default=0) + 1, dtype=np.int64)
        for r in highest:
            best[r.a] = r.n
        shards = [(r.shard, r.sizes, bytes(r.words), bytes(r.keys), bytes(r.counts)) for r in dense.collect()]
        held = spark.sparkContext.broadcast({"name": uuid.uuid4().hex, "shards": shards, "highest": best})

        def run(batches):
            own, counts = aligner(a_path, b_path), _counts(held)
            for batch in batches:
                for a, b, found in own.slices_of(batch.column(1)):
                    n_cuts = len(found.a_ends) - 1
                    sums, tops = np.zeros(n_cuts, dtype=np.int64), np.zeros(n_cuts, dtype=np.int64)
                    for cut, pairs in found.links():
                        keys, index = np.unique(pairs, return_inverse=True)
                        n = counts.of(keys)
                        np.add.at(sums, cut, n[index])
                        np.add.at(tops, cut, (n == counts.highest[keys >> 32])[index].astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[a:b], *base(own, found), pa.array(found.per_text(tops)), pa.array(found.per_text(sums))], [*names, "n_best", "count_sum"]
                    )

        return rows.mapInArrow(lean(run), f"{_BASE}, n_best long, count_sum long")

    def spread(batches):
        own = aligner(a_path, b_path)
        for batch in batches:
            for a, b, found in own.slices_of(batch.column(1)):
                keys, times = found.held()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *base(own, found), keys, times], [*names, "keys", "times"])

    per_row = rows.mapInArrow(lean(spread), f"{_BASE}, keys array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id())
    per_row = materialize(per_row, "aligned-rows")
    links = per_row.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    known = lexicon(dense)
    highest = known.groupBy("a").agg(F.max("n").alias("highest"))
    known = materialize(known.join(F.broadcast(highest), "a").select("key", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-lexicon")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = joined(links, known, ["key"], "n", total).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    )
    return per_row.join(found, "row", "left").select(
        *names, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum")
    )
