"""Texts whose token sets are near, found by groups of tokens instead of single ones.

Two sets with a Jaccard similarity of t or more, of n and m tokens, differ in at most
d = (n + m)(1 - t) / (1 + t) of them. Tokens are dealt to k > d groups, the same for all
sets of a size class: a token that only one set has changes one group, so at least k - d
groups are equal. As in a prefix filter, whose terms are groups here, the d + c rarest
groups of each set suffice: c of them are common to both, for any c up to k - d. A group of
several tokens is rare even where each of them is not, and c must be met, so few sets
meet that are not near.

Sets travel as 32-bit hashes and groups as 64-bit ones. Equal tokens have equal hashes, so
no pair is missed, and every pair that meets is verified on the tokens themselves.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.storage import cleaned, discard, materialize, scratch_path

#: Groups for each that may differ, and equal ones that are asked for where there must be as many.
SPARE, COMMON = 1.5, 5
#: Counters of tokens; sets that are taken apart at once; groups of a round; sets of a tile; rows that are broadcast at most (8 MB of numbers).
COUNTERS, ROWS, ROUND, TILE, BROADCAST_ROWS = 1 << 16, 1024, 4_000_000, 2048, 1_000_000


def term_sets(texts: DataFrame, by: list[str]) -> DataFrame:
    """(.. by, i, terms, name) of ``texts`` (.. by, i, text): their set of tokens in order, and a name that equal sets of one group ``by`` have in common."""
    t = texts.select(*by, "i", F.sort_array(F.array_distinct(tokens(F.col("text")))).alias("terms"))
    parts = [F.to_json(F.struct(*by))] if by else []
    name = F.unhex(F.sha2(F.concat_ws(" ", *parts, F.array_join("terms", " ")), 256))
    return t.withColumn("name", F.coalesce(name, F.lit(b"")))  # never null, which a join would make sure of by taking all texts apart once more


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _weights(sets: DataFrame) -> np.ndarray:
    """How rare a token is by the last bits of its hash, as small numbers of at least 1: tokens are counted task by task in as many counters, whatever the table."""

    def count(batches):
        n = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False)
            n += np.bincount(codes & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at])], ["at", "n"])

    found = sets.select("codes").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n = np.ones(COUNTERS)
    n[[r["at"] for r in found]] = [r["n"] for r in found]
    return np.maximum(np.rint(8 * np.log2(max(2, n.sum()) / n)), 1).astype(np.int16)


def classes(threshold: float, most: int) -> np.ndarray:
    """The largest size of each class, up to one beyond ``most``: sets that may be alike are in the same class or the next."""
    out = [1]
    while len(out) < 2 or out[-2] < most:
        out.append(max(out[-1] + 1, int(out[-1] / threshold + 1e-9)))
    return np.array(out, dtype=np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rare_groups(batch: pa.RecordBatch, own: np.ndarray, largest: np.ndarray, threshold: float, weights: np.ndarray, spare: float = SPARE, common: int = COMMON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, group's hash, least) of each row's rarest groups in the size classes ``own``; near sets have ``least`` of them in common. Rows of class -1 have none."""
    codes = batch.column("codes")
    sizes = np.diff(codes.offsets.to_numpy()).astype(np.int64)
    terms = codes.flatten().to_numpy(zero_copy_only=False)
    d = np.floor(2 * largest[own] * ((1 - threshold) / (1 + threshold)) + 1e-6).astype(np.int64)
    k = np.where(own < 0, 0, np.where(d > 0, np.ceil(spare * (d + 1)).astype(np.int64), 1))
    least = np.minimum(k - d, common)
    start = np.cumsum(k) - k
    in_use = np.repeat(own >= 0, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)[in_use]
    terms = terms[in_use]
    h = _mixed(terms.astype(np.uint32).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    cell = start[row] + (h % k[row].astype(np.uint64)).astype(np.int64)
    n = int(k.sum())
    # sums below 2**53 are exact, in whatever order they are made
    low, high = (np.bincount(cell, x.astype(np.float64), n).astype(np.uint64) for x in (h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)))
    rarity = np.bincount(cell, weights[terms & (COUNTERS - 1)].astype(np.float64), n).astype(np.uint64)
    rows = np.repeat(np.arange(len(k)), k)
    place = np.arange(n) - start[rows]
    seed = _mixed(batch.column("g").to_numpy(zero_copy_only=False).astype(np.uint64) + own.astype(np.uint64))[rows]
    name = _mixed(_mixed(_mixed(seed + place.astype(np.uint64)) + low) + high)
    # in one order for all sets: rare ones first, then by name
    order = np.lexsort((name, (rows.astype(np.uint64) << np.uint64(40)) + (np.uint64((1 << 40) - 1) - rarity)))
    chosen = order[place < (d + least)[rows]]
    return rows[chosen], name[chosen], least[rows[chosen]]


def rounds(sizes: dict[int, int], threshold: float, most: int) -> list[tuple[int, int, int, int]]:
    """Ranges of size classes (first, last, and the sizes over the one and up to the other that are in them or before the first) whose sets (``sizes``: how many of each size) have about ``most`` groups together, or one class."""
    largest = classes(threshold, max(sizes, default=1))
    rows = np.zeros(len(largest) + 1)
    n, count = np.array(list(sizes), dtype=np.int64), np.array(list(sizes.values()))
    own = np.searchsorted(largest, n)
    for c in (own, own + 1):
        np.add.at(rows, c, count * largest[np.minimum(c, len(largest) - 1)] * (2 * (1 - threshold) / (1 + threshold)) + count)
    out, held = [], most + 1
    for c in range(len(largest)):
        if held + rows[c] > most:
            out.append((c, c))
            held = 0
        out[-1] = (out[-1][0], c)
        held += rows[c]
    return [(low, high, int(largest[low - 2]) if low > 1 else 0, int(largest[high])) for low, high in out]


def candidates(sets: DataFrame, weights: np.ndarray, threshold: float, some: tuple[int, int, int, int] = (0, 1 << 30, 0, 1 << 30), spare: float = SPARE, common: int = COMMON) -> DataFrame:
    """(a, b): ids of ``sets`` (id, g, codes), one row for each set, that have enough rare groups in common and sizes near enough; each pair once, in the range of classes that the larger set is in."""

    def groups(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sizes = np.diff(batch.column("codes").offsets.to_numpy()).astype(np.int64)
            largest = classes(threshold, int(sizes.max()))
            own = np.searchsorted(largest, sizes)
            ids = batch.column("id").to_numpy()
            # a set meets those of its own class and, as the smaller one (a size below 0), those of the next
            after = np.where(np.floor(sizes / threshold + 1e-9) > largest[own], own + 1, -1)
            for c, sign in ((own, 1), (after, -1)):
                c = np.where((c >= some[0]) & (c <= some[1]), c, -1)
                row, name, least = _rare_groups(batch, c, largest, threshold, weights, spare, common)
                yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(ids[row]), pa.array(sign * (sizes[row] * 8 + least))], ["sig", "id", "n"])

    rows = sets.where(F.size("codes").between(some[2] + 1, some[3])).select("id", "g", "codes").mapInArrow(groups, "sig long, id long, n long")
    # both sides the same columns, so that they are shuffled once
    x, y = (rows.select("sig", F.col("id").alias(f"{end}_id"), F.col("n").alias(f"{end}_n")) for end in "xy")
    n, m = F.shiftright(F.abs("x_n"), 3), F.shiftright("y_n", 3)
    near = (n >= m * threshold - 1e-9) & (m >= n * threshold - 1e-9)  # and so no y_n below 0
    once = F.when(F.col("x_n") < 0, F.lit(True)).otherwise(F.col("x_id") < F.col("y_id"))
    found = x.join(y, (x.sig == y.sig) & near & once)
    # all groups that two sets share are of one class, and ask for as many
    least = F.first(F.abs("x_n").bitwiseAND(F.lit(7)))
    met = found.groupBy(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).agg(F.count("*").alias("common"), least.alias("least"))
    return met.where("common >= least").select("a", "b")


def met_pairs(sets: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """The candidates of all classes, written: range by range, so that the groups of a part of the classes alone lie on disk at once."""
    sizes = {r["n"]: r["count"] for r in sets.groupBy(F.size("codes").alias("n")).count().collect()}  # as many rows as sizes
    path = scratch_path(sets.sparkSession, "near-candidates")
    for some in rounds(sizes, threshold, ROUND):
        candidates(sets, weights, threshold, some).write.mode("append").parquet(path)
    return sets.sparkSession.read.schema("a long, b long").parquet(path)


def _shared(pairs: pa.Table, sets: pa.Table, threshold: float) -> pa.Table:
    """(a, b, similarity) of the ``pairs`` (a, b) of ``sets`` (id, terms) that reach the threshold."""
    ids, terms = sets["id"].to_numpy(), sets["terms"].combine_chunks()
    order, sizes = np.argsort(ids), np.diff(terms.offsets.to_numpy())
    ids, starts = ids[order], (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    numbers = terms.flatten().dictionary_encode().indices.to_numpy()
    pairs = pairs.sort_by("a")
    a, b = (np.searchsorted(ids, pairs[end].to_numpy()) for end in "ab")
    both, held = np.zeros(len(a), dtype=np.int64), np.zeros(numbers.max(initial=0) + 1, dtype=bool)
    cuts = np.flatnonzero(np.diff(a, prepend=-1))
    for low, high in zip(cuts, np.append(cuts[1:], len(a)), strict=True):
        own = numbers[starts[a[low]] : starts[a[low]] + sizes[a[low]]]
        held[own] = True
        for i in range(low, high):
            both[i] = held[numbers[starts[b[i]] : starts[b[i]] + sizes[b[i]]]].sum()
        held[own] = False
    similarity = both / (sizes[a] + sizes[b] - both)
    return pairs.select(["a", "b"]).append_column("similarity", pa.array(similarity)).filter(pa.array(similarity >= threshold))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of ``pairs`` by their ``sets`` (id, terms), all ids of pairs; both written.

    Sets go to tiles of about ``TILE`` with those that they are compared with: those that have their least
    partner's partner in common lie together, so a set of a dense group is not copied for each of its pairs.
    """
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = materialize(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "near-labels")
    further = ends.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("label"))  # the least of partners' partners
    label = materialize(label.unionByName(further).groupBy("a").agg(F.min("label").alias("label")), "near-labels")
    many = label.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    spread = lambda c, n: F.pmod(F.xxhash64(c), n)
    blocks = F.lit(max(1, -(-label.count() // TILE)))
    n = F.coalesce("n", F.lit(1))
    tile = F.xxhash64(spread("label", blocks), spread("a", F.ceil(n / TILE)), spread("b", F.ceil(n / (8 * TILE))))
    tiled = materialize(pairs.join(label, "a").join(many, "label", "left").select(tile.alias("tile"), "a", "b"), "near-tiles")
    wanted = tiled.select(F.col("tile").alias("of"), F.col("a").alias("id")).union(tiled.select("tile", "b")).distinct().join(sets, "id")

    def compare(some: pa.Table, own: pa.Table) -> pa.Table:
        return _shared(some, own, threshold)

    return tiled.groupBy("tile").cogroup(wanted.select("of", "id", "terms").groupBy("of")).applyInArrow(compare, "a long, b long, similarity double")


def near(texts: DataFrame, by: list[str], threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((.. by, a, b, similarity), (.. by, i, first)) of ``texts`` (.. by, i, text): near pairs of one group ``by``, and texts whose set an earlier one has.

    Of texts with equal sets the first alone, by ``i``, is in pairs, a < b. Texts without tokens are near none.
    """
    with cleaned(texts.sparkSession):
        coded = term_sets(texts, by).select(*by, "i", "name", F.transform("terms", lambda w: F.hash(w)).alias("codes"))
        written = materialize(coded.withColumn("id", F.monotonically_increasing_id()), "token-codes")
        coded = written.where(F.size("codes") > 0)
        first = coded.groupBy("name").agg(F.min(F.struct("i", "id")).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = coded.select(*by, "i", "name", "id").join(first.select("name", "first"), "name").where("id <> first.id")
        again = materialize(again.select(*by, "i", "id", F.col("first.i").alias("first")), "token-copies")
        weights = _weights(coded)
        g = F.xxhash64(*by) if by else F.lit(0).cast("long")
        sets = coded.select("id", g.alias("g"), "codes").join(_few(again.select("id")), "id", "left_anti")
        pairs = met_pairs(sets, weights, threshold)
        met = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-ids")
        met = materialize(coded.select("id", *by, "i", "name").join(_few(met), "id"), "near-names")
        discard(written)
        own = term_sets(texts.join(_few(met.select("i").distinct()), "i", "left_semi"), by).groupBy("name").agg(F.first("terms").alias("terms"))
        terms = materialize(met.join(own, "name").select("id", "terms"), "near-terms")
        found = materialize(_verified(pairs, terms, threshold), "near-verified")
        discard(terms)
        left, right = (met.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in [*by, "i"]]) for end in "ab")
        same = functools.reduce(lambda x, c: x & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), by, F.lit(True))
        ends = [F.least("i_a", "i_b").alias("a"), F.greatest("i_a", "i_b").alias("b")]
        found = found.join(left, "a").join(right, "b").where(same & (F.col("i_a") != F.col("i_b"))).select(*[F.col(f"{c}_a").alias(c) for c in by], *ends, "similarity")
        return materialize(found, "near-pairs"), again.drop("id")
