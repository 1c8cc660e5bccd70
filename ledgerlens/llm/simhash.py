"""Near duplicates by SimHash, found by the generalised pigeonhole principle.

Fingerprints within ``distance`` bits: cut the 64 bits into parts and give part i
a threshold t_i of -1 or more with the sum of (t_i + 1) equal to distance + 1.
Were two fingerprints to differ in over t_i bits in every part, they would differ
in over ``distance`` bits altogether; so probing each part's values within t_i
bits, and verifying, misses no link. Correlated bits go to the same part, and
thresholds come from dynamic programming over the estimated candidates of each
part, which the table's own bit and value counts give: many rows call for few
wide parts with higher thresholds, few rows for narrow parts probed exactly.

Only distinct fingerprints are linked; documents get their fingerprint's
component. Null and empty texts, and texts without words, have fingerprint zero.
Repeated rows and ids are documents of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chosen, discard, lean, materialize, small_batches, text_or_empty
from .components import components

BITS = 64
#: Relative cost of a probe (a shuffled row) against a verified candidate.
PROBE_COST = 4.0


def shingle_hashes(ws: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``width`` consecutive words, space-joined; of all words where there are fewer."""
    if not ws:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(ws)
    n = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1
    ends = np.cumsum(n) - 1
    starts = ends - n + 1
    k = max(1, len(ws) - width + 1)
    at = zip(starts[:k].tolist(), ends[min(width, len(ws)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in at), dtype="<u8", count=k)


def simhash(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of these hashes, as a signed number; zero where there are none."""
    k = len(hashes)
    if not k:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, k, 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > k, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text over its lower-cased ``width``-word shingles, repeated ones as often as they stand."""
    return simhash(shingle_hashes(text.lower().split(), width, seed))  # of bytes: A-Z and the six ASCII spaces alone


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's lower-cased shingles, sorted."""
    return np.unique(shingle_hashes(text.lower().split(), width))


def fingerprints(docs: DataFrame, doc_col="doc_id", text_col="text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, width, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.encode(text_or_empty(text_col), "UTF-8")).mapInArrow(
        lean(run), "doc_id long, fp long"
    )


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: rows in which both bits are set. Summed on the executors; 4,096 numbers reach the driver."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(np.asarray(batch.column(0)).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            x = x.astype(np.float32)
            total += x.T @ x
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells.astype(np.int32)), pa.array(total.ravel()[cells].astype(np.int64))], ["cell", "n"]
        )

    out = np.zeros(BITS * BITS)
    for r in fps.select("fp").mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


def grouped_bits(both: np.ndarray, rows: int, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of nearly equal size, each grown from its most correlated bits."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts, 0, -1):
        size = -(-len(left) // k)
        free = sorted(left)
        group = [free[int(np.argmax(corr[np.ix_(free, free)].sum(axis=1)))]]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group))
        left -= set(group)
    return groups


def mask_of(bits: list[int]) -> int:
    """A signed long with these bits set."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def ball(width: int, t: int) -> int:
    return sum(math.comb(width, k) for k in range(t + 1))


def estimated_candidates(both: np.ndarray, rows: int, bits: list[int], equal_pairs: float, t: int) -> float:
    """Rows within ``t`` bits of a row in these bits: bits taken as independent, scaled so that t = 0 is as counted."""
    if t < 0:
        return 0.0
    p = np.diag(both)[bits] / max(rows, 1)
    differ = 2 * p * (1 - p)
    chance = np.zeros(t + 2)
    chance[0] = 1.0
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    scale = equal_pairs / max(rows * float(np.prod(1 - differ)), 1e-9)
    return rows * float(chance[: t + 1].sum()) * max(scale, 1.0)


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds, one for each part, with the sum of (t + 1) equal to distance + 1 and the least total cost.

    ``costs[i][t + 1]`` is the cost of threshold t in part i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, ts) in best.items():
            for u in range(distance + 2 - spent):
                new = (total + cost[u], [*ts, u - 1])
                if spent + u not in step or new < step[spent + u]:
                    step[spent + u] = new
        best = step
    return best[distance + 1]


def probe_plan(distinct: DataFrame, distance: int, parts=(2, 3, 4)) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each probed part, for the cheapest way of cutting the 64 bits."""
    rows = distinct.count()
    both = bit_counts(distinct)
    groups = {m: grouped_bits(both, rows, m) for m in parts}
    masks = [(m, i, mask_of(g)) for m, gs in groups.items() for i, g in enumerate(gs)]
    values = distinct.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(k)).alias("v")) for m, i, k in masks])).alias("x")
    ).select("x.*")
    pairs = {
        (r.m, r.i): r.s / max(rows, 1)
        for r in values.groupBy("m", "i", "v").agg(F.count("*").alias("n")).groupBy("m", "i").agg(F.sum(F.col("n") * F.col("n")).alias("s")).collect()
    }
    plans = []
    for m, gs in groups.items():
        costs = [
            [0.0]
            + [
                PROBE_COST * (ball(len(g), t // 2) + ball(len(g), t - t // 2)) + estimated_candidates(both, rows, g, pairs.get((m, i), 1.0), t)
                for t in range(distance + 1)
            ]
            for i, g in enumerate(gs)
        ]
        cost, ts = allocate(costs, distance)
        plans.append((cost, m, [(mask_of(g), g, t) for g, t in zip(gs, ts, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


def _values(i: int, mask: int, bits: list[int], t: int) -> list[Column]:
    """(part, value) structs of a fingerprint's values within ``t`` bits in part ``i``."""
    value = F.col("fp").bitwiseAND(F.lit(mask))
    flips = [mask_of(list(c)) for k in range(t + 1) for c in itertools.combinations(bits, k)]
    return [F.struct(F.lit(i).alias("i"), value.bitwiseXOR(F.lit(x)).alias("v")) for x in flips]


def links(distinct: DataFrame, distance: int = 3, plan: list[tuple[int, list[int], int]] | None = None) -> DataFrame:
    """(a, b), a < b: pairs of different fingerprints that differ in ``distance`` bits at most.

    Values within t bits meet halfway: one side lists its values within t // 2 bits, the
    other within the rest. Where ``distinct`` has a ``label``, pairs of equal labels don't come out.
    """
    plan = plan or probe_plan(distinct.select("fp"), distance)
    own = ["label"] if "label" in distinct.columns else []
    sides = []
    for end, half in (("a", lambda t: t - t // 2), ("b", lambda t: t // 2)):
        values = F.explode(F.array(*[x for i, (m, b, t) in enumerate(plan) for x in _values(i, m, b, half(t))]))
        rows = distinct.select(F.col("fp").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in own], values.alias("k"))
        sides.append(rows.select(end, *[f"{end}_{c}" for c in own], F.col("k.i").alias(f"{end}_i"), F.col("k.v").alias(f"{end}_v")))
    met = (F.col("a_i") == F.col("b_i")) & (F.col("a_v") == F.col("b_v")) & (F.col("a") < F.col("b"))
    if own:
        met = met & (F.col("a_label") != F.col("b_label"))
    probe, index = sides
    return probe.join(index, met & (_differ("a", "b") <= distance)).select("a", "b").distinct()


def _differ(x: str, y: str) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def spokes(distinct: DataFrame, distance: int, plan: list[tuple[int, list[int], int]]) -> DataFrame:
    """(a, b): fingerprints linked to the smallest one that has the same value in a probed part, where that is near enough.

    As many links as fingerprints and parts at most: they join a dense group before its pairs are looked at.
    """
    values = distinct.select("fp", F.explode(F.array(*[_values(i, m, b, 0)[0] for i, (m, b, _) in enumerate(plan)])).alias("k"))
    values = values.select("fp", "k.i", "k.v")
    hubs = values.groupBy("i", "v").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("i", "v", "hub")
    met = values.join(hubs, ["i", "v"]).where((F.col("fp") != F.col("hub")) & (_differ("fp", "hub") <= distance))
    return met.select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def _relabelled(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """``nodes`` (fp, label) with labels replaced by those of ``joined`` (node, label)."""
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return nodes.join(new, "label", "left").select("fp", F.coalesce("new", "label").alias("label"))


def near_duplicates(docs: DataFrame, doc_col="doc_id", text_col="text", distance: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id of those linked, directly or through others.

    Dense groups are first joined by ``spokes``; the probes that follow find every link between
    fingerprints of different groups, and components of groups join those.
    """
    fps = materialize(fingerprints(docs, doc_col, text_col, width), "simhash-fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    own = distinct.select("fp")
    plan = probe_plan(own, distance)
    nodes = materialize(_relabelled(own.select("fp", F.col("fp").alias("label")), components(spokes(own, distance, plan))), "simhash-groups")
    label_of = lambda end: nodes.select(F.col("fp").alias(end), F.col("label").alias(f"{end}_label"))
    met = links(nodes, distance, plan).join(label_of("a"), "a").join(label_of("b"), "b")
    labelled = distinct.join(_relabelled(nodes, components(met, "a_label", "b_label")), "fp")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(least, "label").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, width: int, doc_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, shingles): the distinct hashes of a text's shingles, sorted, as 64-bit numbers."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.encode(text_or_empty(text_col), "UTF-8")).mapInArrow(
        lean(run), "doc_id long, shingles binary"
    )


def similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those rows (a, b, sa, sb) whose shingle sets have a Jaccard similarity of ``similarity`` or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= similarity * (len(u) + len(v) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(mask)

    return pairs.mapInArrow(lean(run), "a long, b long")


#: Bits of a set's parities.
PARITIES = 2048


def parities(hashes: np.ndarray) -> bytes:
    """For each bit whether an odd number of the set's hashes falls on it: two sets differ in as many hashes, at least, as in bits."""
    counts = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a_id, b_id) of those rows (a_id, b_id, na, nb, pa, pb) whose sizes and parities allow a Jaccard similarity of ``similarity`` or more.

    Sets of n and m hashes with similarity s differ in (1 - s) / (1 + s) of n + m at most, so this drops no similar pair.
    """
    share = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, PARITIES // 8) for i in (4, 5))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            n = np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))
            keep = pa.array(differ <= share * n + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a_id", "b_id"]).filter(keep)

    return pairs.mapInArrow(lean(run), "a_id long, b_id long")


def sketched(docs: DataFrame, width: int, doc_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, fp, content, size, parities): a SimHash, a 128-bit hash, the size and parities of the set of ``width``-word shingles."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps, contents, sizes, odd = [], [], [], []
            for t in batch.column(1).to_pylist():
                hashes = shingle_set(t, width)
                fps.append(simhash(hashes))
                contents.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                odd.append(parities(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.int64()), pa.array(contents, pa.binary()), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary())],
                ["doc_id", "fp", "content", "size", "parities"],
            )

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.encode(text_or_empty(text_col), "UTF-8")).mapInArrow(
        lean(run), "doc_id long, fp long, content binary, size int, parities binary"
    )


def central_spokes(live: DataFrame, distance: int, plan: list[tuple[int, list[int], int]]) -> DataFrame:
    """(a_id, b_id): rows (fp, doc_id) linked to the most central of those that have the same value in a probed part, where that is near enough.

    Like ``spokes``, as many links as rows and parts at most; but as links are judged on whole sets
    later, a hub must be like many of its group: it is the fingerprint next to the group's bitwise majority.
    """
    values = live.select("fp", "doc_id", F.explode(F.array(*[_values(i, m, b, 0)[0] for i, (m, b, _) in enumerate(plan)])).alias("k"))
    values = values.select("fp", "doc_id", "k.i", "k.v")
    ones = [F.sum(F.shiftright("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    shared = values.groupBy("i", "v").agg(F.count("*").alias("n"), *ones).where("n > 1")
    middle = F.lit(0).cast("long")
    for b in range(BITS):
        middle = middle.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(mask_of([b]))).otherwise(F.lit(0)).cast("long"))
    near = values.join(shared.select("i", "v", middle.alias("middle")), ["i", "v"])
    hubs = near.groupBy("i", "v").agg(F.min(F.struct(_differ("fp", "middle").alias("away"), "doc_id", "fp")).alias("hub"))
    hubs = hubs.select("i", "v", F.col("hub.doc_id").alias("a_id"), F.col("hub.fp").alias("hub"))
    met = values.join(hubs, ["i", "v"]).where((F.col("doc_id") != F.col("a_id")) & (_differ("fp", "hub") <= distance))
    return met.select("a_id", F.col("doc_id").alias("b_id")).distinct()


def probed(leads: DataFrame, node: DataFrame, distance: int, plan: list[tuple[int, list[int], int]]) -> DataFrame:
    """(a_id, b_id) of those ``leads`` (lead, fp) of different labels whose fingerprints differ in ``distance`` bits at most.

    Each fingerprint is probed once, for the smallest document that has it; others of that
    fingerprint are paired with this one.
    """
    labelled = leads.join(node, leads.lead == node.node).select("lead", "fp", "label")
    first = labelled.groupBy("fp").agg(F.min(F.struct("lead", "label")).alias("first")).select("fp", "first.*")
    of = lambda end: first.select(F.col("fp").alias(end), F.col("lead").alias(f"{end}_id"))
    met = links(first.select("fp", "label"), distance, plan).join(of("a"), "a").join(of("b"), "b").select("a_id", "b_id")
    same = labelled.join(first.select("fp", F.col("lead").alias("a_id"), F.col("label").alias("a_label")), "fp").where("label <> a_label")
    return met.union(same.select("a_id", F.col("lead").alias("b_id")))


#: Documents whose shingles are counted to tell common ones, and common shingles kept at most.
SAMPLED, COMMON = 20_000, 100_000


def common_shingles(docs: DataFrame, width: int, doc_col="doc_id", text_col="text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more of a sample of documents, sorted, and in how many they stand."""
    every = max(1, docs.count() // SAMPLED)
    sample = docs.where(F.pmod(F.xxhash64(F.col(doc_col)), F.lit(every)) == 0)

    def run(batches):
        for batch in batches:
            for s in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s, "<i8"))], ["x"])

    counts = shingle_sets(sample, width, doc_col, text_col).mapInArrow(lean(run), "x long").groupBy("x").agg(F.count("*").alias("n"))
    found = counts.where("n > 2").orderBy(F.desc("n"), "x").limit(COMMON).toArrow()
    x, n = (found.column(c).to_numpy().astype("<i8") for c in ("x", "n"))
    order = np.argsort(x.view("<u8"))
    return x.view("<u8")[order], n[order]


def rarest_first(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in the one order that all sets share: by count in the sample, then by hash."""
    n = np.zeros(len(hashes), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        n = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, n))]


def prefixes(docs: DataFrame, width: int, similarity: float, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(doc_id, x, at, size) of a set's first shingles, rarest first: sets of ``similarity`` or more have one in common.

    Such sets share ``similarity`` of the larger one at least, so all but that many, and one, are listed.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            xs, lengths, sizes = [np.zeros(0, dtype="<u8")], [], []
            for t in batch.column(1).to_pylist():
                hashes = rarest_first(shingle_set(t, width), common, counts)
                n = len(hashes)
                xs.append(hashes[: n - math.ceil(similarity * n - 1e-6) + 1])
                lengths.append(len(xs[-1]))
                sizes.append(n)
            lengths = np.array(lengths, dtype=np.int64)
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            doc = np.repeat(np.asarray(batch.column(0)), lengths)
            size = np.repeat(np.array(sizes, dtype=np.int32), lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(np.concatenate(xs).view("<i8")), pa.array(at.astype(np.int32)), pa.array(size)], ["doc_id", "x", "at", "size"]
            )

    return docs.select("doc_id", F.encode(text_or_empty("text"), "UTF-8")).mapInArrow(lean(run), "doc_id long, x long, at int, size int")


def prefix_links(texts: DataFrame, labels: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a_id, b_id), written: all pairs of ``texts`` (doc_id, text) that can have ``similarity``, but those of equal ``labels`` (doc_id, label) or of none.

    Exact: two such sets have their first common shingle, in the order that all share, among the
    first of both, and it suffices to find them there. They share it and what stands behind it at
    most, 2s / (1 + s) of their mean size at least; and the shingles before it, of those that more
    than one group has, differ.
    """
    common, counts = common_shingles(texts, width)
    rows = prefixes(texts, width, similarity, common, counts).join(labels, "doc_id")
    whole = Window.partitionBy("x")
    rows = rows.select("*", F.min("label").over(whole).alias("least"), F.max("label").over(whole).alias("most"))
    rows = rows.where("least < most").select("*", F.lag("x").over(Window.partitionBy("doc_id").orderBy("at")).alias("before"))
    rows = materialize(rows.drop("least", "most"), "simhash-prefixes")
    a, b = (rows.select("x", *[F.col(c).alias(f"{end}_{c}") for c in ("doc_id", "at", "size", "label", "before")]) for end in "ab")
    share = similarity / (1 + similarity)
    order = F.struct("a_size", "a_doc_id") < F.struct("b_size", "b_doc_id")
    bound = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    first = ~F.coalesce(F.col("a_before") == F.col("b_before"), F.lit(False))
    met = order & first & (F.col("a_label") != F.col("b_label")) & (bound >= share * (F.col("a_size") + F.col("b_size")) - 1e-6)
    pairs = a.join(b, (a.x == b.x) & met)
    ends = pairs.select(F.least("a_doc_id", "b_doc_id").alias("a_id"), F.greatest("a_doc_id", "b_doc_id").alias("b_id")).distinct()
    ends = materialize(ends, "simhash-ends")
    discard(rows)
    return ends


def groups(
    docs: DataFrame,
    doc_col="doc_id",
    text_col="text",
    width: int = 5,
    similarity: float = 0.8,
    distance: int = 10,
    stars: int = 2,
    key_col: str | None = None,
    probe: int = 6,
) -> DataFrame:
    """(row_key, doc_id, group_id, kept) of every row: group_id is the smallest doc_id of its near duplicates.

    Rows are told apart by ``key_col``, a long that must not change when ``docs`` is read again, or
    by numbers of their own; the one with the smallest (doc_id, key) of a group is kept.
    Documents of equal shingle sets are one node; equal fingerprints alone join nothing. As in
    ``near_duplicates`` a plan of the generalised pigeonhole cuts the fingerprints: dense groups are
    first joined by ``stars`` rounds of links to the most central document of the same value in a
    part, within ``distance`` bits (a member leaves the later of these rounds only), then probes
    find all pairs of different groups within ``probe`` bits. As sets of ``similarity`` can differ in more
    bits, an exact search follows: there all documents meet on the rare shingles of their sets,
    which misses no pair, and only pairs already in one group are skipped. Parities rule out pairs
    that can't be similar; every link is then verified on whole shingle sets.

    Null and empty texts, and texts without words, are one empty set; null ids come first; an
    empty table gives an empty result; other columns are not read.
    """
    if key_col is None:
        key_col = "row_key"
        docs = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias(key_col))
        docs, doc_col, text_col = materialize(docs, "simhash-rows"), "doc_id", "text"
    # from here on a row's key stands for its doc_id
    fps = materialize(sketched(docs, width, key_col, text_col), "simhash-fps")
    first = F.min(F.struct("doc_id", "fp")).alias("first")
    lead = fps.groupBy("content").agg(first).select("content", F.col("first.doc_id").alias("lead"), "first.fp")
    lead = materialize(lead, "simhash-leads")
    plan = probe_plan(materialize(lead.select("fp").distinct(), "simhash-distinct"), probe)
    node = lead.select(F.col("lead").alias("node"), F.col("lead").alias("label"))
    live = lead.select("fp", F.col("lead").alias("doc_id"))
    whole = docs.select(F.col(key_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for step in range(stars + 2):
        if step < stars:
            ends = materialize(central_spokes(live, distance, plan), "simhash-ends")
        elif step == stars:
            ends = materialize(probed(lead.select("lead", "fp"), node, probe, plan), "simhash-ends")
        else:
            ends = prefix_links(whole, node.withColumnRenamed("node", "doc_id"), width, similarity)
        marks = lambda end: fps.select(F.col("doc_id").alias(f"{end}_id"), F.col("size").alias(f"n{end}"), F.col("parities").alias(f"p{end}"))
        met = ends.join(marks("a"), "a_id").join(marks("b"), "b_id").select("a_id", "b_id", "na", "nb", "pa", "pb")
        met = materialize(possible(met, similarity), "simhash-possible")
        discard(ends)
        ends = met
        wanted = materialize(ends.select(F.col("a_id").alias("doc_id")).union(ends.select("b_id")).distinct(), "simhash-wanted")
        texts = chosen(whole, wanted, "doc_id")
        sets = materialize(shingle_sets(texts, width), "simhash-sets")
        of = lambda end, sets=sets: sets.select(F.col("doc_id").alias(f"{end}_id"), F.col("shingles").alias(f"s{end}"))
        true = similar(ends.join(of("a"), "a_id").join(of("b"), "b_id").select("a_id", "b_id", "sa", "sb"), similarity)
        label_of = lambda end, node=node: node.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        labels = components(true.join(label_of("a"), "a").join(label_of("b"), "b"), "a_label", "b_label")
        discard(sets)
        discard(ends)
        joined = labels.select(F.col("node").alias("label"), F.col("label").alias("joined"))
        node = materialize(
            node.join(joined, "label", "left").select("node", F.coalesce("joined", "label").alias("label")), "simhash-groups"
        )
        gone = labels.where("node <> label").select(F.col("node").alias("doc_id"))
        live = materialize(live.join(gone, "doc_id", "left_anti").select("fp", "doc_id"), "simhash-leads")
    of_content = lead.join(node, lead.lead == node.node).select("content", "label")
    rows = fps.select(F.col("doc_id").alias("row_key"), "content").join(of_content, "content").select("row_key", "label")
    ids = docs.select(F.col(key_col).cast("long").alias("row_key"), F.col(doc_col).cast("long").alias("doc_id"))
    rows = materialize(rows.join(ids, "row_key"), "simhash-labels")
    least = rows.groupBy("label").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    kept = (F.col("row_key") == F.col("first.row_key")).alias("kept")
    return rows.join(least, "label").select("row_key", "doc_id", F.col("first.doc_id").alias("group_id"), kept)


def hex_of(fp: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
