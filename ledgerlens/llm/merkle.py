"""A Merkle manifest of a dataset, as a persistent tree that copies paths.

Each row is a leaf: the hash of its fields. Leaves are numbered within their tree
(a language) by document; a node is the hash of every two consecutive nodes below
it, a last one without a neighbour of that one alone, until one is left. The trees'
roots, in order of their names, are the leaves of a last tree.

The tree is built in aligned blocks of 1,024 nodes: ten levels of a block in one
task, then the blocks' roots as nodes of the next round, so rounds grow with the
logarithm of the table to the base 1,024 and no task sees more than a block. A
changed leaf makes a version of the tree: within its block only the ancestors of
that leaf are copied, all other nodes are shared with the first version, and the
version goes on through the blocks above with the siblings that all documents of a
block share. Numbers within a tree come from ranges of the sorted rows and their
counts, so a tree with most rows is numbered by many tasks.

Null fields are told from empty ones. Rows with equal ids, or none (these come
first), stand in order of their leaves; rows repeated whole are leaves of their own,
in a fixed order. Texts of any length are hashed whole inside the engine. An empty
table gives an empty manifest; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, joined, lean, materialize

#: Levels of a block.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of a path's steps: the sibling stands to the left, to the right, or there is none.
LEFT, RIGHT, ALONE = "<", ">", "-"
DIGEST = 64


def field(value: Column) -> Column:
    """A value as its length in bytes and itself, ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def joint(*hashes: str) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


# ---- one block -------------------------------------------------------------


def levels(nodes: list[str], height: int) -> list[list[str]]:
    """A block's nodes by level, ``height`` levels above the given ones."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([joint(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(tree: list[list[str]], i: int) -> str:
    """The steps from node ``i`` to the block's root: where the sibling stands, and its hash."""
    steps = []
    for nodes in tree[:-1]:
        other = i ^ 1
        steps.append((LEFT if i & 1 else RIGHT) + nodes[other] if other < len(nodes) else ALONE)
        i >>= 1
    return "".join(steps)


def steps_of(path: str):
    at = 0
    while at < len(path):
        side = path[at]
        size = 0 if side == ALONE else DIGEST
        yield side, path[at + 1 : at + 1 + size]
        at += 1 + size


def copies(node: str, path: str) -> list[str]:
    """The ancestors that a version with ``node`` at the foot of ``path`` copies, lowest first; it shares all other nodes."""
    out = []
    for side, other in steps_of(path):
        node = joint(other, node) if side == LEFT else joint(node, other)
        out.append(node)
    return out


def height_of(size: int, bits: int) -> int:
    """Levels that a block of a tree of ``size`` nodes has: up to its root, or all ``bits`` of them if there are more blocks."""
    return min(bits, (size - 1).bit_length())


# ---- trees over blocks -----------------------------------------------------


def numbered(rows: DataFrame, tree: str, order: list[str], label: str) -> tuple[DataFrame, int]:
    """``rows`` with ``pos``, the number within ``tree`` by ``order``, and ``size``, how many the tree has; the largest size.

    Ranges of the sorted rows are counted by tree; a row's number is what its tree has in ranges before, and its place in its own.
    """
    inner = [*rows.columns]
    at = F.monotonically_increasing_id()  # the range in the upper bits, the row's place in its range in the lower 33
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("at", at)
    ranged = materialize(ranged.withColumn("range", F.shiftright("at", 33)), f"{label}-ranged")
    parts = ranged.groupBy("range", tree).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy(tree)
    parts = parts.select(
        "range", tree, "first",
        F.coalesce(F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(own).alias("size"),
    )
    parts = materialize(parts, f"{label}-ranges")
    count, largest = parts.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    found = ranged.join(F.broadcast(parts) if count <= BROADCAST_KEYS // 10 else parts, ["range", tree])
    return found.select(*inner, (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "size"), largest


def _block(bits: int):
    """Each node of a block with its path to the block's root, and what a version copies there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        nodes = table["node"].to_pylist()
        tree = levels(nodes, height_of(table["size"][0].as_py(), bits))
        paths = [siblings(tree, i) for i in range(len(nodes))]
        changed = [None if x is None else copies(x, p) for x, p in zip(table["changed"].to_pylist(), paths, strict=True)]
        return pa.table(
            {
                "tree": table["tree"], "block": table["block"], "pos": table["pos"], "id": table["id"], "node": table["node"], "changed": table["changed"],
                "path": pa.array(paths, pa.string()), "copied": pa.array(changed, pa.list_(pa.string())),
                "top": pa.array([tree[-1][0]] * len(nodes), pa.string()), "blocks": pa.array([-(-table["size"][0].as_py() >> bits)] * len(nodes), pa.int64()),
                "foot": pa.array([i == 0 for i in range(len(nodes))], pa.bool_()),
            }
        )

    return run


_BLOCK = (
    "tree string, block long, pos long, id long, node string, changed string, path string, copied array<string>, top string, blocks long, foot boolean"
)


def grown(nodes: DataFrame, largest: int, label: str, bits: int = BITS) -> DataFrame:
    """(tree, pos, id, node, changed, path, copied, top) of (tree, pos, size, id, node, changed): each node's path to its tree's root.

    ``top`` is that root, ``copied`` the ancestors that the version with ``changed`` in the node's
    place copies within its block.
    """
    rows = nodes.withColumn("block", F.shiftright("pos", bits)).groupBy("tree", "block").applyInArrow(_block(bits), _BLOCK)
    if largest <= 1 << bits:
        return rows.drop("block", "blocks", "foot")
    rows = materialize(rows, f"{label}-blocks")
    nothing = F.lit(None).cast("string")
    above = rows.where("foot").select("tree", F.col("block").alias("pos"), F.col("blocks").alias("size"), F.lit(None).cast("long").alias("id"), F.col("top").alias("node"), nothing.alias("changed"))
    upper = grown(above, -(-largest >> bits), label, bits).select("tree", F.col("pos").alias("block"), F.col("path").alias("upper"), F.col("top").alias("upper_top"))
    found = rows.join(upper, ["tree", "block"])  # at most 1,024 rows of a key
    return found.select("tree", "pos", "id", "node", "changed", F.concat("path", "upper").alias("path"), "copied", F.col("upper_top").alias("top"))


def manifest(docs: DataFrame, tampered: Column, tree_col: str = "lang", id_col: str = "doc_id", fields=FIELDS, touched: str = "n_chars", bits: int = BITS) -> DataFrame:
    """(id, leaf, subroot, root, path, proof_sha256, copied, folded_root, verified) for every row.

    Rows where ``tampered`` holds have 1 added to ``touched`` (null stays null): ``folded_root`` is the
    root of the version that this makes, ``copied`` the nodes that the version does not share, from the
    leaf's parent to the root (null where nothing changed). ``path`` leads from leaf to root. Blocks have
    2 to the power ``bits`` nodes.
    """
    own = [F.col(f"`{c}`") for c in fields]
    more = [(F.col(f"`{c}`").cast("decimal(20,0)") + 1).cast("string") if c == touched else F.col(f"`{c}`") for c in fields]
    changed = F.coalesce(tampered, F.lit(False)) & F.col(f"`{touched}`").isNotNull()
    # a name before which nothing stands but null's: names keep the order of their bytes
    tree = F.coalesce(F.concat(F.lit(":"), F.col(f"`{tree_col}`").cast("string")), F.lit("-"))
    leaves = docs.select(
        tree.alias("tree"), F.col(f"`{id_col}`").cast("long").alias("id"), leaf(own).alias("node"),
        F.when(changed, leaf(more)).alias("changed"), F.monotonically_increasing_id().alias("place"),
    )
    leaves = materialize(leaves, "merkle-leaves")
    nodes, largest = numbered(leaves, "tree", ["id", "node", "place"], "merkle")
    rows = materialize(grown(nodes.drop("place"), largest, "merkle", bits), "merkle-rows")
    roots = rows.groupBy("tree").agg(F.count("*").alias("rows"), F.min("top").alias("node")).withColumn("all", F.lit("all"))
    roots, trees = numbered(materialize(roots, "merkle-roots"), "all", ["tree"], "merkle-roots")
    roots = materialize(roots.withColumnRenamed("tree", "name"), "merkle-numbered")
    nothing = F.lit(None)
    last = grown(roots.select(F.col("all").alias("tree"), "pos", "size", nothing.cast("long").alias("id"), "node", nothing.cast("string").alias("changed")), trees, "merkle-roots", bits)
    upper = roots.join(last.select("pos", F.col("path").alias("upper"), F.col("top").alias("root")), "pos")
    upper = materialize(upper.select(F.col("name").alias("tree"), "rows", "upper", "root"), "merkle-upper")
    rows = joined(rows, upper, ["tree"], "rows", rows.count())

    def fold(batches):
        for batch in batches:
            get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            folded, copied, proofs = [], [], []
            for node, changed, path, low, upper in zip(get["node"], get["changed"], get["path"], get["copied"], get["upper"], strict=True):
                proofs.append(joint(*(other for _, other in steps_of(path + upper))))
                if changed is None:  # no version of its own: every node is shared
                    copied.append(None)
                    folded.append((copies(node, path + upper) or [node])[-1])
                    continue
                # the version goes on where its block's copies end
                done = len(low)
                rest = list(steps_of(path + upper))[done:]
                now = [*low, *copies(low[-1] if low else changed, "".join(s + o for s, o in rest))]
                copied.append(now)
                folded.append((now or [changed])[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.names.index("id")), batch.column(batch.schema.names.index("node")), batch.column(batch.schema.names.index("top")), batch.column(batch.schema.names.index("root")),
                    pa.array([p + u for p, u in zip(get["path"], get["upper"], strict=True)], pa.string()), pa.array(proofs, pa.string()), pa.array(copied, pa.list_(pa.string())),
                    pa.array(folded, pa.string()), pa.array([f == r for f, r in zip(folded, get["root"], strict=True)], pa.bool_()),
                ],
                ["id", "leaf", "subroot", "root", "path", "proof_sha256", "copied", "folded_root", "verified"],
            )

    return rows.mapInArrow(
        lean(fold), "id long, leaf string, subroot string, root string, path string, proof_sha256 string, copied array<string>, folded_root string, verified boolean"
    )
