"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _roots(parents: DataFrame) -> DataFrame:
    """``parents`` (node, parent) followed to the nodes that are their own parents: each pass doubles the steps taken."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        passed = materialize(
            parents.join(above, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "cc-parents"
        )
        discard(parents)
        parents = passed.select("node", "parent")
        if passed.where("moved").isEmpty():
            return parents


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): nodes of ``edges`` with one label for each component.

    Each round every node points to its smallest neighbour if that is smaller, pointers are
    followed to their roots, and edges are redrawn between roots; the graph shrinks until no
    edge is left. A path, however long, goes in one round of as many passes as its length has
    binary digits. A node's neighbours are only ever reduced to their minimum, so a node of any
    degree is summed up before it is shuffled. Null ends are dropped; no edges give an empty
    result.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    live = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = materialize(
        live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("label", F.col("node")), "cc-labels"
    )
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        roots = _roots(materialize(least.select("node", F.least("node", "least").alias("parent")), "cc-parents"))
        of = lambda end: roots.select(F.col("node").alias(end), F.col("parent").alias(f"p_{end}"))
        moved = (
            live.join(of("a"), "a").join(of("b"), "b").select(
                F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b")
            )
        )
        old_live, old_labels = live, labels
        live = materialize(moved.where("a <> b").distinct(), "cc-edges")
        labels = materialize(
            labels.join(of("label"), "label", "left").select("node", F.coalesce("p_label", "label").alias("label")), "cc-labels"
        )
        for x in (old_live, old_labels, roots):
            discard(x)
    return labels
