"""Connected components of a link table, without driver-side graphs or a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitframe.llm.common import store


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parent pointers to their ends by doubling: log2 of the longest chain rounds."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = store(parents.join(above, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
        parents = jumped.select("node", "parent")
        if not jumped.where("moved").take(1):
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``a``, ``b``, longs); root is the same within a component.

    Each round points every node at its least neighbour, follows the pointers to their ends and contracts the
    graph to those ends. At least half of the nodes vanish each round; a star takes one. Loops and repeated
    edges are allowed; null ends are dropped; no edges give no rows.
    """
    edges = store(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while edges.take(1):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        roots = _roots(store(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent"))))
        left = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        edges = store(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("root"))
        else:
            step = roots.select(F.col("node").alias("root"), "parent")
            labels = store(labels.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
