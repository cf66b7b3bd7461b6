"""Connected components over an edge table, without gathering edges anywhere.

The star contraction alternates two steps until no edge changes: every node sends its larger neighbours to
the least node it sees, then its smaller ones. Both steps are an aggregation with map-side combine and an
equi-join, so a hub that touches a third of all nodes is split by the skew join instead of filling one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaforge.session import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has an edge to another; root is the component's least node.

    NULL ends and loops are ignored, repeated edges count once, an empty table gives an empty result.
    Raises if the edges have not settled after ``max_rounds`` (rounds grow as the logarithm of the longest chain).
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
        e = cut(_small_star(_large_star(e)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def merge_local_labels(nodes: DataFrame, node: str, label: str) -> DataFrame:
    """Join groups that were found apart: ``(node, root)`` where labels that share a node have one root.

    ``nodes`` has a row for every (node, label) that some task gave; a node seen by one task alone costs no
    join, since components are only computed over the labels that a shared node ties together.
    """
    seen = cut(nodes.select(F.col(node).alias("node"), F.col(label).alias("label")).filter("node is not null and label is not null"))
    per_node = cut(seen.groupBy("node").agg(F.min("label").alias("label"), F.max("label").alias("top")))
    tied = per_node.filter("top <> label")
    if tied.isEmpty():
        return per_node.select("node", F.col("label").alias("root"))
    ties = seen.join(tied.select("node", F.col("label").alias("least")), "node").filter("label <> least").select(F.col("label").alias("a"), F.col("least").alias("b"))
    roots = connected_components(ties).select(F.col("node").alias("label"), "root")
    return per_node.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("root"))
