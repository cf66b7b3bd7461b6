"""The similarity graph as an edge table (src, dst, w): per-row top-k, mutual minimum, degree normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaforge.functions.vectors import sim_kernel
from vistaforge.operators.knn import blocked_topk, routed_topk
from vistaforge.session import cut

ROUND = 9
EXACT_ROWS = 100_000


def kernel_edges(df: DataFrame, k: int = 100, id_col: str = "image_id", vec_col: str = "embedding", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Edges of weight max(dot^3, 0) to the ``k`` most similar rows of every row, itself included, zero weights dropped.

    Up to ``exact_rows`` rows all are compared with all in blocks (``knn.blocked_topk``), whose cost is quadratic; beyond, rows are compared with
    those of the cells they visit (``knn.routed_topk``), which misses few neighbours."""
    if df.limit(exact_rows + 1).count() > exact_rows:
        near = routed_topk(df, k, id_col, vec_col)
    else:
        q = df.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("embedding"))
        near = blocked_topk(df, q, k, "dot", id_col, vec_col)
    return near.select(F.col("query_id").alias("src"), F.col("image_id").alias("dst"), F.round(sim_kernel("value"), ROUND).alias("w")).filter("w > 0")


def top_k_edges(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest edges out of every node, ties to the least dst; not symmetrised."""
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return edges.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def mutual_min(edges: DataFrame) -> DataFrame:
    """Edges that exist in both directions, with the lesser weight (minimum with the transpose).

    Both directions of a pair get one key, so this is one aggregation and no self-join."""
    pair = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("w").alias("w"), F.countDistinct("src").alias("n"))
    both = pair.filter("n = 2 or a = b")
    flat = both.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).alias("e"), "w")
    return flat.select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"), "w")


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``: row sums without loops."""
    return edges.filter("src <> dst").groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"))


def normalize(edges: DataFrame) -> DataFrame:
    """D^-1/2 (W - diag W) D^-1/2; nodes of degree zero drop out instead of giving infinities."""
    d = degrees(edges)
    e = edges.filter("src <> dst")
    a, b = d.withColumnsRenamed({"node": "src", "degree": "ds"}), d.withColumnsRenamed({"node": "dst", "degree": "dd"})
    scaled = e.join(a, "src").join(b, "dst")
    return scaled.filter("ds > 0 and dd > 0").select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))


def normalized_graph(df: DataFrame, k: int = 100, id_col: str = "image_id", vec_col: str = "embedding", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """The whole graph from vectors. Mutual edges are written once, as degrees and scaling both read them."""
    return normalize(cut(mutual_min(kernel_edges(df, k, id_col, vec_col, exact_rows))))


def query_seed(df: DataFrame, queries: DataFrame, keep: int = 50, id_col: str = "image_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, image_id, q)``: kernel similarities of each query to its ``keep`` nearest rows; all others are zero."""
    near = blocked_topk(df, queries, keep, "dot", id_col, vec_col)
    return near.select("query_id", "image_id", F.round(sim_kernel("value"), ROUND).alias("q")).filter("q > 0")


def mat_vec(edges: DataFrame, f: DataFrame) -> DataFrame:
    """``(query_id, image_id, f)``: W f for sparse vectors ``(query_id, image_id, f)``; one join and one aggregation."""
    moved = edges.join(f.withColumnRenamed("image_id", "dst"), "dst")
    return moved.groupBy("query_id", F.col("src").alias("image_id")).agg(F.sum(F.col("w") * F.col("f")).alias("f"))


def k_hop_nodes(edges: DataFrame, seeds: DataFrame, levels: int) -> DataFrame:
    """``(query_id, image_id)`` within ``levels`` hops of the seeds ``(query_id, image_id)``."""
    reached = seeds.select("query_id", "image_id").distinct()
    for _ in range(levels):
        step = reached.join(edges.select(F.col("src").alias("image_id"), "dst"), "image_id").select("query_id", F.col("dst").alias("image_id"))
        reached = reached.union(step).distinct()
    return reached
