"""Ranking by diffusion over the normalised graph: (I - alpha Wn) f = q.

``neumann`` and ``conjugate_residual`` iterate on tables, cutting lineage in the shared folder, and work at any size. ``minres`` and the
spectral solver work on one graph in one task and refuse more than ``MAX_TASK_EDGES`` edges. ``diffuse`` takes the Krylov solver that the size allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaforge.operators.graph import k_hop_nodes, mat_vec
from vistaforge.session import cut

ALPHA = 0.9
MAX_TASK_EDGES = 20_000_000
MAX_QUERIES = 4_096
TINY = 1e-24


def neumann(edges: DataFrame, seed: DataFrame, alpha: float = ALPHA, rounds: int = 20, cut_every: int = 4) -> DataFrame:
    """``(query_id, image_id, f)`` after a fixed number of rounds; rows that nothing reaches are absent (zero)."""
    e = cut(edges)
    base = cut(seed.select("query_id", "image_id", F.col("q").alias("f")))
    f = base
    for i in range(1, rounds + 1):
        spread = mat_vec(e, f).withColumn("f", F.col("f") * alpha)
        f = base.unionByName(spread).groupBy("query_id", "image_id").agg(F.sum("f").alias("f"))
        if i % cut_every == 0 and i < rounds:
            f = cut(f)
    return f


class Sparse:
    """A square sparse matrix as sorted coordinate arrays over the nodes that occur."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, nodes: np.ndarray | None = None) -> None:
        self.nodes = np.unique(np.concatenate([src, dst])) if nodes is None else nodes
        self.i, self.j = np.searchsorted(self.nodes, src), np.searchsorted(self.nodes, dst)
        order = np.argsort(self.i, kind="stable")
        self.i, self.j, self.w, self.n = self.i[order], self.j[order], w[order], len(self.nodes)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.i, weights=self.w * x[self.j], minlength=self.n)

    def dense(self) -> np.ndarray:
        a = np.zeros((self.n, self.n))
        a[self.i, self.j] = self.w
        return a


def minimum_residual(times, b: np.ndarray, steps: int) -> np.ndarray:
    """The vector of the Krylov space of ``steps`` dimensions with the least residual (Lanczos basis, least squares)."""
    beta = np.linalg.norm(b)
    if beta == 0:
        return np.zeros_like(b)
    basis, images = [b / beta], []
    for _ in range(steps):
        y = times(basis[-1])
        images.append(y)
        y = y.copy()
        for _ in range(2):
            for v in basis:
                y -= (v @ y) * v
        norm = np.linalg.norm(y)
        if norm < 1e-12:
            break
        basis.append(y / norm)
    m = np.stack(images, axis=1)
    c, *_ = np.linalg.lstsq(m, b, rcond=None)
    return np.stack(basis[: m.shape[1]], axis=1) @ c


def _in_one_task(edges: DataFrame, seed: DataFrame, solve) -> DataFrame:
    if edges.limit(MAX_TASK_EDGES + 1).count() > MAX_TASK_EDGES:
        raise ValueError(f"the graph has more than {MAX_TASK_EDGES} edges; use conjugate_residual or neumann")
    e = edges.select(F.lit(0).alias("g"), "src", "dst", "w")
    s = seed.select(F.lit(0).alias("h"), "query_id", "image_id", "q")

    def run(graph, wanted):
        a = Sparse(graph["src"].to_numpy(), graph["dst"].to_numpy(), graph["w"].to_numpy(), np.unique(np.concatenate([graph["src"], graph["dst"], wanted["image_id"]])))
        queries = []
        for qid, own in wanted.groupby("query_id"):
            b = np.zeros(a.n)
            b[np.searchsorted(a.nodes, own["image_id"])] = own["q"]
            queries.append((qid, b))
        rows = [pd.DataFrame({"query_id": qid, "image_id": a.nodes, "f": f}) for qid, f in solve(a, queries)]
        return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "image_id": [], "f": []})

    return e.groupBy("g").cogroup(s.groupBy("h")).applyInPandas(run, "query_id long, image_id long, f double")


def minres(edges: DataFrame, seed: DataFrame, alpha: float = ALPHA, steps: int = 10) -> DataFrame:
    """``(query_id, image_id, f)`` by ``steps`` minimum-residual steps; for graphs that fit one task."""
    return _in_one_task(edges, seed, lambda a, qs: [(k, minimum_residual(lambda x: x - alpha * (a @ x), b, steps)) for k, b in qs])


def conjugate_residual(edges: DataFrame, seed: DataFrame, alpha: float = ALPHA, steps: int = 10) -> DataFrame:
    """``(query_id, image_id, f)``: the iterates of ``minres`` by two-term recurrences on tables.

    A step is one product with the graph, two aggregations to a scalar per query, and joins of these few scalars; the residual of I - alpha Wn,
    which is symmetric and positive, is least over the same spaces. Rows that nothing reaches are absent (zero).
    """
    e = cut(edges)
    apply = lambda f: f.unionByName(graph_times(e, f, -alpha)).groupBy("query_id", "image_id").agg(F.sum("f").alias("f"))
    r = cut(seed.select("query_id", "image_id", F.col("q").alias("f")))
    ar = apply(r)
    s = r.withColumnRenamed("f", "r").join(ar.withColumnRenamed("f", "ar"), ["query_id", "image_id"], "full").fillna(0.0)
    s = cut(s.select("query_id", "image_id", F.lit(0.0).alias("x"), "r", "ar", F.col("r").alias("p"), F.col("ar").alias("ap")))
    for i in range(1, steps + 1):
        dots = s.groupBy("query_id").agg(F.sum(F.col("r") * F.col("ar")).alias("rar"), F.sum(F.col("ap") * F.col("ap")).alias("apap"))
        s = s.join(dots, "query_id").withColumn("a", F.when((F.col("apap") > TINY) & (F.col("rar") > TINY), F.col("rar") / F.col("apap")).otherwise(F.lit(0.0)))
        s = s.select("query_id", "image_id", "rar", (F.col("x") + F.col("a") * F.col("p")).alias("x"), (F.col("r") - F.col("a") * F.col("ap")).alias("r"), "p", "ap")
        if i == steps:
            break
        ar = apply(s.select("query_id", "image_id", F.col("r").alias("f"))).withColumnRenamed("f", "ar")
        s = s.join(ar, ["query_id", "image_id"], "full").fillna(0.0, ["x", "r", "p", "ap", "ar"])
        new = s.groupBy("query_id").agg(F.sum(F.col("r") * F.col("ar")).alias("new"), F.max("rar").alias("old"))
        s = s.drop("rar").join(new, "query_id").withColumn("b", F.when(F.col("old") > TINY, F.col("new") / F.col("old")).otherwise(F.lit(0.0)))
        s = cut(s.select("query_id", "image_id", "x", "r", "ar", (F.col("r") + F.col("b") * F.col("p")).alias("p"), (F.col("ar") + F.col("b") * F.col("ap")).alias("ap")))
    return s.select("query_id", "image_id", F.col("x").alias("f"))


def graph_times(edges: DataFrame, f: DataFrame, by: float) -> DataFrame:
    return mat_vec(edges, f).withColumn("f", F.col("f") * by)


def diffuse(edges: DataFrame, seed: DataFrame, alpha: float = ALPHA, steps: int = 10, task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """``minres`` where the graph fits one task, else the same iterates on tables."""
    small = edges.limit(task_edges + 1).count() <= task_edges
    return minres(edges, seed, alpha, steps) if small else conjugate_residual(edges, seed, alpha, steps)


def spectral(edges: DataFrame, seed: DataFrame, alpha: float = 0.99, rank: int = 2_000) -> DataFrame:
    """``(query_id, image_id, f)`` by the filter (1 - alpha) / (1 - alpha lambda) on the ``rank`` eigenpairs of largest
    magnitude; for graphs that fit one task."""

    def solve(a: Sparse, queries):
        if a.n > 8_000:
            raise ValueError("more than 8,000 nodes are too many for a dense eigensolver")
        values, vectors = np.linalg.eigh(a.dense())
        top = np.argsort(-np.abs(values))[:rank]
        u, g = vectors[:, top], (1 - alpha) / (1 - alpha * values[top])
        return [(k, u @ (g * (u.T @ b))) for k, b in queries]

    return _in_one_task(edges, seed, solve)


def truncated(edges: DataFrame, seed: DataFrame, alpha: float = 0.99, levels: int = 2, steps: int = 8) -> DataFrame:
    """``(query_id, image_id, f)`` on the subgraph within ``levels`` hops of each query's seed; others are absent.

    Hops are counted over the edges given; queries are solved in one task each, by the size of their subgraph."""
    near = cut(k_hop_nodes(edges, seed, levels))
    a = near.withColumnRenamed("image_id", "src")
    b = near.withColumnRenamed("image_id", "dst")
    sub = edges.join(a, "src").join(b, ["query_id", "dst"])

    def run(key, graph, wanted):
        if not len(graph):
            return wanted.rename(columns={"qid": "query_id", "q": "f"})[["query_id", "image_id", "f"]]
        m = Sparse(graph["src"].to_numpy(), graph["dst"].to_numpy(), graph["w"].to_numpy(), np.unique(np.concatenate([graph["src"], graph["dst"], wanted["image_id"]])))
        q = np.zeros(m.n)
        q[np.searchsorted(m.nodes, wanted["image_id"])] = wanted["q"]
        return pd.DataFrame({"query_id": key[0], "image_id": m.nodes, "f": minimum_residual(lambda x: x - alpha * (m @ x), q, steps)})

    s = seed.select(F.col("query_id").alias("qid"), "image_id", "q")
    return sub.groupBy("query_id").cogroup(s.groupBy("qid")).applyInPandas(run, "query_id long, image_id long, f double")


def full_ranking(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(query_id, image_id, f, reached)``: ranked rows first; every node of ``nodes`` that a query does not reach is appended.

    The queries are a stated set of at most ``MAX_QUERIES``, so each node is repeated for them without a join."""
    ids = [r[0] for r in scores.select("query_id").distinct().limit(MAX_QUERIES + 1).collect()]
    if len(ids) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; rank fewer at a time")
    pairs = nodes.select("image_id", F.explode(F.array(*[F.lit(i).cast("long") for i in ids]) if ids else F.array().cast("array<long>")).alias("query_id"))
    rest = pairs.join(scores, ["query_id", "image_id"], "left_anti").select("query_id", "image_id", F.lit(0.0).alias("f"), F.lit(False).alias("reached"))
    return scores.select("query_id", "image_id", "f", F.lit(True).alias("reached")).unionByName(rest)
