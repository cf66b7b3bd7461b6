"""Density clustering of vectors over spatial partitions with overlapping margins.

Vectors are reduced to the leading principal directions of a bounded sample, and space is divided into cells around its dense regions,
and one for rows near none. A row also goes to every cell from which a row at the threshold to it may come: how far the margins reach
is set by pairs planted at the threshold, of which ``RECALL`` must share a cell. A cell of more than a task's work is divided further, again
with margins set by planted pairs, or, where most of it is one dense group, by spreading the group's rows (``cells.parts_of_cell``).

A row with a neighbour at ``threshold`` or more is a core row, so clusters are the chains of such pairs. Inside a task, dense regions are
found in linear time first: all rows at the threshold to a leader are in its cluster. Then blocks of rows that are still apart are compared
by exact cosine, all of them, so nothing is lost inside a task. Clusters of different tasks are merged through the core
rows that both hold. Representatives are medoids: for cosine, the member with the greatest sum of similarities to all is the
one with the greatest product with the cluster's vector sum, which partial sums give without comparing pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaforge.llm.vectors import ID, VEC, cell_limits, coarse_centres, copy_classes, local_roots, one_per_id, prepared, sampled, similar_cells, unit_rows, with_pivot
from vistaforge.operators.cells import outside, parts_of_cell
from vistaforge.operators.components import merge_local_labels
from vistaforge.session import written

THRESHOLD = 0.70
RECALL, ENERGY = 0.995, 0.9
TASK_ROWS = 60_000
BLOCK, ACROSS = 1_024, 8_192
LEAST_REGION, FAILURES = 16, 4
SUMS_HELD = 4_096


def principal_directions(sample: np.ndarray, energy: float = ENERGY) -> np.ndarray:
    """(dim, kept): as many leading principal directions of the sample as hold ``energy`` of it."""
    values, vectors = np.linalg.eigh(sample.T.astype(np.float64) @ sample)
    order = np.argsort(-values)
    kept = int(np.searchsorted(np.cumsum(values[order]) / max(values.sum(), 1e-12), energy)) + 1
    return vectors[:, order[:kept]].astype(np.float32)


def dense_regions(v: np.ndarray, threshold: float) -> np.ndarray:
    """Least position of each row's region: the rows at the threshold to a leader. Leaders are the rows nearest the middle of what is
    left, and single rows where that finds no region."""
    root, left, failed = np.arange(len(v)), np.arange(len(v)), 0
    rng = np.random.default_rng(len(v))
    while len(left) > LEAST_REGION and failed < FAILURES:
        lead = left[int((v[left] @ v[left].mean(axis=0)).argmax()) if not failed else rng.integers(len(left))]
        near = v[left] @ v[lead] >= threshold
        failed = 0 if near.sum() >= LEAST_REGION else failed + 1
        if not failed:
            root[left[near]] = left[near].min()
            left = left[~near]
    return root


def cluster_rows(v: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Least position of each row's cluster. Rows outside the largest region are compared with all rows that are apart from them."""
    n, root = len(v), dense_regions(v, threshold)
    size = np.bincount(root, minlength=n)[root]
    order = np.lexsort((root, size))
    v, rank = v[order], np.empty(n, np.int64)
    rank[order] = np.arange(n)
    root = rank[root][order]
    for at in range(0, n - int(size.max(initial=0)) if n else 0, BLOCK):
        for to in range(at, n, ACROSS):
            own, other = root[at : at + BLOCK], root[to : to + ACROSS]
            if (own == own[0]).all() and (other == own[0]).all():
                continue
            i, j = np.nonzero(v[at : at + BLOCK] @ v[to : to + ACROSS].T >= threshold)
            i, j = own[i], other[j]
            apart = i != j
            if apart.any():
                pair = np.unique(i[apart] * n + j[apart])
                root = local_roots(n, pair // n, pair % n)[root]
    least = np.full(n, n)
    np.minimum.at(least, root, order)
    return least[root][rank]


def cluster_labels(df: DataFrame, id_col: str = ID, vec_col: str = VEC, threshold: float = THRESHOLD, task_rows: int = TASK_ROWS) -> DataFrame:
    """``(image_id, cluster_id)`` for every id with a usable vector; cluster_id is the cluster's least id.

    An id like no other is alone in its cluster. Repeated ids are one record, exact copies share a cluster, unusable
    vectors and NULL ids have none, an empty table gives no rows. A task gets ``task_rows`` rows, fewer where many of them must be
    compared with each other.
    """
    rows = prepared(df, id_col, vec_col)
    total = df.count()
    sample_ids, sample = sampled(rows, total)
    if not len(sample):
        return df.sparkSession.createDataFrame([], "image_id long, cluster_id long")
    dim, centres, directions = sample.shape[1], coarse_centres(sample), principal_directions(sample)
    reduced = centres @ directions
    low, up = cell_limits(sample, centres, directions, threshold, RECALL)
    in_row, in_cell = similar_cells(sample @ directions @ reduced.T, low, up)
    points = np.concatenate([np.zeros((1, dim), np.float32), centres])
    parts = {}
    for c in np.unique(in_cell):
        own = in_row[in_cell == c]
        expected = len(own) * total / len(sample)
        work = expected * max(1.0, 4 * math.sqrt(outside(sample[own], threshold))) / task_rows
        if work > 1:
            parts[int(c)] = parts_of_cell(sample_ids[own], sample[own], points[c + 1], work, threshold, RECALL)

    def pack(batches):
        for pdf in batches:
            at, v = unit_rows(pdf["vec"], dim)
            if not len(at):
                continue
            ids = pdf["id"].to_numpy()[at]
            row, cell = similar_cells(v @ directions @ reduced.T, low, up)
            calm = ~np.isin(cell, list(parts))
            rows_out, cells_out, parts_out = [row[calm]], [cell[calm]], [np.zeros(calm.sum(), np.int64)]
            for c, way in parts.items():
                r = row[cell == c]
                i, p = way.of(v[r], ids[r], points[c + 1])
                rows_out.append(r[i]), cells_out.append(np.full(len(i), c)), parts_out.append(p)
            row = np.concatenate(rows_out)
            yield pd.DataFrame({"cell": np.concatenate(cells_out), "part": np.concatenate(parts_out), "id": ids[row], "v": [x.tobytes() for x in v[row]]})

    def join_cell(key, pdf):
        ids, v = with_pivot(parts.get(int(key[0])), pdf["id"].to_numpy(), np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(len(pdf), -1))
        root = cluster_rows(v, threshold)
        return pd.DataFrame({"id": ids, "label": pd.Series(ids).groupby(root).transform("min")})

    reps, copies = copy_classes(rows)
    packed = reps.mapInPandas(pack, "cell int, part int, id long, v binary")
    labels = packed.groupBy("cell", "part").applyInPandas(join_cell, "id long, label long")
    tied = labels.withColumnRenamed("id", "rep").join(copies, "rep").select("id", "label")
    roots = merge_local_labels(labels.unionByName(tied), "id", "label")
    named = roots.groupBy("root").agg(F.min("node").alias("cluster_id"))
    return roots.join(named, "root").select(F.col("node").alias("image_id"), "cluster_id")


def cluster_report(df: DataFrame, labels: DataFrame, typical: int = 3, id_col: str = ID, vec_col: str = VEC) -> DataFrame:
    """``(cluster_id, cluster_size, rank, image_id, centrality)``: size and the ``typical`` most typical members of
    each cluster; centrality is the member's mean similarity to the cluster, itself included; ties go to the least id.

    Rows alone in their cluster need no sums. Of the others, each task adds up the vectors of a cluster before anything is shuffled, and the
    products with the sums are built-in expressions on the rows themselves.
    """
    labels = written(labels.select(F.col("image_id").alias("id"), "cluster_id"))
    sizes = written(labels.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")).filter("cluster_size > 1"))
    alone = labels.join(sizes, "cluster_id", "left_anti").select("cluster_id", F.lit(1).cast("long").alias("cluster_size"), F.lit(1).alias("rank"), F.col("id").alias("image_id"), F.lit(1.0).alias("centrality"))
    members = one_per_id(prepared(df, id_col, vec_col)).join(labels.join(sizes, "cluster_id", "left_semi"), "id").select("cluster_id", "id", "vec")

    def sums(batches):
        names, total = [], np.empty((0, 0))
        for pdf in batches:
            at, v = unit_rows(pdf["vec"])
            if not len(at):
                continue
            names = np.concatenate([names, pdf["cluster_id"].to_numpy()[at]]) if len(names) else pdf["cluster_id"].to_numpy()[at]
            code, names = pd.factorize(names)
            order = np.argsort(code, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(code))[:-1]])
            total = np.add.reduceat((np.concatenate([total, v]) if total.size else v.astype(np.float64))[order], first, axis=0)
            if len(names) > SUMS_HELD:
                yield pd.DataFrame({"cluster_id": names, "total": list(total)})
                names, total = [], np.empty((0, 0))
        if len(names):
            yield pd.DataFrame({"cluster_id": names, "total": list(total)})

    def add(key, pdf):
        return pd.DataFrame({"cluster_id": [key[0]], "total": [np.stack(pdf["total"].to_list()).sum(axis=0)]})

    total = "cluster_id long, total array<double>"
    centre = written(members.mapInPandas(sums, total).groupBy("cluster_id").applyInPandas(add, total).join(sizes, "cluster_id"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    scored = members.join(centre, "cluster_id").select("cluster_id", "cluster_size", F.col("id").alias("image_id"), F.round(dot("vec", "total") / F.sqrt(dot("vec", "vec")) / F.col("cluster_size"), 6).alias("centrality"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("centrality"), "image_id")
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= typical)
    return best.select("cluster_id", "cluster_size", "rank", "image_id", "centrality").unionByName(alone)


def cluster_pairs(labels: DataFrame, probes: DataFrame) -> DataFrame:
    """Pairs of the ids in ``probes`` (column image_id) that share a cluster, smaller id first."""
    own = labels.join(probes.select("image_id").distinct(), "image_id")
    a, b = own.select(F.col("image_id").alias("image_id_a"), "cluster_id"), own.select(F.col("image_id").alias("image_id_b"), "cluster_id")
    return a.join(b, "cluster_id").filter("image_id_a < image_id_b").select("image_id_a", "image_id_b")
