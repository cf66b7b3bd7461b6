"""Nearest vectors: exact shortlists of one query or many, and the similarity self-join, exact or routed over cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaforge.functions.vectors import l2_distance, shortlist_score
from vistaforge.operators.cells import Routes, bounded_sample, prepared, unit_rows
from vistaforge.session import written

QUERY_BLOCK = 4_096
#: Scores held at once, and pairs of vectors gathered at once, by a task of ``routed_topk``.
SCORES, EXACT = 10_000_000, 50_000


def l2_shortlist(df: DataFrame, query: list[float], k: int, id_col: str = "image_id", vec_col: str = "embedding") -> DataFrame:
    """``(image_id, dist, score)``: the ``k`` rows nearest to one query vector, in order of (rounded distance, id).

    The query is a literal, so the plan is one scan, an expression and TakeOrderedAndProject: no join, no shuffle. NULL
    vectors are left out; k beyond the table gives the whole table.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    near = df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("image_id"), F.round(l2_distance(vec_col, q), 6).alias("dist"))
    return near.orderBy("dist", "image_id").limit(k).select("image_id", "dist", F.round(shortlist_score("dist"), 6).alias("score"))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def top_pairs(qid: np.ndarray, q: np.ndarray, did: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` greatest scores, rounded to six digits, of every row of ``score`` (queries x rows), ties to the least id."""
    k, score = min(k, score.shape[1]), np.round(score, 6)
    if score.shape[1] <= 4 * k:
        order = np.lexsort((np.broadcast_to(did, score.shape), -score), axis=1)[:, :k]
    else:
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        order = np.empty((len(score), k), np.int64)
        for i, row in enumerate(score):
            at = np.flatnonzero(row >= kth[i])
            order[i] = at[np.lexsort((did[at], -row[at]))[:k]]
    return pd.DataFrame({"query_id": np.repeat(qid, k), "image_id": did[order].ravel(), "value": np.take_along_axis(score, order, 1).ravel()})


def blocked_topk(df: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "image_id", vec_col: str = "embedding", keep_self: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, image_id, value, rank)``: exact top ``k`` rows of ``df`` for each query vector.

    ``queries``: ``(query_id, embedding)``. They go over the rows in blocks of bounded size: a block is broadcast, each
    partition multiplies it with its rows batch by batch and keeps ``k`` per query, so the shuffle carries k rows per query
    and partition. value is the distance (``l2``, least first) or the dot product (``dot``, greatest first).
    """
    if metric not in ("l2", "dot"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter("vec is not null and size(vec) > 0")
    asked = queries.select(F.col("query_id").cast("long").alias("qid"), F.col("embedding").alias("vec")).filter("vec is not null and size(vec) > 0")
    blocks = max(1, math.ceil(asked.count() / block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    schema = "query_id long, image_id long, value double"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        part = asked.filter(F.col("block") == b).orderBy("qid").toPandas()
        if not len(part):
            continue
        sent = spark.sparkContext.broadcast((part["qid"].to_numpy(), matrix(part["vec"])))

        def search(batches, sent=sent):
            qid, q = sent.value
            best = None
            for pdf in batches:
                if not len(pdf):
                    continue
                x, ids = matrix(pdf["vec"]), pdf["id"].to_numpy()
                score = q @ x.T if metric == "dot" else -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T), 0))
                if not keep_self:
                    score = np.where(ids[None] == qid[:, None], -np.inf, score)
                got = top_pairs(qid, q, ids, score, k)
                best = got if best is None else pd.concat([best, got])
                best = best.sort_values(["query_id", "value", "image_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
            if best is not None:
                best = best[np.isfinite(best["value"])]
                yield best.assign(value=-best["value"]) if metric == "l2" else best

        out = out.unionByName(rows.mapInPandas(search, schema))
    value = F.round("value", 6)
    w = Window.partitionBy("query_id").orderBy(value.asc() if metric == "l2" else value.desc(), "image_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "image_id", value.alias("value"), "rank")


def stored_rows(file: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, float32 matrix) of a Parquet file ``(id, v)`` in the shared folder."""
    place, path = fs.FileSystem.from_uri(file)
    with place.open_input_file(path) as f:
        rows = pq.ParquetFile(f).read(columns=["id", "v"])
    ids, v = rows["id"].to_numpy(), rows["v"].combine_chunks()
    ends = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
    return ids, np.frombuffer(v.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(len(v), -1)


def leading(row: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, value, rank) of the ``k`` greatest values of every row, ties to the least id, in order."""
    order = np.lexsort((ids, -value, row))
    row, ids, value = row[order], ids[order], value[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row))) + 1
    kept = rank <= k
    return row[kept], ids[kept], value[kept], rank[kept]


def products(q: np.ndarray, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, value): for every query all rows of ``x`` whose product with it, rounded to six digits, is among the ``k`` greatest and not
    under its ``floor``, and some others. Products in single precision leave out what is certainly not, the others are computed exactly."""
    n, groups, out = len(x), 4 * k, []
    size, longest = np.sqrt(np.einsum("ij,ij->i", q, q)), math.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64).max())
    a, b = (q / size[:, None]).astype(np.float32), (x / longest).astype(np.float32)
    error, step = 2.5e-7 * x.shape[1] + 1e-6 / (size * longest), max(1, SCORES // n)
    for i in range(0, len(q), step):
        score, low = a[i : i + step] @ b.T, floor[i : i + step] / (size[i : i + step] * longest)
        if n >= groups:
            # the k-th of the greatest of each group is no greater than the k-th of all
            tops = score[:, : n // groups * groups].reshape(len(score), -1, groups).max(axis=1)
            low = np.maximum(low, np.partition(tops, groups - k, axis=1)[:, groups - k])
        row, col = np.divmod(np.flatnonzero(score >= (low - error[i : i + step]).astype(np.float32)[:, None]), n)
        if len(row) > score.size // 16:
            at = np.arange(len(score))
            all_of = top_pairs(at, q[i : i + step], ids, q[i : i + step] @ x.T.astype(np.float64), k)
            found = tuple(all_of[c].to_numpy() for c in ("query_id", "image_id", "value"))
        else:
            parts = [np.einsum("ij,ij->i", q[i + row[j : j + EXACT]], x[col[j : j + EXACT]].astype(np.float64)) for j in range(0, len(row), EXACT)]
            found = row, ids[col], np.round(np.concatenate(parts), 6) if parts else np.empty(0)
            if len(row) > groups * len(score):
                found = leading(*found, k)[:3]
        out.append((found[0] + i, *found[1:]))
    return tuple(np.concatenate(c) for c in zip(*out))


def routed_topk(df: DataFrame, k: int, id_col: str = "image_id", vec_col: str = "embedding", task_rows: int = 20_000) -> DataFrame:
    """``(query_id, image_id, value, rank)``: the ``k`` rows of greatest dot product for every row, itself included, among those of the cells
    that it visits (``cells.Routes``; some neighbours of rows that are like few others are missed). Rows are shuffled once, into a file for
    every part of a cell in the shared folder. A task has up to ``QUERY_BLOCK`` rows of a file as queries, or several small files, and reads the files that they visit, one
    after the other, so neither queries nor what they find are shuffled. Values are exact. Unusable vectors are left out.
    """
    spark, rows, schema = df.sparkSession, prepared(df, id_col, vec_col), "query_id long, image_id long, value double, rank int"
    total = df.count()
    sample = bounded_sample(rows, total)
    if not len(sample):
        return spark.createDataFrame([], schema)
    routes, dim = Routes(sample, total, task_rows, k), sample.shape[1]

    def place(batches):
        for pdf in batches:
            at, v = unit_rows(pdf["vec"], dim)
            if len(at):
                ids, home = pdf["id"].to_numpy()[at], routes.homes(v)
                yield pd.DataFrame({"cell": home, "part": routes.part_of(ids, home), "id": ids, "v": [np.asarray(pdf["vec"].iloc[i], np.float32).tobytes() for i in at]})

    index = written(rows.mapInPandas(place, "cell int, part int, id long, v binary"), "cell", "part")
    files: dict[tuple[int, int], list[str]] = {}
    tasks, room, least = [], 0, min(QUERY_BLOCK, total // (4 * spark.sparkContext.defaultParallelism))
    for r in index.select("cell", "part", F.col("_metadata.file_path").alias("file")).groupBy("cell", "part", "file").count().orderBy("cell", "part", "file").collect():
        files.setdefault((r["cell"], r["part"]), []).append(r["file"])
        for i in range(0, r["count"], QUERY_BLOCK):
            if room <= 0:
                tasks.append([])
                room = least
            tasks[-1].append((r["file"], r["cell"], i))
            room -= min(QUERY_BLOCK, r["count"] - i)
    sent = spark.sparkContext.broadcast((routes, files, tasks))

    def search(batches):
        routes, files, tasks = sent.value
        for pdf in batches:
            for file, home, start in (block for i in pdf["id"] for block in tasks[i]):
                qid, v = (x[start : start + QUERY_BLOCK] for x in stored_rows(file))
                q = v.astype(np.float64)
                yield found_by(qid, q, home, *routes.visited((q / np.sqrt((q * q).sum(axis=1))[:, None]).astype(np.float32)), files)

    def found_by(qid, q, home, query, cell, part, files):
        best, floor = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), np.full(len(q), -np.inf)
        waiting, many = [], 0
        order = np.lexsort((part, cell, cell != home))
        query, cell, part = query[order], cell[order], part[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(part) != 0)]) if len(cell) else []
        groups = [(query[i:j], files.get((int(cell[i]), int(part[i])), [])) for i, j in zip(starts, [*starts[1:], len(cell)])]
        for at, some in groups:
            for file in some:
                got = products(q[at], *stored_rows(file), floor[at], k)
                waiting.append((at[got[0]], *got[1:]))
                many += len(got[0])
                if many > len(best[0]):
                    best = leading(*(np.concatenate(c) for c in zip(best[:3], *waiting)), k)
                    floor[best[0][best[3] == k]] = best[2][best[3] == k]
                    waiting, many = [], 0
        row, ids, value, rank = leading(*(np.concatenate(c) for c in zip(best[:3], *waiting)), k)
        return pd.DataFrame({"query_id": qid[row], "image_id": ids, "value": value, "rank": rank.astype(np.int32)})

    met = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInPandas(search, schema)
    if not index.groupBy("id").count().filter("count > 1").limit(1).count():
        return met
    w = Window.partitionBy("query_id").orderBy(F.desc("value"), "image_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def random_shortlist(df: DataFrame, k: int, seed: int = 0, id_col: str = "image_id") -> DataFrame:
    """``(image_id, score, rank)``: ``k`` different ids in a seeded random order, from rank 0 on, with seeded uniform scores; fewer if there are fewer."""
    u = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("image_id")), F.lit(1 << 31)) / float(1 << 31)
    ids = df.select(F.col(id_col).alias("image_id")).filter("image_id is not null").distinct()
    some = ids.withColumn("_u", u(1)).orderBy("_u", "image_id").limit(k)
    return some.select("image_id", u(2).alias("score"), (F.row_number().over(Window.orderBy("_u", "image_id")) - 1).cast("long").alias("rank"))
