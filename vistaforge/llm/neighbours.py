"""The k most similar vectors by additive quantisation and exact reranking.

Encoding: every vector is its cell's centre and a sum of one entry from each of ``BOOKS`` full-dimensional codebooks, trained level by level on the
residuals of a bounded sample; codes are found by beam search. Kept per row are its codes, the norm of the decoded sum and the vector.

Routing: rows go to the cell of the centre they are most similar to, once. A query visits the cells in the order of its similarity to their
centres, as many as neighbours within the sample lie in (``cells.Routes``): few inside a dense region, up to all where nothing is near.
Large cells get more centres; what is still large is spread by id, and its queries go to every part.

Scoring: for a query the products with all codebook entries form lookup tables (two codebooks share one table), so
the cosine with a decoded row is a sum of table entries over the stored norm. The best rows of each cell by that score are
reranked by the exact cosine in the same task, which holds their vectors: the shuffle carries every row once, the queries, and k rows
per query and cell visited. Every row is encoded; the plan is the same for any number of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaforge.llm.vectors import ID, VEC, bounded_sample, one_per_id, prepared, unit_rows
from vistaforge.operators.cells import Routes
from vistaforge.session import written

BOOKS, WORDS, BEAM = 16, 64, 4
RERANK, RERANK_SHARE = 256, 0.25
TASK_ROWS = 50_000
SCORES = 4_000_000


def train_codebooks(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """(books, words, dim): residual k-means, each level fitted to what the levels before leave over."""
    rng, rest, out = np.random.default_rng(seed), sample.astype(np.float32).copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            to = (rest @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            size = np.bincount(to, minlength=words)
            order = np.argsort(to, kind="stable")
            filled = np.flatnonzero(size)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])[filled]
            c[filled] = np.add.reduceat(rest[order], starts, axis=0) / size[filled, None]
            empty = np.flatnonzero(size == 0)
            c[empty] = rest[rng.integers(0, len(rest), len(empty))]
        to = (rest @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        rest -= c[to]
        out.append(c)
    return np.stack(out)


def encode(v: np.ndarray, books: np.ndarray, beam: int = BEAM, chunk: int = 1_024, centre: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(codes of v - centre, norm of centre and decoded sum) by beam search: word w turns a partial code with residual r and error e
    into one with error e - 2 r.w + |w|^2; the ``beam`` partial codes of least error go on."""
    m, words, dim = books.shape
    size = (books * books).sum(axis=2)
    all_codes, norms = np.empty((len(v), m), np.uint8), np.empty(len(v), np.float32)
    for at in range(0, len(v), chunk):
        x = v[at : at + chunk] - (centre[at : at + chunk] if isinstance(centre, np.ndarray) else centre)
        n = len(x)
        rest, err, codes = x[:, None, :], np.zeros((n, 1), np.float32), np.empty((n, 1, 0), np.uint8)
        for k in range(m):
            width = rest.shape[1]
            grown = (err[:, :, None] + size[k] - 2 * (rest.reshape(-1, dim) @ books[k].T).reshape(n, width, words)).reshape(n, -1)
            keep = min(beam, grown.shape[1]) if k < m - 1 else 1
            best = np.argpartition(grown, keep - 1, axis=1)[:, :keep] if keep > 1 else grown.argmin(axis=1)[:, None]
            row, parent, word = np.arange(n)[:, None], best // words, best % words
            err = grown[row, best]
            codes = np.concatenate([codes[row, parent], word[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[row, parent] - books[k][word]
        all_codes[at : at + n] = codes[:, 0]
        norms[at : at + n] = np.linalg.norm(v[at : at + n] - rest[:, 0], axis=1)
    return all_codes, norms


def table_scores(q: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """(queries, rows): cosine with the decoded rows, from tables over pairs of codebooks."""
    m, words, _ = books.shape
    out = np.zeros((len(q), len(codes)), np.float32)
    for k in range(0, m, 2):
        one = q @ books[k].T
        if k + 1 < m:
            two = q @ books[k + 1].T
            table = (one[:, :, None] + two[:, None, :]).reshape(len(q), -1)
            at = codes[:, k].astype(np.int64) * words + codes[:, k + 1]
        else:
            table, at = one, codes[:, k].astype(np.int64)
        out += np.take(table, at, axis=1)
    return out / np.maximum(norms, 1e-9)


def _search_cell(qid, q, ids, v, codes, norms, books, centre, k, rerank):
    found, r = [], min(len(v), max(rerank, math.ceil(RERANK_SHARE * len(v))))
    step = int(np.clip(SCORES // (len(v) + r * v.shape[1]), 1, 128))
    for at in range(0, len(q), step):
        some, own = q[at : at + step], qid[at : at + step]
        approx = (table_scores(some, books, codes, np.ones_like(norms)) + (some @ centre)[:, None]) / np.maximum(norms, 1e-9)
        top = np.argpartition(-approx, r - 1, axis=1)[:, :r] if r < approx.shape[1] else np.broadcast_to(np.arange(r), (len(some), r))
        exact = np.einsum("qrd,qd->qr", v[top], some)
        exact[ids[top] == own[:, None]] = -np.inf
        take = min(k, r)
        order = np.argsort(-exact, axis=1, kind="stable")[:, :take]
        found.append(pd.DataFrame({"query_id": np.repeat(own, take), "id": ids[np.take_along_axis(top, order, 1)].ravel(), "sim": np.take_along_axis(exact, order, 1).ravel().astype(np.float64)}))
    out = pd.concat(found)
    return out[np.isfinite(out["sim"])]


def nearest(df: DataFrame, queries: DataFrame, k: int, id_col: str = ID, vec_col: str = VEC, rerank: int = RERANK, task_rows: int = TASK_ROWS) -> DataFrame:
    """``(query_id, rank, image_id, sim)``: for each id of ``queries`` the k other ids most similar to it.

    ``queries`` has a column ``query_id`` of ids of ``df``; NULL, unknown and unusable ones give no rows, repeated ones
    count once. A repeated id is one record; of equal similarities any may come out, ordered by id. Fewer than k others in the cells
    visited give fewer rows; empty tables give none. ``rerank`` rows per query and cell, or ``RERANK_SHARE`` of the
    cell where that is more, are compared exactly (measured recall is in the README).
    """
    spark = df.sparkSession
    rows = one_per_id(prepared(df, id_col, vec_col))
    wanted = written(queries.select(F.col("query_id").cast("long").alias("id")).filter("id is not null").distinct())
    total = df.count()
    sample = bounded_sample(prepared(df, id_col, vec_col), total)
    schema = "query_id long, id long, sim double"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, image_id long, sim double")
    dim, routes = sample.shape[1], Routes(sample, total, task_rows, k)
    middles = np.concatenate([np.zeros((1, dim), np.float32), routes.centres])
    books = train_codebooks(sample - middles[routes.homes(sample)])

    def encoded(batches):
        for pdf in batches:
            at, v = unit_rows(pdf["vec"], dim)
            if len(at):
                ids, cell = pdf["id"].to_numpy()[at], routes.homes(v)
                codes, norms = encode(v, books, centre=middles[cell])
                yield pd.DataFrame({"cell": cell, "part": routes.part_of(ids, cell), "id": ids, "codes": [x.tobytes() for x in codes], "norm": norms, "v": [x.tobytes() for x in v]})

    def asked(batches):
        for pdf in batches:
            at, v = unit_rows(pdf["vec"], dim)
            ids = pdf["id"].to_numpy()[at]
            for i in range(0, len(at), 1_024):
                some = v[i : i + 1_024]
                row, cell, part = routes.visited(some)
                yield pd.DataFrame({"cell": cell, "part": part, "id": ids[i + row], "v": [x.tobytes() for x in some[row]]})

    def search(key, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "sim": []}).astype({"query_id": np.int64, "id": np.int64})
        codes = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1)
        v, q = (np.frombuffer(b"".join(x["v"]), np.float32).reshape(len(x), -1) for x in (left, right))
        return _search_cell(right["id"].to_numpy(), q, left["id"].to_numpy(), v, codes, left["norm"].to_numpy(), books, middles[int(key[0])], k, rerank)

    index = rows.mapInPandas(encoded, "cell int, part int, id long, codes binary, norm float, v binary")
    visits = rows.join(wanted, "id", "left_semi").mapInPandas(asked, "cell int, part int, id long, v binary")
    found = index.groupBy("cell", "part").cogroup(visits.groupBy("cell", "part")).applyInPandas(search, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("image_id"), "sim")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """The pairs of a search, smaller id first, each once."""
    return found.select(F.least("query_id", "image_id").alias("image_id_a"), F.greatest("query_id", "image_id").alias("image_id_b")).distinct()
