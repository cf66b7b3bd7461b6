"""Matching of local features of a query image against those of database images.

Features are long tables ``(image_id, kp_idx, desc)``. A match is decided per (query, image) pair from all distances between
the two sets. The features of an image are one group, whose size is bounded by the keypoint cap of the extractor; the queries that ask for it
are gone through inside the group, so features are not repeated for them. Query features are sent to the tasks (checked against ``MAX_QUERY_ROWS``), so only database features
are shuffled, once, by image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaforge.operators.knn import matrix

MAX_QUERY_ROWS = 65_536
OUT = "query_id long, image_id long, q_idx long, db_idx long, value double"


def _squared(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (d * d).sum(1)[None] - 2 * (q @ d.T), 0)


def _ratio_rows(dist: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose nearest column is at most ``threshold`` times as far as the second: (rows, columns, ratios)."""
    if dist.shape[1] < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    first = dist.argmin(axis=1)
    two = np.partition(dist, 1, axis=1)[:, :2]
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = np.where(two[:, 1] > 0, two[:, 0] / two[:, 1], np.inf)
    rows = np.flatnonzero(ratio <= threshold)
    return rows, first[rows], ratio[rows]


def snn(q, d, threshold=0.95):
    """Ratio test from the query's side, on distances."""
    return _ratio_rows(np.sqrt(_squared(q, d)), threshold)


def smnn(q, d, threshold=0.99):
    """Ratio test from both sides; pairs that both give; the value is the greater ratio."""
    dist = np.sqrt(_squared(q, d))
    i, j, r = _ratio_rows(dist, threshold)
    b, a, s = _ratio_rows(dist.T, threshold)
    _, x, y = np.intersect1d(i * len(d) + j, a * len(d) + b, return_indices=True)
    return i[x], j[x], np.maximum(r[x], s[y])


def ratio_from_database(q, d, threshold=0.95):
    """Ratio test from the database's side, on distances, by exact search; pairs come out as (query, database)."""
    j, i, r = _ratio_rows(np.sqrt(_squared(q, d)).T, threshold)
    return i, j, r


def ratio_from_database_squared(q, d, threshold=0.95):
    """As ``ratio_from_database`` on squared distances with 1e-8 added below the line."""
    if len(q) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    sq = _squared(q, d).T
    two = np.partition(sq, 1, axis=1)[:, :2]
    ratio = two[:, 0] / (1e-8 + two[:, 1])
    j = np.flatnonzero(ratio <= threshold)
    return sq.argmin(axis=1)[j], j, ratio[j]


def mutual_cosine(q, d, threshold=0.82):
    """Mutual nearest by dot product; above ``threshold`` strictly, unless that is 0 or less."""
    s = q @ d.T
    to, back = s.argmax(axis=1), s.argmax(axis=0)
    i = np.flatnonzero(back[to] == np.arange(len(q)))
    best = s[i, to[i]]
    keep = best > threshold if threshold > 0 else np.ones(len(i), bool)
    return i[keep], to[i][keep], best[keep]


def dual_softmax(q, d, beta=20.0, least=0.01):
    """Mutual best by e^2 / (row sum x column sum) with e = exp(beta (dot - 1)), above ``least``."""
    e = np.exp(beta * (q @ d.T - 1))
    p = e * e / e.sum(axis=1, keepdims=True) / e.sum(axis=0, keepdims=True)
    to, back = p.argmax(axis=1), p.argmax(axis=0)
    i = np.flatnonzero(back[to] == np.arange(len(q)))
    best = p[i, to[i]]
    return i[best > least], to[i][best > least], best[best > least]


def locally_affine(q, d, qxy, dxy, ratio=0.95, area=1 / 100, spread=4.0, fits=128, error=1.0, least=5, seed=0):
    """Spatially adaptive matching (Cavalli, Larsson, Oswald, Sattler and Pollefeys 2020): a match is kept if the matches around it move alike.

    Nearest neighbours are tentative matches, those whose ratio is best within a radius (the image's area over pi times ``1 / area`` discs) are
    seeds, and a seed's neighbourhood are the tentative matches within ``spread`` radii of it on both sides. In it affine maps through
    two matches and the seed are tried; the one with most matches within ``error`` of a tenth of the radius is fitted again to those, and a seed
    that keeps ``least`` gives all of them. The value is the match's ratio.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    rows, cols, value = _ratio_rows(np.sqrt(_squared(q, d)), np.inf)
    if len(rows) < least:
        return none
    a, b = qxy[rows].astype(float), dxy[cols].astype(float)
    reach = [np.sqrt(max(float(np.prod(np.ptp(x, axis=0))), 1e-9) * area / np.pi) for x in (a, b)]
    apart = [np.sqrt(_squared(x, x)) for x in (a, b)]
    better = (value[None] < value[:, None]) | ((value[None] == value[:, None]) & (np.arange(len(rows))[None] < np.arange(len(rows))[:, None]))
    seeds = np.flatnonzero((value <= ratio) & ~((apart[0] < reach[0]) & better).any(axis=1))
    kept, rng = np.zeros(len(rows), bool), np.random.default_rng(seed)
    for s in seeds:
        near = np.flatnonzero((apart[0][s] <= spread * reach[0]) & (apart[1][s] <= spread * reach[1]))
        if len(near) < least:
            continue
        x, y = a[near] - a[s], b[near] - b[s]
        two = rng.integers(0, len(near), (fits, 2))
        base, image = x[two], y[two]
        good = np.abs(np.linalg.det(base)) > 1e-9
        if not good.any():
            continue
        maps = np.linalg.solve(base[good], image[good])
        close = error * 0.1 * spread * reach[1]
        hits = np.linalg.norm(x[None] @ maps - y[None], axis=2) <= close
        inside = hits[hits.sum(axis=1).argmax()]
        for _ in range(2):
            if inside.sum() < least:
                break
            one = np.column_stack([x, np.ones(len(x))])
            fit, *_ = np.linalg.lstsq(one[inside], y[inside], rcond=None)
            inside = np.linalg.norm(one @ fit - y, axis=1) <= close
        if inside.sum() >= least:
            kept[near[inside]] = True
    return rows[kept], cols[kept], value[kept]


METHODS = {
    "snn": snn,
    "smnn": smnn,
    "flann": ratio_from_database,
    "faiss_cpu": ratio_from_database_squared,
    "faiss_gpu": ratio_from_database_squared,
    "mnn": mutual_cosine,
    "dual_softmax": dual_softmax,
    "adalam": locally_affine,
}


#: Methods that also get the places of the features: ``fn(q, d, qxy, dxy, **options)``.
SPATIAL = {"adalam"}


def register_matcher(name: str, fn, spatial: bool = False) -> None:
    """Slot for matchers that need a model or geometry: ``fn(q, d, **options) -> (q rows, d rows, values)``, with the places of both
    sides after the descriptors if ``spatial``."""
    METHODS[name] = fn
    (SPATIAL.add if spatial else SPATIAL.discard)(name)


def match_features(query: DataFrame, database: DataFrame, method: str = "smnn", shortlist: DataFrame | None = None, **options) -> DataFrame:
    """``(query_id, image_id, q_idx, db_idx, value)``: matches of each query with each image (of its ``shortlist``, if given).

    ``query``: ``(query_id, kp_idx, desc)``; ``database``: ``(image_id, kp_idx, desc)``; ``shortlist``: ``(query_id, image_id)``. NULL
    descriptors are left out; sets of fewer than two features have no ratio and no match; ties go to the least kp_idx.
    """
    if method not in METHODS:
        raise NotImplementedError(f"unknown matching method {method!r}; known: {sorted(METHODS)}")
    fn, spatial = METHODS[method], method in SPATIAL
    cols = ["kp_idx", "desc", *(["x", "y"] if spatial else [])]
    q = query.select("query_id", *cols).filter("desc is not null").limit(MAX_QUERY_ROWS + 1).toPandas()
    if len(q) > MAX_QUERY_ROWS:
        raise ValueError(f"more than {MAX_QUERY_ROWS} query features; match fewer queries at a time")
    places = lambda g: (g[["x", "y"]].to_numpy(float),) if spatial else ()
    sets = {int(k): (g["kp_idx"].to_numpy(), matrix(g["desc"]), places(g)) for k, g in q.sort_values(["query_id", "kp_idx"]).groupby("query_id")}
    sent = database.sparkSession.sparkContext.broadcast(sets)
    features = database.select("image_id", *cols).filter("desc is not null")
    if shortlist is None:
        features = features.withColumn("asked", F.lit(None).cast("array<long>"))
    else:
        features = features.join(shortlist.groupBy("image_id").agg(F.collect_set(F.col("query_id").cast("long")).alias("asked")), "image_id")

    def run(key, pdf):
        pdf, out = pdf.sort_values("kp_idx"), []
        idx, m, at = pdf["kp_idx"].to_numpy(), matrix(pdf["desc"]), places(pdf)
        for qid in sent.value if pdf["asked"].iloc[0] is None else sorted(pdf["asked"].iloc[0]):
            if qid in sent.value:
                own, v, spots = sent.value[qid]
                i, j, value = fn(v, m, *spots, *at, **options)
                out.append(pd.DataFrame({"query_id": qid, "image_id": key[0], "q_idx": own[i], "db_idx": idx[j], "value": value}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "image_id", "q_idx", "db_idx", "value")})

    return features.groupBy("image_id").applyInPandas(run, OUT)


def matched_points(matches: DataFrame, query: DataFrame, database: DataFrame) -> DataFrame:
    """``(query_id, image_id, q_idx, db_idx, x1, y1, x2, y2)``: places of matched keypoints, by two equi-joins."""
    a = query.select("query_id", F.col("kp_idx").alias("q_idx"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = database.select("image_id", F.col("kp_idx").alias("db_idx"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return matches.join(a, ["query_id", "q_idx"]).join(b, ["image_id", "db_idx"]).select("query_id", "image_id", "q_idx", "db_idx", "x1", "y1", "x2", "y2")
