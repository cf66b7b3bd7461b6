"""Geometric verification: convex hulls, homographies by seeded sampling, scores with their gates, projected corners."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_MATCHES = 50
LEAST_INLIERS = 50
#: Lower (excluded) and upper (included) limit of a scale factor that counts, by criterion (fixed values).
SCALE_LIMITS = {"scale_factor_max": (0.12, 8.0), "scale_factor_min": (0.1, 10.0)}
CRITERIA = ("num_inliers", *SCALE_LIMITS)


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull of points; 0 for fewer than three or for points on a line."""
    p = np.unique(np.stack([x, y], axis=1)[np.isfinite(x) & np.isfinite(y)], axis=0)
    if len(p) < 3:
        return 0.0

    def chain(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = np.array(chain(p.tolist()) + chain(p[::-1].tolist()))
    return 0.5 * abs(float(h[:, 0] @ np.roll(h[:, 1], -1) - h[:, 1] @ np.roll(h[:, 0], -1)))


def hull_areas(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """``(*keys, area)`` per group; groups are the keypoints of one image, bounded by the extractor's cap."""
    types = dict(points.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", area double"

    def run(key, pdf):
        return pd.DataFrame([[*key, hull_area(pdf[x].to_numpy(float), pdf[y].to_numpy(float))]], columns=[*keys, "area"])

    return points.select(*keys, x, y).groupBy(*keys).applyInPandas(run, schema)


def scale_factor(area1: Column | str, area2: Column | str) -> Column:
    """Square root of the ratio of hull areas; NULL where the first is 0."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (area1, area2))
    return F.when(a > 0, F.sqrt(b / a))


def gated_scale(factor: Column, criterion: str) -> Column:
    low, high = SCALE_LIMITS[criterion]
    return F.when((factor <= low) | (factor > high) | factor.isNull(), 0.0).otherwise(factor)


def gated_score(n_matches: Column, n_inliers: Column, factor: Column, criterion: str) -> Column:
    """Score by criterion: 0 below 50 matches; inliers as they are; a scale factor only with more than 50 inliers."""
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}")
    if criterion == "num_inliers":
        return F.when(n_matches < LEAST_MATCHES, 0.0).otherwise(n_inliers.cast("double"))
    return F.when((n_matches < LEAST_MATCHES) | ~(n_inliers > LEAST_INLIERS), 0.0).otherwise(gated_scale(factor, criterion))


def scale_of_homography(h: Column | str) -> Column:
    """Geometric mean of the singular values of the upper-left 2x2 part, H scaled to h33 = 1: sqrt(|det|)."""
    h = F.col(h) if isinstance(h, str) else h
    a = lambda i, j: h[i][j] / h[2][2]
    return F.sqrt(F.abs(a(0, 0) * a(1, 1) - a(0, 1) * a(1, 0)))


def projected_corners(h: Column | str, hq: Column | str, wq: Column | str, hd: Column | str, wd: Column | str) -> Column:
    """The closed polygon of the query's corners in relative database coordinates: array of five (x, y).

    Order: top left, bottom left, bottom right, top right, top left; |z| < 1e-8 and sizes of 0 count as 1."""
    h, hq, wq, hd, wd = (F.col(c) if isinstance(c, str) else c for c in (h, hq, wq, hd, wd))
    zero = F.lit(0.0)
    hq, wq, hd, wd = (c.cast("double") for c in (hq, wq, hd, wd))

    def at(x, y):
        px, py, z = (h[i][0] * x + h[i][1] * y + h[i][2] for i in range(3))
        safe = F.when(F.abs(z) < 1e-8, 1.0).otherwise(z)
        return F.struct((px / safe / F.when(wd == 0, 1.0).otherwise(wd)).alias("x"), (py / safe / F.when(hd == 0, 1.0).otherwise(hd)).alias("y"))

    return F.array(at(zero, zero), at(zero, hq), at(wq, hq), at(wq, zero), at(zero, zero))


def fit_homography(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Least-squares homography a -> b by normalised direct linear transform; h33 = 1 where it is not 0."""

    def normal(p):
        c, s = p.mean(axis=0), p.std() or 1.0
        return (p - c) / s, np.array([[1 / s, 0, -c[0] / s], [0, 1 / s, -c[1] / s], [0, 0, 1]])

    (p, t), (q, u) = normal(a), normal(b)
    one, zero = np.ones(len(p)), np.zeros((len(p), 3))
    ph = np.column_stack([p, one])
    m = np.concatenate([np.hstack([ph, zero, -q[:, :1] * ph]), np.hstack([zero, ph, -q[:, 1:] * ph])])
    h = np.linalg.solve(u, np.linalg.svd(m)[2][-1].reshape(3, 3) @ t)
    if not np.isfinite(h).all() or abs(np.linalg.det(h)) < 1e-15:
        return None
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def _errors(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = np.column_stack([a, np.ones(len(a))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.hypot(*(p[:, :2] / p[:, 2:] - b).T)
    return np.where(np.isfinite(e), e, np.inf)


def ransac(a: np.ndarray, b: np.ndarray, threshold: float = 2.0, rounds: int = 2_000, confidence: float = 0.999, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """(homography a -> b or None, inlier mask). Samples of four are scored by truncated squared error; the best model is
    refitted to its inliers until they settle; sampling ends early at the given confidence."""
    n, rng = len(a), np.random.default_rng(seed)
    best, cost, needed = None, np.inf, rounds
    tried = 0
    while n >= 4 and tried < min(rounds, needed):
        tried += 1
        pick = rng.choice(n, 4, replace=False)
        h = fit_homography(a[pick], b[pick])
        if h is None:
            continue
        e = np.minimum(_errors(h, a, b), threshold) ** 2
        if e.sum() < cost:
            cost, best = e.sum(), h
            share = np.mean(e < threshold**2)
            needed = np.log(1 - confidence) / np.log(1 - min(share**4, 1 - 1e-9)) if share > 0 else rounds
    if best is None:
        return None, np.zeros(n, bool)
    inliers = _errors(best, a, b) < threshold
    for _ in range(5):
        if inliers.sum() < 4:
            break
        h = fit_homography(a[inliers], b[inliers])
        if h is None:
            break
        more = _errors(h, a, b) < threshold
        if more.sum() < inliers.sum():
            break
        best, same, inliers = h, bool((more == inliers).all()), more
        if same:
            break
    return best, inliers


def verify(points: DataFrame, criterion: str = "num_inliers", threshold: float = 2.0, rounds: int = 2_000, seed: int = 0) -> DataFrame:
    """``(query_id, image_id, n_matches, num_inliers, score, status, h)`` from matched points ``(query_id, image_id, x1, y1, x2, y2)``.

    Pairs below 50 matches are settled by a count and never reach the fit (status ``few_matches``). The fit maps
    query to database; ``scale_factor_min`` fits the other way and inverts. status: ``ok``, ``few_inliers``, ``failed``.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}")
    key = ["query_id", "image_id"]
    counts = points.groupBy(*key).agg(F.count("*").alias("n_matches"))
    enough = points.join(counts.filter(F.col("n_matches") >= LEAST_MATCHES).select(*key), key)

    def run(k, pdf):
        a, b = pdf[["x1", "y1"]].to_numpy(float), pdf[["x2", "y2"]].to_numpy(float)
        order = np.lexsort((b[:, 1], b[:, 0], a[:, 1], a[:, 0]))
        a, b = a[order], b[order]
        back = criterion == "scale_factor_min"
        h, inl = ransac(b, a, threshold, rounds, seed=zlib.crc32(repr((k, seed)).encode())) if back else ransac(a, b, threshold, rounds, seed=zlib.crc32(repr((k, seed)).encode()))
        if h is not None and back:
            h = np.linalg.inv(h) if abs(np.linalg.det(h)) > 1e-15 else None
        n, score, status = int(inl.sum()), 0.0, "failed" if h is None else "few_inliers"
        if h is None:
            h, n = np.zeros((3, 3)), 0
        elif criterion == "num_inliers":
            score, status = float(n), "ok" if n > LEAST_INLIERS else status
        elif n > LEAST_INLIERS:
            one, two = hull_area(*a[inl].T), hull_area(*b[inl].T)
            factor = np.sqrt((one / two if back else two / one)) if min(one, two) > 0 else 0.0
            low, high = SCALE_LIMITS[criterion]
            score, status = (factor if low < factor <= high else 0.0), "ok"
        return pd.DataFrame({"query_id": [k[0]], "image_id": [k[1]], "num_inliers": [n], "score": [score], "status": [status], "h": [h.tolist()]})

    fitted = enough.groupBy(*key).applyInPandas(run, "query_id long, image_id long, num_inliers long, score double, status string, h array<array<double>>")
    none = F.array(*[F.array(*[F.lit(0.0)] * 3)] * 3)
    joined = counts.join(fitted, key, "left")
    return joined.select(*key, "n_matches", F.coalesce("num_inliers", F.lit(0)).alias("num_inliers"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("status", F.lit("few_matches")).alias("status"), F.coalesce("h", none).alias("h"))


def resorted(verified: DataFrame, shortlist: DataFrame) -> DataFrame:
    """The shortlist ``(query_id, rank, image_id)`` by descending score, former rank at ties; unmatched images score 0."""
    from pyspark.sql import Window

    scored = shortlist.join(verified, ["query_id", "image_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "image_id")
    return scored.select("query_id", "image_id", "score", F.col("rank").alias("shortlist_rank"), (F.row_number().over(w) - 1).alias("rank"))
