"""Numerics on image planes and tokens: heatmaps, peaks, keypoint selection, pooling, optimal transport.

A plane is a long table ``(image_id, y, x, v)``. Steps that look at single rows or cells are column expressions; steps that look at
neighbourhoods work on one image per group, which the image's size bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaforge.functions.vectors import l2_normalize, let


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(v: Column | str, temperature: float = 1.0) -> Column:
    """Softmax of an array, in double precision, shifted by its maximum."""
    v = _c(v)
    e = let(F.array_max(v).cast("double"), lambda m: F.transform(v, lambda x: F.exp((x.cast("double") - m) * temperature)))
    return let(e, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda t: F.transform(e, lambda x: x / t)))


def keypoint_heatmap(cells: DataFrame) -> DataFrame:
    """``(image_id, y, x, v)`` from logits ``(image_id, cy, cx, logits)`` of 8 x 8 pixels and one entry for none of them."""
    p = cells.select("image_id", "cy", "cx", F.slice(softmax("logits"), 1, 64).alias("p"))
    flat = p.select("image_id", "cy", "cx", F.posexplode("p").alias("k", "v"))
    return flat.select("image_id", (F.col("cy") * 8 + F.floor(F.col("k") / 8)).cast("int").alias("y"), (F.col("cx") * 8 + F.col("k") % 8).cast("int").alias("x"), "v")


def local_peaks(plane: DataFrame, radius: int = 2, threshold: float = 0.05, border: int = 0) -> DataFrame:
    """Rows of a plane that are the greatest of their (2 radius + 1)^2 window and above ``threshold``; equal neighbours all
    stay. Pixels that are not in the table count as lower than any. ``border`` pixels at the edges never are peaks."""

    def run(pdf):
        if not len(pdf):
            return pdf
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        h, w = y.max() + 1, x.max() + 1
        a = np.full((h + 2 * radius, w + 2 * radius), -np.inf)
        a[y + radius, x + radius] = pdf["v"]
        top = np.full((h, w), -np.inf)
        for dy in range(2 * radius + 1):
            for dx in range(2 * radius + 1):
                np.maximum(top, a[dy : dy + h, dx : dx + w], out=top)
        keep = (pdf["v"].to_numpy() == top[y, x]) & (pdf["v"].to_numpy() > threshold)
        if border:
            keep &= (y >= border) & (x >= border) & (y < h - border) & (x < w - border)
        return pdf[keep]

    return plane.select("image_id", "y", "x", "v").filter("v is not null").groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, v double")


def top_keypoints(points: DataFrame, k: int, score: str = "v", positive: bool = False) -> DataFrame:
    """The ``k`` rows of greatest score per image, ties by place; with ``positive`` only scores above 0."""
    rows = points.filter(F.col(score) > 0) if positive else points
    w = Window.partitionBy("image_id").orderBy(F.desc(score), "y", "x")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dual_scale(small: DataFrame, large: DataFrame, k: int, s1: float = 0.6, s2: float = 1.3) -> DataFrame:
    """Keypoints of two scales in the coordinates of the original: a fifth of ``k`` from the small one, the rest from the large."""
    one = lambda df, n, s: top_keypoints(df, int(n)).select("image_id", (F.col("x") / s).alias("x"), (F.col("y") / s).alias("y"), F.lit(1 / s).alias("scale"), "v")
    return one(small, k * 0.2, s1).unionByName(one(large, k * 0.8, s2))


def soft_argmax(v: Column | str, side: int = 8, temperature: float = 3.0) -> Column:
    """struct(dx, dy, confidence): expected offset from the middle of a side x side patch, and its greatest probability."""
    place = F.sequence(F.lit(0), F.lit(side * side - 1))

    def expected(p: Column, f) -> Column:
        return F.aggregate(F.zip_with(p, place, lambda a, i: a * (f(i) - side // 2)), F.lit(0.0), lambda s, x: s + x)

    return let(softmax(v, temperature), lambda p: F.struct(expected(p, lambda i: i % side).alias("dx"), expected(p, lambda i: F.floor(i / side)).alias("dy"), F.array_max(p).alias("confidence")))


def refined(matches: DataFrame, least: float = 0.25) -> DataFrame:
    """Matches ``(x1, y1, scale, logits, ...)`` moved by the expected offset times the scale; confidence must exceed ``least``."""
    m = matches.withColumn("_o", soft_argmax("logits")).filter(F.col("_o.confidence") > least)
    return m.withColumn("x1", F.col("x1") + F.col("_o.dx") * F.col("scale")).withColumn("y1", F.col("y1") + F.col("_o.dy") * F.col("scale")).drop("_o")


def space_to_depth(plane: DataFrame, side: int = 8) -> DataFrame:
    """``(image_id, cy, cx, channel, v)``: the pixels of each side x side cell as channels."""
    return plane.select("image_id", F.floor(F.col("y") / side).cast("int").alias("cy"), F.floor(F.col("x") / side).cast("int").alias("cx"), ((F.col("y") % side) * side + F.col("x") % side).cast("int").alias("channel"), "v")


def sample_plane(plane: DataFrame, points: DataFrame, size: tuple[int, int], full: tuple[int, int], mode: str = "bilinear") -> DataFrame:
    """``points`` with ``value``: the plane of ``size`` (h, w) read at points given in an image of ``full`` (h, w).

    Coordinates are scaled so that 0 and full - 1 are the outer edges of the outer pixels. Bilinear weighs four pixels, nearest
    takes one (halves to even); outside is 0. The taps are one equi-join on (image, y, x).
    """
    (h, w), (fh, fw) = size, full
    px, py = F.col("x") / (fw - 1) * w - 0.5, F.col("y") / (fh - 1) * h - 0.5
    p = points.withColumn("_id", F.monotonically_increasing_id()) if "point_id" not in points.columns else points.withColumn("_id", F.col("point_id"))
    p = p.withColumn("_px", px).withColumn("_py", py)
    if mode == "nearest":
        taps = F.array(F.struct(F.bround("_py").cast("int").alias("ty"), F.bround("_px").cast("int").alias("tx"), F.lit(1.0).alias("tw")))
    elif mode == "bilinear":
        y0, x0 = F.floor("_py"), F.floor("_px")
        ay, ax = F.col("_py") - y0, F.col("_px") - x0
        taps = F.array(*[F.struct((y0 + dy).cast("int").alias("ty"), (x0 + dx).cast("int").alias("tx"), ((ay if dy else 1 - ay) * (ax if dx else 1 - ax)).alias("tw")) for dy in (0, 1) for dx in (0, 1)])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    each = p.select("image_id", "_id", F.explode(taps).alias("t")).select("image_id", "_id", "t.*")
    read = each.join(plane.select("image_id", F.col("y").alias("ty"), F.col("x").alias("tx"), "v"), ["image_id", "ty", "tx"]).groupBy("image_id", "_id").agg(F.sum(F.col("tw") * F.col("v")).alias("value"))
    return p.join(read, ["image_id", "_id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))).drop("_id", "_px", "_py")


def keypoint_scores(heat: DataFrame, reliability: DataFrame, points: DataFrame, full: tuple[int, int], coarse: tuple[int, int]) -> DataFrame:
    """``points`` (with point_id) and ``score``: nearest heat times bilinear reliability; the point (0, 0) scores -1; only scores
    above 0 stay."""
    a = sample_plane(heat, points, full, full, "nearest").withColumnRenamed("value", "_heat")
    b = sample_plane(reliability, points, coarse, full).select("point_id", F.col("value").alias("_rel"))
    s = a.join(b, "point_id").withColumn("score", F.when((F.col("x") == 0) & (F.col("y") == 0), -1.0).otherwise(F.col("_heat") * F.col("_rel")))
    return s.filter("score > 0").drop("_heat", "_rel")


def deformable_sample(plane: DataFrame, points: DataFrame, size: tuple[int, int], full: tuple[int, int], limit: float = 128.0) -> DataFrame:
    """``(image_id, point_id, value)``: sum over a point's offsets of weight times the plane read at the moved point.

    ``points``: ``(image_id, point_id, x, y, offsets)`` with offsets as array of struct(dx, dy, weight), clamped to ``limit``."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(-limit)), F.lit(limit))
    moved = points.select("image_id", F.col("point_id").alias("owner"), "x", "y", F.posexplode("offsets").alias("i", "o"))
    moved = moved.select("image_id", "owner", (F.col("x") + clamp(F.col("o.dx"))).alias("x"), (F.col("y") + clamp(F.col("o.dy"))).alias("y"), F.col("o.weight").alias("weight"))
    read = sample_plane(plane, moved, size, full)
    return read.groupBy("image_id", F.col("owner").alias("point_id")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def gem_pool(tokens: DataFrame, p: float = 3.0, floor: float = 1e-6) -> DataFrame:
    """``(image_id, embedding)``: generalised mean of each dimension over the tokens ``(image_id, token)``, then length one."""
    flat = tokens.select("image_id", F.posexplode("token").alias("i", "x"))
    dims = flat.groupBy("image_id", "i").agg(F.pow(F.avg(F.pow(F.greatest(F.col("x").cast("double"), F.lit(floor)), F.lit(p))), F.lit(1 / p)).alias("g"))
    row = dims.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda s: s["g"]).alias("g"))
    return row.select("image_id", l2_normalize("g").alias("embedding"))


def transport_weights(s: np.ndarray, dustbin: float = 1.0, rounds: int = 3) -> np.ndarray:
    """Log of the plan that sends n patches (columns) to m clusters (rows) and a last row for what fits none, near exp(score).

    The plan is of the form diag(a) exp(s) diag(b); every patch sends 1, every cluster wants 1 and the last row the other n - m. The matrix
    itself is fitted to these sums in turn (iterative proportional fitting), ``rounds`` times rows and then columns. Rows are
    scaled first, so each may start at any factor and starts with its greatest value at 1.
    """
    clusters, patches = s.shape
    if patches <= clusters:
        raise ValueError("more columns than clusters are needed")
    plan = np.exp(np.vstack([s - s.max(axis=1, keepdims=True), np.zeros((1, patches))]))
    wanted = np.append(np.ones(clusters), patches - clusters)[:, None]
    for _ in range(rounds):
        plan *= wanted / plan.sum(axis=1, keepdims=True)
        plan /= np.maximum(plan.sum(axis=0, keepdims=True), np.finfo(float).tiny)
    with np.errstate(divide="ignore"):
        return np.log(plan)


def assign_by_transport(scores: DataFrame, dustbin: float = 1.0, rounds: int = 3) -> DataFrame:
    """``(image_id, patch, cluster, log_p)`` from ``(image_id, patch, scores)``; cluster = number of scores is the dustbin.

    Groups are the patches of one image. An image needs more patches than clusters, others give no rows."""

    def run(key, pdf):
        pdf = pdf.sort_values("patch")
        s = np.stack(pdf["scores"].to_list()).astype(float).T
        if s.shape[1] <= s.shape[0]:
            return pd.DataFrame({"image_id": [], "patch": [], "cluster": [], "log_p": []})
        lp = transport_weights(s, dustbin, rounds)
        m, n = lp.shape
        return pd.DataFrame({"image_id": key[0], "patch": np.tile(pdf["patch"].to_numpy(), m), "cluster": np.repeat(np.arange(m), n), "log_p": lp.ravel()})

    return scores.groupBy("image_id").applyInPandas(run, "image_id long, patch long, cluster int, log_p double")


def weighted_clusters(assigned: DataFrame, features: DataFrame, tokens: DataFrame, clusters: int) -> DataFrame:
    """``(image_id, embedding)``: per cluster the sum of features weighted by exp(log_p), scaled to length one, laid out channel by
    channel after the scaled scene token, the whole scaled to length one. features: ``(image_id, patch, f)``, tokens: ``(image_id, t)``."""
    flat = features.select("image_id", "patch", F.posexplode("f").alias("c", "x"))
    w = assigned.filter(F.col("cluster") < clusters).select("image_id", "patch", "cluster", F.exp("log_p").alias("p"))
    sums = flat.join(w, ["image_id", "patch"]).groupBy("image_id", "cluster", "c").agg(F.sum(F.col("x").cast("double") * F.col("p")).alias("s"))
    per = sums.withColumn("n", F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("image_id", "cluster"))))
    vec = per.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "cluster", (F.col("s") / F.col("n")).alias("x")))), lambda s: s["x"]).alias("local"))
    return vec.join(tokens, "image_id").select("image_id", let(F.concat(l2_normalize("t"), "local"), l2_normalize).alias("embedding"))
