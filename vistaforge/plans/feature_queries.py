"""Local features: matching, verification, planes, pooling, the inverted file. Features come from ``embeddings``: its label is the
image, vec_id the keypoint, the first two values its place."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaforge.functions import vectors as V
from vistaforge.operators import asmk, geometry, match, planes, shapes
from vistaforge.plans.registry import query, table


def _features(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("long").alias("image_id"), F.col("vec_id").alias("kp_idx"), F.col("embedding").alias("desc"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def _query_features(spark, d):
    """Every image is a query and meets every image, itself included."""
    return _features(spark, d).withColumnRenamed("image_id", "query_id")


def _matched(spark, d, method, **options):
    return match.match_features(_query_features(spark, d), _features(spark, d), method, **options).withColumn("value", F.round("value", 6))


_PAIRS = """WITH p AS (SELECT a.label::BIGINT AS query_id, b.label::BIGINT AS image_id, a.vec_id AS q_idx, b.vec_id AS db_idx,
 list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot
 FROM embeddings a, embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, query_id, q_idx ORDER BY dist, db_idx) AS rq, row_number() OVER (PARTITION BY image_id, query_id, db_idx ORDER BY dist, q_idx) AS rd,
 nth_value(dist, 2) OVER (PARTITION BY image_id, query_id, q_idx ORDER BY dist, db_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS q2,
 nth_value(dist, 2) OVER (PARTITION BY image_id, query_id, db_idx ORDER BY dist, q_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d2 FROM p) """
_OUT = "SELECT query_id, image_id, q_idx, db_idx, "


@query(_PAIRS + _OUT + "round(dist / q2, 6) AS value FROM r WHERE rq = 1 AND dist / q2 <= 0.95")
def match_snn(spark, d):
    return _matched(spark, d, "snn")


@query(_PAIRS + _OUT + "round(greatest(dist / q2, dist / d2), 6) AS value FROM r WHERE rq = 1 AND rd = 1 AND dist / q2 <= 0.99 AND dist / d2 <= 0.99")
def match_smnn(spark, d):
    return _matched(spark, d, "smnn")


@query(_PAIRS + _OUT + "round(dist / d2, 6) AS value FROM r WHERE rd = 1 AND dist / d2 <= 0.95")
def match_ratio_db_to_query(spark, d):
    return _matched(spark, d, "flann")


@query(_PAIRS + _OUT + "round(dist * dist / (1e-8 + d2 * d2), 6) AS value FROM r WHERE rd = 1 AND dist * dist / (1e-8 + d2 * d2) <= 0.95")
def match_ratio_squared(spark, d):
    return _matched(spark, d, "faiss_cpu")


_MUTUAL_DOT = """, c AS (SELECT *, row_number() OVER (PARTITION BY image_id, query_id, q_idx ORDER BY dot DESC, db_idx) AS cq, row_number() OVER (PARTITION BY image_id, query_id, db_idx ORDER BY dot DESC, q_idx) AS cd FROM p) """


@query(_PAIRS + _MUTUAL_DOT + _OUT + "round(dot, 6) AS value FROM c WHERE cq = 1 AND cd = 1 AND dot > 0.3")
def match_mnn_cosine(spark, d):
    return _matched(spark, d, "mnn", threshold=0.3)


@query(_PAIRS + _MUTUAL_DOT + _OUT + "round(dot, 6) AS value FROM c WHERE cq = 1 AND cd = 1")
def match_mnn_batch(spark, d):
    """Mutual nearest neighbours of several image pairs at once, without a threshold."""
    return _matched(spark, d, "mnn", threshold=-1)


@query(_PAIRS + """, e AS (SELECT *, exp(20 * (dot - 1)) AS e FROM p),
s AS (SELECT *, e * e / sum(e) OVER (PARTITION BY image_id, query_id, q_idx) / sum(e) OVER (PARTITION BY image_id, query_id, db_idx) AS pr FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, query_id, q_idx ORDER BY pr DESC, db_idx) AS a, row_number() OVER (PARTITION BY image_id, query_id, db_idx ORDER BY pr DESC, q_idx) AS b FROM s) """ + _OUT + "round(pr, 6) AS value FROM k WHERE a = 1 AND b = 1 AND pr > 0.01")
def match_dual_softmax(spark, d):
    return _matched(spark, d, "dual_softmax")


@query()
def match_adalam(spark, d):
    """Matches that move like those around them; no SQL, tested on planted motions."""
    return _matched(spark, d, "adalam")


@query(_PAIRS + """SELECT r.query_id, r.image_id, q_idx, db_idx, a.embedding[1]::DOUBLE AS x1, a.embedding[2]::DOUBLE AS y1, b.embedding[1]::DOUBLE AS x2, b.embedding[2]::DOUBLE AS y2
FROM r JOIN embeddings a ON a.vec_id = q_idx JOIN embeddings b ON b.vec_id = db_idx WHERE rq = 1 AND dist / q2 <= 0.95""")
def matched_keypoints(spark, d):
    q, db = _query_features(spark, d), _features(spark, d)
    return match.matched_points(match.match_features(q, db, "snn"), q, db)


@query("SELECT label::BIGINT AS image_id, vec_id AS kp_idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, list_transform(embedding::DOUBLE[], lambda v: trunc(least(greatest(v * 512, 0), 255)) / 512) AS \"desc\" FROM embeddings WHERE label IN (SELECT DISTINCT (image_id % 10) FROM shortlist WHERE query_id = 0)")
def shortlisted_features(spark, d):
    """Stored (quantised) features of shortlisted images only, read back as floats."""
    stored = _features(spark, d).withColumn("desc", V.quantize("desc"))
    short = table(spark, d, "shortlist").filter("query_id = 0").select((F.col("image_id") % 10).alias("image_id")).distinct()
    return stored.join(short, "image_id", "left_semi").select("image_id", "kp_idx", "x", "y", V.dequantize("desc").alias("desc"))


@query("SELECT label::BIGINT AS image_id, round(min(x), 6) AS least, round(max(x), 6) AS greatest, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label")
def descriptor_statistics(spark, d):
    s = shapes.descriptor_statistics(_features(spark, d))
    return s.select("image_id", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


_HULL = """WITH pts AS (SELECT DISTINCT label, vec_id % 2 AS side, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
g AS ({groups}),
ed AS (SELECT a.image_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM g a JOIN g b ON a.image_id = b.image_id AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM g c WHERE c.image_id = a.image_id AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
h AS (SELECT image_id, 0.5::DOUBLE * sum(ax * by_ - bx * ay) AS area FROM ed GROUP BY image_id) """


@query(_HULL.format(groups="SELECT label::BIGINT AS image_id, x, y FROM pts") + "SELECT image_id, round(area, 6) AS area FROM h")
def hull_area(spark, d):
    return geometry.hull_areas(_features(spark, d), ["image_id"]).withColumn("area", F.round("area", 6))


@query(_HULL.format(groups="SELECT label * 2 + side AS image_id, x, y FROM pts") + """SELECT (a.image_id // 2)::BIGINT AS image_id, round(sqrt(b.area / a.area), 6) AS scale,
round(CASE WHEN sqrt(b.area / a.area) <= 0.12 OR sqrt(b.area / a.area) > 8 THEN 0 ELSE sqrt(b.area / a.area) END, 6) AS gated FROM h a JOIN h b ON b.image_id = a.image_id + 1 WHERE a.image_id % 2 = 0""")
def scale_factor(spark, d):
    f = _features(spark, d).withColumn("side", F.col("kp_idx") % 2)
    areas = geometry.hull_areas(f, ["image_id", "side"])
    one = areas.filter("side = 0").select("image_id", F.col("area").alias("a1"))
    two = areas.filter("side = 1").select("image_id", F.col("area").alias("a2"))
    s = geometry.scale_factor("a1", "a2")
    return one.join(two, "image_id").select("image_id", F.round(s, 6).alias("scale"), F.round(geometry.gated_scale(s, "scale_factor_max"), 6).alias("gated"))


_GATES = [(49, 49, 2.0), (50, 50, 2.0), (51, 51, 2.0), (200, 120, 0.12), (200, 120, 0.11), (200, 120, 8.0), (200, 120, 9.0), (200, 120, 10.5), (200, 120, None), (0, 0, None)]


@query("WITH g(m, i, s) AS (VALUES " + ", ".join(f"({m}, {i}, {'NULL' if s is None else s}::DOUBLE)" for m, i, s in _GATES) + """)
SELECT m, i, CASE WHEN m < 50 THEN 0::DOUBLE ELSE i::DOUBLE END AS inliers,
CASE WHEN m < 50 OR i <= 50 OR s IS NULL OR s <= 0.12 OR s > 8 THEN 0::DOUBLE ELSE s END AS scale_max,
CASE WHEN m < 50 OR i <= 50 OR s IS NULL OR s <= 0.1 OR s > 10 THEN 0::DOUBLE ELSE s END AS scale_min FROM g""")
def match_gates(spark, d):
    g = spark.createDataFrame(_GATES, "m int, i int, s double")
    score = lambda c: geometry.gated_score(F.col("m"), F.col("i"), F.col("s"), c)
    return g.select("m", "i", score("num_inliers").alias("inliers"), score("scale_factor_max").alias("scale_max"), score("scale_factor_min").alias("scale_min"))


_H = "SELECT image_id, [[1 + (image_id % 7) / 10.0::DOUBLE, 0.05::DOUBLE, (image_id % 50)::DOUBLE], [-0.03::DOUBLE, 0.9::DOUBLE + (image_id % 3) / 10.0::DOUBLE, (image_id % 20)::DOUBLE], [0.0001::DOUBLE * (image_id % 5), 0.0::DOUBLE, 1.0::DOUBLE]] AS h, hd, wd FROM (SELECT DISTINCT image_id, h AS hd, w AS wd FROM image_size WHERE h IS NOT NULL AND w IS NOT NULL AND image_id IS NOT NULL)"


def _planted_h(spark, d):
    i = F.col("image_id")
    s = table(spark, d, "image_size").select("image_id", F.col("h").alias("hd"), F.col("w").alias("wd")).filter("hd is not null and wd is not null and image_id is not null").distinct()
    row = lambda *x: F.array(*[c.cast("double") for c in x])
    h = F.array(row(1 + (i % 7) / 10, F.lit(0.05), i % 50), row(F.lit(-0.03), 0.9 + (i % 3) / 10, i % 20), row(0.0001 * (i % 5), F.lit(0.0), F.lit(1.0)))
    return s.withColumn("h", h)


_CORNERS = ["0.0::DOUBLE, 0.0::DOUBLE", "0.0::DOUBLE, 480.0::DOUBLE", "640.0::DOUBLE, 480.0::DOUBLE", "640.0::DOUBLE, 0.0::DOUBLE", "0.0::DOUBLE, 0.0::DOUBLE"]


@query(f"WITH q AS ({_H}), c AS (SELECT q.*, p.i, p.x, p.y FROM q, (VALUES " + ", ".join(f"({i}, {c})" for i, c in enumerate(_CORNERS)) + """) p(i, x, y)),
z AS (SELECT *, h[3][1] * x + h[3][2] * y + h[3][3] AS z FROM c)
SELECT image_id, hd, wd, i, round((h[1][1] * x + h[1][2] * y + h[1][3]) / CASE WHEN abs(z) < 1e-8 THEN 1 ELSE z END / CASE WHEN wd = 0 THEN 1 ELSE wd END, 6) AS px,
round((h[2][1] * x + h[2][2] * y + h[2][3]) / CASE WHEN abs(z) < 1e-8 THEN 1 ELSE z END / CASE WHEN hd = 0 THEN 1 ELSE hd END, 6) AS py FROM z""")
def corner_projection(spark, d):
    p = geometry.projected_corners("h", F.lit(480), F.lit(640), "hd", "wd")
    e = _planted_h(spark, d).select("image_id", "hd", "wd", F.posexplode(p).alias("i", "p"))
    return e.select("image_id", "hd", "wd", "i", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query(f"SELECT image_id, hd, wd, round(sqrt(abs(h[1][1] * h[2][2] - h[1][2] * h[2][1])), 6) AS scale FROM ({_H})")
def homography_scale(spark, d):
    return _planted_h(spark, d).select("image_id", "hd", "wd", F.round(geometry.scale_of_homography("h"), 6).alias("scale"))


def _planted_points(spark, d):
    """Keypoints of each image as the query's, moved by a known similarity; every fifth is moved elsewhere."""
    f = _features(spark, d)
    s = 1 + F.col("image_id") / 10
    out = (F.col("kp_idx") % 5 == 0).cast("double")
    x1, y1 = (F.col("x") + 1) * 300, (F.col("y") + 1) * 300
    jump = F.pmod(F.xxhash64("kp_idx"), F.lit(400)) - 200
    return f.select(F.lit(0).cast("long").alias("query_id"), "image_id", x1.alias("x1"), y1.alias("y1"), (x1 * s + 20 + out * jump).alias("x2"), (y1 * s - 10 - out * jump * 0.7).alias("y2"))


@query()
def homography_ransac(spark, d):
    v = geometry.verify(_planted_points(spark, d), "num_inliers")
    return v.select("query_id", "image_id", "n_matches", "num_inliers", "score", "status", F.round(F.col("h")[0][0], 4).alias("h11"), F.round(F.col("h")[0][2], 3).alias("h13"))


@query()
def geometric_resort(spark, d):
    v = geometry.verify(_planted_points(spark, d), "scale_factor_max")
    short = _features(spark, d).select("image_id").distinct().select(F.lit(0).cast("long").alias("query_id"), F.col("image_id").cast("int").alias("rank"), "image_id")
    return geometry.resorted(v.select("query_id", "image_id", F.round("score", 4).alias("score")), short)


@query()
def geometric_resort_min(spark, d):
    v = geometry.verify(_planted_points(spark, d), "scale_factor_min")
    return v.select("query_id", "image_id", "n_matches", "num_inliers", F.round("score", 4).alias("score"), "status")


def _cells(spark, d):
    """Logit cells: each feature is one 8 x 8 cell; 32 cells make a row of an image."""
    from pyspark.sql import Window

    f = _features(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("image_id").orderBy("kp_idx")) - 1)
    return f.select("image_id", F.floor(F.col("n") / 8).cast("int").alias("cy"), (F.col("n") % 8).cast("int").alias("cx"), F.concat(F.transform("desc", lambda x: x.cast("double") * 8), F.array(F.lit(1.0))).alias("logits"))


_HEAT = """WITH n AS (SELECT label::BIGINT AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, list_concat(list_transform(embedding::DOUBLE[], lambda x: x * 8), [1.0::DOUBLE]) AS l FROM embeddings),
t AS (SELECT image_id, n // 8 AS cy, n % 8 AS cx, l, list_sum(list_transform(l, lambda x: exp(x))) AS s FROM n),
u AS (SELECT image_id, cy, cx, unnest(range(0, 64)) AS k, l, s FROM t),
hm AS (SELECT image_id, (cy * 8 + k // 8)::INT AS y, (cx * 8 + k % 8)::INT AS x, exp(l[k + 1]) / s AS v FROM u) """


@query(_HEAT + "SELECT image_id, y, x, round(v, 6) AS v FROM hm")
def keypoint_heatmap(spark, d):
    return planes.keypoint_heatmap(_cells(spark, d)).withColumn("v", F.round("v", 6))


def _heat(spark, d):
    return planes.keypoint_heatmap(_cells(spark, d)).withColumn("v", F.round("v", 9))


_PEAKS = _HEAT + """, hr AS (SELECT image_id, y, x, round(v, 9) AS v FROM hm),
mx AS (SELECT a.image_id, a.y, a.x, a.v, max(b.v) AS m FROM hr a JOIN hr b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY ALL),
pk AS (SELECT image_id, y, x, v FROM mx WHERE v = m AND v > 0.05) """


@query(_PEAKS + "SELECT image_id, y, x, round(v, 6) AS v FROM pk")
def heatmap_nms(spark, d):
    return planes.local_peaks(_heat(spark, d)).withColumn("v", F.round("v", 6))


@query(_PEAKS.replace("v > 0.05", "v > -1e9") + ", sz AS (SELECT image_id, max(y) AS my, max(x) AS mx FROM hm GROUP BY image_id) SELECT image_id, y, x, round(v, 6) AS v FROM pk JOIN sz USING (image_id) WHERE y BETWEEN 4 AND my - 4 AND x BETWEEN 4 AND mx - 4")
def heatmap_nms_border(spark, d):
    """Peaks of radius 2 without a threshold, four pixels at the edges left out."""
    return planes.local_peaks(_heat(spark, d), 2, -1e9, 4).withColumn("v", F.round("v", 6))


@query(_PEAKS + "SELECT image_id, y, x, round(v, 6) AS v, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS rank FROM pk QUALIFY rank <= 20")
def keypoint_topk(spark, d):
    k = planes.top_keypoints(planes.local_peaks(_heat(spark, d)), 20)
    return k.select("image_id", "y", "x", F.round("v", 6).alias("v"), F.col("rank").cast("long").alias("rank"))


@query(_PEAKS + """, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS r FROM pk)
SELECT image_id, round(x / 0.6::DOUBLE, 6) AS x, round(y / 0.6::DOUBLE, 6) AS y, round(1 / 0.6::DOUBLE, 6) AS scale, round(v, 6) AS v FROM k WHERE r <= 4
UNION ALL SELECT image_id, round(x / 1.3::DOUBLE, 6), round(y / 1.3::DOUBLE, 6), round(1 / 1.3::DOUBLE, 6), round(v, 6) FROM k WHERE r <= 16""")
def keypoints_two_scales(spark, d):
    p = planes.local_peaks(_heat(spark, d))
    return planes.dual_scale(p, p, 20).select("image_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "scale", "v")])


@query("""WITH e AS (SELECT vec_id AS image_id, list_transform(embedding::DOUBLE[], lambda x: exp(3 * x * 8)) AS e FROM embeddings),
u AS (SELECT image_id, unnest(range(0, 64)) AS k, e, list_sum(e) AS s FROM e)
SELECT image_id, round(sum(e[k + 1] / s * (k % 8 - 4)), 6) AS dx, round(sum(e[k + 1] / s * (k // 8 - 4)), 6) AS dy, round(max(e[k + 1] / s), 6) AS confidence FROM u GROUP BY image_id""")
def soft_argmax(spark, d):
    o = planes.soft_argmax(F.transform("desc", lambda x: x.cast("double") * 8))
    return _features(spark, d).select(F.col("kp_idx").alias("image_id"), o.alias("o")).select("image_id", *[F.round(f"o.{c}", 6).alias(c) for c in ("dx", "dy", "confidence")])


@query("""WITH e AS (SELECT vec_id AS q_idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, list_transform(embedding::DOUBLE[], lambda x: exp(3 * x * 8)) AS e FROM embeddings),
u AS (SELECT q_idx, x, y, unnest(range(0, 64)) AS k, e, list_sum(e) AS s FROM e),
o AS (SELECT q_idx, x, y, sum(e[k + 1] / s * (k % 8 - 4)) AS dx, sum(e[k + 1] / s * (k // 8 - 4)) AS dy, max(e[k + 1] / s) AS c FROM u GROUP BY ALL)
SELECT q_idx, round(x + dx * 2, 6) AS x1, round(y + dy * 2, 6) AS y1 FROM o WHERE c > 0.25""")
def refined_matches(spark, d):
    m = _features(spark, d).select(F.col("kp_idx").alias("q_idx"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lit(2.0).alias("scale"), F.transform("desc", lambda x: x.cast("double") * 8).alias("logits"))
    return planes.refined(m).select("q_idx", F.round("x1", 6).alias("x1"), F.round("y1", 6).alias("y1"))


@query(_HEAT + "SELECT image_id, y // 8 AS cy, x // 8 AS cx, (y % 8) * 8 + x % 8 AS channel, round(v, 6) AS v FROM hm")
def space_to_depth(spark, d):
    return planes.space_to_depth(planes.keypoint_heatmap(_cells(spark, d))).withColumn("v", F.round("v", 6))


_SAMPLED = _HEAT + """, pl AS (SELECT image_id, y, x, round(v, 9) AS v FROM hm WHERE y < 32 AND x < 64),
pt AS (SELECT label::BIGINT AS image_id, vec_id AS point_id, (embedding[1]::DOUBLE + 0.6) * 400 AS x, (embedding[2]::DOUBLE + 0.6) * 200 AS y FROM embeddings),
at_ AS (SELECT *, x / 511 * 64 - 0.5 AS px, y / 255 * 32 - 0.5 AS py FROM pt),
tp AS (SELECT a.*, floor(py)::INT + dy AS ty, floor(px)::INT + dx AS tx, (CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS w FROM at_ a, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)),
bl AS (SELECT tp.image_id, point_id, any_value(tp.x) AS x, any_value(tp.y) AS y, any_value(px) AS px, any_value(py) AS py, coalesce(sum(w * v), 0) AS value FROM tp LEFT JOIN pl ON pl.image_id = tp.image_id AND pl.y = ty AND pl.x = tx GROUP BY tp.image_id, point_id) """


def _sample_points(spark, d):
    return _features(spark, d).select("image_id", F.col("kp_idx").alias("point_id"), ((F.col("x") + 0.6) * 400).alias("x"), ((F.col("y") + 0.6) * 200).alias("y"))


@query(_SAMPLED + "SELECT image_id, point_id, round(value, 6) AS value FROM bl")
def bilinear_sample(spark, d):
    plane = _heat(spark, d).filter("y < 32 and x < 64")
    return planes.sample_plane(plane, _sample_points(spark, d), (32, 64), (256, 512)).select("image_id", "point_id", F.round("value", 6).alias("value"))


@query(_SAMPLED + "SELECT bl.image_id, point_id, round(value * pl.v, 6) AS score FROM bl JOIN pl ON pl.image_id = bl.image_id AND pl.y = round_even(bl.py, 0)::INT AND pl.x = round_even(bl.px, 0)::INT WHERE value * pl.v > 0")
def keypoint_scores(spark, d):
    plane = _heat(spark, d).filter("y < 32 and x < 64")
    p = _sample_points(spark, d)
    near = planes.sample_plane(plane, p, (32, 64), (256, 512), "nearest").withColumnRenamed("value", "heat")
    smooth = planes.sample_plane(plane, p, (32, 64), (256, 512)).select("point_id", "value")
    return near.join(smooth, "point_id").withColumn("s", F.col("heat") * F.col("value")).filter("s > 0").select("image_id", "point_id", F.round("s", 6).alias("score"))


@query()
def deformable_sample(spark, d):
    plane = _heat(spark, d).filter("y < 32 and x < 64")
    off = F.array(*[F.struct(F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy"), F.lit(w).alias("weight")) for dx, dy, w in ((0, 0, 0.5), (8, -4, 0.25), (-500, 3, 0.25))])
    p = _sample_points(spark, d).withColumn("offsets", off)
    return planes.deformable_sample(plane, p, (32, 64), (256, 512)).select("image_id", "point_id", F.round("value", 6).alias("value"))


@query("""WITH t AS (SELECT label::BIGINT AS image_id, unnest(range(1, 65)) AS i, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT image_id, i, pow(avg(pow(greatest(e[i], 1e-6::DOUBLE), 3)), 1 / 3.0::DOUBLE) AS g FROM t GROUP BY image_id, i),
n AS (SELECT image_id, sqrt(sum(g * g)) AS n FROM g GROUP BY image_id)
SELECT image_id, list(round(g / n, 6) ORDER BY i) AS embedding FROM g JOIN n USING (image_id) GROUP BY image_id""")
def gem_pool(spark, d):
    t = _features(spark, d).select("image_id", F.col("desc").alias("token"))
    return planes.gem_pool(t).withColumn("embedding", V.rounded("embedding"))


def _lse(n: int) -> str:
    half = lambda k, prev, side: (
        f", u{k} AS (SELECT image_id, j, la - ln(sum(exp(s + {prev}))) AS u FROM a JOIN la USING (image_id, j){side} GROUP BY image_id, j, la)"
        f", v{k} AS (SELECT image_id, patch, lb - ln(sum(exp(s + u))) AS v FROM a JOIN u{k} USING (image_id, j) JOIN nn USING (image_id) GROUP BY image_id, patch, lb)"
    )
    return "".join(half(k, "v" if k > 1 else "0", f" JOIN v{k - 1} USING (image_id, patch)" if k > 1 else "") for k in range(1, n + 1))


_SINKHORN = """WITH sc AS (SELECT label::BIGINT AS image_id, vec_id AS patch, unnest(range(0, 5)) AS j, embedding::DOUBLE[] AS e FROM embeddings),
a AS (SELECT image_id, patch, j, CASE WHEN j = 4 THEN 1.0::DOUBLE ELSE e[j + 1] * 8 END AS s FROM sc),
nn AS (SELECT label::BIGINT AS image_id, count(*) AS n, -ln(count(*) + 4) AS lb FROM embeddings GROUP BY label),
la AS (SELECT image_id, j, lb + CASE WHEN j = 4 THEN ln(n - 4) ELSE 0 END AS la FROM nn, range(0, 5) r(j))""" + _lse(3) + """,
lp AS (SELECT a.image_id, a.patch, a.j, s + u + v - lb AS log_p FROM a JOIN u3 USING (image_id, j) JOIN v3 USING (image_id, patch) JOIN nn USING (image_id)) """


def _transport(spark, d):
    s = _features(spark, d).select("image_id", F.col("kp_idx").alias("patch"), F.transform(F.slice("desc", 1, 4), lambda x: x.cast("double") * 8).alias("scores"))
    return planes.assign_by_transport(s)


@query(_SINKHORN + "SELECT image_id, patch, j::INT AS cluster, round(log_p, 6) AS log_p FROM lp")
def sinkhorn(spark, d):
    return _transport(spark, d).withColumn("log_p", F.round("log_p", 6))


@query(_SINKHORN + """, f AS (SELECT label::BIGINT AS image_id, vec_id AS patch, unnest(range(0, 8)) AS c, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT image_id, j, c, sum(e[c + 9] * exp(log_p)) AS s FROM f JOIN lp USING (image_id, patch) WHERE j < 4 GROUP BY ALL),
nrm AS (SELECT *, s / sqrt(sum(s * s) OVER (PARTITION BY image_id, j)) AS x FROM s),
loc AS (SELECT image_id, list(x ORDER BY c, j) AS l FROM nrm GROUP BY image_id),
tok AS (SELECT label::BIGINT AS image_id, arg_min(embedding::DOUBLE[], vec_id)[17:20] AS t FROM embeddings GROUP BY label),
b AS (SELECT image_id, list_concat(list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))), l) AS e FROM loc JOIN tok USING (image_id))
SELECT image_id, list_transform(e, lambda x: round(x / sqrt(list_dot_product(e, e)), 6)) AS embedding FROM b""")
def weighted_clusters(spark, d):
    f = _features(spark, d)
    feats = f.select("image_id", F.col("kp_idx").alias("patch"), F.slice("desc", 9, 8).alias("f"))
    tokens = f.groupBy("image_id").agg(F.min_by("desc", "kp_idx").alias("t")).select("image_id", F.slice("t", 17, 4).alias("t"))
    return planes.weighted_clusters(_transport(spark, d), feats, tokens, 4).withColumn("embedding", V.rounded("embedding"))


@query()
def asmk_query(spark, d):
    """Shortlists of three images from the inverted file."""
    f = _features(spark, d)
    words = asmk.train_words(f, 32)
    index = asmk.postings(f, words)
    asked = index.filter("image_id < 3").withColumnRenamed("image_id", "query_id")
    return asmk.query_inverted_file(index, asked, 10)
