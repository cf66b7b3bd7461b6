"""Search requests: merging, pages, overlays, envelopes, dispatch."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaforge.operators import serve
from vistaforge.plans.registry import query, table

_SHORT = "s AS (SELECT query_id, image_id, min(shortlist_rank) AS rank, max(sims) AS score FROM shortlist GROUP BY ALL), v AS (SELECT query_id, image_id, max(score) AS score FROM resort_score WHERE resort_criterion = 'scale_factor_max' GROUP BY ALL)"
_MERGED = "WITH " + _SHORT + """, g AS (SELECT v.query_id, v.image_id, v.score, s.score AS global_similarity, s.rank AS r, TRUE AS verified FROM v JOIN s USING (query_id, image_id) WHERE v.score <> 0),
m AS (SELECT * FROM g UNION ALL SELECT query_id, image_id, score, score, rank, FALSE FROM s ANTI JOIN g USING (query_id, image_id)),
o AS (SELECT query_id, image_id, score, global_similarity, verified, row_number() OVER (PARTITION BY query_id ORDER BY verified DESC, CASE WHEN verified THEN -score END, r, image_id) - 1 AS rank FROM m) """


def _short(spark, d):
    return table(spark, d, "shortlist").groupBy("query_id", "image_id").agg(F.min("shortlist_rank").alias("rank"), F.max("sims").alias("score"))


def _verified(spark, d):
    r = table(spark, d, "resort_score").filter("resort_criterion = 'scale_factor_max'")
    return r.groupBy("query_id", "image_id").agg(F.max("score").alias("score"))


def _merged(spark, d):
    return serve.merged(_verified(spark, d), _short(spark, d))


@query(_MERGED + "SELECT query_id, image_id, round(score, 6) AS score, round(global_similarity, 6) AS global_similarity, verified, rank FROM o")
def fallback_merge(spark, d):
    m = _merged(spark, d)
    return m.select("query_id", "image_id", F.round("score", 6).alias("score"), F.round("global_similarity", 6).alias("global_similarity"), "verified", "rank")


@query("WITH " + _SHORT + " SELECT v.query_id, v.image_id, v.score FROM v WHERE score <> 0")
def irrelevance_filter(spark, d):
    return _verified(spark, d).filter("score <> 0")


@query("WITH " + _SHORT + ", j AS (SELECT s.query_id, s.image_id, coalesce(v.score, 0) AS score, s.rank AS shortlist_rank FROM s LEFT JOIN v USING (query_id, image_id)) SELECT query_id, image_id, score, shortlist_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shortlist_rank, image_id) - 1 AS rank FROM j")
def resort_order(spark, d):
    """Descending score with former rank at ties."""
    from vistaforge.operators.geometry import resorted

    out = resorted(_verified(spark, d), _short(spark, d).drop("score"))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(_MERGED + "SELECT query_id, image_id, rank FROM o WHERE rank >= 10 AND rank < 20")
def result_page(spark, d):
    return serve.page(_merged(spark, d), 10, 10).select("query_id", "image_id", "rank")


_INPUT = "SELECT image_id, min(path) AS path FROM images GROUP BY image_id"


@query(_MERGED + f""", f AS (SELECT image_id, path, split_part(path, '/', 1) || '/' AS root FROM ({_INPUT}))
SELECT query_id, o.rank, replace(path, 'photos/', 'collection/') AS path, 'Rank: ' || o.rank::VARCHAR AS rank_text, 'scale_factor_max: ' || printf('%.3g', score) || ', global_similarity: ' || printf('%.3g', global_similarity) AS score_text, 'collection' AS prefix
FROM o JOIN f USING (image_id) WHERE o.rank < 5""")
def result_overlays(spark, d):
    """Rows of a first page with their texts."""
    p = serve.page(_merged(spark, d), 0, 5)
    images = table(spark, d, "images").groupBy("image_id").agg(F.min("path").alias("path"))
    return serve.result_rows(p, images, "scale_factor_max", "photos").select("query_id", "rank", "path", "rank_text", "score_text", "prefix")


@query()
def result_envelope(spark, d):
    p = serve.page(_merged(spark, d), 0, 5)
    images = table(spark, d, "images").groupBy("image_id").agg(F.min("path").alias("path"))
    return serve.envelope(serve.result_rows(p, images, "scale_factor_max", "photos"))


@query("""WITH s AS (SELECT DISTINCT image_id, h, w FROM image_size WHERE h IS NOT NULL AND w IS NOT NULL),
c AS (SELECT image_id, h, w, trunc(0.9::DOUBLE * w)::INT AS xa, trunc(0.25::DOUBLE * w)::INT AS xb, trunc(0.1::DOUBLE * h)::INT AS ya, trunc(0.75::DOUBLE * h)::INT AS yb FROM s)
SELECT image_id, h, w, least(xa, xb) AS xmin, greatest(xa, xb) AS xmax, least(ya, yb) AS ymin, greatest(ya, yb) AS ymax FROM c""")
def query_crop(spark, d):
    s = table(spark, d, "image_size").select("image_id", "h", "w").distinct().filter("h is not null and w is not null")
    c = serve.crop_pixels(F.lit(0.9), F.lit(0.1), F.lit(0.25), F.lit(0.75), "w", "h")
    return s.select("image_id", "h", "w", *[c[k].alias(k) for k in ("xmin", "xmax", "ymin", "ymax")])


_REQUESTS = [
    ("similarity", "homography", 0, 10), ("similarity-bbox", "homography", 20, 20), ("num-inliers", "vlm", 0, 50), ("num-inliers-bbox", "vlm", 90, 20),
    ("zoom-in", "homography", 0, 10), ("zoom-in", "vlm", 0, 10), ("zoom-out", "homography", 0, 10), ("zoom-out", "vlm", 100, 900), (None, "homography", 30, 1),
]
_PLANNED = ["('skip', FALSE, 300)", "('skip', TRUE, 400)", "('num_inliers', FALSE, 500)", "('num_inliers', TRUE, 1000)", "('scale_factor_max', TRUE, 300)", "('vlm_zoom_in', TRUE, 300)", "('scale_factor_min', TRUE, 300)", "('vlm_zoom_out', TRUE, 1000)", "('skip', FALSE, 310)"]


@query("SELECT (row_number() OVER ()) - 1 AS id, * FROM (VALUES " + ", ".join(_PLANNED) + ") t(criterion, crop, shortlist_size)")
def search_dispatch(spark, d):
    """Requests planned: criterion, crop and size of the shortlist."""
    out = []
    for i, (mode, zoom, offset, limit) in enumerate(_REQUESTS):
        search = {"search_mode": {"id": mode, "tool_data": {"x1": 0.1, "x2": 0.5, "y1": 0.1, "y2": 0.5}}} if mode else {}
        p = serve.plan_request({"data": {"limit": limit, "offset": offset, "engine_options": {"diffusion": False, "zooming_alg": zoom}, "query": {"value": {"path": "a.jpg", "prefix": "upload"}} | search}})
        out.append((i, p.criterion, p.crop, p.shortlist_size))
    return spark.createDataFrame(out, "id long, criterion string, crop boolean, shortlist_size int")


@query("SELECT * FROM (VALUES ('upload', 'a.jpg', '/up/a.jpg'), ('collection', 'x/b.jpg', '/data/x/b.jpg'), ('other', 'c.jpg', 'c.jpg')) t(prefix, path, place)")
def query_paths(spark, d):
    c = serve.Config().with_options(upload_dir="/up/", input_dir="/data/")
    rows = [("upload", "a.jpg"), ("collection", "x/b.jpg"), ("other", "c.jpg")]
    return spark.createDataFrame([(p, x, serve.query_path(x, p, c)) for p, x in rows], "prefix string, path string, place string")


@query("SELECT 'unioned' AS kind, count(*) AS n FROM (SELECT DISTINCT image_id FROM (SELECT image_id FROM shortlist UNION ALL SELECT image_id FROM resort_score)) UNION ALL SELECT 'common', count(*) FROM (SELECT image_id FROM shortlist INTERSECT SELECT image_id FROM resort_score) UNION ALL SELECT 'only_shortlist', count(*) FROM (SELECT image_id FROM shortlist EXCEPT SELECT image_id FROM resort_score)")
def id_sets(spark, d):
    """Union, intersection and difference of the ids of two result tables."""
    a, b = table(spark, d, "shortlist").select("image_id"), table(spark, d, "resort_score").select("image_id")
    parts = (("unioned", a.union(b).distinct()), ("common", a.intersect(b)), ("only_shortlist", a.distinct().exceptAll(a.intersect(b))))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
