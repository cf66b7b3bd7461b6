"""Catalogs, stored results, sizes and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaforge.operators import shapes
from vistaforge.plans.registry import query, table
from vistaforge.sources import cache, catalog

_CATALOG = r"""WITH c AS (SELECT DISTINCT path FROM images WHERE regexp_matches(lower(path), '\.(jpg|jpeg|png|bmp|gif)$')),
ids AS (SELECT row_number() OVER (ORDER BY path) - 1 AS image_id, path FROM c) """


@query(_CATALOG + "SELECT image_id, path FROM ids")
def catalog_extension_filter(spark, d):
    return catalog.catalog(table(spark, d, "images"))


@query("SELECT i.album, s.query_id, min(s.shortlist_rank) AS shortlist_rank, i.path, i.image_id FROM shortlist s JOIN (SELECT DISTINCT image_id, path, album FROM images) i USING (image_id) GROUP BY ALL")
def gather_paths(spark, d):
    """Paths of shortlisted images, keeping their rank."""
    images = table(spark, d, "images").select("image_id", "path", "album").distinct()
    short = table(spark, d, "shortlist").groupBy("query_id", "image_id").agg(F.min("shortlist_rank").alias("shortlist_rank"))
    return short.join(images, "image_id").select("album", "query_id", "shortlist_rank", "path", "image_id")


@query(_CATALOG + "SELECT i.image_id AS given_id, ids.image_id, path FROM (SELECT DISTINCT image_id, path FROM images) i JOIN ids USING (path)")
def path_to_id(spark, d):
    images = table(spark, d, "images").select(F.col("image_id").alias("given_id"), "path").distinct()
    return images.join(catalog.catalog(images.select("path")), "path").select("given_id", "image_id", "path")


@query("SELECT row_number() OVER (ORDER BY path DESC) - 1 AS image_id, path FROM (SELECT DISTINCT path FROM images WHERE path IS NOT NULL)")
def file_list_catalog(spark, d):
    """A list of files (a driver's list by nature) in the order given, here the paths backwards; nothing is filtered."""
    return catalog.from_list(spark, sorted((r[0] for r in table(spark, d, "images").select("path").filter("path is not null").distinct().collect()), reverse=True))


_HEADS = ["ffd8ffe0", "89504e470d0a1a0a00", "474946383961", "424d0000", "00112233"]
_BARE = """WITH p AS (SELECT path, regexp_replace(path, '\\.[^./]*$', '') AS bare, min(image_id) % 5 AS kind FROM images WHERE path IS NOT NULL GROUP BY ALL),
b AS (SELECT bare, min(kind) AS kind FROM p WHERE bare <> path GROUP BY bare), f AS (SELECT path FROM p UNION SELECT bare FROM b),
e AS (SELECT bare, ['jpg', 'png', 'gif', 'bmp'][kind + 1] AS ext FROM b WHERE kind < 4),
t AS (SELECT bare, i, bare || CASE WHEN i > 0 THEN '_' || i ELSE '' END || '.' || ext AS name FROM e, range(0, 20) r(i)) """


@query(_BARE + "SELECT bare AS path, arg_min(name, i) AS new_path FROM t WHERE name NOT IN (SELECT path FROM f) GROUP BY bare")
def extension_repair_plan(spark, d):
    """Beside every image lies a file of its name without extension, whose bytes are those of one of four types or of none."""
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    p = table(spark, d, "images").filter("path is not null").groupBy("path").agg((F.min("image_id") % 5).cast("int").alias("kind")).withColumn("bare", bare)
    b = p.filter("bare <> path").groupBy("bare").agg(F.min("kind").alias("kind"))
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in _HEADS]), F.col("kind") + 1))
    files = p.select("path", F.lit(None).cast("binary").alias("head")).unionByName(b.select(F.col("bare").alias("path"), head.alias("head")))
    return catalog.repair_plan(files.groupBy("path").agg(F.max("head").alias("head")))


@query("""SELECT DISTINCT image_id, CASE WHEN image_id % 5 < 4 THEN CASE WHEN image_id % 5 = 3 THEN w ELSE h END END AS h, CASE WHEN image_id % 5 < 4 THEN CASE WHEN image_id % 5 = 3 THEN h ELSE w END END AS w
FROM image_size WHERE image_id IS NOT NULL AND h BETWEEN 0 AND 65535 AND w BETWEEN 0 AND 65535""")
def header_sizes(spark, d):
    """Headers of four formats (the JPEG turned by its orientation) and of none, made of each image's stored size."""
    s = table(spark, d, "image_size").filter("image_id is not null and h between 0 and 65535 and w between 0 and 65535").select("image_id", "h", "w").distinct()
    big = lambda c, n: F.lpad(F.hex(F.col(c)), n, "0")
    little = lambda c, n: F.concat(F.substring(big(c, 4), 3, 2), F.substring(big(c, 4), 1, 2), F.lit("0000"[: n - 4]))
    turned = "ffd8ffe10024" + "457869660000" + "49492a0008000000" + "0100" + "12010300010000000600000000000000" + "0000" + "ffc0001108"
    kinds = [
        F.concat(F.lit("89504e470d0a1a0a0000000d49484452"), big("w", 8), big("h", 8), F.lit("08060000")),
        F.concat(F.lit("474946383961"), little("w", 4), little("h", 4)),
        F.concat(F.lit("424d0000000000000000000000002800" + "0000"), little("w", 8), little("h", 8)),
        F.concat(F.lit(turned), big("h", 4), big("w", 4), F.lit("03")),
        F.lit("00"),
    ]
    head = F.element_at(F.array(*kinds), (F.col("image_id") % 5).cast("int") + 1)
    return catalog.header_sizes(s.select("image_id", F.unhex(head).alias("head")))


@query("SELECT count(*) AS n, sum(('0x' || substr(md5(path), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM (SELECT DISTINCT image_id, path FROM images)")
def collection_fingerprint(spark, d):
    return cache.fingerprint(table(spark, d, "images").select("image_id", "path").distinct())


@query("SELECT * FROM (VALUES ('global', './tmp/_data_imgs/dinosalad_global_index'), ('graph', './tmp/_data_imgs/dinosalad_Wn'), ('local', './tmp/_data_imgs/xfeat_4096_uint8'), ('given', '/idx/xfeat_2048')) t(kind, path)")
def stored_paths(spark, d):
    f = cache.cache_folder("/data/imgs")
    return spark.createDataFrame(
        [("global", cache.global_index_path(f, "dinosalad")), ("graph", cache.graph_path(f, "dinosalad")), ("local", cache.local_feature_path(f, "xfeat", 4096, True)), ("given", cache.local_feature_path(cache.cache_folder("/data/imgs", "/idx"), "xfeat", 2048))],
        "kind string, path string",
    )


def _sizes(spark, d):
    return table(spark, d, "image_size").select("image_id", "h", "w").distinct()


@query("SELECT h, w, count(*) AS n FROM (SELECT DISTINCT image_id, h, w FROM image_size) GROUP BY h, w")
def shape_histogram(spark, d):
    return shapes.shape_histogram(_sizes(spark, d))


@query("SELECT h, w, count(*) AS n FROM (SELECT DISTINCT image_id, h, w FROM image_size) WHERE h IS NOT NULL AND w IS NOT NULL GROUP BY h, w ORDER BY n DESC, h, w LIMIT 1")
def commonest_shape(spark, d):
    return shapes.commonest_shape(_sizes(spark, d))


_SHAPES = """WITH s AS (SELECT DISTINCT image_id, h, w FROM image_size WHERE h > 0 AND w > 0),
n AS (SELECT *, round_even(w * 512::DOUBLE / greatest(w, h), 0)::INT AS nw, round_even(h * 512::DOUBLE / greatest(w, h), 0)::INT AS nh FROM s),
p AS (SELECT *, ((2 * (nw // 2)) // 16) * 8.0::DOUBLE AS hw, ((2 * (nh // 2)) // 16) * 8.0::DOUBLE AS hh0 FROM n),
o AS (SELECT image_id, h, w, (2 * CASE WHEN nw = nh THEN 3 * hw / 4 ELSE hh0 END)::INT AS h_out, (2 * hw)::INT AS w_out FROM p) """


def _shaped(spark, d):
    s = _sizes(spark, d).filter("h > 0 and w > 0").withColumn("o", shapes.patch_shape("w", "h"))
    return s.select("image_id", "h", "w", F.col("o.h").alias("h_out"), F.col("o.w").alias("w_out"))


@query(_SHAPES + "SELECT * FROM o")
def patch_shapes(spark, d):
    return _shaped(spark, d)


@query(_SHAPES + "SELECT h_out AS h, w_out AS w, image_id, (row_number() OVER (PARTITION BY h_out, w_out ORDER BY image_id) - 1) // 8 AS batch FROM (SELECT DISTINCT image_id, h_out, w_out FROM o)")
def shape_batches(spark, d):
    one = _shaped(spark, d).select("image_id", F.col("h_out").alias("h"), F.col("w_out").alias("w")).distinct()
    return shapes.shape_batches(one, 8)


@query(_SHAPES + """, b AS (SELECT h_out, w_out, (row_number() OVER (PARTITION BY h_out, w_out ORDER BY image_id) - 1) // 8 AS k FROM (SELECT DISTINCT image_id, h_out, w_out FROM o)),
g AS (SELECT count(*) AS n FROM b GROUP BY h_out, w_out, k) SELECT count(*) AS n_batches, round(avg(n), 6) AS mean_size, min(n) AS least, max(n) AS most FROM g""")
def batch_statistics(spark, d):
    one = _shaped(spark, d).select("image_id", F.col("h_out").alias("h"), F.col("w_out").alias("w")).distinct()
    return shapes.batch_statistics(shapes.shape_batches(one, 8)).withColumn("mean_size", F.round("mean_size", 6))


@query(_SHAPES + "SELECT image_id, h_out, w_out FROM o WHERE image_id IS NOT NULL")
def shape_order(spark, d):
    """Images ordered by the shape a network makes of them, range-partitioned so that equal shapes meet in one task."""
    return _shaped(spark, d).repartitionByRange("h_out", "w_out", "image_id").sortWithinPartitions("h_out", "w_out", "image_id").select("image_id", "h_out", "w_out")


@query(_SHAPES + """, z AS (SELECT h_out, w_out, count(DISTINCT image_id) AS n_images FROM o WHERE h_out >= 16 AND w_out >= 16 GROUP BY ALL),
q AS (SELECT *, unnest(range(0, (h_out // 16) * (w_out // 16))) AS i FROM z)
SELECT h_out, w_out, n_images, i::BIGINT AS patch, ((i % (w_out // 16)) + 0.5::DOUBLE) * 16 AS x, ((i // (w_out // 16)) + 0.5::DOUBLE) * 16 AS y FROM q""")
def patch_centres(spark, d):
    """All patches of every shape that occurs, and how many images have it: centres depend on the shape alone."""
    shaped = _shaped(spark, d).filter("h_out >= 16 and w_out >= 16").groupBy("h_out", "w_out").agg(F.countDistinct("image_id").alias("n_images"))
    last = (F.floor(F.col("h_out") / 16) * F.floor(F.col("w_out") / 16) - 1).cast("long")
    p = shaped.select("h_out", "w_out", "n_images", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("patch"))
    c = shapes.patch_centre("patch", "w_out")
    return p.select("h_out", "w_out", "n_images", "patch", c["x"].alias("x"), c["y"].alias("y"))


@query("""WITH s AS (SELECT DISTINCT image_id, h, w FROM image_size WHERE h > 0 AND w > 0)
SELECT image_id, h, w, round(100.25::DOUBLE * w / 512, 6) AS x, round(57.5::DOUBLE * h / 384, 6) AS y FROM s""")
def rescaled_points(spark, d):
    """A place in an image of 512 by 384 in the pixels of each original."""
    s = _sizes(spark, d).filter("h > 0 and w > 0")
    return s.select("image_id", "h", "w", F.round(shapes.rescaled(F.lit(100.25), F.lit(512), "w"), 6).alias("x"), F.round(shapes.rescaled(F.lit(57.5), F.lit(384), "h"), 6).alias("y"))


@query("""WITH s AS (SELECT DISTINCT image_id, h, w FROM image_size WHERE h >= 32 AND w >= 32)
SELECT image_id, h, w, (h // 32) * 32 AS h32, (w // 32) * 32 AS w32, round(h / ((h // 32) * 32)::DOUBLE, 6) AS rh, round(w / ((w // 32) * 32)::DOUBLE, 6) AS rw FROM s""")
def sizes_multiple_of_32(spark, d):
    s = _sizes(spark, d).filter("h >= 32 and w >= 32").withColumn("o", shapes.multiple_of_32("w", "h"))
    return s.select("image_id", "h", "w", F.col("o.h").alias("h32"), F.col("o.w").alias("w32"), F.round("o.rh", 6).alias("rh"), F.round("o.rw", 6).alias("rw"))


@query("""WITH c AS (SELECT image_id, count(*) AS n FROM shortlist GROUP BY image_id)
SELECT image_id, n, (sum(n) OVER (ORDER BY image_id) - n)::BIGINT AS start, ((sum(n) OVER (ORDER BY image_id) - n) // 100)::BIGINT AS chunk FROM c""")
def feature_offsets(spark, d):
    """Offsets of each image's rows in a store ordered by image, and chunks of whole images."""
    counts = table(spark, d, "shortlist").groupBy("image_id").agg(F.count("*").alias("n"))
    return shapes.image_chunks(shapes.feature_offsets(counts), 100).select("image_id", "n", F.col("start").cast("long").alias("start"), "chunk")
