"""Shortlists, the similarity graph and diffusion, over the vectors of ``embeddings`` and ``global_desc``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaforge.functions import vectors as V
from vistaforge.operators import diffusion, graph, knn
from vistaforge.operators.cells import one_per_id
from vistaforge.plans.registry import query, table
from vistaforge.session import cut

#: Queries of the searches: every row whose id is divisible by this.
EVERY = 50
_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_DIST = "round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")


def _seeds(spark, d):
    return _vectors(spark, d).filter(F.col("image_id") % EVERY == 0).withColumnRenamed("image_id", "query_id")


@query(f"""SELECT b.vec_id AS image_id, {_DIST} AS dist, round((2 - {_DIST}) / 2, 6) AS score
FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY dist, image_id LIMIT 100""")
def knn_l2_topk(spark, d):
    v = _vectors(spark, d)
    return knn.l2_shortlist(v, list(v.filter("image_id = 0").select("embedding").first()[0]), 100)


@query(f"""SELECT a.vec_id AS query_id, b.vec_id AS image_id, {_DIST} AS value, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 50""")
def knn_l2_multi_query(spark, d):
    return knn.blocked_topk(_vectors(spark, d), _seeds(spark, d), 50).withColumn("rank", F.col("rank").cast("long"))


_UNIT = """WITH u AS (SELECT image_id, min(described_at) AS t FROM global_desc WHERE len(global_descs) = 96 GROUP BY image_id),
ok AS (SELECT g.image_id, global_descs::DOUBLE[] AS v FROM global_desc g JOIN u ON g.image_id = u.image_id AND g.described_at = u.t
  WHERE len(list_filter(global_descs, lambda x: isnan(x) OR x IS NULL)) = 0 AND list_dot_product(global_descs::DOUBLE[], global_descs::DOUBLE[]) > 1e-12),
n AS (SELECT image_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e FROM ok) """


@query(_UNIT + """SELECT a.image_id AS query_id, b.image_id, round(list_dot_product(a.e, b.e), 6) AS value, row_number() OVER (PARTITION BY a.image_id ORDER BY round(list_dot_product(a.e, b.e), 6) DESC, b.image_id) AS rank
FROM n a, n b WHERE a.image_id % 50 = 0 AND a.image_id <> b.image_id QUALIFY rank <= 10""")
def knn_global_descriptors(spark, d):
    """Exact cosine neighbours of a stated query set (every fiftieth image) in the whole collection, first description of each."""
    g = table(spark, d, "global_desc").filter("size(global_descs) = 96")
    w = g.groupBy("image_id").agg(F.min_by("global_descs", "described_at").alias("v"))
    clean = w.filter(~F.exists("v", lambda x: F.isnan(x) | x.isNull()) & (V.dot("v", "v") > 1e-12)).select("image_id", V.l2_normalize("v").alias("embedding"))
    q = clean.filter("image_id % 50 = 0").withColumnRenamed("image_id", "query_id")
    return knn.blocked_topk(clean, q, 10, "dot", keep_self=False).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT vec_id AS image_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS embedding FROM embeddings")
def l2_normalize(spark, d):
    return _vectors(spark, d).select("image_id", V.rounded(V.l2_normalize("embedding")).alias("embedding"))


@query("""WITH a AS (SELECT vec_id AS image_id, embedding::DOUBLE[] AS v, list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS s FROM embeddings),
b AS (SELECT image_id, list_transform(v, lambda x: sqrt(greatest(x / s, 1e-6::DOUBLE))) AS r FROM a)
SELECT image_id, list_transform(r, lambda x: round(x / sqrt(list_dot_product(r, r)), 6)) AS embedding FROM b""")
def root_sift(spark, d):
    return _vectors(spark, d).select("image_id", V.rounded(V.root_sift("embedding")).alias("embedding"))


@query("""SELECT vec_id AS image_id, list_transform(embedding::DOUBLE[], lambda x: trunc(least(greatest(x * 512, 0), 255))::SMALLINT) AS q,
list_transform(embedding::DOUBLE[], lambda x: trunc(least(greatest(x * 512, 0), 255)) / 512) AS back FROM embeddings""")
def quantize_roundtrip(spark, d):
    q = V.quantize("embedding")
    return _vectors(spark, d).select("image_id", q.alias("q"), V.dequantize(q).alias("back"))


_EDGES = f"""WITH s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round({_DOT}, 6) AS s FROM embeddings a, embeddings b),
k AS (SELECT src, dst, round(greatest(s * s * s, 0), 9) AS w, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM s),
e AS MATERIALIZED (SELECT src, dst, w FROM k WHERE r <= 100 AND w > 0) """
_MUTUAL = _EDGES + ", m AS MATERIALIZED (SELECT x.src, x.dst, least(x.w, y.w) AS w FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src) "
_WN = _MUTUAL + """, g AS (SELECT src, sum(w) AS d FROM m WHERE src <> dst GROUP BY src),
wn AS MATERIALIZED (SELECT m.src, m.dst, m.w / sqrt(a.d * b.d) AS w FROM m JOIN g a ON m.src = a.src JOIN g b ON m.dst = b.src WHERE m.src <> m.dst) """
_SEED = f"""SELECT a.vec_id AS query_id, b.vec_id AS image_id, round(pow(round({_DOT}, 6), 3), 9) AS q, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 6) DESC, b.vec_id) AS r
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"""


@query(_EDGES + "SELECT src, dst, w FROM e")
def sim_kernel_topk_edges(spark, d):
    return graph.kernel_edges(_vectors(spark, d))


@query(_EDGES + "SELECT src, dst, w FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 10")
def top_k_edges(spark, d):
    """Per-row top-k without symmetrising."""
    return graph.top_k_edges(graph.kernel_edges(_vectors(spark, d)), 10)


@query(_MUTUAL + "SELECT src, dst, w FROM m")
def mutual_min_graph(spark, d):
    return graph.mutual_min(graph.kernel_edges(_vectors(spark, d)))


@query(_MUTUAL + "SELECT src AS node, round(sum(w), 5) AS degree FROM m WHERE src <> dst GROUP BY src")
def graph_degrees(spark, d):
    return graph.degrees(graph.mutual_min(graph.kernel_edges(_vectors(spark, d)))).withColumn("degree", F.round("degree", 5))


@query(_WN + "SELECT src, dst, round(w, 6) AS w FROM wn")
def normalized_graph(spark, d):
    return graph.normalized_graph(_vectors(spark, d)).withColumn("w", F.round("w", 6))


@query(f"SELECT query_id, image_id, q FROM ({_SEED}) WHERE r <= 50 AND q > 0")
def diffusion_seed(spark, d):
    return graph.query_seed(_vectors(spark, d), _seeds(spark, d))


def _wn(spark, d):
    return cut(graph.normalized_graph(_vectors(spark, d)))


_STEPS = [
    f", f{i} AS MATERIALIZED (SELECT query_id, image_id, sum(f) AS f FROM (SELECT query_id, image_id, f FROM f0 UNION ALL SELECT p.query_id, wn.src, 0.9::DOUBLE * wn.w * p.f FROM wn JOIN f{i - 1} p ON wn.dst = p.image_id) GROUP BY ALL)"
    for i in range(1, 41)
]


@query(_WN.replace("WITH s AS", f"WITH f0 AS (SELECT query_id, image_id, q AS f FROM ({_SEED}) WHERE r <= 50 AND q > 0), s AS") + "".join(_STEPS[:4]) + "SELECT query_id, image_id, round(f, 6) AS f FROM f4")
def diffusion_fixed_iter(spark, d):
    seed = graph.query_seed(_vectors(spark, d), _seeds(spark, d))
    return diffusion.neumann(_wn(spark, d), seed, rounds=4).withColumn("f", F.round("f", 6))


@query(_WN.replace("WITH s AS", f"WITH f0 AS (SELECT query_id, image_id, q AS f FROM ({_SEED}) WHERE r <= 50 AND q > 0), s AS") + "SELECT p.query_id, wn.src AS image_id, round(sum(wn.w * p.f), 6) AS f FROM wn JOIN f0 p ON wn.dst = p.image_id GROUP BY ALL")
def graph_mat_vec(spark, d):
    seed = graph.query_seed(_vectors(spark, d), _seeds(spark, d)).withColumnRenamed("q", "f")
    return graph.mat_vec(_wn(spark, d), seed).withColumn("f", F.round("f", 6))


def _ranked(f, k=100):
    from pyspark.sql import Window

    f = f.withColumn("f", F.round("f", 5))
    w = Window.partitionBy("query_id").orderBy(F.desc("f"), "image_id")
    ranked = f.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "image_id", "rank", F.round((2 + F.col("f")) / 2, 6).alias("score"))


@query()
def diffusion_minres(spark, d):
    """The diffusion shortlist: seed, minimum-residual solve, descending order, score (2 + f) / 2."""
    return _ranked(diffusion.minres(_wn(spark, d), graph.query_seed(_vectors(spark, d), _seeds(spark, d))))


@query(_WN.replace("WITH s AS", f"WITH f0 AS (SELECT query_id, image_id, q AS f FROM ({_SEED}) WHERE r <= 50 AND q > 0), s AS") + "".join(_STEPS) + """, o AS (SELECT query_id, image_id, round(f, 5) AS f FROM f40)
SELECT query_id, image_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, image_id) AS rank, round((2 + f) / 2, 6) AS score FROM o QUALIFY rank <= 100""")
def diffusion_converged(spark, d):
    """The same by table iterations, for graphs of any size."""
    return _ranked(diffusion.neumann(_wn(spark, d), graph.query_seed(_vectors(spark, d), _seeds(spark, d)), rounds=40))


@query()
def diffusion_conjugate(spark, d):
    """The same by conjugate residuals on tables: the iterates of the minimum-residual solve without its bound on the graph."""
    return _ranked(diffusion.conjugate_residual(_wn(spark, d), graph.query_seed(_vectors(spark, d), _seeds(spark, d))))


@query()
def spectral_rank(spark, d):
    return _ranked(diffusion.spectral(_wn(spark, d), graph.query_seed(_vectors(spark, d), _seeds(spark, d)), rank=400))


@query()
def truncated_diffusion(spark, d):
    v = _vectors(spark, d)
    seed = graph.query_seed(v, _seeds(spark, d), keep=10).withColumn("q", F.round(V.sim_kernel("q"), 9))
    return _ranked(diffusion.truncated(_wn(spark, d), seed))


@query(_MUTUAL + ", h0 AS (SELECT DISTINCT vec_id AS query_id, vec_id AS image_id FROM embeddings WHERE vec_id % 50 = 0), h1 AS (SELECT query_id, image_id FROM h0 UNION SELECT query_id, dst FROM h0 JOIN m ON src = image_id) SELECT query_id, image_id FROM h1")
def k_hop_nodes(spark, d):
    m = graph.mutual_min(graph.kernel_edges(_vectors(spark, d)))
    seeds = _vectors(spark, d).filter(F.col("image_id") % EVERY == 0).select(F.col("image_id").alias("query_id"), "image_id")
    return graph.k_hop_nodes(m, seeds, 1)


@query(_MUTUAL + ", h1 AS (SELECT DISTINCT vec_id AS query_id, vec_id AS image_id FROM embeddings WHERE vec_id % 50 = 0), h2 AS (SELECT query_id, image_id FROM h1 UNION SELECT query_id, dst FROM h1 JOIN m ON src = image_id) SELECT q.query_id, e.vec_id AS image_id, h2.image_id IS NOT NULL AS reached FROM (SELECT DISTINCT query_id FROM h1) q CROSS JOIN embeddings e LEFT JOIN h2 ON h2.query_id = q.query_id AND h2.image_id = e.vec_id")
def full_ranking(spark, d):
    """Reached nodes and, after them, all others of the collection."""
    m = graph.mutual_min(graph.kernel_edges(_vectors(spark, d)))
    seeds = _vectors(spark, d).filter(F.col("image_id") % EVERY == 0).select(F.col("image_id").alias("query_id"), "image_id")
    reached = graph.k_hop_nodes(m, seeds, 1).withColumn("f", F.lit(1.0))
    return diffusion.full_ranking(reached, _vectors(spark, d)).select("query_id", "image_id", "reached")


@query()
def routed_graph(spark, d):
    """The kernel graph of all image descriptors, rows compared within the cells they visit."""
    described = table(spark, d, "global_desc").select(F.col("image_id").alias("id"), F.col("global_descs").alias("vec"), "described_at")
    g = one_per_id(described.filter("id is not null"), "described_at").withColumnsRenamed({"id": "image_id", "vec": "v"})
    clean = g.filter("size(v) = 96").filter(~F.exists("v", lambda x: F.isnan(x) | x.isNull()) & (V.dot("v", "v") > 1e-12)).select("image_id", V.l2_normalize("v").alias("embedding"))
    return graph.kernel_edges(clean, 50, exact_rows=0)


@query()
def random_shortlist(spark, d):
    return knn.random_shortlist(table(spark, d, "images"), 100, seed=42)
