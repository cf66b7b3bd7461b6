"""Queries of this subpackage, and SQL for those that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaforge.llm import clusters, leakage, neardup, neighbours, packing, ranking, repetition, subset

CRITERIA = ["sims", "confidence", "num_inliers", "scale_factor_max"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(neardup.near_duplicate_groups(_t(spark, d, "global_desc")))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(_t(spark, d, "global_desc"))


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    short = _t(spark, d, "shortlist")
    cols = ["query_id", "image_id", "criterion", "score"]
    scores = (
        short.select("query_id", "image_id", F.lit("sims").alias("criterion"), F.col("sims").alias("score"))
        .unionByName(_t(spark, d, "vlm_verdict").select("query_id", "image_id", F.lit("confidence").alias("criterion"), F.col("confidence").alias("score")))
        .unionByName(_t(spark, d, "resort_score").select("query_id", "image_id", F.col("resort_criterion").alias("criterion"), "score"))
        .select(*cols)
    )
    return scores, short.select("query_id", "image_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    scores, cand = _scores(spark, d)
    return ranking.leximin_top(scores, cand, CRITERIA, 10, of=3).select("query_id", "image_id")


def p2_leximin(spark: SparkSession, d: str) -> DataFrame:
    scores, cand = _scores(spark, d)
    return ranking.leximin_ranking(scores, cand, CRITERIA).select("query_id", "image_id", F.col("rank").cast("long").alias("rank"), F.round("weakest", 6).alias("weakest"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    probes = _t(spark, d, "probe_images").filter("for_neighbours").select(F.col("image_id").alias("query_id"))
    return neighbours.neighbour_pairs(neighbours.nearest(_t(spark, d, "global_desc"), probes, 5))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "global_desc")
    asked = rows.filter("image_id % 50 = 0").select(F.col("image_id").alias("query_id"))
    return neighbours.nearest(rows, asked, 10)


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    return subset.subset_coverage(_t(spark, d, "global_desc"), _t(spark, d, "subset_request"))


def p4_subset(spark: SparkSession, d: str) -> DataFrame:
    return subset.varied_subset(_t(spark, d, "global_desc"), _t(spark, d, "subset_request"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    labels = clusters.cluster_labels(_t(spark, d, "global_desc"))
    return clusters.cluster_pairs(labels, _t(spark, d, "probe_images").filter("for_clusters"))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "global_desc")
    return clusters.cluster_report(rows, clusters.cluster_labels(rows))


def _capacity(spark: SparkSession, d: str) -> int:
    return int(_t(spark, d, "pack_capacity").agg(F.min("capacity_tokens")).first()[0])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(packing.pack(_t(spark, d, "documents"), _capacity(spark, d)))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(spark, d, "documents"), _capacity(spark, d))


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    return packing.mixture(packing.pack(_t(spark, d, "documents"), _capacity(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive_documents(_t(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(_t(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_leximin, p3_found, p3_neighbours, p4_coverage, p4_subset, p5_found, p5_clusters, p6_found, p6_containers, p6_mixture, p7_found, p8_found, p8_shares)}


_P2 = """
WITH cand AS (SELECT DISTINCT query_id, image_id FROM shortlist WHERE query_id IS NOT NULL AND image_id IS NOT NULL),
s AS (
  SELECT query_id, image_id, 'sims' AS c, max(sims) AS v FROM shortlist GROUP BY ALL
  UNION ALL SELECT query_id, image_id, 'confidence', max(confidence) FROM vlm_verdict GROUP BY ALL
  UNION ALL SELECT query_id, image_id, resort_criterion, max(score) FROM resort_score
    WHERE resort_criterion IN ('num_inliers', 'scale_factor_max') GROUP BY ALL),
p AS (
  SELECT s.query_id, s.image_id,
    (rank() OVER (PARTITION BY query_id, c ORDER BY v) - 1 + count(*) OVER (PARTITION BY query_id, c, v) / 2.0::DOUBLE)
      / count(*) OVER (PARTITION BY query_id, c) AS p
  FROM s SEMI JOIN cand USING (query_id, image_id) WHERE v IS NOT NULL),
o AS (SELECT query_id, image_id, list(p) AS l, avg(p) AS m FROM p GROUP BY ALL),
f AS (
  SELECT cand.query_id, cand.image_id, list_transform(list_sort(list_concat(coalesce(l, CAST([] AS DOUBLE[])),
      list_resize(CAST([] AS DOUBLE[]), 4 - coalesce(len(l), 0), coalesce(m, 0.5::DOUBLE)))), lambda x: round(x, 9)) AS w
  FROM cand LEFT JOIN o USING (query_id, image_id))
"""


_UNIT = """u AS (SELECT image_id, arg_min(global_descs, described_at)::DOUBLE[] AS v FROM global_desc WHERE image_id IS NOT NULL AND len(global_descs) = 96 GROUP BY image_id),
n AS (SELECT image_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e FROM u
  WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND list_dot_product(v, v) > 1e-12) """


def _chains(threshold: float) -> str:
    """Pairs of images joined by chains of pairs at the threshold, in both directions."""
    return f"""WITH RECURSIVE {_UNIT},
e AS MATERIALIZED (SELECT a.image_id AS a, b.image_id AS b FROM n a JOIN n b ON a.image_id <> b.image_id AND list_dot_product(a.e, b.e) >= {threshold}),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) """


_P8 = r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT row_number() OVER () AS d, doc_id, l FROM t WHERE len(l) > 8),
u AS (SELECT d, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM w),
v AS (SELECT d, i, list(x) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x FROM u),
k AS (SELECT d, i, x, unnest(range(1, 9)) AS o FROM v WHERE len(x) = 8),
h AS (SELECT d, i, o, hash(list_concat(x[1 : o - 1], ['*'], x[o + 1 : 8])) AS key FROM k),
f AS (SELECT d, o, key, min(i) AS first FROM h GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT DISTINCT h.d, h.i FROM h JOIN f USING (d, o, key) WHERE h.i > first),
c AS (SELECT d, count(DISTINCT i + s) AS n FROM r, range(0, 8) g(s) GROUP BY d) """


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _chains(0.95) + "SELECT a AS image_id_a, b AS image_id_b FROM r WHERE a < b",
        "p1_groups": _chains(0.95) + "SELECT a AS image_id, least(a, min(b)) AS group_id FROM r WHERE a <> b GROUP BY a",
        "p3_found": f"""WITH {_UNIT}, k AS (SELECT a.image_id AS a, b.image_id AS b FROM n a JOIN (SELECT DISTINCT image_id FROM probe_images WHERE for_neighbours) USING (image_id), n b
  WHERE a.image_id <> b.image_id QUALIFY row_number() OVER (PARTITION BY a.image_id ORDER BY list_dot_product(a.e, b.e) DESC, b.image_id) <= 5)
SELECT DISTINCT least(a, b) AS image_id_a, greatest(a, b) AS image_id_b FROM k""",
        "p5_found": _chains(0.70) + """, p AS (SELECT DISTINCT image_id FROM probe_images WHERE for_clusters)
SELECT a AS image_id_a, b AS image_id_b FROM r WHERE a < b AND a IN (SELECT image_id FROM p) AND b IN (SELECT image_id FROM p)""",
        "p8_found": _P8 + "SELECT DISTINCT doc_id FROM c JOIN w USING (d) WHERE c.n > len(l) / 2.0",
        "p2_leximin": _P2 + "SELECT query_id, image_id, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, image_id) AS rank, round(w[1], 6) AS weakest FROM f",
        "p2_found": _P2 + """SELECT query_id, image_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY
  list_transform(list_sort([w[1] + w[2] + w[3], w[1] + w[2] + w[4], w[1] + w[3] + w[4], w[2] + w[3] + w[4]]), lambda x: round(x / 3, 9)) DESC, image_id) <= 10""",
    }
