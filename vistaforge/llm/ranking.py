"""One ranking from differently scaled scores by leximin over percentiles.

Each score becomes the candidate's mid-rank percentile among the candidates of its query that have that score, so neither
range nor an extreme value matters. A candidate's percentiles are sorted ascending and compared lexicographically: the one whose
weakest score is better comes first, then the second weakest decides, and so on, so a weak score cannot be masked by a
strong one. A missing score is replaced by the mean of the candidate's own percentiles, which never is its weakest nor
its strongest and so counts neither for nor against it.

``of`` = m compares, instead of single percentiles, the means of every m of them, again sorted ascending: the item whose weakest m
scores are better together comes first. A weak score is part of the first mean that is compared, so it is never masked, but it does not
decide alone; with m = 1 this is plain leximin, with all scores the order by their mean.

Plan. Equal scores are counted before anything is ordered (map-side aggregation); positions within a query come from a range
partitioning by (query, criterion, score) with per-partition totals carried forward, so a query that holds a third of all
rows is spread over many tasks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaforge.session import cut


def percentiles(scores: DataFrame) -> DataFrame:
    """``(query_id, image_id, criterion, pct)`` for rows ``(query_id, image_id, criterion, score)`` of one score each.

    pct = (rows below + half of the equal rows) / rows, within (query, criterion); NULL and NaN scores are left out.
    """
    s = scores.select("query_id", "image_id", "criterion", "score").filter("score is not null and not isnan(score)")
    key = ["query_id", "criterion"]
    tallied = s.groupBy(*key, "score").agg(F.count("*").alias("n"))
    spread = cut(tallied.repartitionByRange(*[F.col(c) for c in key], F.col("score")).withColumn("pid", F.spark_partition_id()))
    parts = spread.groupBy(*key, "pid").agg(F.sum("n").alias("part_n"))
    before = Window.partitionBy(*key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_n").over(before), F.lit(0))).withColumn("total", F.sum("part_n").over(Window.partitionBy(*key)))
    inside = Window.partitionBy("pid", *key).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, [*key, "pid"])
    pct = placed.select(*key, "score", ((F.col("before") + F.col("below") + F.col("n") / 2) / F.col("total")).alias("pct"))
    return s.join(pct, [*key, "score"]).select("query_id", "image_id", "criterion", "pct")


def leximin_ranking(scores: DataFrame, candidates: DataFrame, criteria: list[str], of: int = 1) -> DataFrame:
    """``(query_id, image_id, rank, weakest)``: one order of each query's candidates.

    ``scores``: ``(query_id, image_id, criterion, score)``, higher is better; repeats of one (query, image, criterion) count
    once (the greatest value), rows of other criteria and of images that are no candidates are ignored.
    ``candidates``: ``(query_id, image_id)``, repeats count once, NULL keys are dropped. Candidates without any score get the
    neutral percentile 0.5 throughout. Equal vectors are ordered by image_id.
    """
    cand = candidates.select("query_id", "image_id").filter("query_id is not null and image_id is not null").distinct()
    one = scores.select("query_id", "image_id", "criterion", F.col("score").cast("double").alias("score")).filter(F.col("criterion").isin(criteria)).groupBy("query_id", "image_id", "criterion").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score"))
    pct = percentiles(one.join(cand, ["query_id", "image_id"], "left_semi"))
    own = pct.groupBy("query_id", "image_id").agg(F.sort_array(F.collect_list("pct")).alias("own"), F.avg("pct").alias("mean"))
    full = cand.join(own, ["query_id", "image_id"], "left")
    size = F.size(F.coalesce("own", F.array().cast("array<double>")))
    fill = F.array_repeat(F.coalesce("mean", F.lit(0.5)), F.lit(len(criteria)) - size)
    full = full.withColumn("vec", F.transform(F.sort_array(F.concat(F.coalesce("own", F.array().cast("array<double>")), fill)), lambda x: F.round(x, 9)))
    full = full.withColumn("weakest", F.array_min("vec"))
    if of > 1:
        means = [F.round(sum((F.col("vec")[i] for i in some), F.lit(0.0)) / of, 9) for some in combinations(range(len(criteria)), of)]
        full = full.withColumn("vec", F.sort_array(F.array(*means)))
    w = Window.partitionBy("query_id").orderBy(F.desc("vec"), "image_id")
    return full.withColumn("rank", F.row_number().over(w)).select("query_id", "image_id", "rank", "weakest")


def leximin_top(scores: DataFrame, candidates: DataFrame, criteria: list[str], k: int, of: int = 1) -> DataFrame:
    """The best ``k`` candidates of each query; the limit goes below the window's shuffle."""
    return leximin_ranking(scores, candidates, criteria, of).filter(F.col("rank") <= k)
