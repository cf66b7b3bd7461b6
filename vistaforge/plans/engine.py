"""A search from request to answer: plan, shortlist, re-rank, merge, page."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistaforge.functions.vectors import shortlist_score
from vistaforge.operators import asmk, diffusion, geometry, graph, knn, match, serve, vlm
from vistaforge.plans.index import INVERTED_FILE, Index, shortlisted_features
from vistaforge.sources import catalog, extract, images

QUERY = 0


@dataclass(frozen=True)
class QueryImage:
    """What an extractor slot gives for a query: its vector, its local features ``(kp_idx, x, y, desc)`` and its size."""

    vector: list[float] | None
    features: DataFrame | None
    h: int
    w: int


def describer(spark: SparkSession, config: serve.Config, global_model: Callable[[], object], local_model: Callable[[], object]) -> Callable[[str, tuple | None], QueryImage]:
    """``describe(path, box)`` for an Engine from the same models as the index: the file is read, cut to the box (relative, x1 y1 x2 y2)
    where there is one, and described as an image of one row."""

    def describe(path: str, box: tuple | None) -> QueryImage:
        content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        if box is not None:
            pixels = images.decode(content)
            (x1, y1, x2, y2), (h, w) = box, pixels.shape[:2]
            xs, ys = sorted((int(x1 * w), int(x2 * w))), sorted((int(y1 * h), int(y2 * h)))
            content = images.encode_png(images.crop(pixels, xs[0], ys[0], xs[1], ys[1]))
        one = spark.createDataFrame([(QUERY, bytearray(content))], "image_id long, content binary")
        features = extract.local_features(one, config.local_features, local_model, config.num_local_features).drop("image_id")
        vector = None if config.global_features == INVERTED_FILE else list(extract.global_descriptors(one, config.global_features, global_model).first()["embedding"])
        h, w = catalog.header_size(content)
        return QueryImage(vector, features, h or 0, w or 0)

    return describe


class Engine:
    """Answers requests over an index. ``describe(path, box)`` gives the QueryImage of a (cropped) query; ``model`` answers prompts."""

    def __init__(self, spark: SparkSession, index: Index, config: serve.Config, describe: Callable[[str, tuple | None], QueryImage], model: Callable[[str, list], str] | None = None, seed: int = 0) -> None:
        self.spark, self.index, self.config, self.describe, self.model, self.seed = spark, index, config, describe, model, seed

    def shortlist(self, q: QueryImage, k: int, use_diffusion: bool = False) -> DataFrame:
        """``(query_id, rank, image_id, score)``: the ``k`` nearest by distance, by diffusion from the nearest, or by the inverted file."""
        if self.config.global_features == INVERTED_FILE:
            met = asmk.query_inverted_file(self.index.vectors, asmk.postings(q.features.select(F.lit(QUERY).cast("long").alias("image_id"), "desc"), self.index.words).withColumnRenamed("image_id", "query_id"), k)
            return met.select("query_id", (F.col("rank") - 1).alias("rank"), "image_id", "score")
        if use_diffusion:
            asked = self.spark.createDataFrame([(QUERY, [float(x) for x in q.vector])], "query_id long, embedding array<double>")
            f = diffusion.diffuse(self.index.edges, graph.query_seed(self.index.vectors, asked))
            near = f.orderBy(F.desc("f"), "image_id").limit(k).select("image_id", F.col("f").alias("order"), ((2 + F.col("f")) / 2).alias("score"))
        else:
            near = knn.l2_shortlist(self.index.vectors, q.vector, k).select("image_id", (-F.col("dist")).alias("order"), shortlist_score("dist").alias("score"))
        w = Window.orderBy(F.desc("order"), "image_id")
        return near.select(F.lit(QUERY).cast("long").alias("query_id"), (F.row_number().over(w) - 1).alias("rank"), "image_id", "score")

    def verify(self, q: QueryImage, shortlist: DataFrame, criterion: str, method: str) -> DataFrame:
        """``(query_id, image_id, score, points)`` by matching and geometry; points are the query's corners in the image."""
        query = q.features.select(F.lit(QUERY).cast("long").alias("query_id"), "kp_idx", "x", "y", "desc")
        db = shortlisted_features(self.spark, self.index, self.config, shortlist)
        matches = match.match_features(query, db, method, shortlist.select("query_id", "image_id"))
        v = geometry.verify(match.matched_points(matches, query, db), criterion, self.config.inl_th, self.config.num_iter)
        corners = geometry.projected_corners("h", F.lit(q.h), F.lit(q.w), "hd", "wd")
        sizes = self.index.sizes.select("image_id", F.coalesce("h", F.lit(0)).alias("hd"), F.coalesce("w", F.lit(0)).alias("wd"))
        return v.join(sizes, "image_id").select("query_id", "image_id", "score", corners.alias("points"))

    def judged(self, shortlist: DataFrame, criterion: str, has_box: bool) -> DataFrame:
        """The shortlist by the verdicts of the model; rows that score 0 stay in their order."""
        if self.model is None:
            raise ValueError("this engine has no vision-language model")
        paths = shortlist.join(self.index.images, "image_id")
        answers = vlm.parse_collective(vlm.ask(paths, self.model, has_box).select("query_id", "chunk", "response", "n_candidates", "offset"))
        placed = vlm.chunks(paths).join(answers.withColumnRenamed("candidate", "place"), ["query_id", "chunk", "place"])
        return vlm.resort_by_verdict(shortlist.drop("score"), placed.select("query_id", "image_id", "category", "confidence"), criterion)

    def search(self, request: dict) -> dict:
        """The answer to a request ``{"data": ...}`` as a nested dict; a page bounds what comes to the driver."""
        started = time.perf_counter()
        plan = serve.plan_request(request, self.config)
        if plan.path is None:
            picked = knn.random_shortlist(self.index.images, plan.shortlist_size, self.seed)
            ranked = picked.select(F.lit(QUERY).cast("long").alias("query_id"), "image_id", "score", F.col("score").alias("global_similarity"), "rank")
        else:
            ranked = self._ranked(plan)
        if "points" not in ranked.columns:
            ranked = ranked.withColumn("points", F.lit(None).cast("array<struct<x:double,y:double>>"))
        page = serve.page(ranked, plan.offset, plan.limit)
        rows = serve.result_rows(page, self.index.images, plan.criterion, self.config.input_dir, self.config.prefix)
        drawn = page.select("rank", F.to_json(serve.path_overlay("points")).alias("paths_over"))
        out = []  # keys and texts below are fixed values of the protocol
        for r in rows.join(drawn, "rank").orderBy("rank").collect():
            overlays = {"rank": r["rank_text"], "score": r["score_text"], "paths_over": json.loads(r["paths_over"])}
            out.append({"path": r["path"], "overlays": overlays, "output_information": {"text_info": r["text_info"]}, "prefix": r["prefix"]})
        answer: dict = {"data": {"images": out}}
        if plan.path is not None:
            answer["data"]["query_image"] = {"overlays": {"rank": "", "score": "Query image"}}
            answer["data"]["query_text"] = f"Processed in {time.perf_counter() - started:.4g} seconds"
        return answer

    def _ranked(self, plan: serve.Plan) -> DataFrame:
        q = self.describe(plan.path, plan.box)
        short = self.shortlist(q, plan.shortlist_size, plan.diffusion)
        similarity = short.select("query_id", "image_id", F.col("score").alias("global_similarity"))
        if plan.criterion == "skip":
            return short.withColumn("global_similarity", F.col("score"))
        if plan.criterion.startswith("vlm_"):
            return self.judged(short, plan.criterion, plan.box is not None).join(similarity, ["query_id", "image_id"])
        verified = self.verify(q, short, plan.criterion, plan.matching_method)
        merged = serve.merged(verified.select("query_id", "image_id", "score"), short)
        return merged.join(verified.filter("score <> 0").select("query_id", "image_id", "points"), ["query_id", "image_id"], "left")
