"""Answering search requests: mode dispatch, crops, merging of verified and unverified results, pages, envelopes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the protocol.
DEFAULT_PREFIX = "collection"
PATH_COLOUR = "#edae49"
SEARCH_MODES = {
    "similarity": ("skip", False),
    "similarity-bbox": ("skip", True),
    "num-inliers": ("num_inliers", False),
    "num-inliers-bbox": ("num_inliers", True),
    "zoom-in": ({"homography": "scale_factor_max", "vlm": "vlm_zoom_in"}, True),
    "zoom-out": ({"homography": "scale_factor_min", "vlm": "vlm_zoom_out"}, True),
}


@dataclass(frozen=True)
class Config:
    """Settings of an engine; ``with_options`` gives a changed copy and refuses names it does not know. The defaults are fixed values of the protocol."""

    global_features: str = "dinosalad"
    local_features: str = "xfeat"
    num_local_features: int = 4_096
    quantize_local_desc: bool = False
    local_desc_image_size: tuple[int, int] = (800, 600)
    local_desc_batch_size: int = 2
    global_desc_image_size: int = 448
    global_desc_batch_size: int = 2
    matching_method: str = "smnn"
    resort_criterion: str = "scale_factor_max"
    inl_th: float = 2.0
    num_iter: int = 2_000
    num_nn: int = 100
    use_diffusion: bool = False
    force_recache: bool = False
    vlm_model: str = "qwen2vl-2b"
    vlm_bbox: tuple[int, int, int, int] | None = None
    input_dir: str = ""
    upload_dir: str = ""
    prefix: str = DEFAULT_PREFIX

    def with_options(self, **options: Any) -> Config:
        return replace(self, **options)


@dataclass(frozen=True)
class Plan:
    """What a request asks for."""

    criterion: str
    crop: bool
    path: str | None
    box: tuple[float, float, float, float] | None
    diffusion: bool
    matching_method: str
    vlm_model: str
    limit: int
    offset: int
    shortlist_size: int


def criterion_of(mode: str | None, zooming: str = "homography") -> tuple[str, bool]:
    """(criterion, whether the query is cropped) of a search mode; none given means similarity."""
    if (mode or "similarity") not in SEARCH_MODES:
        raise ValueError(f"Unknown search mode: {mode}")
    criterion, crop = SEARCH_MODES[mode or "similarity"]
    return (criterion if isinstance(criterion, str) else criterion["vlm" if zooming == "vlm" else "homography"]), crop


def shortlist_size(offset: int, limit: int) -> int:
    return max(300, min(10 * (offset + limit), 1_000))


def query_path(path: str, prefix: str, config: Config) -> str:
    """The place of a query image by the prefix of its request."""
    if prefix == "upload":
        return f"{config.upload_dir.rstrip('/')}/{path}"
    if prefix == config.prefix:
        return f"{config.input_dir.rstrip('/')}/{path}".replace(f"{prefix}/{prefix}", prefix)
    return path


def plan_request(request: dict, config: Config = Config()) -> Plan:
    """Read a request ``{"data": {...}}``; one without a query is for browsing."""
    data = request["data"]
    limit, offset = int(data["limit"]), int(data["offset"])
    options = data.get("engine_options", {})
    common = {"diffusion": bool(options.get("diffusion", config.use_diffusion)), "matching_method": options.get("matching_method", config.matching_method), "vlm_model": options.get("vlm_model", config.vlm_model), "limit": limit, "offset": offset}
    if "query" not in data:
        return Plan("random", False, None, None, shortlist_size=offset + limit, **common)
    value, mode = data["query"]["value"], data["query"].get("search_mode", {})
    criterion, crop = criterion_of(mode.get("id"), options.get("zooming_alg", "homography"))
    tool = mode["tool_data"] if crop else None
    box = (tool["x1"], tool["y1"], tool["x2"], tool["y2"]) if tool else None
    return Plan(criterion, crop, query_path(value["path"], value.get("prefix", ""), config), box, shortlist_size=shortlist_size(offset, limit), **common)


def crop_pixels(x1, y1, x2, y2, w, h) -> Column:
    """struct(xmin, xmax, ymin, ymax) of a relative box, truncated to pixels and put in order."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    cut = lambda v, size: (c(v) * c(size)).cast("int")
    xa, xb, ya, yb = cut(x1, w), cut(x2, w), cut(y1, h), cut(y2, h)
    return F.struct(F.least(xa, xb).alias("xmin"), F.greatest(xa, xb).alias("xmax"), F.least(ya, yb).alias("ymin"), F.greatest(ya, yb).alias("ymax"))


def merged(verified: DataFrame, shortlist: DataFrame) -> DataFrame:
    """``(query_id, image_id, score, global_similarity, verified, rank)``: verified images (score not 0) by descending score, then
    those of the shortlist that are not among them, in its order and with its score. rank counts from 0 per query.

    ``verified``: ``(query_id, image_id, score)``; ``shortlist``: ``(query_id, rank, image_id, score)``.
    """
    short = shortlist.select("query_id", "image_id", F.col("rank").alias("short_rank"), F.col("score").alias("global_similarity"))
    good = verified.filter("score <> 0 and score is not null").select("query_id", "image_id", "score")
    first = good.join(short, ["query_id", "image_id"]).withColumn("verified", F.lit(True))
    rest = short.join(good, ["query_id", "image_id"], "left_anti").withColumn("score", F.col("global_similarity")).withColumn("verified", F.lit(False))
    every = first.unionByName(rest)
    w = Window.partitionBy("query_id").orderBy(F.desc("verified"), F.when(F.col("verified"), -F.col("score")), "short_rank", "image_id")
    return every.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).drop("short_rank")


def page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows with offset <= rank < offset + limit; beyond the end there are none."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    return ranked.filter((F.col("rank") >= offset) & (F.col("rank") < offset + limit))


@F.pandas_udf(StringType())
def three_digits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Numbers in three significant digits (``%.3g``), which the JVM's formats do not have; used on pages only."""
    for s in batches:
        yield s.map(lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.3g}")


def served_path(path: Column | str, input_dir: str, prefix: str = DEFAULT_PREFIX) -> Column:
    """A path with the collection's folder replaced by the prefix that clients know, wherever it occurs."""
    c = F.col(path) if isinstance(path, str) else path
    return F.replace(c, F.lit(input_dir if input_dir.endswith("/") else input_dir + "/"), F.lit(prefix + "/"))


def path_overlay(points: Column | str) -> Column:
    """Polygon points as an overlay; no points give an empty list."""
    c = F.col(points) if isinstance(points, str) else points
    one = F.array(F.struct(F.lit(PATH_COLOUR).alias("color"), F.transform(c, lambda p: F.array(p["x"], p["y"])).alias("points_xy")))
    return F.when(F.size(F.coalesce(c, F.array().cast("array<struct<x:double,y:double>>"))) > 0, one).otherwise(F.array().cast("array<struct<color:string,points_xy:array<array<double>>>>"))


def result_rows(rows: DataFrame, images: DataFrame, criterion: str, input_dir: str, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """``(query_id, rank, path, rank_text, score_text, text_info, prefix)`` of a page ``(query_id, image_id, score, global_similarity, rank)``."""
    out = rows.join(images.select("image_id", "path"), "image_id")
    return out.select(
        "query_id",
        "rank",
        served_path("path", input_dir, prefix).alias("path"),
        F.concat(F.lit("Rank: "), F.col("rank").cast("string")).alias("rank_text"),
        F.concat(F.lit(criterion + ": "), three_digits("score"), F.lit(", global_similarity: "), three_digits("global_similarity")).alias("score_text"),
        F.format_string("%.3f", F.col("score")).alias("text_info"),
        F.lit(prefix).alias("prefix"),
    )


def envelope(result: DataFrame) -> DataFrame:
    """``(query_id, images)``: the page of each query as one JSON array in order of rank; a page bounds its size."""
    item = F.struct(
        "rank",
        F.struct("path", F.struct(F.col("rank_text").alias("rank"), F.col("score_text").alias("score")).alias("overlays"), F.struct("text_info").alias("output_information"), "prefix").alias("image"),
    )
    return result.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["image"])).alias("images"))


#: Matching methods in the order in which they are offered, as far as there is a matcher for them.
OFFERED_METHODS = ("snn", "smnn", "adalam", "lightglue")
CAPABILITIES = {
    "engine_options": ["matching_method", "diffusion", "zooming_alg", "vlm_model"],
    "images_overlays": ["rank", "paths_over", "score"],
    "search_types": ["image", "upload"],
    "search_modes": list(SEARCH_MODES),
}


def capabilities() -> dict:
    """What the service offers: options with their values and defaults, overlays, search types and modes."""
    from vistaforge.operators.match import METHODS
    from vistaforge.operators.vlm import MODEL_SHORTCUTS

    methods = [m for m in OFFERED_METHODS if m in METHODS]
    values = {"matching_method": (methods, "lightglue" if "lightglue" in methods else Config.matching_method), "diffusion": (None, True), "zooming_alg": (["homography", "vlm"], "homography"), "vlm_model": (list(MODEL_SHORTCUTS), "qwen2vl-2b")}
    options = [{"id": k, "label": k, "default": d, "type": "option" if v else "bool"} | ({"values": v} if v else {}) for k, (v, d) in values.items()]
    overlays = [{"id": k, "label": k, "default": True, "type": "paths" if k == "paths_over" else "text"} for k in CAPABILITIES["images_overlays"]]
    modes = [{"id": m, "label": m.replace("-", " ").capitalize(), "type": "image"} | ({"tool": "rectangle"} if crop else {}) for m, (_, crop) in SEARCH_MODES.items()]
    return {"data": {"engine_options": options, "images_overlays": overlays, "search_types": CAPABILITIES["search_types"], "search_modes": modes}}


def echo(payload: dict) -> dict:
    return {"message": "Image processed", "data": payload}
