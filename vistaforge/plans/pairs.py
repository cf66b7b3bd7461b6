"""From the files of two pictures to their matches: detection, matching, and refinement where the model gives it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vistaforge.operators import match, planes
from vistaforge.sources import extract


def match_files(left: DataFrame, right: DataFrame, key: str, model: Callable[[], object], method: str = "mnn", most: int | None = 4_096, **options) -> DataFrame:
    """``(query_id, image_id, q_idx, db_idx, x1, y1, x2, y2)`` for files ``(image_id, content)`` of queries and of images, each with each."""
    q = extract.local_features(left, key, model, most).withColumnRenamed("image_id", "query_id")
    d = extract.local_features(right, key, model, most)
    return match.matched_points(match.match_features(q, d, method, **options), q, d)


def refined(points: DataFrame, offsets: DataFrame, scales: DataFrame, least: float = 0.25) -> DataFrame:
    """Matches whose place in the query is moved by what a model says of the pair (``planes.refined``).

    ``offsets``: ``(query_id, image_id, q_idx, db_idx, logits)``, an 8 by 8 field of logits each; ``scales``: ``(query_id, q_idx, scale)``, the size of
    the query's keypoints. Matches of a confidence up to ``least`` are dropped."""
    met = points.join(offsets, ["query_id", "image_id", "q_idx", "db_idx"]).join(scales, ["query_id", "q_idx"])
    return planes.refined(met, least).drop("logits", "scale")
