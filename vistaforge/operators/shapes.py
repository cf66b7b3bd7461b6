"""Sizes, shapes and offsets: what networks make of an image, batches of equal shape, and places of features in a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaforge.operators.position import running_total, with_position


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def patch_shape(w: Column | str, h: Column | str, size: int = 512, patch: int = 16) -> Column:
    """struct(h, w) of an image whose long side is scaled to ``size`` (halves to even) and cropped to whole patches; a square
    becomes three quarters as high. NULL and sizes below 1 give NULL."""
    w, h = _c(w), _c(h)
    longest = F.greatest(w, h)
    fit = lambda x: F.bround(x * size / longest).cast("int")
    half = lambda x: F.floor((2 * F.floor(x / 2)) / patch) * patch / 2
    nw, nh = fit(w), fit(h)
    hw = half(nw)
    hh = F.when(nw == nh, 3 * hw / 4).otherwise(half(nh))
    return F.when((w > 0) & (h > 0), F.struct((2 * hh).cast("int").alias("h"), (2 * hw).cast("int").alias("w")))


def patch_centre(index: Column | str, width: Column | str, patch: int = 16) -> Column:
    """struct(x, y): the middle of patch number ``index`` in an image of ``width`` pixels."""
    per_row = F.floor(_c(width) / patch)
    return F.struct(((_c(index) % per_row + 0.5) * patch).alias("x"), ((F.floor(_c(index) / per_row) + 0.5) * patch).alias("y"))


def multiple_of_32(w: Column | str, h: Column | str) -> Column:
    """struct(h, w, rh, rw): size cut down to multiples of 32, and the factors back to the original; NULL below 32."""
    w, h = _c(w), _c(h)
    nw, nh = F.floor(w / 32) * 32, F.floor(h / 32) * 32
    return F.when((nw > 0) & (nh > 0), F.struct(nh.cast("int").alias("h"), nw.cast("int").alias("w"), (h / nh).alias("rh"), (w / nw).alias("rw")))


def rescaled(x: Column | str, size: Column | str, original: Column | str) -> Column:
    """A coordinate in an image of ``size`` in the pixels of the original."""
    return _c(x) * _c(original) / _c(size)


def shape_histogram(sizes: DataFrame) -> DataFrame:
    """``(h, w, n)`` by frequency."""
    return sizes.groupBy("h", "w").agg(F.count("*").alias("n"))


def commonest_shape(sizes: DataFrame) -> DataFrame:
    return shape_histogram(sizes.filter("h is not null and w is not null")).orderBy(F.desc("n"), "h", "w").limit(1)


def shape_batches(shapes: DataFrame, size: int) -> DataFrame:
    """``(image_id, h, w, batch)``: batches of at most ``size`` images of equal shape, in order of id within a shape. Places come from a
    range partitioning, so the commonest shape is no single task."""
    placed = with_position(shapes, "h", "w", "image_id")
    first = placed.groupBy("h", "w").agg(F.min("position").alias("first"))
    same = F.col("h").eqNullSafe(F.col("fh")) & F.col("w").eqNullSafe(F.col("fw"))
    out = placed.join(first.withColumnsRenamed({"h": "fh", "w": "fw"}), same)
    return out.withColumn("batch", F.floor((F.col("position") - F.col("first")) / size).cast("long")).drop("position", "first", "fh", "fw")


def batch_statistics(batches: DataFrame) -> DataFrame:
    """One row ``(n_batches, mean_size, least, most)``."""
    sized = batches.groupBy("h", "w", "batch").agg(F.count("*").alias("n"))
    return sized.agg(F.count("*").alias("n_batches"), F.avg("n").alias("mean_size"), F.min("n").alias("least"), F.max("n").alias("most"))


def feature_offsets(counts: DataFrame) -> DataFrame:
    """``(image_id, n, start)``: the first row of each image's features in a store ordered by image."""
    return running_total(counts.select("image_id", "n"), "n", "image_id", name="start")


def image_chunks(offsets: DataFrame, rows: int) -> DataFrame:
    """Offsets with ``chunk``: whole images only, about ``rows`` features each."""
    return offsets.withColumn("chunk", F.floor(F.col("start") / rows).cast("long"))


def descriptor_statistics(features: DataFrame, vec: str = "desc") -> DataFrame:
    """``(image_id, least, greatest, mean, deviation)`` over all values of an image's vectors (population deviation)."""
    flat = features.select("image_id", F.explode(vec).alias("x")).withColumn("x", F.col("x").cast("double"))
    return flat.groupBy("image_id").agg(F.min("x").alias("least"), F.max("x").alias("greatest"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
