"""Stored results: where they lie, and whether they still hold.

A result is a Parquet folder with a manifest of what it was made from (number and fingerprint of the images, settings), so
a changed collection or setting is never answered from an old result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistaforge.functions.vectors import dequantize


def cache_folder(img_dir: str, index_dir: str | None = None) -> str:
    return index_dir if index_dir is not None else "./tmp/" + img_dir.replace("/", "_")


def global_index_path(folder: str, features: str) -> str:
    return f"{folder}/{features}_global_index"


def graph_path(folder: str, features: str) -> str:
    return f"{folder}/{features}_Wn"


def local_feature_path(folder: str, features: str, count: int, quantized: bool = False) -> str:
    return f"{folder}/{features}_{count}" + ("_uint8" if quantized else "")


def fingerprint(images: DataFrame) -> DataFrame:
    """One row ``(n, fingerprint)``: number of paths and the sum of 32 bits of their MD5, in any order."""
    part = F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long")
    return images.select("path").agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).alias("fingerprint"))


def _manifest(spark: SparkSession, path: str) -> dict | None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path + ".manifest")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(path + ".manifest").collect()) or "{}")


def cached(spark: SparkSession, path: str, images: DataFrame, settings: dict, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path`` if its manifest matches the images and settings; else it is made and written."""
    want = _wanted(images, settings)
    if force or _manifest(spark, path) != want:
        make().write.mode("overwrite").parquet(path)
        _write_manifest(spark, path, want)
    return spark.read.parquet(path)


def _wanted(images: DataFrame, settings: dict) -> dict:
    f = fingerprint(images).first()
    return json.loads(json.dumps({"n": f["n"], "fingerprint": f["fingerprint"], "settings": settings}))


def _write_manifest(spark: SparkSession, path: str, want: dict) -> None:
    spark.createDataFrame([(json.dumps(want, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path + ".manifest")


def cached_features(spark: SparkSession, path: str, images: DataFrame, settings: dict, make: Callable[[], DataFrame], force: bool = False) -> None:
    """``cached`` for a store of local features: what is missing is made and written by ``write_local_features``."""
    want = _wanted(images, settings)
    if force or _manifest(spark, path) != want:
        write_local_features(make(), path)
        _write_manifest(spark, path, want)


def read_all_features(spark: SparkSession, path: str, quantized: bool = False) -> DataFrame:
    """The whole store, descriptors as floats."""
    f = spark.read.parquet(path).drop("bucket")
    return f.withColumn("desc", dequantize("desc")) if quantized else f


def feature_slice(spark: SparkSession, path: str, offsets: DataFrame, first: int, last: int, buckets: int = 64) -> DataFrame:
    """Rows ``first <= row < last`` of the store in the order of (image_id, kp_idx), with their ``row``. ``offsets``: ``(image_id, n, start)`` as
    ``shapes.feature_offsets`` gives them; only the images that the slice touches are read."""
    touched = offsets.filter((F.col("start") < last) & (F.col("start") + F.col("n") > first)).select("image_id", "start")
    rows = read_local_features(spark, path, touched, buckets).join(touched, "image_id")
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("kp_idx")) - 1 + F.col("start")
    return rows.withColumn("row", place).filter((F.col("row") >= first) & (F.col("row") < last)).drop("start")


def write_local_features(features: DataFrame, path: str, buckets: int = 64) -> None:
    """``(image_id, kp_idx, x, y, desc, ...)`` partitioned by a hash of the image, so that a shortlist reads few files."""
    features.withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_local_features(spark: SparkSession, path: str, shortlist: DataFrame, buckets: int = 64) -> DataFrame:
    """Features of the shortlist's images; the bucket is part of the join key, so partitions without any are pruned."""
    wanted = shortlist.select("image_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int"))
    return spark.read.parquet(path).join(wanted, ["bucket", "image_id"]).drop("bucket")


def merge_verdicts(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The verdict cache ``(key, category, confidence)`` at ``path`` after ``new`` was added; new verdicts replace old ones.

    The merged table is written beside the old one and takes its name when it is complete; the former is kept under ``.old`` until then
    and is taken up again if a run ended between the two renames."""
    place, merged, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".merged", ".old"))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place) and fs.exists(old):
        fs.rename(old, place)
    fresh = new.groupBy("key").agg(F.max_by(F.struct("category", "confidence"), F.struct("confidence", "category")).alias("v")).select("key", "v.category", "v.confidence")
    if fs.exists(place):
        fresh.write.mode("overwrite").parquet(path + ".new")
        fresh = spark.read.parquet(path + ".new")
        fresh = spark.read.parquet(path).join(fresh, "key", "left_anti").unionByName(fresh)
    fresh.write.mode("overwrite").parquet(path + ".merged")
    fs.delete(old, True)
    if fs.exists(place):
        fs.rename(place, old)
    fs.rename(merged, place)
    fs.delete(old, True)
    return spark.read.parquet(path)


def export_json(verdicts: DataFrame) -> DataFrame:
    """One JSON object per row, ``{key: [category, confidence]}``."""
    return verdicts.select(F.to_json(F.create_map("key", F.array("category", F.col("confidence").cast("string")))).alias("json"))


def import_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """``(key, category, confidence)`` from rows of JSON objects ``{key: [category, confidence], ...}``; the greater verdict of a
    repeated key holds."""
    pairs = texts.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("key", "v"))
    rows = pairs.select("key", F.col("v")[0].alias("category"), F.col("v")[1].try_cast("double").alias("confidence"))
    return rows.groupBy("key").agg(F.max_by(F.struct("category", "confidence"), F.struct("confidence", "category")).alias("v")).select("key", "v.category", "v.confidence")
