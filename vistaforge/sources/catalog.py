"""Image catalogs from folders or lists, header sizes, and repair of file names without extension."""

from __future__ import annotations

import os
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaforge.operators.position import with_position
from vistaforge.session import cut

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif")
#: Leading bytes (hex) by type, and the extension they get (fixed values).
MAGIC = (("ffd8ff", "jpg"), ("89504e470d0a1a0a", "png"), ("474946383761", "gif"), ("474946383961", "gif"), ("424d", "bmp"), ("49492a00", "tiff"), ("4d4d002a", "tiff"))


def is_image_path(path: Column | str, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.lower(c).rlike(r"\.(" + "|".join(extensions) + r")$")


def catalog(paths: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``(image_id, path)`` of the image paths among ``paths``, each once; the id is the place in path order.

    Ids are given once and should be stored: adding files later renumbers them (see ``append_to_catalog``)."""
    return with_position(paths.select("path").filter(is_image_path("path", extensions)).distinct(), "path", name="image_id").select("image_id", "path")


def scan_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The catalog of a folder and all below it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    return catalog(files, extensions)


def from_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(image_id, path)`` in the order given, unfiltered; a path given twice has two ids."""
    return spark.createDataFrame(list(enumerate(paths)), "image_id long, path string")


def append_to_catalog(known: DataFrame, paths: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``known`` and the new paths after it; ids once given stay."""
    start = known.agg(F.coalesce(F.max("image_id") + 1, F.lit(0))).first()[0]
    new = catalog(paths.join(known, "path", "left_anti"), extensions)
    return known.select("image_id", "path").unionByName(new.withColumn("image_id", F.col("image_id") + start))


def sniffed_type(head: Column | str) -> Column:
    """The extension that a file's first bytes ask for, or NULL."""
    c = F.lower(F.hex(F.col(head) if isinstance(head, str) else head))
    out = F.lit(None).cast("string")
    for magic, ext in reversed(MAGIC):
        out = F.when(F.startswith(c, F.lit(magic)), ext).otherwise(out)
    return out


def repair_plan(files: DataFrame) -> DataFrame:
    """``(path, new_path)`` for files ``(path, head)`` without extension whose bytes are an image's.

    The new name is path.ext or, where that exists, path_N.ext with the least free N from 1. ``apply_repair`` renames."""
    base = F.element_at(F.split("path", "/"), -1)
    bare = files.filter(~base.rlike(r"[^.].*\.[^.]*$") & sniffed_type("head").isNotNull()).select("path", sniffed_type("head").alias("ext"))
    names = files.select(F.col("path").alias("name"))
    tries = bare.withColumn("stem", F.col("path"))
    taken = names.withColumn("stem", F.regexp_replace("name", r"(_\d+)?\.[^./]*$", "")).groupBy("stem").agg(F.count("*").alias("n"))
    tries = tries.join(taken, "stem", "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n"), F.lit(0)).cast("int"))))
    tries = tries.withColumn("name", F.concat("path", F.when(F.col("i") > 0, F.concat(F.lit("_"), F.col("i").cast("string"))).otherwise(""), F.lit("."), "ext"))
    free = tries.join(names, "name", "left_anti")
    return free.groupBy("path").agg(F.min_by("name", "i").alias("new_path"))


def apply_repair(plan: DataFrame) -> DataFrame:
    """``(path, new_path, renamed)`` after renaming the files of a ``repair_plan`` in the tasks that hold its rows. A file that is gone, or whose
    new name has been taken since, is left alone; so a task that runs twice does no harm. Needs a file system that all executors mount."""

    def run(batches):
        for pdf in batches:
            done = []
            for a, b in zip(pdf["path"], pdf["new_path"]):
                free = os.path.exists(a) and not os.path.exists(b)
                if free:
                    os.rename(a, b)
                done.append(free)
            yield pdf.assign(renamed=done)

    return cut(plan.select("path", "new_path").mapInPandas(run, "path string, new_path string, renamed boolean"))


def header_size(data: bytes) -> tuple[int | None, int | None]:
    """(height, width) from the first bytes of PNG, GIF, BMP or JPEG; EXIF orientations 5 to 8 swap them; unreadable is (None, None)."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h = struct.unpack(">II", data[16:24])
        elif data[:4] == b"GIF8":
            w, h = struct.unpack("<HH", data[6:10])
        elif data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            h = abs(h)
        elif data[:2] == b"\xff\xd8":
            return _jpeg_size(data)
        else:
            return None, None
        return h, w
    except (struct.error, IndexError):
        return None, None


def _jpeg_size(data: bytes) -> tuple[int | None, int | None]:
    at, turned = 2, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None, None
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\x00\x00":
            turned = _orientation(data[at + 10 : at + 2 + size]) in (5, 6, 7, 8)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return (w, h) if turned else (h, w)
        at += 2 + size
    return None, None


def _orientation(tiff: bytes) -> int:
    try:
        order = "<" if tiff[:2] == b"II" else ">"
        start = struct.unpack(order + "I", tiff[4:8])[0]
        for i in range(struct.unpack(order + "H", tiff[start : start + 2])[0]):
            entry = tiff[start + 2 + 12 * i : start + 14 + 12 * i]
            if struct.unpack(order + "H", entry[:2])[0] == 274:
                return struct.unpack(order + "H", entry[8:10])[0]
    except struct.error:
        pass
    return 1


def header_sizes(files: DataFrame, head: str = "head", key: str = "image_id") -> DataFrame:
    """``(key, h, w)`` from the first bytes of each file, or from all of them; Arrow batches, no pixels."""

    def run(batches):
        for pdf in batches:
            got = [header_size(bytes(b)) if b is not None else (None, None) for b in pdf["head"]]
            out = pd.DataFrame(got, columns=["h", "w"]).astype("Int64")
            yield pd.concat([pdf[["key"]].reset_index(drop=True), out], axis=1)

    rows = files.select(F.col(key).alias("key"), F.col(head).alias("head"))
    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, h int, w int").withColumnRenamed("key", key)
