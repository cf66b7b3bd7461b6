"""Building what searches need, once, from a folder of images: catalog, vectors, graph, local features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaforge.functions import vectors as V
from vistaforge.operators import asmk, graph
from vistaforge.operators.graph import EXACT_ROWS
from vistaforge.operators.serve import Config
from vistaforge.sources import cache, catalog, extract


#: The value of ``global_features`` for which images are found by the inverted file over their local features.
INVERTED_FILE = "mast3r"


@dataclass(frozen=True)
class Index:
    """The tables of a collection. With the inverted file, ``vectors`` holds the postings, ``edges`` is None and ``words`` the codebook."""

    images: DataFrame
    vectors: DataFrame
    edges: DataFrame | None
    sizes: DataFrame
    features_path: str
    words: np.ndarray | None = None


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").filter(catalog.is_image_path("path"))


def build_index(spark: SparkSession, folder: str, config: Config, global_model: Callable[[], object] | None, local_model: Callable[[], object], index_dir: str | None = None, k: int = 100, exact_graph_rows: int = EXACT_ROWS) -> Index:
    """Every table is stored with a manifest and made again only if the images or its settings changed (or ``force_recache``).

    Files go through the extractors in the task that reads them, under their path; only results are joined to the catalog,
    so contents are never shuffled. The graph is exact up to ``exact_graph_rows`` images and built by cells beyond (see ``graph.kernel_edges``).
    """
    place = cache.cache_folder(folder, index_dir)
    scanned = catalog.scan_folder(spark, folder)
    images = cache.cached(spark, f"{place}/images", scanned, {}, lambda: scanned, config.force_recache)

    def stored(path: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
        return cache.cached(spark, path, images, settings, make, config.force_recache)

    def named(by_path: DataFrame) -> DataFrame:
        return by_path.join(images, "path").drop("path").select("image_id", *[c for c in by_path.columns if c != "path"])

    files = lambda: _contents(spark, folder)
    sizes = stored(f"{place}/image_size", {}, lambda: named(catalog.header_sizes(files(), "content", "path")))
    path = cache.local_feature_path(place, config.local_features, config.num_local_features, config.quantize_local_desc)
    settings = {"model": config.local_features, "n": config.num_local_features, "quantized": config.quantize_local_desc}

    def features() -> DataFrame:
        f = named(extract.local_features(files(), config.local_features, local_model, config.num_local_features, key_col="path"))
        return f.withColumn("desc", V.quantize("desc")) if config.quantize_local_desc else f

    cache.cached_features(spark, path, images, settings, features, config.force_recache)
    if config.global_features == INVERTED_FILE:
        local = cache.read_all_features(spark, path, config.quantize_local_desc)
        codebook = stored(f"{place}/{INVERTED_FILE}_words", settings, lambda: asmk.words_table(spark, asmk.train_words(local)))
        words = asmk.words_of(codebook)
        return Index(images, stored(f"{place}/{INVERTED_FILE}_postings", settings, lambda: asmk.postings(local, words)), None, sizes, path, words)
    vectors = stored(cache.global_index_path(place, config.global_features), {"model": config.global_features, "size": config.global_desc_image_size}, lambda: named(extract.global_descriptors(files(), config.global_features, global_model, config.global_desc_batch_size, key_col="path")))
    edges = stored(cache.graph_path(place, config.global_features), {"model": config.global_features, "k": k}, lambda: graph.normalized_graph(vectors, k, exact_rows=exact_graph_rows))
    return Index(images, vectors, edges, sizes, path)


def shortlisted_features(spark: SparkSession, index: Index, config: Config, shortlist: DataFrame) -> DataFrame:
    """Local features of the shortlist's images only, as floats, from the store's buckets that hold them."""
    f = cache.read_local_features(spark, index.features_path, shortlist)
    return f.withColumn("desc", V.dequantize("desc")) if config.quantize_local_desc else f
