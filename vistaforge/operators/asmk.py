"""Retrieval by aggregated selective match kernels over an inverted file, as published (Tolias, Avrithis, Jegou 2013).

A codebook is trained on a bounded sample; every descriptor is assigned to its nearest word; the residuals of an image at a word
are summed and reduced to signs. A query meets an image only at words they share: the inverted file is a table of postings
partitioned by word, and a query is one equi-join and one aggregation. The similarity of two sign vectors u is cubed where positive,
and an image's sum is divided by the root of its number of words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaforge.operators.knn import matrix

TRAIN_ROWS = 20_000
POSTING = "image_id long, word_id int, code array<tinyint>"


def train_words(features: DataFrame, words: int = 64, rounds: int = 10, seed: int = 3, rows: int = TRAIN_ROWS) -> np.ndarray:
    """(words, dim) k-means centres of at most ``rows`` features, chosen by a hash of their key."""
    total = features.count()
    share = min(1.0, rows / max(total, 1))
    pick = features.filter("desc is not null").filter(F.pmod(F.xxhash64("image_id", "kp_idx"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    x = matrix(pick.orderBy("image_id", "kp_idx").limit(rows).toPandas()["desc"])
    if not len(x):
        raise ValueError("no features to train words on")
    c = x[np.random.default_rng(seed).choice(len(x), min(words, len(x)), replace=False)]
    for _ in range(rounds):
        to = ((c * c).sum(1) - 2 * x @ c.T).argmin(axis=1)
        c = np.stack([x[to == k].mean(axis=0) if (to == k).any() else c[k] for k in range(len(c))])
    return c


def words_table(spark: SparkSession, words: np.ndarray) -> DataFrame:
    """``(word_id, centre)``: the codebook as a table to store."""
    return spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(words)], "word_id int, centre array<double>")


def words_of(table: DataFrame) -> np.ndarray:
    """The codebook of a stored table; its size is that of the training."""
    return matrix(table.orderBy("word_id").toPandas()["centre"])


def postings(features: DataFrame, words: np.ndarray, id_col: str = "image_id") -> DataFrame:
    """``(image_id, word_id, code)``: signs of the summed residuals of an image at a word. Sums of a partition are made
    before the shuffle."""
    dim = words.shape[1]

    def partial(batches):
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["desc"])
                to = ((words * words).sum(1) - 2 * x @ words.T).argmin(axis=1)
                got = pd.DataFrame(x - words[to]).groupby([pdf["image_id"].to_numpy(), to]).sum()
                yield pd.DataFrame({"image_id": got.index.get_level_values(0), "word_id": got.index.get_level_values(1), "part": list(got.to_numpy())})

    parts = features.select(F.col(id_col).cast("long").alias("image_id"), "desc").filter("desc is not null and image_id is not null").mapInPandas(partial, "image_id long, word_id int, part array<double>")
    sums = [F.sum(F.col("part")[i]) for i in range(dim)]
    added = parts.groupBy("image_id", "word_id").agg(F.array(*sums).alias("r"))
    return added.select("image_id", "word_id", F.transform("r", lambda x: F.when(x >= 0, 1).otherwise(-1).cast("tinyint")).alias("code"))


def query_inverted_file(index: DataFrame, query: DataFrame, k: int, alpha: int = 3, tau: float = 0.0) -> DataFrame:
    """``(query_id, image_id, score, rank)``: the ``k`` best images for postings ``(query_id, word_id, code)``."""
    from pyspark.sql import Window

    sizes = index.groupBy("image_id").agg(F.count("*").alias("n"))
    q = query.select("query_id", "word_id", F.col("code").alias("qcode"))
    u = F.aggregate(F.zip_with("code", "qcode", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size("code")
    met = index.join(q, "word_id").select("query_id", "image_id", u.alias("u")).filter(F.col("u") > tau)
    score = met.groupBy("query_id", "image_id").agg(F.sum(F.pow("u", F.lit(alpha))).alias("s")).join(sizes, "image_id")
    out = score.select("query_id", "image_id", F.round(F.col("s") / F.sqrt("n"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "image_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
