"""A varied subset: a fixed-size weighted sample with probability inverse to local density.

Density of a row is the mean, over ``REPEATS`` independent sign hashes, of the number of rows of its scope in the same bucket.
Counts are exact at any size: buckets are not folded, since foreign rows in a slot would hide the density of small groups. Counts over one are
written, so the planner knows their size when they are joined back to the rows' buckets; of the rows only ids and buckets move.
The draw is the exponential race: key = -ln(u) * density with u from a hash of the id; the smallest keys win. No task holds a request:
a histogram of the keys tells how far the winners reach, and those rows are numbered by a range partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaforge.llm.vectors import ID, VEC, unit_rows
from vistaforge.operators.position import with_position
from vistaforge.session import cut, written

REPEATS = 12
REQUEST_BLOCK = 4
CHOSEN_BLOCK = 16_384
#: Steps of the histogram of the race for each factor e.
STEPS = 32
SEED = 40_009


def bucket_keys(v: np.ndarray, bits: int, repeats: int = REPEATS) -> np.ndarray:
    """(rows, repeats): the bucket of each row's sign hash, with the number of the hash in its upper bits."""
    p = np.random.default_rng(SEED).standard_normal((v.shape[1], bits * repeats)).astype(np.float32)
    sign = ((v @ p) > 0).reshape(len(v), repeats, bits)
    return sign @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(repeats, dtype=np.int64) << 56)


def race_keys(ids: np.ndarray, request: int, density: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Arrival times at rate 1 / density; the same for the same id, request and seed."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((request * 0xD1B54A32D192ED03 + seed) & 0xFFFFFFFFFFFFFFFF)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(u) * density


def usable_members(df: DataFrame, id_col: str, vec_col: str, group_col: str) -> tuple[DataFrame, int]:
    """Rows ``(id, grp, vec)``, one per id, whose vector may be usable, and the length most vectors of the table have."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(vec_col).cast("array<float>").alias("vec")).filter("id is not null and size(vec) > 0")
    most = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    again = written(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    once = rows.join(again, "id", "left_semi").groupBy("id").agg(F.first("grp").alias("grp"), F.first("vec").alias("vec"))
    return rows.join(again, "id", "left_anti").select("id", "grp", "vec").unionByName(once.select("id", "grp", "vec")), most["dim"] if most else 0


def asked_for(requests: DataFrame) -> list[list]:
    """The requests (id, album, size) in blocks of about ``REQUEST_BLOCK``."""
    asked = requests.select(F.col("request_id").cast("long"), F.col("album").cast("string"), F.col("subset_size").cast("long")).filter("request_id is not null and subset_size > 0").dropDuplicates(["request_id"])
    got = sorted((r["request_id"], r["album"], r["subset_size"]) for r in asked.collect())
    return [got[i : i + REQUEST_BLOCK] for i in range(0, len(got), REQUEST_BLOCK)]


def varied_subset(df: DataFrame, requests: DataFrame, id_col: str = ID, vec_col: str = VEC, group_col: str = "album") -> DataFrame:
    """``(request_id, image_id, density)``: per request (``request_id, album, subset_size``; NULL album = all rows) so many
    different ids of the album, all of them where it has no more.

    Repeated ids count once, unusable vectors and NULL ids are never drawn, an unknown album and a NULL or
    non-positive size give no rows. Requests are a stated set and are answered in blocks of ``REQUEST_BLOCK``.
    """
    rows, dim = usable_members(df, id_col, vec_col, group_col)
    return _drawn(rows, dim, asked_for(requests), df.count())[1].select("request_id", F.col("id").alias("image_id"), F.round("density", 6).alias("density"))


def subset_coverage(df: DataFrame, requests: DataFrame, id_col: str = ID, vec_col: str = VEC, group_col: str = "album") -> DataFrame:
    """``(request_id, image_id, density, chosen, representative_id, similarity)``: the subset and how it covers its scope, one row for every
    usable id of each request's album: whether it was drawn, and the drawn id most similar to it (ties: the least id; a drawn one stands
    for itself or for a copy). Other cases as in ``varied_subset``.

    The drawn rows are sent in blocks of at most ``CHOSEN_BLOCK`` vectors; rows are read once per block and not shuffled for it.
    """
    spark = df.sparkSession
    rows, dim = usable_members(df, id_col, vec_col, group_col)
    asked = asked_for(requests)
    raced, drawn = _drawn(rows, dim, asked, df.count())
    drawn = written(drawn.select("request_id", "id"))
    album = {request: album for block in asked for request, album, _ in block}
    blocks = max(1, math.ceil(drawn.count() / CHOSEN_BLOCK))
    of_block = drawn.withColumn("block", F.pmod(F.xxhash64("request_id", "id"), F.lit(blocks)))
    schema = "request_id long, id long, rep long, sim double"
    near = spark.createDataFrame([], schema)
    for b in range(blocks if dim else 0):
        part = rows.join(of_block.filter(F.col("block") == b), "id").select("request_id", "id", "vec").toPandas().sort_values(["request_id", "id"])
        sent = {}
        for request, own in part.groupby("request_id"):
            at, v = unit_rows(own["vec"], dim)
            sent[int(request)] = (album[int(request)], own["id"].to_numpy()[at], v)
        chosen = spark.sparkContext.broadcast(sent)

        def nearest(batches, chosen=chosen):
            for pdf in batches:
                at, v = unit_rows(pdf["vec"], dim)
                ids, grp = pdf["id"].to_numpy()[at], pdf["grp"].to_numpy()[at]
                for request, (name, reps, c) in chosen.value.items():
                    own = np.arange(len(ids)) if name is None else np.flatnonzero(grp == name)
                    for k in range(0, len(own), 2_048):
                        some = own[k : k + 2_048]
                        sims = np.round(v[some] @ c.T, 6)
                        best = sims.argmax(axis=1)
                        yield pd.DataFrame({"request_id": request, "id": ids[some], "rep": reps[best], "sim": sims[np.arange(len(some)), best].astype(np.float64)})

        near = near.unionByName(rows.mapInPandas(nearest, schema))
    if blocks > 1:
        best = F.max_by(F.struct("rep", "sim"), F.struct("sim", -F.col("rep"))).alias("best")
        near = near.groupBy("request_id", "id").agg(best).select("request_id", "id", "best.*")
    flags = drawn.select("request_id", "id", F.lit(True).alias("chosen"))
    out = raced.select("request_id", "id", "density").join(near, ["request_id", "id"]).join(flags, ["request_id", "id"], "left")
    return out.select("request_id", F.col("id").alias("image_id"), F.round("density", 6).alias("density"), F.coalesce("chosen", F.lit(False)).alias("chosen"), F.col("rep").alias("representative_id"), F.round("sim", 6).alias("similarity"))


def _drawn(rows: DataFrame, dim: int, blocks: list[list], total: int) -> tuple[DataFrame, DataFrame]:
    """(all members of the requests' scopes with density and race, those drawn)."""
    bits = min(56, max(8, math.ceil(math.log2(max(total, 2)))))
    raced = rows.sparkSession.createDataFrame([], "request_id long, id long, density double, race double, size long")
    for block in blocks if dim else []:
        raced = raced.unionByName(_raced(rows, block, bits, dim))
    raced = cut(raced.withColumn("step", F.floor(F.log("race") * STEPS)))
    return raced, _first(raced)


def _first(raced: DataFrame) -> DataFrame:
    """The ``size`` rows of each request with least (race, id). Counts of a fine histogram of the race, a small table, tell in which step
    of it the last of them lies, so rows of later steps are dropped; the others get their place from a range partitioning."""
    steps = raced.groupBy("request_id", "size", "step").agg(F.count("*").alias("n"))
    before = Window.partitionBy("request_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    last = written(steps.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("before < size").groupBy("request_id").agg(F.max("step").alias("last")))
    near = with_position(raced.join(last, "request_id").filter("step <= last"), "request_id", "race", "id")
    begin = written(near.groupBy("request_id").agg(F.min("position").alias("begin")))
    return near.join(begin, "request_id").filter("position - begin < size").select("request_id", "id", "density")


def _raced(rows: DataFrame, block: list, bits: int, dim: int) -> DataFrame:
    scopes = sorted({album for _, album, _ in block}, key=lambda x: (x is not None, x))
    of_scope = {album: i for i, album in enumerate(scopes)}

    def keyed(batches):
        for pdf in batches:
            at, v = unit_rows(pdf["vec"], dim)
            if not len(at):
                continue
            keys, grp, ids = bucket_keys(v, bits), pdf["grp"].to_numpy()[at], pdf["id"].to_numpy()[at]
            for album, i in of_scope.items():
                own = np.arange(len(ids)) if album is None else np.flatnonzero(grp == album)
                if len(own):
                    yield pd.DataFrame({"scope": i, "key": keys[own].ravel(), "id": np.repeat(ids[own], REPEATS)})

    keys = rows.mapInPandas(keyed, "scope int, key long, id long")
    counts = written(keys.groupBy("scope", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    density = keys.join(counts, ["scope", "key"], "left").groupBy("scope", "id").agg((F.sum(F.coalesce("n", F.lit(1))) / REPEATS).alias("density"))

    def race(batches):
        for pdf in batches:
            for request, album, size in block:
                own = pdf[pdf["scope"] == of_scope[album]]
                if len(own):
                    ids, thick = own["id"].to_numpy(), own["density"].to_numpy()
                    yield pd.DataFrame({"request_id": request, "id": ids, "density": thick, "race": race_keys(ids, request, thick), "size": size})

    return density.mapInPandas(race, "request_id long, id long, density double, race double, size long")
