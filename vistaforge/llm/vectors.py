"""What the vector operators share beside the cells of the core: classes of exact copies, cells of all space, cells by similarity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaforge.operators.cells import ID, PLANTED, SAMPLE_ROWS, VEC, Parts, beside, bounded_sample, coarse_centres, local_roots, one_per_id, partners, prepared, sampled, unit_rows  # noqa: F401
from vistaforge.session import written

RIM, ORIGIN = 0.97, 4


def copy_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, copies): one row ``(id, vec)`` per distinct vector, and ``(id, rep)`` for all others.

    Two independent 64-bit hashes stand for the vector, so only hashes and ids are aggregated. Hashes that occur under
    two ids are written, so their size is known when they are joined to the rows: vectors move only if there are many.
    """
    hashed = rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(7), "vec"))
    twice = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("top")).filter("rep <> top").drop("top")
    twice = written(twice)
    joined = hashed.join(twice, ["h1", "h2"], "left")
    return joined.filter("rep is null or id = rep").select("id", "vec"), joined.filter("id <> rep").select("id", "rep").distinct()


def cells_with_margin(v: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the home cell of every row and of each other cell whose border is within ``margin``.

    Cells are the Voronoi cells of the centres and of the origin (cell -1, for rows near no centre). If two rows
    are at most twice the margin apart and lie in different home cells, one of them is within the margin of the
    border between those, so some cell holds both.
    """
    n = len(v)
    if not len(centres):
        return np.arange(n), np.full(n, -1)
    sims = v @ centres.T
    gain = np.concatenate([np.full((n, 1), 0.5, np.float32), sims], axis=1)
    home = gain.argmax(axis=1)
    points = np.concatenate([np.zeros((1, centres.shape[1]), np.float32), centres])
    apart = np.sqrt(np.maximum(((points**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * points @ points.T), 1e-12))
    reach = (gain[np.arange(n), home][:, None] - gain) / apart[home]
    reach[np.arange(n), home] = -1
    row, cell = np.nonzero(reach <= margin)
    return row, cell - 1


def similar_cells(sims: np.ndarray, low: float, up: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): a row is in each cell whose centre has similarity ``low`` or more to it, and in cell -1 if none has ``up``."""
    row, cell = np.nonzero(np.concatenate([(sims.max(axis=1, initial=-1) < up)[:, None], sims >= low], axis=1))
    return row, cell - 1


def cell_limits(sample: np.ndarray, centres: np.ndarray, directions: np.ndarray, threshold: float, recall: float) -> tuple[float, float]:
    """(low, up) for ``similar_cells``. Two rows below ``up`` to all centres meet in cell -1; if one of two rows at the threshold has ``up`` or
    more to a centre, the other must have ``low``. For each of several ``up``, ``low`` is set so that of partners planted around rows at
    ``up`` exactly, the worst place, ``RIM`` have it, and is lowered until of all pairs planted around the sample's rows a share of
    ``recall`` shares a cell. Those are taken that put fewest of the sample's rows into cells, cell -1 counting more, since nothing in it is alike.
    """
    if not len(centres):
        return 1.0, 2.0
    rng, best = np.random.default_rng(79), None
    c = centres[rng.integers(0, len(centres), PLANTED)]
    around, away = (sample[rng.integers(0, len(sample), PLANTED)] for _ in range(2))
    to_centres = directions @ (centres @ directions).T
    sims, pair = sample @ to_centres, [x @ to_centres for x in partners(sample, threshold, 82)]
    for up in np.arange(0.6, 0.96, 0.05):
        b = beside(beside(c, around, up, 80), np.roll(away, 1, axis=0), threshold, 81)
        low = float(np.quantile(((b @ directions) * (c @ directions)).sum(axis=1), 1 - RIM))
        while _meet(*pair, low, up) < recall:
            low -= 0.03
        row, cell = similar_cells(sims, low, up)
        cost = len(row) + ORIGIN * (cell == -1).sum()
        if best is None or cost < best[0]:
            best = (cost, low, float(up))
    return best[1:]


def _meet(a: np.ndarray, b: np.ndarray, low: float, up: float) -> float:
    """Share of the pairs, given by their similarities to the centres, that share a cell."""
    return float((((a >= low) & (b >= low)).any(axis=1) | ((a.max(axis=1) < up) & (b.max(axis=1) < up))).mean())


def with_pivot(way: Parts | None, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a part, and the pivot where its group is spread over parts: all of them hold it, and so are merged."""
    if way is None or way.pivot is None:
        return ids, v
    return np.append(ids, way.pivot_id), np.concatenate([v, way.pivot[None]])
