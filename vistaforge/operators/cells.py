"""Vectors in cells: usable rows, a bounded sample, coarse centres, and overlapping parts of a cell too large for a task."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaforge.session import written

SAMPLE_ROWS = 16_000
ID, VEC = "image_id", "global_descs"
PLANTED = 1_000
#: Share of a query's neighbours whose cells it must visit, classes of queries, queries tried within the sample.
REACH, CLASSES, TRIED = 0.97, 8, 2_000
#: Similarity below which a row is near no centre.
NOWHERE = 0.5


def unit_rows(vectors: pd.Series, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix): the usable vectors of a batch, scaled to length one.

    Unusable are NULL, empty, of another length than ``dim`` (the commonest length where not given), with NaN,
    infinity or NULL inside, and all zero.
    """
    lens = np.fromiter((-1 if v is None else len(v) for v in vectors), np.int64, len(vectors))
    if dim is None:
        dim = int(np.bincount(lens[lens > 0]).argmax()) if (lens > 0).any() else 0
    at = np.flatnonzero(lens == dim) if dim > 0 else np.empty(0, np.int64)
    if not len(at):
        return at, np.empty((0, max(dim, 0)), np.float32)
    values = vectors.to_numpy()
    m = np.stack([np.asarray(values[i], dtype=np.float64) for i in at])
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(norm) & (norm > 1e-12)
    return at[good], (m[good] / norm[good, None]).astype(np.float32)


def prepared(df: DataFrame, id_col: str = ID, vec_col: str = VEC) -> DataFrame:
    """``(id, vec)`` of the rows that may be usable; other columns, whatever their names, are left behind."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).filter("id is not null and size(vec) > 0")


def sampled(rows: DataFrame, total: int, size: int = SAMPLE_ROWS, salt: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of about ``size`` rows chosen by a hash of their id; only models are fitted on it."""
    if total == 0:
        return np.empty(0, np.int64), np.empty((0, 0), np.float32)
    share = min(1.0, size / total)
    picked = rows.filter(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1_000_000)) < int(round(share * 1_000_000)) + 1).select("id", "vec").limit(2 * size).toPandas()
    at, m = unit_rows(picked["vec"])
    return picked["id"].to_numpy()[at], m


def bounded_sample(rows: DataFrame, total: int, size: int = SAMPLE_ROWS, salt: int = 11) -> np.ndarray:
    """The vectors of ``sampled``."""
    return sampled(rows, total, size, salt)[1]


def coarse_centres(sample: np.ndarray, join: float = 0.6, support: int = 5, limit: int = 1024) -> np.ndarray:
    """Unit vectors of the sample's dense regions; scattered rows belong to none of them.

    Leaders are picked greedily at cosine ``join``, moved to their members' mean twice, and merged when they
    come within 0.8 of each other. A region needs ``support`` rows of the sample. At most ``limit`` centres.
    """
    left, found = np.arange(len(sample)), []
    while len(left) and len(found) < limit:
        block = sample[left[:256]]
        near, alive, leads = block @ block.T >= join, np.ones(len(block), bool), []
        for i in range(len(block)):
            if alive[i]:
                leads.append(i)
                alive &= ~near[i]
        sims = sample[left] @ block[leads].T
        to = sims.argmax(axis=1)
        took = sims[np.arange(len(left)), to] >= join
        for j in range(len(leads)):
            own = left[took & (to == j)]
            if len(own) >= support:
                found.append((len(own), sample[own].mean(axis=0)))
        left = left[~took]
    if not found:
        return np.empty((0, sample.shape[1] if sample.ndim == 2 else 0), np.float32)
    c = np.stack([v for _, v in sorted(found, key=lambda f: -f[0])][:limit])
    for _ in range(2):
        c = c / np.linalg.norm(c, axis=1, keepdims=True)
        sims = sample @ c.T
        to, took = sims.argmax(axis=1), sims.max(axis=1) >= join - 0.05
        size = np.bincount(to[took], minlength=len(c))
        kept: list[int] = []
        for j in np.argsort(-size, kind="stable"):
            if size[j] >= support and (not kept or (c[kept] @ c[j]).max() < 0.8):
                kept.append(int(j))
        if not kept:
            return np.empty((0, sample.shape[1]), np.float32)
        c = c[kept]
        sims = sample @ c.T
        to, took = sims.argmax(axis=1), sims.max(axis=1) >= join - 0.05
        c = np.stack([sample[took & (to == j)].mean(axis=0) if (took & (to == j)).any() else c[j] for j in range(len(c))])
    return (c / np.linalg.norm(c, axis=1, keepdims=True)).astype(np.float32)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position of each component of a small graph held in arrays."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
        live = root[a] != root[b]
        a, b = a[live], b[live]
        if not len(a) and (before == root).all():
            break
    return root


def one_per_id(rows: DataFrame, first_by: str | None = None) -> DataFrame:
    """One row ``(id, vec)`` per id, with ``first_by`` the one of least value there (rows that have none are left out). Only ids that
    occur again are aggregated; the rest is passed through by an anti-join that is planned by the size of those ids, which are written first."""
    rows = rows.filter(F.col(first_by).isNotNull()) if first_by else rows
    again = written(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    alone = rows.join(again, "id", "left_anti")
    some = rows.join(again, "id", "left_semi").groupBy("id").agg((F.min_by("vec", first_by) if first_by else F.first("vec")).alias("vec"))
    return alone.select("id", "vec").unionByName(some)


def beside(a: np.ndarray, towards: np.ndarray, cosine: float, seed: int) -> np.ndarray:
    """For each row of ``a`` a unit vector at the cosine to it: every second one away in the direction of a row of ``towards``, the others in any."""
    noise = np.random.default_rng(seed).standard_normal(a.shape)
    odd = (np.arange(len(a)) % 2 == 1)[:, None]
    u = np.where(odd, towards + 1e-3 * noise, noise)
    u -= (a * u).sum(axis=1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return (cosine * a + math.sqrt(1 - cosine**2) * u).astype(np.float32)


def partners(v: np.ndarray, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``PLANTED`` rows of ``v`` and for each a vector at the threshold."""
    rng = np.random.default_rng(seed)
    a = v[rng.integers(0, len(v), PLANTED)]
    return a, beside(a, v[rng.integers(0, len(v), PLANTED)], threshold, seed + 1)


@dataclass
class Parts:
    """How the rows of one cell go to tasks; ``load`` is the share of them in the fullest. ``pivot`` given: rows at the threshold to
    it, which are one group, are spread over ``count`` parts by their id, each once, and all other rows go to every part. Else a row
    goes to the ``near`` of the ends that it points at most."""

    count: int = 1
    near: int = 1
    load: float = 1.0
    ends: np.ndarray | None = None
    pivot: np.ndarray | None = None
    pivot_id: int = 0
    threshold: float = 1.0

    def of(self, v: np.ndarray, ids: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of every row and part that it goes to."""
        n = len(v)
        if self.count == 1:
            return np.arange(n), np.zeros(n, np.int64)
        if self.pivot is not None:
            one = v @ self.pivot >= self.threshold
            mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            rest = np.flatnonzero(~one)
            return np.concatenate([np.flatnonzero(one), np.repeat(rest, self.count)]), np.concatenate([((mixed >> np.uint64(33)) % np.uint64(self.count)).astype(np.int64)[one], np.tile(np.arange(self.count), len(rest))])
        points = (v - centre) @ self.ends.T
        return np.repeat(np.arange(n), self.near), np.argpartition(-points, self.near - 1, axis=1)[:, : self.near].ravel()


def pivot_of(own: np.ndarray) -> int:
    """Position of the row nearest the middle."""
    return int((own @ own.mean(axis=0)).argmax())


def outside(own: np.ndarray, threshold: float) -> float:
    """Share of the rows that are not at the threshold to the pivot."""
    return float((own @ own[pivot_of(own)] < threshold).mean())


def parts_of_cell(ids: np.ndarray, own: np.ndarray, centre: np.ndarray, size: float, threshold: float, recall: float, most: int = 4_096) -> Parts:
    """Parts for a cell of which ``(ids, own)`` is a sample; ``size``: into how many tasks' worth of work it must be cut.

    With ends, the number of parts a row goes to is what pairs planted at the threshold around the sample need to share a part with
    probability ``recall``, and there are so many ends that none gets more than twice a task's rows or two fifths of the cell. Going to t of C parts, t grows far
    more slowly than C. Where most rows are at the threshold to one row, the pivot, spreading those costs less.
    """
    if size <= 1 or not len(own):
        return Parts()
    residual, count = own - centre, math.ceil(size)
    middle = pivot_of(own)
    pivot, rest = own[middle], outside(own, threshold)
    spread = Parts(count, load=(1 - rest) / count + rest, pivot=pivot, pivot_id=int(ids[middle]), threshold=threshold)
    if rest == 0:
        return spread
    a, b = partners(own, threshold, 71)
    rng, best = np.random.default_rng(73), None
    ends_of = min(most, 1 << max(3, math.ceil(math.log2(size)) + 4))
    c = 4
    while c <= ends_of:
        take = residual[rng.permutation(len(residual))[:c]] if c <= len(residual) else np.concatenate([residual, rng.standard_normal((c - len(residual), own.shape[1])) * residual.std(axis=0)])
        ends = take + 1e-6 * rng.standard_normal(take.shape)
        ends = (ends / np.linalg.norm(ends, axis=1, keepdims=True)).astype(np.float32)
        rank = [np.argsort(np.argsort(-((x - centre) @ ends.T), axis=1, kind="stable"), axis=1, kind="stable") for x in (a, b)]
        near = int(np.quantile(np.maximum(*rank).min(axis=1), recall, method="higher")) + 1
        got = Parts(c, near, ends=ends)
        got.load = np.bincount(got.of(own, ids, centre)[1], minlength=c).max() / len(own) if near < c else 1.0
        if best is None or got.load < 0.8 * best.load:
            best = got
        if got.load <= min(2 / size, 0.4):
            break
        c *= 2
    fair = spread.load <= max(best.load, min(2 / size, 0.4))
    return spread if fair and 1 - rest + rest * count <= best.near or spread.load < best.load and best.load * size > 2 else best


class Routes:
    """How rows and queries of a neighbour search meet in cells.

    A row goes to the cell of the centre it is most similar to, or of none. A query visits the cells in the order of its similarity to
    their centres, as many as hold a share of ``REACH`` of the neighbours that queries of its class have within the sample; classes are by
    similarity to the best centre, so a query inside a dense region visits few cells and one that is like nothing may visit
    all. Large cells get more centres; what is still large is spread over parts, all of which a query visits."""

    def __init__(self, sample: np.ndarray, total: int, task_rows: int, k: int) -> None:
        scale = total / len(sample)
        self.centres = coarse_centres(sample)
        home = self.homes(sample) - 1
        kept, rng = [], np.random.default_rng(89)
        for c in range(-1, len(self.centres)):
            own = np.flatnonzero(home == c)
            more = min(len(own), int(2 * len(own) * scale / task_rows))
            if more > 1:
                kept.append(sample[rng.choice(own, more, replace=False)])
            elif c >= 0:
                kept.append(self.centres[c : c + 1])
        self.centres = np.concatenate(kept) if kept else self.centres
        home, cells = self.homes(sample), len(self.centres) + 1
        self.parts = np.maximum(1, np.ceil(np.bincount(home, minlength=cells) * scale / task_rows).astype(np.int64))
        tried, wanted, rank = rng.permutation(len(sample))[:TRIED], min(k, len(sample) - 1), []
        for i in range(0, len(tried) if wanted else 0, 200):
            some = tried[i : i + 200]
            sims = sample[some] @ sample.T
            sims[np.arange(len(some)), some] = -2
            near = np.argpartition(-sims, wanted - 1, axis=1)[:, :wanted]
            rank.append(np.take_along_axis(np.argsort(self.order(sample[some]), axis=1), home[near], axis=1))
        rank = np.concatenate(rank) if rank else np.empty((len(tried), 0), np.int64)
        best = self.best(sample[tried])
        self.limits = np.quantile(best, np.arange(1, CLASSES) / CLASSES)
        of = np.searchsorted(self.limits, best)
        self.visits = np.array([int(np.quantile(rank[of == i], REACH, method="higher")) + 1 if (of == i).any() and rank.size else cells for i in range(CLASSES)])

    def best(self, v: np.ndarray) -> np.ndarray:
        return (v @ self.centres.T).max(axis=1, initial=-1)

    def order(self, v: np.ndarray) -> np.ndarray:
        """(rows, cells): cells from the nearest on; cell 0 is that of rows near no centre."""
        return np.argsort(-np.concatenate([np.full((len(v), 1), NOWHERE, np.float32), v @ self.centres.T], axis=1), axis=1, kind="stable")

    def homes(self, v: np.ndarray) -> np.ndarray:
        return np.where(self.best(v) > NOWHERE, (v @ self.centres.T).argmax(axis=1) + 1 if len(self.centres) else 0, 0)

    def part_of(self, ids: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The part of its cell that each row is in."""
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % self.parts[cell]

    def visited(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell, part) of all that the queries visit."""
        n = self.visits[np.searchsorted(self.limits, self.best(v))]
        row, at = np.nonzero(np.arange(len(self.parts))[None] < n[:, None])
        cell = self.order(v)[row, at]
        many = self.parts[cell]
        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(row, many), np.repeat(cell, many), part
