"""Scale-invariant keypoints and descriptors (Lowe 2004) in NumPy, as a local model for the extractor slot.

No extremum is dropped for low contrast or for lying on an edge unless limits are given; ``most`` keeps those of highest contrast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from vistaforge.sources import images

#: Layers an octave, blur of the first, blur that the input is taken to have; greatest share of a descriptor's length in one value (fixed values).
LAYERS, SIGMA, GIVEN, CLIP = 3, 1.6, 0.5, 0.2
LEAST_SIDE = 16


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, borders mirrored."""
    reach = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        wide = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        x = sum(w * (wide[i : i + x.shape[0]] if axis == 0 else wide[:, i : i + x.shape[1]]) for i, w in enumerate(k))
    return x


def octave(x: np.ndarray) -> np.ndarray:
    """(LAYERS + 3, h, w): the layers of an octave that begins at blur SIGMA."""
    layers = [x]
    for i in range(1, LAYERS + 3):
        before = SIGMA * 2 ** ((i - 1) / LAYERS)
        layers.append(blurred(layers[-1], before * np.sqrt(2 ** (2 / LAYERS) - 1)))
    return np.stack(layers)


def extrema(d: np.ndarray) -> np.ndarray:
    """(n, 3): layer, y, x of values greater or less than all their 26 neighbours."""
    inner = d[1:-1, 1:-1, 1:-1]
    high, low = np.full(inner.shape, -np.inf), np.full(inner.shape, np.inf)
    for s in range(3):
        for y in range(3):
            for x in range(3):
                if (s, y, x) != (1, 1, 1):
                    other = d[s : s + inner.shape[0], y : y + inner.shape[1], x : x + inner.shape[2]]
                    np.maximum(high, other, out=high), np.minimum(low, other, out=low)
    return np.argwhere((inner > high) | (inner < low)) + 1


def refined(d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, edge ratios): a parabola through each extremum and its neighbours; places move by half a step at most."""
    s, y, x = at.T
    v = lambda a, b, c: d[s + a, y + b, x + c]
    g = np.stack([v(1, 0, 0) - v(-1, 0, 0), v(0, 1, 0) - v(0, -1, 0), v(0, 0, 1) - v(0, 0, -1)], 1) / 2
    ss, yy, xx = v(1, 0, 0) + v(-1, 0, 0) - 2 * v(0, 0, 0), v(0, 1, 0) + v(0, -1, 0) - 2 * v(0, 0, 0), v(0, 0, 1) + v(0, 0, -1) - 2 * v(0, 0, 0)
    sy, sx, yx = ((v(*a) - v(*b) - v(*c) + v(*e)) / 4 for a, b, c, e in (((1, 1, 0), (1, -1, 0), (-1, 1, 0), (-1, -1, 0)), ((1, 0, 1), (1, 0, -1), (-1, 0, 1), (-1, 0, -1)), ((0, 1, 1), (0, 1, -1), (0, -1, 1), (0, -1, -1))))
    h = np.stack([np.stack([ss, sy, sx], 1), np.stack([sy, yy, yx], 1), np.stack([sx, yx, xx], 1)], 1)
    move = -np.einsum("nij,nj->ni", np.linalg.pinv(h), g)
    move = np.clip(np.nan_to_num(move), -0.5, 0.5)
    det = yy * xx - yx * yx
    with np.errstate(divide="ignore", invalid="ignore"):
        edge = np.where(det > 0, (yy + xx) ** 2 / det, np.inf)
    return at + move, v(0, 0, 0) + 0.5 * (g * move).sum(1), edge


def directions(size: np.ndarray, angle: np.ndarray, y: float, x: float, sigma: float) -> list[float]:
    """The directions of the gradients around a place: the strongest of 36 and all with 0.8 of its strength."""
    reach = max(1, int(round(4.5 * sigma)))
    top, left = max(0, int(round(y)) - reach), max(0, int(round(x)) - reach)
    m, a = size[top : int(round(y)) + reach + 1, left : int(round(x)) + reach + 1], angle[top : int(round(y)) + reach + 1, left : int(round(x)) + reach + 1]
    yy, xx = np.mgrid[top : top + m.shape[0], left : left + m.shape[1]]
    w = m * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * (1.5 * sigma) ** 2))
    h = np.bincount((np.rint(a / (2 * np.pi) * 36).astype(int) % 36).ravel(), w.ravel(), 36)
    for _ in range(2):
        h = (np.roll(h, 1) + h + np.roll(h, -1)) / 3
    before, after = np.roll(h, 1), np.roll(h, -1)
    peak = np.flatnonzero((h > before) & (h > after) & (h >= 0.8 * h.max()))
    return [float((p + 0.5 * (before[p] - after[p]) / (before[p] - 2 * h[p] + after[p])) * 2 * np.pi / 36) for p in peak]


def descriptor(size: np.ndarray, angle: np.ndarray, y: float, x: float, sigma: float, turn: float) -> np.ndarray:
    """128 values: gradients in 4 by 4 fields of three blurs' width around the place, turned by ``turn``, in 8 directions."""
    width, c, s = 3 * sigma, np.cos(turn), np.sin(turn)
    reach = int(min(np.ceil(width * 2.5 * np.sqrt(2)), np.hypot(*size.shape)))
    top, left = max(0, int(round(y)) - reach), max(0, int(round(x)) - reach)
    part = slice(top, int(round(y)) + reach + 1), slice(left, int(round(x)) + reach + 1)
    m, a = size[part].ravel(), angle[part].ravel()
    yy, xx = (g.ravel() for g in np.mgrid[top : top + size[part].shape[0], left : left + size[part].shape[1]])
    u, v = ((xx - x) * c + (yy - y) * s) / width, ((yy - y) * c - (xx - x) * s) / width
    keep = (np.abs(u) < 2.5) & (np.abs(v) < 2.5)
    u, v, m = u[keep], v[keep], m[keep] * np.exp(-(u[keep] ** 2 + v[keep] ** 2) / 8)
    o = ((a[keep] - turn) / (2 * np.pi) * 8) % 8
    u, v, out = u + 1.5, v + 1.5, np.zeros((6, 6, 8))
    iu, iv, io = np.floor(u).astype(int), np.floor(v).astype(int), np.floor(o).astype(int)
    for du in (0, 1):
        for dv in (0, 1):
            for do in (0, 1):
                w = m * np.abs(1 - du - (u - iu)) * np.abs(1 - dv - (v - iv)) * np.abs(1 - do - (o - io))
                np.add.at(out, (iv + dv + 1, iu + du + 1, (io + do) % 8), w)
    d = out[1:5, 1:5].ravel()
    d = np.minimum(d / max(np.linalg.norm(d), 1e-12), CLIP)
    return d / max(np.linalg.norm(d), 1e-12)


def keypoints(grey: np.ndarray, contrast: float = 0.0, edge: float = np.inf, most: int | None = None) -> pd.DataFrame:
    """``(x, y, scale, angle, score, desc)`` of a grey picture in [0, 1]; score is the contrast."""
    found, step = [], 0.5
    x = images.resize(grey[..., None], 2 * grey.shape[0], 2 * grey.shape[1])[..., 0]
    x = blurred(x, np.sqrt(SIGMA**2 - (2 * GIVEN) ** 2))
    while min(x.shape) >= LEAST_SIDE:
        layers = octave(x)
        d = np.diff(layers, axis=0)
        at = extrema(d)
        if len(at):
            place, value, ratio = refined(d, at)
            good = (np.abs(value) >= contrast) & (ratio <= edge)
            found += [(step, layers, int(i), *p, abs(v)) for i, p, v in zip(at[good, 0], place[good], value[good])]
        x, step = layers[LAYERS][::2, ::2], step * 2
    found = sorted(found, key=lambda f: -f[-1])[:most]
    rows, gradients = [], {}
    for step, layers, i, s, y, x, value in found:
        if (step, i) not in gradients:
            dy, dx = np.gradient(layers[i])
            gradients[step, i] = np.hypot(dy, dx), np.arctan2(dy, dx) % (2 * np.pi)
        sigma = SIGMA * 2 ** (s / LAYERS)
        for turn in directions(*gradients[step, i], y, x, sigma):
            rows.append((x * step, y * step, sigma * step, turn, value, descriptor(*gradients[step, i], y, x, sigma, turn)))
    return pd.DataFrame(rows, columns=["x", "y", "scale", "angle", "score", "desc"])


class Sift:
    """The extractor slot's local model: ``detect(bytes)``; a file that is no picture has no keypoints."""

    def __init__(self, most: int | None = 4_096, root: bool = True) -> None:
        self.most, self.root = most, root

    def detect(self, content: bytes) -> pd.DataFrame:
        try:
            grey = images.decode(content).astype(np.float64) @ (0.299, 0.587, 0.114) / 255
        except ValueError:
            return pd.DataFrame({c: [] for c in ("x", "y", "score", "desc")})
        k = keypoints(grey, most=self.most)
        if self.root and len(k):
            d = np.stack(k["desc"].to_list())
            d = np.sqrt(np.maximum(d / np.maximum(d.sum(axis=1, keepdims=True), 1e-12), 1e-6))
            k["desc"] = list(d / np.linalg.norm(d, axis=1, keepdims=True))
        return k[["x", "y", "score", "desc"]]
