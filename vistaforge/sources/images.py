"""Pixels in Arrow batches: decoding, resizing and normalising for networks, and the pictures that a language model is shown.

PNG, BMP and binary PNM are decoded here; every other format by the imaging library, where one is installed. A picture is an array
(height, width, 3) of bytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from PIL import Image, ImageOps
except ImportError:
    Image = None

#: Mean and deviation by network family (fixed values).
STATISTICS = {"imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)), "half": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))}


def decode(data: bytes) -> np.ndarray:
    """RGB pixels; transparency is dropped, grey is repeated. Raises ValueError for what is no picture or needs a library that is missing."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] == b"BM":
            return _bmp(data)
        if data[:2] in (b"P5", b"P6"):
            return _pnm(data)
        if Image is None:
            raise ValueError("this format needs an imaging library, and none is installed")
        return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(data))).convert("RGB"))
    except (struct.error, zlib.error, IndexError, KeyError, OSError) as e:
        raise ValueError(f"unreadable picture: {e}") from e


def _rgb(x: np.ndarray) -> np.ndarray:
    return np.repeat(x[..., :1], 3, axis=2) if x.shape[2] < 3 else x[..., :3]


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, interlaced, depth = 8, [], None, 0, 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if interlaced or depth not in (1, 2, 4, 8, 16):
        raise ValueError("no header, or an interlaced picture")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride, step = -(-w * depth * channels // 8), max(1, depth * channels // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, stride + 1)
    rows, above = np.empty((h, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(h):
        above = rows[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)
        rows = rows if colour == 3 else rows * np.uint8(255 // ((1 << depth) - 1))
    x = rows[:, : w * channels].reshape(h, w, channels)
    return palette[x[..., 0]] if colour == 3 else _rgb(x)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        wide = np.zeros(-(-len(line) // step) * step, np.uint8)
        wide[: len(line)] = line
        return np.add.accumulate(wide.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    out, up, given = [0] * (len(line) + step), [0] * step + above.tolist(), line.tolist()
    for i, x in enumerate(given):
        a, b, c = out[i], up[i + step], up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if p <= q and p <= r else b if q <= r else c
        out[i + step] = (x + guess) & 255
    return np.array(out[step:], np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, head, w, h, _, depth, packing = struct.unpack("<I I i i H H I", data[10:34])
    if depth not in (8, 24, 32) or packing not in (0, 3):
        raise ValueError("packed pictures are not read")
    stride = (w * depth // 8 + 3) // 4 * 4
    x = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)[:, : w * depth // 8].reshape(abs(h), w, depth // 8)
    if depth == 8:
        x = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)[x[..., 0]]
    x = x[..., 2::-1]
    return x[::-1] if h > 0 else x


def _pnm(data: bytes) -> np.ndarray:
    words, at = [], 2
    while len(words) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        words.append(int(data[at:end]))
        at = end
    w, h, _ = words
    channels = 3 if data[:2] == b"P6" else 1
    return _rgb(np.frombuffer(data, np.uint8, w * h * channels, at + 1).reshape(h, w, channels))


def encode_png(x: np.ndarray) -> bytes:
    """RGB pixels as PNG."""
    h, w, _ = x.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(x, np.uint8).reshape(h, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def _weights(size: int, new: int) -> np.ndarray:
    """(new, size): triangle filter, as wide as the pixels that fall into one where the picture shrinks."""
    scale = size / new
    centre, reach = (np.arange(new) + 0.5) * scale, max(scale, 1.0)
    w = np.maximum(0, 1 - np.abs(np.arange(size)[None] + 0.5 - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """The picture at another size, bilinear and without aliasing; bytes stay bytes."""
    out = np.einsum("ya,abc->ybc", _weights(x.shape[0], h), x.astype(np.float64))
    out = np.einsum("xb,ybc->yxc", _weights(x.shape[1], w), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if x.dtype == np.uint8 else out


def network_input(x: np.ndarray, size: int | tuple[int, int] | None = None, statistics: str | None = "imagenet") -> np.ndarray:
    """(3, h, w) floats: scaled to ``size`` (one number: both sides; None: left), to [0, 1], and normalised (None: not)."""
    if size is not None:
        x = resize(x, *((size, size) if isinstance(size, int) else size))
    out = x.astype(np.float32) / 255
    if statistics is not None:
        mean, deviation = STATISTICS[statistics]
        out = (out - np.array(mean, np.float32)) / np.array(deviation, np.float32)
    return np.ascontiguousarray(out.transpose(2, 0, 1))


def crop(x: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """The part inside the box, cut to the picture; one pixel at least."""
    h, w = x.shape[:2]
    left, top = min(max(x1, 0), w - 1), min(max(y1, 0), h - 1)
    return x[top : max(top + 1, min(y2, h)), left : max(left + 1, min(x2, w))]


def draw_box(x: np.ndarray, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, int, int] = (255, 0, 0), width: int = 3) -> np.ndarray:
    """A copy with the outline of the box, ``width`` pixels inwards."""
    out, inside = x.copy(), np.zeros(x.shape[:2], bool)
    h, w = inside.shape
    inside[max(y1, 0) : y2 + 1, max(x1, 0) : x2 + 1] = True
    inside[max(y1 + width, 0) : max(min(y2 + 1 - width, h), 0), max(x1 + width, 0) : max(min(x2 + 1 - width, w), 0)] = False
    out[inside] = colour
    return out


def capped(x: np.ndarray, longest: int = 448) -> np.ndarray:
    """The picture with its longer edge at most ``longest``; sizes are truncated, 1 at least."""
    h, w = x.shape[:2]
    if max(h, w) <= longest:
        return x
    scale = longest / max(h, w)
    return resize(x, max(1, int(h * scale)), max(1, int(w * scale)))


def side_by_side(a: np.ndarray, b: np.ndarray, height: int = 448) -> np.ndarray:
    """Two pictures next to each other at one height."""
    return np.concatenate([resize(x, height, max(1, int(x.shape[1] * height / x.shape[0]))) for x in (a, b)], axis=1)


def thumbnail_hash(x: np.ndarray, side: int = 16) -> str:
    """MD5 of the picture's bytes at ``side`` by ``side``."""
    return hashlib.md5(resize(x, side, side).tobytes()).hexdigest()


def shown(query: np.ndarray, candidates: list[np.ndarray], box: tuple[int, int, int, int] | None = None) -> list[np.ndarray]:
    """What a model is shown: the query (with its box drawn, and the part inside it) and the candidates, none longer than the cap."""
    first = [query] if box is None else [draw_box(query, *box), crop(query, *box)]
    return [capped(x) for x in first + candidates]


def load(path: str) -> np.ndarray | None:
    """The picture at a path, no longer than a model is shown, or None where there is none that can be read."""
    try:
        with open(path, "rb") as f:
            return capped(decode(f.read()))
    except (OSError, ValueError):
        return None


def pictures(files: DataFrame, content: str = "content") -> DataFrame:
    """``(image_id, h, w, thumbnail)``: size and thumbnail hash of every file ``(image_id, content)``, NULL where it cannot be read."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, c in zip(pdf["image_id"], pdf["c"]):
                try:
                    x = decode(bytes(c))
                    out.append((i, *x.shape[:2], thumbnail_hash(x)))
                except (ValueError, TypeError):
                    out.append((i, None, None, None))
            yield pd.DataFrame(out, columns=["image_id", "h", "w", "thumbnail"]).astype({"h": "Int64", "w": "Int64"})

    return files.select("image_id", F.col(content).alias("c")).mapInPandas(run, "image_id long, h int, w int, thumbnail string")
