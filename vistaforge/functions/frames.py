"""Local affine frames as column expressions: [[a, b, x], [c, d, y]] maps the unit circle to a keypoint's neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str | float) -> Column:
    return F.lit(float(c)) if isinstance(c, (int, float)) else F.col(c) if isinstance(c, str) else c


def frame(x: Column | str, y: Column | str, scale: Column | str | float = 1.0, angle: Column | str | float = 0.0) -> Column:
    """The frame at a place, of unit scale and not turned unless given; angles in radians, y downwards."""
    s, a = _c(scale).cast("double"), _c(angle).cast("double")
    row = lambda p, q, r: F.array(p, q, _c(r).cast("double"))
    return F.array(row(s * F.cos(a), s * F.sin(a), x), row(-s * F.sin(a), s * F.cos(a), y))


def centre(laf: Column | str) -> Column:
    """struct(x, y) of a frame's middle."""
    m = _c(laf)
    return F.struct(m[0][2].alias("x"), m[1][2].alias("y"))


def scale(laf: Column | str) -> Column:
    """Geometric mean of the two scales: the root of the area's factor."""
    m = _c(laf)
    return F.sqrt(F.abs(m[0][0] * m[1][1] - m[0][1] * m[1][0]))


def angle(laf: Column | str) -> Column:
    """How far the frame is turned, in radians."""
    m = _c(laf)
    return F.atan2(m[0][1], m[0][0])


def moved(laf: Column | str, rx: Column | str | float, ry: Column | str | float) -> Column:
    """The frame in a picture that is ``rx`` times as wide and ``ry`` times as high."""
    m = _c(laf)
    row = lambda i, r: F.transform(m[i], lambda v: v * r)
    return F.array(row(0, _c(rx)), row(1, _c(ry)))
