"""Column expressions over array<float> vectors. All stay in the JVM; arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _d(x: Column) -> Column:
    return x.cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: a lambda that names an outer expression would compute it per element."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))), F.lit(0.0), lambda s, x: s + x))


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + _d(x) * _d(x)))


def l2_normalize(v: Column | str) -> Column:
    """Length one; a zero vector stays zero, NULL stays NULL."""
    return let(l2_norm(v), lambda n: F.transform(_c(v), lambda x: F.when(n > 0, _d(x) / n).otherwise(0.0)))


def root_sift(v: Column | str, eps: float = 1e-6) -> Column:
    """L1 norm, floor at ``eps``, square root, L2 norm."""
    total = F.greatest(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + F.abs(_d(x))), F.lit(eps))
    rooted = let(total, lambda t: F.transform(_c(v), lambda x: F.sqrt(F.greatest(_d(x) / t, F.lit(eps)))))
    return let(rooted, lambda r: l2_normalize(r))


def quantize(v: Column | str) -> Column:
    """Values times 512, clipped to 0..255 and truncated; negatives and values above 255/512 are lost."""
    return F.transform(_c(v), lambda x: F.least(F.greatest(_d(x) * 512, F.lit(0.0)), F.lit(255.0)).cast("smallint"))


def dequantize(v: Column | str) -> Column:
    return F.transform(_c(v), lambda x: _d(x) / 512)


def sim_kernel(x: Column | str) -> Column:
    """max(x^3, 0)."""
    return F.greatest(_c(x) * _c(x) * _c(x), F.lit(0.0))


def shortlist_score(distance: Column | str) -> Column:
    """(2 - d) / 2 for distances between unit vectors."""
    return (F.lit(2.0) - _c(distance)) / 2


def rounded(v: Column | str, digits: int = 6) -> Column:
    return F.transform(_c(v), lambda x: F.round(x, digits))
