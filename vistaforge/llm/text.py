"""Words and shingles of texts as arrays of stable 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
LETTERS_AND_DIGITS = re.compile(r"[^\W_]+")
MIX = np.random.default_rng(17).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """word -> hash, filled on demand; cleared when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hashed(words: list[str], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit value evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for t in range(k):
        h += w[t : t + n] * MIX[t]
    return finish(h)


def id_and_flag(id_col: str) -> list[Column]:
    """Columns ``doc_id`` without NULLs and ``no_id``: a pandas column of longs with NULLs would turn into floats."""
    c = F.col(id_col).cast("long")
    return [F.coalesce(c, F.lit(0)).alias("doc_id"), c.isNull().alias("no_id")]


def id_again() -> Column:
    return F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
