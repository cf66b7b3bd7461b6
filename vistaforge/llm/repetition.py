"""Repeated content inside a document: compression bands reject, the exact share decides.

The letters of a text, lower-cased, are compressed with zstandard as a whole and in fixed chunks (the last one ends with the text). How far
a text compresses depends on its length, so the limits do: a text whose ratio lies over the lower limit of its length class is no
candidate, one over the upper limit is noise. Chunk ratios find repetition packed into one place of a long text.

The lower limits only reject: they lie 0.07 or more above the greatest ratio of texts planted so that just over half of their words are
repeated and every eighth word of the copies is replaced by random letters, the hardest that still counts as repeated. In a candidate a word is
repeated if it lies in a window of ``WINDOW`` words that occurred earlier in the text with at most one word altered. Windows are compared by
hashes of the whole window and of the window with one word left out, in each place, so the cost is linear up to sorting.

One pass over the texts, no shuffle; each task works through its rows document by document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaforge.llm.text import LETTERS, MIX, WordHashes, finish, hashed, id_again, id_and_flag, shingles

WINDOW, SEED_WORDS = 8, 4
CHUNK = 4_096
#: Least bytes of a length class, ratio up to which a text may be repetitive, ratio over which it is noise.
BANDS = ((0, 0.95, 1.60), (256, 0.62, 1.00), (512, 0.53, 0.90), (1_024, 0.48, 0.80), (2_048, 0.43, 0.80), (4_096, 0.40, 0.75), (8_192, 0.38, 0.75), (16_384, 0.37, 0.70), (65_536, 0.35, 0.70))
CHUNK_LOW = 0.40


def repeated_words(w: np.ndarray) -> int:
    """Number of words in windows that occurred earlier with at most one altered word."""
    n = len(w) - WINDOW + 1
    if n <= 1:
        return 0
    seeds = shingles(w, SEED_WORDS)
    order = np.argsort(seeds, kind="stable")
    same = seeds[order[1:]] == seeds[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(seeds) + 1, np.int64)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    run = np.cumsum(again)
    starts = np.flatnonzero(run[WINDOW - SEED_WORDS + 1 :][:n] > run[:n])
    part = [w[starts + t] * MIX[t] for t in range(WINDOW)]
    whole = np.zeros(len(starts), np.uint64)
    for p in part:
        whole += p
    hit = np.zeros(len(starts), bool)
    for t in range(-1, WINDOW):
        key = finish(whole if t < 0 else whole - part[t])
        order = np.argsort(key, kind="stable")
        hit[order[1:][key[order[1:]] == key[order[:-1]]]] = True
    marks = np.zeros(len(w) + 1, np.int64)
    np.add.at(marks, starts[hit], 1)
    np.add.at(marks, starts[hit] + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def band_limits(size: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(BANDS) if size >= least)


def chunk_ratio(raw: bytes, z: zstandard.ZstdCompressor) -> float | None:
    """Least ratio of the text's chunks; None for a text of less than a chunk."""
    starts = [*range(0, len(raw) - CHUNK, CHUNK), len(raw) - CHUNK] if len(raw) >= CHUNK else []
    return min((len(z.compress(raw[i : i + CHUNK])) / CHUNK for i in starts), default=None)


def measured(texts, exact_everywhere: bool = True):
    """Rows (ratio, least chunk ratio, band, words, repeated) of an iterable of texts."""
    z, cache = zstandard.ZstdCompressor(level=3), WordHashes()
    for text in texts:
        words = LETTERS.findall(text.lower()) if text else []
        if not words:
            yield None, None, "empty", 0, 0
            continue
        raw = " ".join(words).encode()
        ratio = len(z.compress(raw)) / len(raw)
        chunk = chunk_ratio(raw, z)
        chunk = ratio if chunk is None else chunk
        low, high = band_limits(len(raw))
        band = "repetitive" if ratio < low or len(raw) >= CHUNK and chunk < CHUNK_LOW else "noise" if ratio > high else "normal"
        repeated = repeated_words(hashed(words, cache)) if exact_everywhere or band == "repetitive" else None
        yield ratio, chunk, band, len(words), repeated


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_everywhere: bool = True) -> DataFrame:
    """``(doc_id, ratio, chunk_ratio, band, n_words, repeated_words, repeated_share)``, a row per row of ``df``.

    band is ``repetitive`` (may be), ``normal``, ``noise`` or ``empty`` (NULL, empty or wordless text: ratios are NULL, share 0).
    repeated_* is exact for every text; without ``exact_everywhere`` it is NULL for those the bands reject.
    Repeated rows and NULL ids are kept as they are; an empty table gives no rows.
    """

    def run(batches):
        for pdf in batches:
            got = pd.DataFrame(measured(pdf["t"], exact_everywhere), columns=["ratio", "chunk_ratio", "band", "n_words", "repeated_words"])
            got["repeated_words"] = got["repeated_words"].astype("Int64")
            yield pd.concat([pdf[["doc_id", "no_id"]].reset_index(drop=True), got], axis=1)

    rows = df.select(*id_and_flag(id_col), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInPandas(run, "doc_id long, no_id boolean, ratio double, chunk_ratio double, band string, n_words long, repeated_words long")
    out = out.select(id_again(), "ratio", "chunk_ratio", "band", "n_words", "repeated_words")
    return out.withColumn("repeated_share", F.when(F.col("n_words") > 0, F.col("repeated_words") / F.col("n_words")).otherwise(F.lit(0.0)))


def repetitive_documents(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Ids of the documents of which more than ``share``, one half at least, of the words repeat what the text said before; texts that the bands
    reject are not measured."""
    return repetition(df, exact_everywhere=False).filter(F.col("repeated_share") > share).select("doc_id").filter("doc_id is not null").distinct()
