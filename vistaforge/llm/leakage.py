"""Evaluation items inside training documents by size-partitioned MinHash containment search.

Sketches are one-permutation MinHash: the hashes of a text's shingles fall into bins by their leading bits, and the least of each bin is
kept. Documents are partitioned by their number of shingles into classes of doubling size, and a class has as many bins as its documents
have shingles, so that an item which is short beside a document of any length still shows. An item is sketched for every class: of its
shingles, those are kept that are the least of their bin. Items and documents meet by equality of class, bin and least hash. A shingle
that both hold is kept by both with probability 0.63, so an item of which seven shingles are left meets in 0.99 of cases twice;
``MEETINGS`` are asked for. Only documents that met an item are searched further, only for the items they met, by exact shingle
containment: matched
five-word shingles are chained into passages, across altered and blacked-out words and markers put in between. Around its
shingles a passage is compared word by word, since an altered word hides the shingles of the words beside it: a matching word of the item
counts 1, another ``-ALTERED``, and the stretches with the greatest sums are the pieces, with words at their ends that match beyond one altered
word. A stretch so goes on over single altered words,
however short it is, and ends where a stock phrase ends, the names and clauses between those being other words. An item counts as
found if one or two pieces hold ``share`` of its words.

Stock phrases are shingles of an item that many documents have which hold little else of it (counted over all documents; an
item that leaked into many documents is none). They make no meeting, and what is found must have
``OWN`` of its words outside of them unless it is ``LONG`` of the item, more than stock phrases in one order give.

Items are a stated, small set: their table of shingle hashes is broadcast in blocks of at most ``BLOCK_SHINGLES``.
Documents are read twice per block, once to count stock phrases, whole, without a shuffle of texts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaforge.llm.text import LETTERS_AND_DIGITS, WordHashes, hashed, shingles

SHINGLE = 5
SHARE = 0.32
MEETINGS, LEAST_CLASS = 2, 8
GAP, STEP, DRIFT = 26, 12, 18
ALTERED, BESIDE, PART = 2, 15, 0.3
STOCK_SHARE, STOCK_LEAST, STOCK_HELD, OWN, LONG = 0.002, 3, 0.25, 0.15, 0.42
BLOCK_SHINGLES = 2_000_000


class ItemTable:
    """Sorted shingle hashes of the items, with the item and place of each. Shingles that an item repeats are left out."""

    def __init__(self, ids: np.ndarray, texts: list) -> None:
        cache, h, item, place, words = WordHashes(), [], [], [], []
        self.text = []
        for i, text in enumerate(texts):
            w = LETTERS_AND_DIGITS.findall(text.lower()) if text else []
            self.text.append(hashed(w, cache))
            s = shingles(self.text[-1], SHINGLE)
            own, at, n = np.unique(s, return_index=True, return_counts=True)
            h.append(own[n == 1]), place.append(at[n == 1]), item.append(np.full((n == 1).sum(), i)), words.append(len(w))
        since = np.concatenate([first_class(x) for x in h])
        h, item, place = np.concatenate(h), np.concatenate(item), np.concatenate(place)
        order = np.argsort(h, kind="stable")
        self.ids, self.words = ids, np.array(words)
        self.item, self.place, self.since = item[order], place[order], since[order]
        self.hash, self.start, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.size = np.maximum(1, np.bincount(item, minlength=len(ids)))
        self.front = np.zeros(1 << 20, bool)
        self.front[(self.hash >> np.uint64(44)).astype(np.int64)] = True
        self.mark_stock(np.zeros(len(order), bool))

    def mark_stock(self, stock: np.ndarray) -> None:
        """stock: for each shingle of each item, whether it is a stock phrase."""
        self.stock, self.common = stock, [np.zeros(len(t), bool) for t in self.text]
        for i, at in zip(self.item[stock], self.place[stock]):
            self.common[i][at : at + SHINGLE] = True

    def poor(self, text: str, cache: WordHashes) -> np.ndarray:
        """The shingles that a text has of items of which it holds less than ``STOCK_HELD``."""
        h = shingles(hashed(LETTERS_AND_DIGITS.findall(text.lower()), cache), SHINGLE)
        rows = np.unique(self.find(h)[1]) if len(h) else np.empty(0, np.int64)
        flat = _ranges(self.start[rows], self.count[rows])
        held = np.bincount(self.item[flat], minlength=len(self.ids)) / self.size
        return flat[held[self.item[flat]] < STOCK_HELD]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, rows of the table's hashes) of the hashes that the table holds."""
        at = np.flatnonzero(self.front[(h >> np.uint64(44)).astype(np.int64)])
        row = np.searchsorted(self.hash, h[at])
        row[row == len(self.hash)] = 0
        good = self.hash[row] == h[at]
        return at[good], row[good]


def size_class(n: int) -> int:
    """The class of a document of n shingles; it has 2 ** class bins, in the first class as many as a usual item has shingles and more."""
    return max(LEAST_CLASS, math.ceil(math.log2(max(n, 2))))


def sketch(h: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the bin minima of the shingles in a class."""
    order = np.argsort(h)
    bins = h[order] >> np.uint64(64 - bits)
    return order[np.concatenate([[True], bins[1:] != bins[:-1]])]


def first_class(h: np.ndarray) -> np.ndarray:
    """For each of an item's shingles, sorted, the first class whose sketch of the item holds it; the sketches of later ones do too."""
    if len(h) < 2:
        return np.full(len(h), LEAST_CLASS)
    alike = 64 - np.floor(np.log2((h[1:] ^ h[:-1]).astype(np.float64))).astype(np.int64)
    return np.concatenate([[LEAST_CLASS], np.maximum(LEAST_CLASS, alike)])


def passages(doc, item, d, i) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, matched): matched shingles at places d and i in order, where each passage begins in it, and its words in shingles."""
    order = np.lexsort((i, d, item, doc))
    doc, item, d, i = doc[order], item[order], d[order], i[order]
    dd, di = np.diff(d), np.diff(i)
    goes_on = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (dd <= GAP) & (di > 0) & (di <= STEP) & (np.abs(dd - di) <= DRIFT)
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    step = np.concatenate([[0], np.where(goes_on, np.minimum(di, SHINGLE), 0)])
    return order, first, SHINGLE + np.add.reduceat(step, first)


def stretches(same: np.ndarray) -> list[tuple[int, int]]:
    """Ends of the disjoint stretches with the greatest sums of 1 for a matching word and -ALTERED for another."""
    out, todo = [], [(0, len(same))]
    while todo:
        low, high = todo.pop()
        total = np.concatenate([[0], np.cumsum(np.where(same[low:high], 1, -ALTERED))])
        gain = total - np.minimum.accumulate(total)
        end = int(gain.argmax())
        if gain[end] < SHINGLE:
            continue
        begin = int(end - total[: end + 1][::-1].argmin())
        out.append((low + begin, low + end))
        todo += [(low, low + begin), (low + end, high)]
    return out


def pieces(text: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) in the item of what a passage with matched shingles at d and i holds of it."""
    near = np.arange(-BESIDE, SHINGLE + BESIDE)
    x, y = (d[:, None] + near).ravel(), (i[:, None] + near).ravel()
    good = (x >= 0) & (x < len(text)) & (y >= 0) & (y < len(item))
    x, y = x[good], y[good]
    same = np.zeros(len(item), bool)
    same[y[text[x] == item[y]]] = True
    return [longer(same, begin, end) for begin, end in stretches(same)]


def longer(same: np.ndarray, begin: int, end: int) -> tuple[int, int]:
    """A stretch with the words that match beyond one altered word at either end, again and again."""
    while end + 1 < len(same) and (same[end] or same[end + 1]):
        end += 1 if same[end] else 2
    while begin > 1 and (same[begin - 1] or same[begin - 2]):
        begin -= 1 if same[begin - 1] else 2
    return begin, end


def two_best(found: list[tuple[int, int]], common: np.ndarray) -> int:
    """Words of an item in the longest piece and the one that adds most to it; 0 if they are stock phrases."""
    if not found:
        return 0
    one = max(found, key=lambda p: p[1] - p[0])
    more = lambda p: p[1] - p[0] - max(0, min(p[1], one[1]) - max(p[0], one[0]))
    held = np.zeros(len(common), bool)
    for begin, end in (one, max(found, key=more)):
        held[begin:end] = True
    return int(held.sum()) if held.mean() >= LONG or (held & ~common).sum() >= OWN * held.sum() else 0


def covered_words(texts: dict, table: ItemTable, doc, item, d, i, share: float) -> pd.DataFrame:
    """(doc, item, covered): words of the item in its one or two best pieces. Items whose two best passages have less than
    ``PART`` of the words that are asked for in shingles are left out: more than every fifth word of those is altered."""
    order, first, matched = passages(doc, item, d, i)
    runs = pd.DataFrame({"doc": doc[order[first]], "item": item[order[first]], "first": first, "last": np.append(first[1:], len(order)), "matched": matched})
    runs = runs.sort_values(["doc", "item", "matched"], ascending=[True, True, False], kind="stable")
    best = runs.groupby(["doc", "item"], sort=False).head(2).groupby(["doc", "item"], sort=False)["matched"].sum()
    best = best[best.to_numpy() >= PART * share * table.words[best.index.get_level_values("item")]]
    runs = runs[pd.MultiIndex.from_frame(runs[["doc", "item"]]).isin(best.index)]
    found: dict[tuple, list] = {}
    for n, it, a, b in zip(runs["doc"], runs["item"], runs["first"], runs["last"]):
        at = order[a:b]
        found.setdefault((n, it), []).extend(pieces(texts[n], table.text[it], d[at], i[at]))
    return pd.DataFrame([(n, it, two_best(p, table.common[it])) for (n, it), p in found.items()], columns=["doc", "item", "covered"]).astype(np.int64)


def contained(texts, table: ItemTable, cache: WordHashes, share: float = SHARE) -> pd.DataFrame:
    """(doc, item, estimate, containment, share) of a batch of texts, doc being the place in the batch."""
    docs, items, d_at, i_at, est, hashes = [], [], [], [], [], {}
    for n, text in enumerate(texts):
        w = LETTERS_AND_DIGITS.findall(text.lower()) if text else []
        w = hashed(w, cache)
        h = shingles(w, SHINGLE)
        if not len(h):
            continue
        bits = size_class(len(h))
        kept = sketch(h, bits)
        rows = np.unique(table.find(h[kept])[1])
        flat = _ranges(table.start[rows], table.count[rows])
        met = np.bincount(table.item[flat[(table.since[flat] <= bits) & ~table.stock[flat]]], minlength=len(table.ids))
        wanted = met >= np.minimum(MEETINGS, table.size)
        if not wanted.any():
            continue
        estimate = met / (table.size * len(kept) / len(h))
        at, row = table.find(h)
        flat = _ranges(table.start[row], table.count[row])
        d = np.repeat(at, table.count[row])
        good = wanted[table.item[flat]]
        flat, d = flat[good], d[good]
        hashes[n] = w
        docs.append(np.full(len(flat), n)), items.append(table.item[flat]), d_at.append(d), i_at.append(table.place[flat]), est.append(estimate[table.item[flat]])
    if not docs:
        return pd.DataFrame({"doc": [], "item": [], "estimate": [], "containment": [], "share": []})
    doc, item, d, i, est = map(np.concatenate, (docs, items, d_at, i_at, est))
    got = covered_words(hashes, table, doc, item, d, i, share)
    exact = pd.DataFrame({"doc": doc, "item": item, "i": i, "estimate": est}).groupby(["doc", "item"]).agg(n=("i", "nunique"), estimate=("estimate", "first"))
    got = got.join(exact, on=["doc", "item"])
    got["containment"] = got["n"] / table.size[got["item"].astype(int)]
    got["share"] = got["covered"] / table.words[got["item"].astype(int)]
    return got[got["share"] >= share][["doc", "item", "estimate", "containment", "share"]]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.empty(0, np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def leaked_items(docs: DataFrame, items: DataFrame, share: float = SHARE, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id, estimate, containment, share)``: documents that hold ``share`` or more of an item's words as a
    passage in one or two pieces (a third, less what altered words at a piece's ends hide); estimate is from the sketch, containment the exact share of the item's shingles.

    NULL, empty and wordless texts and NULL ids hold nothing; items of fewer than five words have no
    shingle and are not searched for; a pair comes out once however often rows repeat.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).filter("id is not null and t is not null")
    asked = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).filter("id is not null and length(t) > 0").dropDuplicates(["id"])
    size = asked.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / 5 / BLOCK_SHINGLES))
    n_docs = docs.count() if size else 0
    often = max(STOCK_LEAST, STOCK_SHARE * n_docs)
    out = spark.createDataFrame([], "doc_id long, item_id long, estimate double, containment double, share double")
    for b in range(blocks if size else 0):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toPandas()
        if not len(block):
            continue
        table = ItemTable(block["id"].to_numpy(), block["t"].to_list())
        plain = spark.sparkContext.broadcast(table)

        def count_poor(batches, plain=plain):
            cache, n = WordHashes(), np.zeros(len(plain.value.stock), np.int64)
            for pdf in batches:
                for text in pdf["t"]:
                    n[plain.value.poor(text, cache)] += 1
            yield pd.DataFrame({"at": np.flatnonzero(n), "n": n[n > 0]})

        counts = rows.mapInPandas(count_poor, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") >= often).toPandas()
        stock = np.zeros(len(table.stock), bool)
        stock[counts["at"].to_numpy(np.int64)] = True
        table.mark_stock(stock)
        sent = spark.sparkContext.broadcast(table)

        def search(batches, sent=sent):
            table, cache = sent.value, WordHashes()
            for pdf in batches:
                got = contained(pdf["t"], table, cache, share)
                at, it = got["doc"].astype(int), got["item"].astype(int)
                yield pd.DataFrame({"doc_id": pdf["id"].to_numpy()[at], "item_id": table.ids[it], "estimate": got["estimate"], "containment": got["containment"], "share": got["share"]})

        out = out.unionByName(rows.mapInPandas(search, "doc_id long, item_id long, estimate double, containment double, share double"))
    return out.groupBy("doc_id", "item_id").agg(F.max("estimate").alias("estimate"), F.max("containment").alias("containment"), F.max("share").alias("share"))
