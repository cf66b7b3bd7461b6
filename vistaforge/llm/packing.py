"""Documents into containers of fixed token capacity, with controlled mixture of sources.

Documents are spread over shards by a hash of their id; each shard is packed by deficit round-robin over one queue per source.
Every window (container) credits each source with its target share of the capacity, its quantum. The sources then have their turns, from
another one on in each window: a source with credit gives the longest item that fits, pays for it, if need be with debt, and waits for
the next round. Room that is left when no source with an item that fits has credit goes to the one with least debt. Credit and debt are carried
from window to window. It is also carried from shard to shard: a shard packs all it holds, so the credit it ends with is known
from its token totals alone, and a running sum over the small table of totals gives every shard its starting
credit without packing the shards one after another.

A document is split only if it exceeds the capacity: into full containers and a remainder that is packed like any other item.
Tokenising is the cost; it is done once, and only (id, source, length) is shuffled.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_right

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaforge.llm.text import id_again, id_and_flag
from vistaforge.session import cut, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenising pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_WINDOWS = 512
MAX_SOURCES = 1_000
NO_SOURCE = "(none)"
_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once per Python worker."""
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("vistaforge", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_lengths(df: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, no_id, source, n_tokens)`` per row of ``df``; whole texts, NULL counts as empty; a NULL id is 0 with ``no_id``."""

    def run(batches):
        enc = encoder(tokenizer)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["t"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "source": pdf["source"], "n_tokens": n})

    rows = df.select(*id_and_flag(id_col), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInPandas(run, "doc_id long, no_id boolean, source string, n_tokens long")


class Queue:
    """Items of one source in order of length; gives the longest that fits."""

    def __init__(self, items: list[tuple[int, int]]) -> None:
        self.items = sorted(items)
        self.sizes = [n for n, _ in self.items]

    def least(self) -> float:
        return self.sizes[0] if self.sizes else math.inf

    def take(self, room: float) -> tuple[int, int]:
        at = bisect_right(self.sizes, room) - 1
        self.sizes.pop(at)
        return self.items.pop(at)


def pack_shard(items: list[tuple[str, int, int]], capacity: int, share: dict[str, float], credit: dict[str, float]) -> list[tuple[int, int]]:
    """(window, item) for items (source, length, item), none longer than the capacity; changes ``credit`` as it goes."""
    queues = {s: Queue([(n, i) for source, n, i in items if source == s]) for s in sorted({source for source, _, _ in items})}
    placed, window = [], 0
    while any(q.sizes for q in queues.values()):
        room = capacity
        for s, part in share.items():
            credit[s] = credit.get(s, 0.0) + part * capacity
        turns, gave = list(queues), True
        turns = turns[window % len(turns) :] + turns[: window % len(turns)]
        while gave:
            gave = False
            ready = [s for s in turns if queues[s].least() <= room and credit.get(s, 0.0) > 0]
            for s in ready or [max((s for s in turns if queues[s].least() <= room), key=lambda x: (credit.get(x, 0.0), x), default="")]:
                if s in queues and queues[s].least() <= room:
                    n, item = queues[s].take(room)
                    placed.append((window, item))
                    credit[s] = credit.get(s, 0.0) - n
                    room -= n
                    gave = True
        for s, part in share.items():
            credit[s] -= part * room
        window += 1
    return placed


def pack(df: DataFrame, capacity: int, tokenizer: str = TOKENIZER, mixture: dict[str, float] | None = None, shard_windows: int = SHARD_WINDOWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(container_id, doc_id, source, piece, start_token, n_tokens)``: where every token of every row goes.

    ``mixture`` maps sources to target shares (default: their shares of all tokens); sources it does not name have target 0
    and are packed where credit is equal or nothing else fits. NULL sources are one source. Rows without tokens
    (NULL, empty) need no container and give no row; repeated rows and NULL ids are packed like others; pieces above 0 exist
    only for documents longer than ``capacity``. An empty table gives no rows.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    lengths = cut(token_lengths(df, tokenizer, id_col, text_col, source_col).filter("n_tokens > 0"))
    by_source = {r["source"]: r["n"] for r in lengths.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"the source column has more than {MAX_SOURCES} values; name a coarser one")
    total = sum(by_source.values())
    given = mixture or by_source
    share = {s: x / (sum(given.values()) or 1) for s, x in given.items()}
    shards = max(1, math.ceil(total / (shard_windows * capacity)))
    keyed = lengths.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int"))
    sums = keyed.groupBy("shard", "source").agg(F.sum("n_tokens").alias("n"))
    per_shard = sums.groupBy("shard").agg(F.sum("n").alias("all"))
    named = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(float(x)).alias("part")) for s, x in share.items()] or [F.struct(F.lit("").alias("source"), F.lit(0.0).alias("part"))])
    grid = per_shard.select("shard", "all", F.explode(named).alias("s")).select("shard", "all", "s.*").join(sums, ["shard", "source"], "left")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.withColumn("credit", F.coalesce(F.sum(F.col("all") * F.col("part") - F.coalesce("n", F.lit(0))).over(before), F.lit(0.0)))
    starting = carried.groupBy(F.col("shard").alias("of_shard")).agg(F.map_from_entries(F.collect_list(F.struct("source", "credit"))).alias("credit"))

    def run(key, left, right):
        credit = dict(right["credit"].iloc[0]) if len(right) and right["credit"].iloc[0] is not None else {}
        ids, sources, sizes = left["doc_id"].tolist(), left["source"].tolist(), left["n_tokens"].tolist()
        none = left["no_id"].tolist()
        order = sorted(range(len(ids)), key=lambda i: (sizes[i], none[i], ids[i]))
        rows, items, full = [], [], 0
        for i in order:
            whole, rest = divmod(sizes[i], capacity)
            if rest == 0 and whole == 1:
                whole, rest = 0, capacity
            for p in range(whole):
                rows.append((full, i, p, p * capacity, capacity))
                full += 1
                for s, part in share.items():
                    credit[s] = credit.get(s, 0.0) + part * capacity
                credit[sources[i]] = credit.get(sources[i], 0.0) - capacity
            if rest:
                items.append((sources[i], rest, (i, whole)))
        table = [(s, n, k) for k, (s, n, _) in enumerate(items)]
        for window, k in pack_shard(table, capacity, share, credit):
            _, n, (i, piece) = items[k]
            rows.append((full + window, i, piece, piece * capacity, n))
        base = int(key[0]) << 32
        out = pd.DataFrame(rows, columns=["container_id", "at", "piece", "start_token", "n_tokens"])
        out["container_id"] += base
        for c in ("doc_id", "no_id", "source"):
            out[c] = left[c].to_numpy()[out["at"].to_numpy(dtype=int)]
        return out[["container_id", "doc_id", "no_id", "source", "piece", "start_token", "n_tokens"]]

    packed = keyed.groupBy("shard").cogroup(starting.groupBy("of_shard")).applyInPandas(run, "container_id long, doc_id long, no_id boolean, source string, piece long, start_token long, n_tokens long")
    return packed.select("container_id", id_again(), "source", "piece", "start_token", "n_tokens")


def mixture(packed: DataFrame) -> DataFrame:
    """``(container_id, source, n_tokens, container_tokens, running_tokens, target)``: what each source has in each container, what it has in
    all containers up to that one of the same shard, and how much of those it would have at its share of all tokens. An empty table gives no rows."""
    shard = F.shiftright("container_id", 32)
    own = written(packed.groupBy("container_id", "source").agg(F.sum("n_tokens").alias("n_tokens")))
    whole = own.groupBy("container_id").agg(F.sum("n_tokens").alias("container_tokens"))
    up_to = Window.partitionBy(shard).orderBy("container_id")
    whole = whole.withColumn("running_all", F.sum("container_tokens").over(up_to))
    shares = own.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens")).crossJoin(own.agg(F.sum("n_tokens").alias("all_tokens")))
    running = F.sum("n_tokens").over(Window.partitionBy(shard, "source").orderBy("container_id"))
    out = own.join(whole, "container_id").join(F.broadcast(shares), "source").withColumn("running_tokens", running)
    return out.select("container_id", "source", "n_tokens", "container_tokens", "running_tokens", F.round(F.col("running_all") * F.col("source_tokens") / F.col("all_tokens"), 3).alias("target"))


def split_documents(packed: DataFrame) -> DataFrame:
    """Ids of the documents that had to be split."""
    return packed.filter("piece > 0 and doc_id is not null").select("doc_id").distinct()
