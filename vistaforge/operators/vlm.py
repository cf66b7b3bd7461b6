"""Verdicts of vision-language models: prompts, parsing, scores, the verdict cache and chunking of what is left to ask.

Parsing is regular expressions on columns; models themselves plug in as callables ``(prompt, candidates) -> text``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Short model names, weights of categories by criterion, words and pattern of answers.
MODEL_SHORTCUTS = {
    "qwen2vl-2b": "Qwen/Qwen2-VL-2B-Instruct",
    "qwen2vl-7b": "Qwen/Qwen2-VL-7B-Instruct",
    "qwen2.5vl-3b": "Qwen/Qwen2.5-VL-3B-Instruct",
    "qwen2.5vl-7b": "Qwen/Qwen2.5-VL-7B-Instruct",
    "gemma3-4b": "google/gemma-3-4b-it",
    "gemma3-12b": "google/gemma-3-12b-it",
    "gemma3-27b": "google/gemma-3-27b-it",
    "deepseek-vl-1.3b": "deepseek-community/deepseek-vl-1.3b-chat",
    "deepseek-vl-7b": "deepseek-community/deepseek-vl-7b-chat",
    "paligemma-3b": "google/paligemma-3b-mix-448",
}
FAMILIES = (
    (("qwen2.5-vl", "qwen2.5_vl"), "qwen2vl"),
    (("qwen2-vl", "qwen2_vl"), "qwen2vl"),
    (("paligemma",), "paligemma"),
    (("gemma-3", "gemma3"), "gemma3"),
    (("deepseek-vl", "deepseek_vl"), "deepseek"),
)
WEIGHTS = {
    "vlm_zoom_in": {"zoom_in": 1.0, "same": 0.3, "zoom_out": 0.1, "irrelevant": 0.0},
    "vlm_zoom_out": {"zoom_out": 1.0, "same": 0.3, "zoom_in": 0.1, "irrelevant": 0.0},
    "vlm_relevant": {"zoom_in": 1.0, "zoom_out": 1.0, "same": 1.0, "irrelevant": 0.0},
}
CATEGORY = "(ZOOM_IN|ZOOM_OUT|SAME|IRRELEVANT)"
ONE_ANSWER = CATEGORY + r"\s*<?([0-9.]+)>?"
ANSWER_LINE = r"IMAGE_?(\d+)\s*[:\-]\s*" + CATEGORY + r"\s*<?([0-9.]*)>?"
KEYWORDS = (
    (("IRRELEVANT", "NOT VISIBLE", "NOT PRESENT"), "irrelevant", 0.0),
    (("ZOOM_IN", "LARGER", "CLOSER", "BIGGER"), "zoom_in", 0.5),
    (("ZOOM_OUT", "SMALLER", "FARTHER", "WIDER"), "zoom_out", 0.5),
    (("SAME", "SIMILAR"), "same", 0.5),
)
CHUNK = 8


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def resolve_model(name: Column | str) -> Column:
    """The full model name of a short one, in any case; other names pass."""
    table = F.create_map(*[F.lit(x) for kv in MODEL_SHORTCUTS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(_c(name))), _c(name))


def model_family(name: Column | str) -> Column:
    out = F.lit("auto")
    for parts, family in reversed(FAMILIES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(F.lower(_c(name)), F.lit(p))
        out = F.when(hit, family).otherwise(out)
    return out


def _confidence(text: Column, category: Column) -> Column:
    """Clamped to [0, 1]; what is no number counts as 0.5, or 0 for irrelevant."""
    number = text.try_cast("double")
    return F.when(number.isNull(), F.when(category == "irrelevant", 0.0).otherwise(0.5)).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def parse_answer(response: Column | str) -> Column:
    """struct(category, confidence) of an answer about one candidate; NULL and text without a verdict are irrelevant, 0."""
    r = F.upper(F.trim(F.coalesce(_c(response), F.lit(""))))
    category = F.lower(F.regexp_extract(r, ONE_ANSWER, 1))
    verdict = F.struct(category.alias("category"), _confidence(F.regexp_extract(r, ONE_ANSWER, 2), category).alias("confidence"))
    fallback = F.struct(F.lit("irrelevant").alias("category"), F.lit(0.0).alias("confidence"))
    for words, name, value in reversed(KEYWORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(r, F.lit(w))
        fallback = F.when(hit, F.struct(F.lit(name).alias("category"), F.lit(value).alias("confidence"))).otherwise(fallback)
    return F.when(category != "", verdict).otherwise(fallback)


def parse_collective(responses: DataFrame) -> DataFrame:
    """``(*keys, candidate, category, confidence)`` for every candidate 0 .. n_candidates - 1 of each row of ``responses``.

    Columns used: response, n_candidates, offset; all others are keys. Numbers outside are ignored, the last line about a candidate
    holds, candidates without a line are irrelevant with 0.
    """
    keys = [c for c in responses.columns if c not in ("response", "n_candidates", "offset")]
    lines = F.regexp_extract_all(F.upper(F.coalesce("response", F.lit(""))), F.lit(ANSWER_LINE), F.lit(0))

    def answer(line: Column) -> Column:
        category = F.lower(F.regexp_extract(line, ANSWER_LINE, 2))
        at = F.regexp_extract(line, ANSWER_LINE, 1).try_cast("int") - F.col("offset")
        return F.struct(at.alias("candidate"), category.alias("category"), _confidence(F.regexp_extract(line, ANSWER_LINE, 3), category).alias("confidence"))

    every = responses.filter("n_candidates > 0").withColumn("answers", F.transform(lines, answer))
    rows = every.select(*keys, "answers", F.explode(F.sequence(F.lit(0), F.col("n_candidates") - 1)).alias("candidate"))
    own = F.element_at(F.reverse(F.filter("answers", lambda a: a["candidate"] == F.col("candidate"))), 1)
    rows = rows.withColumn("own", F.when(F.exists("answers", lambda a: a["candidate"] == F.col("candidate")), own))
    return rows.select(*keys, "candidate", F.coalesce("own.category", F.lit("irrelevant")).alias("category"), F.coalesce("own.confidence", F.lit(0.0)).alias("confidence"))


def verdict_score(category: Column | str, confidence: Column | str, criterion: str) -> Column:
    """Weight of the category under the criterion times the confidence; an unknown criterion counts as ``vlm_relevant``."""
    weights = WEIGHTS.get(criterion, WEIGHTS["vlm_relevant"])
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(table, _c(category)), F.lit(0.0)) * F.coalesce(_c(confidence), F.lit(0.0))


def cache_key(model: Column | str, query_hash: Column | str, path: Column | str, bbox: Column | str | None = None) -> Column:
    """SHA-256 of model|query|path|box; the box is an array of ints written as ``[1, 2, 3, 4]``, or ``None``."""
    box = F.lit("None") if bbox is None else F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(_c(bbox), lambda x: x.cast("string")), ", "), F.lit("]")), F.lit("None"))
    return F.sha2(F.concat_ws("|", _c(model), _c(query_hash), _c(path), box), 256)


def thumbnail_hash(pixels: Column | str) -> Column:
    """MD5 of the bytes of a thumbnail, which an image slot makes."""
    return F.md5(_c(pixels))


def split_by_cache(candidates: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with category and confidence, misses) of candidates that have a column ``key``; a key written twice counts once."""
    known = cache.groupBy("key").agg(F.max_by(F.struct("category", "confidence"), F.struct("confidence", "category")).alias("v"))
    hits = candidates.join(known, "key").select(*candidates.columns, "v.category", "v.confidence")
    return hits, candidates.join(cache.select("key").distinct(), "key", "left_anti")


def chunks(candidates: DataFrame, size: int = CHUNK) -> DataFrame:
    """Candidates ``(query_id, rank, ...)`` with the number of the call they go into and their place in it."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "image_id")) - 1
    return candidates.withColumn("_at", at).withColumn("chunk", F.floor(F.col("_at") / size).cast("int")).withColumn("place", (F.col("_at") % size).cast("int")).drop("_at")


def collective_prompt(n: int, has_box: bool) -> str:
    """The request for one line per candidate; candidates are numbered after the query image, and its crop if there is a box."""
    first = 3 if has_box else 2
    last = first + n - 1
    seen = ["Image 1: the query image" + (" with the region of interest marked by a red box." if has_box else ".")]
    if has_box:
        seen.append("Image 2: the region of interest, cut out.")
    seen.append(f"Images {first}-{last}: candidates from the collection.")
    what = "the region in Images 1-2" if has_box else "the content of Image 1"
    forms = "\n".join(f"  Image_<k>: {c}" for c in ("ZOOM_IN <conf>", "ZOOM_OUT <conf>", "SAME <conf>", "IRRELEVANT"))
    return f"There are {last} images:\n" + "\n".join("- " + s for s in seen) + f"\n\nSay of every candidate whether it shows {what}, and whether larger (ZOOM_IN), smaller (ZOOM_OUT) or at the same scale.\nWrite exactly one line per candidate, in one of these forms:\n{forms}\n<conf> is from 0.1 to 1.0, k the number of the image. Write the lines for Image_{first} to Image_{last} and nothing else."


def readable(candidates: DataFrame, load: Callable[[str], object | None]) -> DataFrame:
    """The candidates whose picture ``load(path)`` gives; the others are in no call and so stay without a verdict."""

    def run(batches):
        for pdf in batches:
            yield pdf[[load(p) is not None for p in pdf["path"]]]

    return candidates.filter("path is not null").mapInPandas(run, candidates.schema)


def with_pictures(model: Callable[[str, list], str], load: Callable[[str], object | None]) -> Callable[[str, list], str]:
    """A backend that takes pictures as a model that takes paths, as ``ask`` and ``ask_each`` call it."""
    return lambda prompt, paths: model(prompt, [load(p) for p in paths])


def ask(candidates: DataFrame, model: Callable[[str, list], str], has_box: bool = False, size: int = CHUNK) -> DataFrame:
    """``(query_id, chunk, n_candidates, offset, response)``: one call per chunk of candidates ``(query_id, rank, image_id, path)``."""

    def run(key, pdf):
        pdf = pdf.sort_values("place")
        text = model(collective_prompt(len(pdf), has_box), pdf["path"].tolist())
        return pd.DataFrame({"query_id": [key[0]], "chunk": [key[1]], "n_candidates": [len(pdf)], "offset": [3 if has_box else 2], "response": [text]})

    return chunks(candidates, size).groupBy("query_id", "chunk").applyInPandas(run, "query_id long, chunk int, n_candidates int, offset int, response string")


def pair_prompt(has_box: bool) -> str:
    """The request about one candidate next to the query (or the query's region)."""
    what = "the region of interest of the first image" if has_box else "the content of the first image"
    return f"Two images are given. Does the second show {what}, and at what scale?\nAnswer with one line: ZOOM_IN <conf> if it is larger there, ZOOM_OUT <conf> if smaller, SAME <conf> if neither, IRRELEVANT if it is not there. <conf> is from 0.1 to 1.0."


def ask_each(candidates: DataFrame, model: Callable[[str, list], str], has_box: bool = False) -> DataFrame:
    """``(query_id, image_id, category, confidence)``: one call per candidate ``(query_id, image_id, path)``, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf["query_id"], "image_id": pdf["image_id"], "response": [model(pair_prompt(has_box), [p]) for p in pdf["path"]]})

    answers = candidates.select("query_id", "image_id", "path").mapInPandas(run, "query_id long, image_id long, response string")
    return answers.select("query_id", "image_id", parse_answer("response").alias("p")).select("query_id", "image_id", "p.category", "p.confidence")


def resort_by_verdict(shortlist: DataFrame, verdicts: DataFrame, criterion: str) -> DataFrame:
    """The shortlist ``(query_id, rank, image_id)`` by descending verdict score, former rank at ties; no verdict scores 0."""
    one = verdicts.filter("category is not null").groupBy("query_id", "image_id").agg(F.max_by("category", F.struct(F.coalesce("confidence", F.lit(0.0)), "category")).alias("category"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    scored = shortlist.join(one, ["query_id", "image_id"], "left").withColumn("score", F.round(verdict_score("category", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)), criterion), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "image_id")
    return scored.select("query_id", "image_id", "score", (F.row_number().over(w) - 1).cast("long").alias("rank"))


def size_for_model(w: Column | str, h: Column | str, longest: int = 448) -> Column:
    """struct(w, h) with the longest edge capped, truncated, at least 1."""
    w, h = _c(w), _c(h)
    scale = F.lit(float(longest)) / F.greatest(w, h)
    fit = lambda x: F.greatest(F.lit(1), (x * scale).cast("int"))
    return F.when(F.greatest(w, h) <= longest, F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))).otherwise(F.struct(fit(w).alias("w"), fit(h).alias("h")))


def side_by_side_size(w1: Column | str, h1: Column | str, w2: Column | str, h2: Column | str, height: int = 448) -> Column:
    """struct(w, h) of two images set next to each other at one height."""
    wide = lambda w, h: F.greatest(F.lit(1), (_c(w) * height / _c(h)).cast("int"))
    return F.struct((wide(w1, h1) + wide(w2, h2)).alias("w"), F.lit(height).alias("h"))
