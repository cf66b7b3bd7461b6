"""Verdicts of vision-language models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaforge.operators import vlm
from vistaforge.plans.registry import query, table

_CASES = ["ZOOM_IN 0.9", "ZOOM_IN <0.9>", "same 0.85", "IRRELEVANT", "zoom_out 7", "SAME 0.9.1", "it looks closer", "", "  Zoom_Out<.5> maybe", "not visible here", "similar scale", "IRRELEVANT 0.4", "wider view", "ZOOM_IN", "no idea", "SAME 1. and ZOOM_IN 0.2"]
# The SQL has its own patterns, words and weights, so that a wrong one in the operators shows.
_ANSWER = {"cat": r"regexp_extract(r, '(ZOOM_IN|ZOOM_OUT|SAME|IRRELEVANT)[[:space:]]*<?([0-9.]+)>?', 1)", "conf": r"regexp_extract(r, '(ZOOM_IN|ZOOM_OUT|SAME|IRRELEVANT)[[:space:]]*<?([0-9.]+)>?', 2)"}
_LINE = "IMAGE_?([0-9]+)[[:space:]]*[:-][[:space:]]*(ZOOM_IN|ZOOM_OUT|SAME|IRRELEVANT)[[:space:]]*<?([0-9.]*)>?"


def _clamp(text: str) -> str:
    return f"CASE WHEN TRY_CAST({text} AS DOUBLE) IS NULL THEN CASE WHEN c = 'irrelevant' THEN 0::DOUBLE ELSE 0.5::DOUBLE END ELSE least(greatest(TRY_CAST({text} AS DOUBLE), 0), 1) END"


_KEY = """WHEN contains(r, 'IRRELEVANT') OR contains(r, 'NOT VISIBLE') OR contains(r, 'NOT PRESENT') THEN 'irrelevant'
WHEN contains(r, 'ZOOM_IN') OR contains(r, 'LARGER') OR contains(r, 'CLOSER') OR contains(r, 'BIGGER') THEN 'zoom_in'
WHEN contains(r, 'ZOOM_OUT') OR contains(r, 'SMALLER') OR contains(r, 'FARTHER') OR contains(r, 'WIDER') THEN 'zoom_out'
WHEN contains(r, 'SAME') OR contains(r, 'SIMILAR') THEN 'same'"""
_KEYCONF = """WHEN regexp_matches(r, 'IRRELEVANT|NOT VISIBLE|NOT PRESENT') THEN 0::DOUBLE
WHEN regexp_matches(r, 'ZOOM_IN|LARGER|CLOSER|BIGGER|ZOOM_OUT|SMALLER|FARTHER|WIDER|SAME|SIMILAR') THEN 0.5::DOUBLE"""
_PARSE = f"""t AS (SELECT id, upper(trim(coalesce(response, ''))) AS r FROM responses),
m AS (SELECT id, r, lower({_ANSWER['cat']}) AS c, {_ANSWER['conf']} AS n FROM t),
parsed AS (SELECT id, CASE WHEN c <> '' THEN c ELSE CASE {_KEY} ELSE 'irrelevant' END END AS category, CASE WHEN c <> '' THEN {_clamp('n')} ELSE CASE {_KEYCONF} ELSE 0::DOUBLE END END AS confidence FROM m) """


@query("WITH responses(id, response) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{c}')" for i, c in enumerate(_CASES)) + "), " + _PARSE + "SELECT id, category, confidence FROM parsed")
def vlm_parse_cases(spark, d):
    r = spark.createDataFrame(list(enumerate(_CASES)), "id long, response string")
    return r.select("id", vlm.parse_answer("response").alias("p")).select("id", "p.category", "p.confidence")


_TEXT = "coalesce(upper(category), 'no idea') || ' <0.' || lpad(cast(floor(least(greatest(coalesce(confidence, 0), 0), 0.999) * 1000) AS INT)::VARCHAR, 3, '0') || '>'"


def _answers(spark, d):
    v = table(spark, d, "vlm_verdict")
    number = F.floor(F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(0.999)) * 1000).cast("int").cast("string")
    return v.select("query_id", "image_id", F.concat(F.coalesce(F.upper("category"), F.lit("no idea")), F.lit(" <0."), F.lpad(number, 3, "0"), F.lit(">")).alias("response"))


@query("WITH responses AS (SELECT DISTINCT query_id::VARCHAR || '/' || image_id::VARCHAR AS id, " + _TEXT + " AS response FROM vlm_verdict WHERE query_id IS NOT NULL AND image_id IS NOT NULL), " + _PARSE + "SELECT id, category, confidence FROM parsed")
def vlm_parse_single(spark, d):
    """Answers written from the verdict table, parsed back."""
    a = _answers(spark, d).filter("query_id is not null and image_id is not null").select(F.concat_ws("/", F.col("query_id").cast("string"), F.col("image_id").cast("string")).alias("id"), "response").distinct()
    return a.select("id", vlm.parse_answer("response").alias("p")).select("id", "p.category", "p.confidence")


_COLLECTIVE = [(0, "Image_2: ZOOM_IN <0.9>\nImage_3: irrelevant", 2, 2), (1, "Image_9: SAME 1", 2, 2), (2, "Image 2: SAME 0.5", 1, 2), (3, "image3 - zoom_out .25\nImage_4: SAME\nImage_3: SAME 0.75", 3, 3), (4, "", 2, 3), (5, "Image_2: SAME 0.1.2", 1, 2)]


@query("WITH r(id, response, n_candidates, off) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{t}', {n}, {o})" for i, t, n, o in _COLLECTIVE) + f"""),
x AS (SELECT id, n_candidates, off, unnest(regexp_extract_all(upper(response), '{_LINE}', 1)) AS k, unnest(regexp_extract_all(upper(response), '{_LINE}', 2)) AS cat, unnest(regexp_extract_all(upper(response), '{_LINE}', 3)) AS n, generate_subscripts(regexp_extract_all(upper(response), '{_LINE}', 1), 1) AS pos FROM r),
l AS (SELECT id, (k::INT - off) AS candidate, lower(cat) AS c, n, pos FROM x),
w AS (SELECT id, candidate, arg_max(c, pos) AS category, arg_max({_clamp('n')}, pos) AS confidence FROM l GROUP BY id, candidate),
every AS (SELECT id, unnest(range(0, n_candidates))::INT AS candidate FROM r)
SELECT id, candidate, coalesce(category, 'irrelevant') AS category, coalesce(confidence, 0) AS confidence FROM every LEFT JOIN w USING (id, candidate)""")
def vlm_parse_collective(spark, d):
    return vlm.parse_collective(spark.createDataFrame(_COLLECTIVE, "id long, response string, n_candidates int, offset int"))


_W = "WHEN 'zoom_in' THEN 1::DOUBLE WHEN 'same' THEN 0.3::DOUBLE WHEN 'zoom_out' THEN 0.1::DOUBLE"


@query(f"SELECT DISTINCT query_id, image_id, round((CASE category {_W} ELSE 0::DOUBLE END) * coalesce(confidence, 0), 6) AS zoom_in, round((CASE WHEN category IN ('zoom_in', 'zoom_out', 'same') THEN 1 ELSE 0 END) * coalesce(confidence, 0), 6) AS relevant FROM vlm_verdict")
def vlm_criterion_score(spark, d):
    v = table(spark, d, "vlm_verdict")
    score = lambda c: F.round(vlm.verdict_score("category", "confidence", c), 6)
    return v.select("query_id", "image_id", score("vlm_zoom_in").alias("zoom_in"), score("unknown").alias("relevant")).distinct()


_VERDICT = f"""WITH v AS (SELECT query_id, image_id, arg_max(category, (coalesce(confidence, 0), category)) AS category, max(coalesce(confidence, 0)) AS confidence FROM vlm_verdict WHERE category IS NOT NULL GROUP BY ALL),
s AS (SELECT query_id, image_id, min(shortlist_rank) AS rank FROM shortlist GROUP BY ALL),
j AS (SELECT s.query_id, s.image_id, s.rank AS r, round((CASE category {_W} ELSE 0::DOUBLE END) * least(greatest(coalesce(confidence, 0), 0), 1), 6) AS score FROM s LEFT JOIN v USING (query_id, image_id)) """


@query(_VERDICT + "SELECT query_id, image_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r, image_id) - 1 AS rank FROM j")
def vlm_resort(spark, d):
    short = table(spark, d, "shortlist").groupBy("query_id", "image_id").agg(F.min("shortlist_rank").alias("rank"))
    return vlm.resort_by_verdict(short, table(spark, d, "vlm_verdict"), "vlm_zoom_in")


_PATHS = "(SELECT DISTINCT image_id, path FROM images)"
_CAND = f"""WITH c AS (SELECT DISTINCT s.query_id, s.image_id, p.path, sha256('Qwen/Qwen2-VL-2B-Instruct|' || md5(s.query_id::VARCHAR) || '|' || p.path || '|' || CASE WHEN s.query_id % 2 = 0 THEN 'None' ELSE '[10, 20, 300, ' || s.query_id::VARCHAR || ']' END) AS key
FROM shortlist s JOIN {_PATHS} p USING (image_id) WHERE s.query_id IS NOT NULL)"""


def _keyed(spark, d):
    paths = table(spark, d, "images").select("image_id", "path").distinct()
    c = table(spark, d, "shortlist").select("query_id", "image_id").filter("query_id is not null").distinct().join(paths, "image_id")
    box = F.when(F.col("query_id") % 2 == 1, F.array(F.lit(10), F.lit(20), F.lit(300), F.col("query_id").cast("int")))
    key = vlm.cache_key(vlm.resolve_model(F.lit("QWEN2VL-2b")), F.md5(F.col("query_id").cast("string")), "path", box)
    return c.select("query_id", "image_id", "path", key.alias("key"))


@query(_CAND + " SELECT * FROM c")
def vlm_cache_key(spark, d):
    return _keyed(spark, d)


def _cache(spark, d):
    v = table(spark, d, "vlm_verdict").filter("category is not null and confidence is not null and image_id % 3 <> 0")
    return _keyed(spark, d).join(v.groupBy("query_id", "image_id").agg(F.max("category").alias("category"), F.max("confidence").alias("confidence")), ["query_id", "image_id"]).select("key", "category", "confidence")


_KNOWN = _CAND + ", k AS (SELECT DISTINCT key, category, confidence FROM c JOIN (SELECT query_id, image_id, max(category) AS category, max(confidence) AS confidence FROM vlm_verdict WHERE category IS NOT NULL AND confidence IS NOT NULL AND image_id % 3 <> 0 GROUP BY ALL) v USING (query_id, image_id)) "


@query(_KNOWN + "SELECT query_id, image_id, category, confidence FROM c JOIN k USING (key)")
def vlm_cache_hit(spark, d):
    return vlm.split_by_cache(_keyed(spark, d), _cache(spark, d))[0].select("query_id", "image_id", "category", "confidence")


@query(_KNOWN + "SELECT query_id, image_id FROM c ANTI JOIN k USING (key)")
def vlm_cache_miss(spark, d):
    return vlm.split_by_cache(_keyed(spark, d), _cache(spark, d))[1].select("query_id", "image_id")


@query("WITH s AS (SELECT query_id, image_id, min(shortlist_rank) AS rank FROM shortlist GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, image_id) - 1 AS n FROM s) SELECT query_id, image_id, (n // 8)::INT AS chunk, (n % 8)::INT AS place FROM n")
def vlm_chunks(spark, d):
    short = table(spark, d, "shortlist").groupBy("query_id", "image_id").agg(F.min("shortlist_rank").alias("rank"))
    return vlm.chunks(short).select("query_id", "image_id", "chunk", "place")


class Stub:
    """Answers by the number in a path, in place of a model."""

    def __call__(self, prompt: str, paths: list) -> str:
        kinds = ("ZOOM_IN 0.75", "ZOOM_OUT 0.5", "SAME <0.25>", "IRRELEVANT")
        return "\n".join(f"Image_{i + 2}: {kinds[len(p) % 4]}" for i, p in enumerate(paths))


@query(f"""WITH s AS (SELECT query_id, image_id, min(shortlist_rank) AS rank FROM shortlist GROUP BY ALL),
p AS (SELECT image_id, min(path) AS path FROM images GROUP BY image_id),
k AS (SELECT query_id, image_id, ['zoom_in', 'zoom_out', 'same', 'irrelevant'][length(path) % 4 + 1] AS category FROM s JOIN p USING (image_id))
SELECT query_id, image_id, category, CASE category WHEN 'zoom_in' THEN 0.75::DOUBLE WHEN 'zoom_out' THEN 0.5::DOUBLE WHEN 'same' THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS confidence FROM k""")
def vlm_collective(spark, d):
    """The whole path from shortlist to verdicts: chunks, prompts, a stand-in model, parsing."""
    paths = table(spark, d, "images").groupBy("image_id").agg(F.min("path").alias("path"))
    short = table(spark, d, "shortlist").groupBy("query_id", "image_id").agg(F.min("shortlist_rank").alias("rank")).join(paths, "image_id")
    got = vlm.parse_collective(vlm.ask(short, Stub()).select("query_id", "chunk", "response", "n_candidates", "offset"))
    placed = vlm.chunks(short)
    return placed.join(got.withColumnRenamed("candidate", "place"), ["query_id", "chunk", "place"]).select("query_id", "image_id", "category", "confidence")


_MODELS = ["qwen2vl-2b", "QWEN2.5VL-7B", "gemma3-4b", "deepseek-vl-7b", "paligemma-3b", "some/other-model"]
_FAMILY = {"qwen2vl-2b": "qwen2vl", "QWEN2.5VL-7B": "qwen2vl", "gemma3-4b": "gemma3", "deepseek-vl-7b": "deepseek", "paligemma-3b": "paligemma", "some/other-model": "auto"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{vlm.MODEL_SHORTCUTS.get(m.lower(), m)}', '{_FAMILY[m]}')" for m in _MODELS) + ") t(name, model, family)")
def vlm_models(spark, d):
    m = spark.createDataFrame([(x,) for x in _MODELS], "name string").withColumn("model", vlm.resolve_model("name"))
    return m.withColumn("family", vlm.model_family("model"))


@query("""WITH s AS (SELECT DISTINCT image_id, h, w FROM image_size WHERE h > 0 AND w > 0)
SELECT image_id, h, w, CASE WHEN greatest(w, h) <= 448 THEN w ELSE greatest(1, trunc(w * (448.0::DOUBLE / greatest(w, h)))::INT) END AS w_out, CASE WHEN greatest(w, h) <= 448 THEN h ELSE greatest(1, trunc(h * (448.0::DOUBLE / greatest(w, h)))::INT) END AS h_out,
2 * greatest(1, trunc(w * 448 / h::DOUBLE)::INT) AS pair_width FROM s""")
def vlm_image_sizes(spark, d):
    s = table(spark, d, "image_size").select("image_id", "h", "w").distinct().filter("h > 0 and w > 0")
    o, two = vlm.size_for_model("w", "h"), vlm.side_by_side_size("w", "h", "w", "h")
    return s.select("image_id", "h", "w", o["w"].alias("w_out"), o["h"].alias("h_out"), two["w"].alias("pair_width"))
