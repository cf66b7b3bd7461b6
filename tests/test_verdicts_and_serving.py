import numpy as np
import pytest

from vistaforge.operators import serve, vlm
from vistaforge.sources import cache


@pytest.mark.parametrize(
    "text, want",
    [("ZOOM_IN 0.9", ("zoom_in", 0.9)), ("ZOOM_IN <0.9>", ("zoom_in", 0.9)), ("SAME 0.85", ("same", 0.85)), ("IRRELEVANT", ("irrelevant", 0.0)), ("zoom_out 7", ("zoom_out", 1.0)), ("SAME 0.9.1", ("same", 0.5)), ("it looks closer", ("zoom_in", 0.5)), ("", ("irrelevant", 0.0)), (None, ("irrelevant", 0.0)), ("irrelevant x.y 0..1", ("irrelevant", 0.0))],
)
def test_answers(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(vlm.parse_answer("t").alias("p")).first()["p"]
    assert tuple(r) == want


def test_collective_answers(spark):
    rows = [(1, "Image_2: ZOOM_IN <0.9>\nImage_3: irrelevant\nImage_2: SAME .5", 2, 2), (2, None, 1, 2), (3, "Image 4 - SAME", 3, 2), (4, "x", 0, 2)]
    got = vlm.parse_collective(spark.createDataFrame(rows, "k long, response string, n_candidates int, offset int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "same", 0.5), (1, 1, "irrelevant", 0.0), (2, 0, "irrelevant", 0.0), (3, 0, "irrelevant", 0.0), (3, 1, "irrelevant", 0.0), (3, 2, "irrelevant", 0.0)]


def test_prompt_numbers_candidates():
    assert "Image_2 to Image_4" in vlm.collective_prompt(3, False) and "Image_3 to Image_5" in vlm.collective_prompt(3, True)


def test_cache_key_is_the_published_text(spark):
    import hashlib

    r = spark.createDataFrame([("m", "q", "p", [1, 2, 3, 4]), ("m", "q", "p", None)], "m string, q string, p string, b array<int>").select(vlm.cache_key("m", "q", "p", "b")).collect()
    assert [x[0] for x in r] == [hashlib.sha256(t.encode()).hexdigest() for t in ("m|q|p|[1, 2, 3, 4]", "m|q|p|None")]


def test_merge_pages_cover_everything(spark):
    rng = np.random.default_rng(0)
    short = spark.createDataFrame([(q, r, 100 + r, float(1 - r / 100)) for q in (1, 2) for r in range(37)], "query_id long, rank int, image_id long, score double")
    ver = spark.createDataFrame([(1, 100 + int(i), float(s)) for i, s in zip(rng.permutation(37)[:20], rng.integers(0, 3, 20))] + [(1, 5, 9.0)], "query_id long, image_id long, score double")
    m = serve.merged(ver, short).cache()
    assert m.count() == 74 and m.filter("query_id = 2 and verified").count() == 0
    pages = [r["image_id"] for o in range(0, 40, 10) for r in serve.page(m.filter("query_id = 1"), o, 10).orderBy("rank").collect()]
    assert pages == [r["image_id"] for r in m.filter("query_id = 1").orderBy("rank").collect()] and len(set(pages)) == 37
    assert serve.page(m, 100, 10).count() == 0
    with pytest.raises(ValueError):
        serve.page(m, -1, 10)
    assert serve.merged(ver.limit(0), short.limit(0)).count() == 0


def test_plans():
    assert serve.criterion_of("zoom-out", "vlm") == ("vlm_zoom_out", True) and serve.criterion_of(None) == ("skip", False)
    with pytest.raises(ValueError):
        serve.criterion_of("nearest")
    with pytest.raises(TypeError):
        serve.Config().with_options(colour=1)
    browse = serve.plan_request({"data": {"limit": 5, "offset": 10}})
    assert browse.criterion == "random" and browse.shortlist_size == 15
    assert len(serve.capabilities()["data"]["search_modes"]) == 6 and serve.echo({"a": 1})["data"] == {"a": 1}


def test_verdict_cache_replaces_and_keeps(spark, tmp_path):
    path, schema = str(tmp_path / "verdicts"), "key string, category string, confidence double"
    cache.merge_verdicts(spark, path, spark.createDataFrame([("a", "same", 0.5), ("b", "same", 0.1)], schema))
    got = cache.merge_verdicts(spark, path, spark.createDataFrame([("b", "zoom_in", 0.9), ("b", "zoom_in", 0.9), ("c", "same", 1.0)], schema))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "same", 0.5), ("b", "zoom_in", 0.9), ("c", "same", 1.0)]
    assert cache.export_json(got).count() == 3


def test_one_call_per_candidate(spark):
    model = lambda prompt, paths: f"SAME 0.{len(paths[0])}"
    c = spark.createDataFrame([(1, 5, "ab"), (1, 6, "abc")], "query_id long, image_id long, path string")
    assert sorted(map(tuple, vlm.ask_each(c, model).collect())) == [(1, 5, "same", 0.2), (1, 6, "same", 0.3)]
    assert "region" in vlm.pair_prompt(True) and vlm.ask_each(c.limit(0), model).count() == 0
