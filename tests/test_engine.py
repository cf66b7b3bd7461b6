from functools import partial

import numpy as np
import pytest

from vistaforge.operators.serve import Config
from vistaforge.plans.engine import Engine, QueryImage
from vistaforge.plans.index import build_index, shortlisted_features
from vistaforge.plans.verdict_queries import Stub
from vistaforge.sources.cache import export_json, import_json
from vistaforge.sources.extract import HashExtractor


global_model = partial(HashExtractor, 16)
local_model = partial(HashExtractor, 16, 80)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("imgs")
    for i in range(30):
        (folder / f"{i:02}.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + bytes([i]))
    config = Config().with_options(input_dir=str(folder), global_desc_batch_size=4, matching_method="snn", quantize_local_desc=False)
    index = build_index(spark, str(folder), config, global_model, local_model, str(tmp_path_factory.mktemp("idx")), k=10)

    def describe(path, box):
        data = open(path, "rb").read()
        f = local_model().detect(data)
        rows = [(int(i), float(r.x), float(r.y), [float(v) for v in r.desc]) for i, r in f.iterrows()]
        return QueryImage(global_model().describe([data])[0].tolist(), spark.createDataFrame(rows, "kp_idx int, x double, y double, desc array<double>"), 480, 640)

    return Engine(spark, index, config, describe, Stub())


def ask(engine, mode=None, limit=5, offset=0, **options):
    search = {"search_mode": {"id": mode, "tool_data": {"x1": 0, "x2": 1, "y1": 0, "y2": 1}}} if mode else {}
    value = {"path": "07.png", "prefix": "collection"}
    return engine.search({"data": {"limit": limit, "offset": offset, "engine_options": {"diffusion": False} | options, "query": {"value": value} | search}})["data"]


def test_similarity_finds_the_query_first(engine):
    got = ask(engine)
    assert len(got["images"]) == 5 and got["images"][0]["path"] == "collection/07.png"
    assert got["images"][0]["overlays"]["rank"] == "Rank: 0" and got["images"][0]["overlays"]["score"] == "skip: 1, global_similarity: 1"
    assert got["images"][0]["overlays"]["paths_over"] == [] and "query_text" in got
    later = ask(engine, offset=3, limit=2)["images"]
    assert [i["path"] for i in later] == [i["path"] for i in got["images"][3:]] and later[0]["overlays"]["rank"] == "Rank: 3"


def test_diffusion_and_geometry(engine):
    assert ask(engine, diffusion=True)["images"][0]["path"].endswith("07.png")
    got = ask(engine, "num-inliers")["images"]
    assert got[0]["path"].endswith("07.png") and got[0]["overlays"]["score"].startswith("num_inliers: 80")
    corners = got[0]["overlays"]["paths_over"][0]["points_xy"]
    assert np.allclose(corners, [[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]], atol=1e-3)
    assert float(got[1]["output_information"]["text_info"]) < 50 and len(got) == 5
    assert ask(engine, "zoom-in")["images"][0]["output_information"]["text_info"] == "1.000"


def test_verdicts_and_browsing(engine):
    got = ask(engine, "zoom-in", zooming_alg="vlm")["images"]
    assert len(got) == 5 and got[0]["overlays"]["score"].startswith("vlm_zoom_in: ")
    page = lambda o: [i["path"] for i in engine.search({"data": {"limit": 10, "offset": o}})["data"]["images"]]
    assert len(page(0)) == 10 and len(set(page(0)) | set(page(10)) | set(page(20))) == 30
    with pytest.raises(ValueError):
        ask(engine, "nearest")


@pytest.mark.parametrize("features", ["dinosalad", "mast3r"])
def test_queries_described_by_the_models_of_the_index(spark, tmp_path, features):
    from vistaforge.plans.engine import describer
    from vistaforge.sources import cache, images

    folder = tmp_path / "imgs"
    folder.mkdir()
    for i in range(12):
        (folder / f"{i:02}.png").write_bytes(images.encode_png(np.random.default_rng(i).integers(0, 256, (20, 30, 3)).astype(np.uint8)))
    config = Config().with_options(input_dir=str(folder), global_features=features, num_local_features=60, quantize_local_desc=True, matching_method="snn")
    index = build_index(spark, str(folder), config, global_model, local_model, str(tmp_path / "idx"), k=5)
    assert spark.read.parquet(index.features_path).groupBy("image_id").count().filter("count = 60").count() == 12
    e = Engine(spark, index, config, describer(spark, config, global_model, local_model))
    assert ask(e)["images"][0]["path"].endswith("07.png")
    assert len(ask(e, "similarity-bbox", limit=4)["images"]) <= 4
    if features == "mast3r":
        counts = spark.read.parquet(index.features_path).groupBy("image_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
        from vistaforge.operators import shapes

        part = cache.feature_slice(spark, index.features_path, shapes.feature_offsets(counts), 50, 130).collect()
        assert sorted(r["row"] for r in part) == list(range(50, 130)) and {r["image_id"] for r in part} == {0, 1, 2}


def test_every_option_offered_answers(engine):
    from vistaforge.operators.serve import capabilities

    options = {o["id"]: o for o in capabilities()["data"]["engine_options"]}["matching_method"]
    assert options["default"] in options["values"]
    for method in options["values"]:
        assert len(ask(engine, "num-inliers", matching_method=method)["images"]) == 5


def test_stored_features_of_a_shortlist(engine, spark):
    got = shortlisted_features(spark, engine.index, engine.config, spark.createDataFrame([(3,), (3,)], "image_id long"))
    assert got.count() == 80
    assert engine.index.sizes.filter("h = 480 and w = 640").count() == 30


def test_verdicts_as_json(spark):
    v = spark.createDataFrame([("k1", "same", 0.5), ("k2", "zoom_in", 1.0)], "key string, category string, confidence double")
    assert sorted(map(tuple, import_json(export_json(v)).collect())) == sorted(map(tuple, v.collect()))


def test_http(engine):
    import json
    import threading
    import urllib.error
    import urllib.request

    from vistaforge.plans.http import server

    s = server(engine, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def post(path, body):
        r = urllib.request.Request(f"http://127.0.0.1:{s.server_address[1]}{path}", data=body, method="POST")
        try:
            with urllib.request.urlopen(r, timeout=60) as f:
                return f.status, json.loads(f.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert post("/image", b'{"a": 1}') == (200, {"message": "Image processed", "data": {"a": 1}})
    assert post("/capabilities", b"{}")[0] == 200
    status, got = post("/images", json.dumps({"data": {"limit": 2, "offset": 0}}).encode())
    assert status == 200 and len(got["data"]["images"]) == 2
    assert post("/images", b'{"data": {}}')[0] == 400 and post("/images", b"no json")[0] == 400 and post("/other", b"{}")[0] == 404
    s.shutdown()


def test_command_line(tmp_path, engine, capsys):
    from vistaforge.__main__ import main, parsed

    config, rest = parsed(["--global_model", "a:b", "--local_model", "c:d", "--inl_th", "3", "--use_diffusion", "true", "--vlm_bbox", "1,2,3,4", "--local_desc_image_size", "(640, 480)"])
    assert (config.inl_th, config.use_diffusion, config.vlm_bbox, config.local_desc_image_size, config.num_nn) == (3.0, True, (1, 2, 3, 4), (640, 480), 100)
    assert rest.global_model == "a:b" and rest.index_dir is None
    model = "vistaforge.sources.extract:HashExtractor"
    main(["--input_dir", engine.config.input_dir, "--index_dir", str(tmp_path / "idx"), "--global_model", model, "--local_model", model])
    assert "'images': 30" in capsys.readouterr().out
