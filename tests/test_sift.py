import math

import numpy as np
from pyspark.sql import functions as F

from vistaforge.functions import frames
from vistaforge.operators import match, vlm
from vistaforge.plans import pairs
from vistaforge.sources import images, sift


def blobs(seed=0, h=120, w=150, n=90):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    out = np.full((h, w), 0.5)
    for _ in range(n):
        cy, cx, a, b, t = rng.uniform(15, h - 15), rng.uniform(15, w - 15), rng.uniform(2, 6), rng.uniform(2, 6), rng.uniform(0, 3)
        u, v = (x - cx) * np.cos(t) + (y - cy) * np.sin(t), (y - cy) * np.cos(t) - (x - cx) * np.sin(t)
        out += rng.uniform(-0.4, 0.4) * np.exp(-(u**2 / a**2 + v**2 / b**2) / 2)
    return np.clip(out, 0, 1)


def agree(a, b, move, within=2.0):
    i, j, _ = match.smnn(np.stack(a["desc"]), np.stack(b["desc"]), 0.9)
    p, q = a[["x", "y"]].to_numpy()[i], b[["x", "y"]].to_numpy()[j]
    return len(i), float((np.linalg.norm(move(p) - q, axis=1) < within).mean())


def test_keypoints_follow_turns_and_scales():
    g = blobs()
    a = sift.keypoints(g, most=150)
    assert len(a) >= 100 and np.allclose(np.linalg.norm(np.stack(a["desc"]), axis=1), 1)
    n, share = agree(a, sift.keypoints(np.rot90(g).copy(), most=150), lambda p: np.column_stack([p[:, 1], g.shape[1] - 1 - p[:, 0]]))
    assert n >= 40 and share > 0.9
    big = images.resize(g[..., None], 180, 225)[..., 0]
    n, share = agree(a, sift.keypoints(big, most=200), lambda p: p * 1.5 + 0.25)
    assert n >= 25 and share > 0.85
    assert len(sift.keypoints(np.full((60, 60), 0.3))) == 0 and len(sift.keypoints(np.zeros((5, 5)))) == 0


def test_files_are_matched(spark):
    files = [bytearray(images.encode_png(np.repeat((blobs(s) * 255).astype(np.uint8)[..., None], 3, axis=2))) for s in (1, 2)]
    shifted = bytearray(images.encode_png(np.repeat((blobs(1) * 255).astype(np.uint8)[5:, 7:, None], 3, axis=2)))
    left = spark.createDataFrame([(1, files[0])], "image_id long, content binary")
    right = spark.createDataFrame([(1, shifted), (2, files[1]), (3, bytearray(b"no picture")), (4, None)], "image_id long, content binary")
    got = pairs.match_files(left, right, "sift", sift.Sift, "smnn", 100, threshold=0.85)
    n = {r["image_id"]: r["n"] for r in got.groupBy("image_id").agg(F.count("*").alias("n")).collect()}
    assert n[1] > 25 and n.get(2, 0) < 0.3 * n[1] and set(n) <= {1, 2}
    right_place = got.filter("image_id = 1 and abs(x1 - x2 - 7) < 1.5 and abs(y1 - y2 - 5) < 1.5").count()
    assert right_place > 0.9 * n[1]
    one = got.filter("image_id = 1").limit(2).cache()
    key = ["query_id", "image_id", "q_idx", "db_idx"]
    logits = F.array(*[F.lit(50.0 if k == 8 * 4 + 6 else 0.0) for k in range(64)])
    moved = pairs.refined(one, one.select(*key, logits.alias("logits")), one.select("query_id", "q_idx", F.lit(2.0).alias("scale")).distinct())
    assert moved.join(one.withColumnRenamed("x1", "x0"), key).filter("abs(x1 - x0 - 4) < 0.01").count() == one.count()


def test_frames(spark):
    df = spark.createDataFrame([(3.0, 4.0, 2.0, math.pi / 6), (1.0, 2.0, 1.0, 0.0)], "x double, y double, s double, a double")
    f = df.select("*", frames.frame("x", "y", "s", "a").alias("laf")).select("*", frames.centre("laf").alias("c"), frames.scale("laf").alias("fs"), frames.angle("laf").alias("fa"), frames.scale(frames.moved("laf", 2.0, 0.5)).alias("ms"), frames.centre(frames.moved("laf", 2.0, 0.5)).alias("mc"))
    for r in f.collect():
        assert abs(r["c"]["x"] - r["x"]) + abs(r["c"]["y"] - r["y"]) + abs(r["fs"] - r["s"]) + abs(r["fa"] - r["a"]) + abs(r["ms"] - r["s"]) < 1e-9
        assert abs(r["mc"]["x"] - 2 * r["x"]) + abs(r["mc"]["y"] - r["y"] / 2) < 1e-9
    assert df.select(frames.frame("x", "y").alias("f")).first()["f"] == [[1.0, 0.0, 3.0], [0.0, 1.0, 4.0]]


def test_pictures_that_cannot_be_read_are_in_no_call(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(images.encode_png(np.full((6, 600, 3), i, np.uint8)) if i != 1 else b"broken")
    rows = spark.createDataFrame([(0, i, i, str(tmp_path / f"{i}.png")) for i in range(4)] + [(0, 9, 9, None)], "query_id long, rank int, image_id long, path string")
    got = vlm.readable(rows, images.load)
    assert sorted(r["image_id"] for r in got.collect()) == [0, 2]
    model = vlm.with_pictures(lambda prompt, shown: f"Image_2: SAME {len(shown)} {shown[0].shape[1]}", images.load)
    assert [r["response"] for r in vlm.ask(got, model).collect()] == ["Image_2: SAME 2 448"]
