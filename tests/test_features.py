import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaforge.operators import geometry, match, planes, shapes


def feats(spark, x, name, image):
    return spark.createDataFrame([(image, i, v.tolist()) for i, v in enumerate(x)], f"{name} long, kp_idx long, desc array<double>")


def test_matchers_find_planted_pairs(spark):
    rng = np.random.default_rng(0)
    q = rng.normal(size=(30, 16))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    p = rng.permutation(30)
    d = q[p] + 0.01 * rng.normal(size=q.shape)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    want = {(int(p[j]), j) for j in range(30)}
    for method in ("snn", "smnn", "flann", "faiss_cpu", "mnn", "dual_softmax"):
        got = match.match_features(feats(spark, q, "query_id", 1), feats(spark, d, "image_id", 5), method).collect()
        assert {(r["q_idx"], r["db_idx"]) for r in got} == want, method
        assert all(r["query_id"] == 1 and r["image_id"] == 5 for r in got)


def test_matchers_on_few_features(spark):
    q, d = feats(spark, np.eye(4), "query_id", 1), feats(spark, np.eye(4)[:1], "image_id", 2)
    for method in ("snn", "smnn"):
        assert match.match_features(q, d, method).count() == 0
    assert match.match_features(q.limit(0), d, "snn").count() == 0
    assert match.match_features(q, d.limit(0), "mnn").count() == 0
    with pytest.raises(NotImplementedError):
        match.match_features(q, d, "lightglue")
    match.register_matcher("first", lambda a, b: (np.array([0]), np.array([0]), np.array([1.0])))
    assert match.match_features(q, d, "first").count() == 1
    del match.METHODS["first"]


H = np.array([[1.2, 0.1, 30.0], [-0.05, 1.1, -12.0], [1e-4, 2e-4, 1.0]])


def planted(n, outliers, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 600, (n, 2))
    p = np.column_stack([a, np.ones(n)]) @ H.T
    b = p[:, :2] / p[:, 2:] + rng.normal(0, 0.3, (n, 2))
    b[:outliers] = rng.uniform(0, 600, (outliers, 2))
    return a, b


def test_ransac_recovers_a_planted_homography():
    a, b = planted(200, 60)
    h, inl = geometry.ransac(a, b, 2.0)
    assert inl[60:].mean() > 0.97 and np.abs(h / h[2, 2] - H).max() < 1.0
    assert geometry.ransac(a[:3], b[:3])[0] is None
    line = np.column_stack([np.arange(60.0), np.arange(60.0)])
    geometry.ransac(line, line)


def test_verification_gates_and_order(spark):
    rows = []
    for image, (n, out) in {1: (200, 40), 2: (49, 0), 3: (100, 70), 4: (120, 10)}.items():
        a, b = planted(n, out, image)
        rows += [(0, image, *map(float, x), *map(float, y)) for x, y in zip(a, b)]
    pts = spark.createDataFrame(rows, "query_id long, image_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["image_id"]: r for r in geometry.verify(pts, "num_inliers").collect()}
    assert got[2]["status"] == "few_matches" and got[2]["score"] == 0 and got[2]["h"] == [[0.0] * 3] * 3
    assert got[3]["status"] == "few_inliers" and 20 <= got[3]["score"] <= 50
    assert got[1]["score"] > 150 and got[4]["score"] > 100
    up = {r["image_id"]: r["score"] for r in geometry.verify(pts, "scale_factor_max").collect()}
    down = {r["image_id"]: r["score"] for r in geometry.verify(pts, "scale_factor_min").collect()}
    assert up[3] == up[2] == 0 and abs(up[1] * down[1] - 1) < 0.1
    short = spark.createDataFrame([(0, 0, 2), (0, 1, 4), (0, 2, 1), (0, 3, 9)], "query_id long, rank int, image_id long")
    order = geometry.resorted(geometry.verify(pts, "num_inliers").select("query_id", "image_id", "score"), short).orderBy("rank").collect()
    assert [r["image_id"] for r in order] == [1, 4, 2, 9]
    assert geometry.verify(pts.limit(0)).count() == 0
    with pytest.raises(ValueError):
        geometry.verify(pts, "area")


def plane_of(spark, a, image=0):
    return spark.createDataFrame([(image, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id long, y int, x int, v double")


def test_peaks_against_brute_force(spark):
    a = np.random.default_rng(1).integers(0, 30, (20, 17)).astype(float)
    want = {(y, x) for y in range(20) for x in range(17) if a[y, x] > 5 and a[y, x] == a[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].max()}
    got = planes.local_peaks(plane_of(spark, a), 2, 5.0)
    assert {(r["y"], r["x"]) for r in got.collect()} == want
    inner = {(r["y"], r["x"]) for r in planes.local_peaks(plane_of(spark, a), 2, 5.0, border=4).collect()}
    assert inner == {(y, x) for y, x in want if 4 <= y < 16 and 4 <= x < 13}
    assert planes.local_peaks(plane_of(spark, a).limit(0)).count() == 0
    assert planes.top_keypoints(got, 3).count() == 3


def test_transport_keeps_mass_and_soft_argmax_finds_the_peak(spark):
    s = np.random.default_rng(0).normal(size=(4, 30))
    p = np.exp(planes.transport_weights(s, rounds=50))
    assert np.allclose(p.sum(axis=0), 1, atol=1e-6) and np.allclose(p[:4].sum(axis=1), 1, atol=1e-3)
    v = [0.0] * 64
    v[8 * 6 + 2] = 20.0
    r = spark.createDataFrame([(v,)], "v array<double>").select(planes.soft_argmax("v").alias("o")).first()["o"]
    assert abs(r["dx"] + 2) < 1e-6 and abs(r["dy"] - 2) < 1e-6 and r["confidence"] > 0.99


def test_sampling(spark):
    a = np.arange(12.0).reshape(3, 4)
    pts = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 7.0, 5.0), (0, 3, 3.5, 2.5), (0, 4, 900.0, 9.0)], "image_id long, point_id long, x double, y double")
    got = {r["point_id"]: r["value"] for r in planes.sample_plane(plane_of(spark, a), pts, (3, 4), (6, 8)).collect()}
    assert got[4] == 0 and abs(got[3] - 5.5) < 1e-9 and abs(got[1] - a[0, 0] * 0.25) < 1e-9 and abs(got[2] - a[2, 3] * 0.25) < 1e-9


def test_shapes(spark):
    rows = [(1, 1000, 750), (2, 512, 512), (3, 1, 2000), (4, 0, 10), (5, None, 5)]
    s = spark.createDataFrame(rows, "image_id long, w int, h int").withColumn("o", shapes.patch_shape("w", "h"))
    got = {r["image_id"]: r["o"] for r in s.collect()}
    assert tuple(got[1]) == (384, 512) and tuple(got[2]) == (384, 512) and tuple(got[3]) == (512, 0) and got[4] is None and got[5] is None
    chunks = shapes.image_chunks(shapes.feature_offsets(spark.createDataFrame([(i, i) for i in range(20)], "image_id long, n long")), 50)
    assert {r["image_id"]: r["start"] for r in chunks.collect()} == {i: i * (i - 1) // 2 for i in range(20)}
    assert shapes.feature_offsets(spark.createDataFrame([], "image_id long, n long")).count() == 0
    assert shapes.commonest_shape(spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "h int, w int")).first()["n"] == 2
    assert s.select(F.count("*")).first()[0] == 5


def test_spatial_matching_keeps_what_moves_alike(spark):
    rng = np.random.default_rng(1)
    n = 240
    q = rng.normal(size=(n, 32))
    d = q + 0.05 * rng.normal(size=q.shape)
    at = rng.uniform(0, 400, (n, 2))
    turn = np.array([[0.9, -0.3], [0.3, 0.9]])
    moved = at @ turn.T + (30, 10)
    wrong = np.arange(n) >= 160
    moved[wrong] = rng.uniform(0, 400, (wrong.sum(), 2))
    rows = lambda x, p, name, i: spark.createDataFrame([(i, k, v.tolist(), float(a), float(b)) for k, (v, (a, b)) in enumerate(zip(x, p))], f"{name} long, kp_idx long, desc array<double>, x double, y double")
    got = match.match_features(rows(q, at, "query_id", 1), rows(d, moved, "image_id", 2), "adalam", error=0.5, area=1 / 10).collect()
    pairs = {(r["q_idx"], r["db_idx"]) for r in got}
    assert len({p for p in pairs if p[0] < 160}) > 140 and len({p for p in pairs if p[0] >= 160}) < 8
    assert match.locally_affine(q[:2], d[:2], at[:2], moved[:2])[0].size == 0


def test_matching_a_shortlist_meets_only_its_pairs(spark):
    x = np.eye(6)
    q = feats(spark, x, "query_id", 1).unionByName(feats(spark, x, "query_id", 2))
    d = feats(spark, x, "image_id", 7).unionByName(feats(spark, x, "image_id", 8))
    short = spark.createDataFrame([(1, 7), (2, 8), (1, 8), (1, 8), (9, 7)], "query_id long, image_id long")
    got = match.match_features(q, d, "mnn", short, threshold=0)
    assert sorted({(r["query_id"], r["image_id"]) for r in got.collect()}) == [(1, 7), (1, 8), (2, 8)] and got.count() == 18
    assert match.match_features(q, d, "mnn", threshold=0).count() == 24


def test_transport_is_of_its_form_and_settles_at_its_sums():
    rng = np.random.default_rng(2)
    s = 3 * rng.normal(size=(4, 30))
    p = np.exp(planes.transport_weights(s, 1.0, 200))
    assert np.allclose(p.sum(axis=0), 1) and np.allclose(p.sum(axis=1), [1, 1, 1, 1, 26], atol=1e-6)
    k = np.log(p) - np.vstack([s, np.ones(30)])
    assert np.allclose(k - k[:1], (k - k[:1])[:, :1], atol=1e-9)
    with pytest.raises(ValueError):
        planes.transport_weights(s.T)
