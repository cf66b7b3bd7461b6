import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vistaforge.functions import vectors as V


def test_normalize_rootsift_and_quantize(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(20)] + [(20, [0.0] * 16), (21, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r for r in df.select("id", "v", V.l2_normalize("v").alias("n"), V.root_sift("v").alias("r"), V.quantize("v").alias("q"), V.dequantize(V.quantize("v")).alias("b")).collect()}
    for i, v in rows[:20]:
        v = np.array(v)
        assert np.allclose(got[i]["n"], v / np.linalg.norm(v))
        s = np.sqrt(np.maximum(v / np.abs(v).sum(), 1e-6))
        assert np.allclose(got[i]["r"], s / np.linalg.norm(s))
        assert got[i]["q"] == np.clip(v * 512, 0, 255).astype(int).tolist()
        inside = (v >= 0) & (v < 255 / 512)
        assert np.all(np.abs(np.array(got[i]["b"]) - v)[inside] <= 1 / 512)
    assert got[20]["n"] == [0.0] * 16
    assert got[21]["n"] is None and got[21]["q"] is None


def test_distance_and_score(spark):
    r = spark.range(1).select(V.l2_distance(V.F.array(V.F.lit(3.0), V.F.lit(0.0)), V.F.array(V.F.lit(0.0), V.F.lit(4.0))).alias("d"), V.sim_kernel(V.F.lit(-0.5)).alias("k"), V.shortlist_score(V.F.lit(0.5)).alias("s")).first()
    assert (r["d"], r["k"], r["s"]) == (5.0, 0.0, 0.75)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=3, max_size=30), st.lists(st.floats(-1, 1), min_size=3, max_size=30))
def test_hull_area_ignores_order_and_inner_points(x, y):
    from vistaforge.operators.geometry import hull_area

    n = min(len(x), len(y))
    a, b = np.array(x[:n]), np.array(y[:n])
    p = np.random.default_rng(1).permutation(n)
    assert abs(hull_area(a, b) - hull_area(a[p], b[p])) < 1e-9
    inner = hull_area(np.append(a, a.mean()), np.append(b, b.mean()))
    assert abs(inner - hull_area(a, b)) < 1e-9
