import numpy as np
import pytest

from vistaforge.operators import asmk, diffusion, graph, knn


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 12)) + 2 * rng.normal(size=(8, 12))[rng.integers(0, 8, 160)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "image_id long, embedding array<double>")


def queries(df):
    return df.filter("image_id in (0, 7)").withColumnRenamed("image_id", "query_id")


def test_shortlist_and_blocks_agree_with_brute_force(spark, data):
    x, df = data
    d = np.linalg.norm(x - x[7], axis=1)
    order = np.lexsort((np.arange(160), d.round(6)))[:20]
    one = knn.l2_shortlist(df, x[7].tolist(), 20).collect()
    assert [r["image_id"] for r in one] == order.tolist()
    many = knn.blocked_topk(df, queries(df), 20, block=1).filter("query_id = 7").orderBy("rank").collect()
    assert [r["image_id"] for r in many] == order.tolist()
    assert knn.l2_shortlist(df, x[7].tolist(), 10_000).count() == 160
    assert knn.blocked_topk(df.limit(0), queries(df), 5).count() == 0
    with pytest.raises(ValueError):
        knn.blocked_topk(df, queries(df), 5, "cosine")


def test_ties_go_to_the_least_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "image_id long, embedding array<double>")
    got = knn.blocked_topk(df, queries(df), 3, "dot").filter("query_id = 0").orderBy("rank").collect()
    assert [r["image_id"] for r in got] == [0, 1, 2]


def dense_graph(x, k):
    s = np.round(np.round(x @ x.T, 6) ** 3, 9)
    w = np.zeros_like(s)
    for i, row in enumerate(np.round(x @ x.T, 6)):
        top = np.lexsort((np.arange(len(row)), -row))[:k]
        w[i, top] = np.maximum(s[i, top], 0)
    w = np.minimum(w, w.T)
    np.fill_diagonal(w, 0)
    d = w.sum(axis=1)
    inv = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    return inv[:, None] * w * inv


def test_graph_is_symmetric_and_solvers_agree_with_a_dense_solve(spark, data):
    x, df = data
    want = dense_graph(x, 20)
    wn = graph.normalized_graph(df, 20).cache()
    got = np.zeros_like(want)
    for r in wn.collect():
        got[r["src"], r["dst"]] = r["w"]
    assert np.allclose(got, want, atol=1e-6) and np.allclose(got, got.T) and np.abs(np.linalg.eigvalsh(got)).max() <= 1 + 1e-9
    seed = graph.query_seed(df, queries(df), 10)
    q = np.zeros(160)
    for r in seed.filter("query_id = 7").collect():
        q[r["image_id"]] = r["q"]
    exact = np.linalg.solve(np.eye(160) - 0.9 * want, q)
    for f, tol in ((diffusion.minres(wn, seed, steps=30), 1e-4), (diffusion.neumann(wn, seed, rounds=80, cut_every=20), 1e-3)):
        v = np.zeros(160)
        for r in f.filter("query_id = 7").collect():
            v[r["image_id"]] = r["f"]
        assert np.abs(v - exact).max() / np.abs(exact).max() < tol
    v = np.zeros(160)
    for r in diffusion.spectral(wn, seed, alpha=0.9, rank=160).filter("query_id = 7").collect():
        v[r["image_id"]] = r["f"]
    assert np.allclose(v, 0.1 * exact, atol=1e-6)
    near = diffusion.truncated(wn, seed, alpha=0.9, levels=1, steps=30).filter("query_id = 7")
    assert 0 < near.count() < 160
    full = diffusion.full_ranking(near, df.filter("image_id < 999"))
    assert full.count() == 160 and full.filter("reached").count() == near.count()


def test_random_shortlist_is_seeded_and_bounded(spark, data):
    _, df = data
    a = [tuple(r) for r in knn.random_shortlist(df, 10, 1).collect()]
    assert a == [tuple(r) for r in knn.random_shortlist(df, 10, 1).collect()] != [tuple(r) for r in knn.random_shortlist(df, 10, 2).collect()]
    assert knn.random_shortlist(df, 10_000, 1).count() == 161 and len({r[0] for r in a}) == 10


def test_inverted_file_finds_the_image_itself(spark):
    rng = np.random.default_rng(2)
    rows = [(i, k, rng.normal(size=16).tolist()) for i in range(12) for k in range(30)]
    f = spark.createDataFrame(rows, "image_id long, kp_idx long, desc array<double>")
    index = asmk.postings(f, asmk.train_words(f, 8)).cache()
    best = asmk.query_inverted_file(index, index.withColumnRenamed("image_id", "query_id"), 1).collect()
    assert len(best) == 12 and all(r["query_id"] == r["image_id"] for r in best)


def test_routed_neighbours_and_graph(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([c + 0.35 * rng.normal(size=(60, 24)) for c in centres] + [rng.normal(size=(40, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(9_000, None), (9_001, []), (9_002, [0.0] * 24), (None, [1.0] * 24)], "image_id long, embedding array<double>")
    want = {(i, int(j)) for i, row in enumerate(x @ x.T) for j in np.argsort(-row)[:10]}
    got = knn.routed_topk(df, 10, task_rows=100).collect()
    found = {(r["query_id"], r["image_id"]) for r in got}
    assert len(got) == len(found) and max(r["rank"] for r in got) == 10
    assert len(found & want) >= 0.93 * len(want)
    assert all(abs(r["value"] - x[r["query_id"]] @ x[r["image_id"]]) < 1e-5 for r in got[::50])
    assert knn.routed_topk(df.limit(0), 10).count() == 0
    clean = df.filter("size(embedding) = 24 and image_id is not null and image_id < 9000")
    exact, routed = (graph.kernel_edges(clean, 5, exact_rows=n).collect() for n in (10_000, 100))
    assert len({(r["src"], r["dst"]) for r in exact} & {(r["src"], r["dst"]) for r in routed}) >= 0.93 * len(exact)


def test_conjugate_residual_on_tables_is_minres(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "image_id long, embedding array<double>")
    wn = graph.normalized_graph(df, 10).cache()
    seed = graph.query_seed(df, df.filter("image_id in (1, 2)").withColumnRenamed("image_id", "query_id"), 5)
    one, two = ({(r["query_id"], r["image_id"]): r["f"] for r in f.collect()} for f in (diffusion.minres(wn, seed, steps=6), diffusion.diffuse(wn, seed, steps=6, task_edges=1)))
    assert all(abs(f - two.get(k, 0.0)) < 1e-6 for k, f in one.items()) and two.keys() <= one.keys()
    assert diffusion.conjugate_residual(wn, seed.limit(0), steps=3).count() == 0


def test_products_hold_the_greatest_with_ties_and_floors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:700] = x[100]
    ids, q = rng.permutation(900) + 5, np.concatenate([x[:40], 1e3 * x[90:110], 1e-4 * x[700:720]]).astype(np.float64)
    value = np.round(q @ x.T.astype(np.float64), 6)
    for k in (3, 50, 1_000):
        want = [sorted(zip(-row, ids))[:k] for row in value]
        for floor in (np.full(len(q), -np.inf), np.array([-w[-1][0] for w in want])):
            row, found, got, rank = knn.leading(*knn.products(q, ids, x, floor, k), k)
            assert [list(zip(-got[row == i], found[row == i])) for i in range(len(q))] == want
            assert all((rank[row == i] == np.arange(1, len(w) + 1)).all() for i, w in enumerate(want))


def test_routed_neighbours_shuffle_each_row_once(spark):
    """Queries that visit many cells, and what they find there, stay in their task."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    x = np.concatenate([c + 0.3 * rng.normal(size=(100, 24)) for c in rng.normal(size=(12, 24))] + [rng.normal(size=(800, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())], "image_id long, embedding array<double>")
    twice, once = (knn.routed_topk(f, 20, task_rows=100) for f in (df, df.dropDuplicates(["image_id"])))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert once.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("r")).agg(F.max("n"), F.sum(F.expr("int(n <> r)")), F.count("*")).first()[:] == (20, 0, 2_000)
    assert all(abs(r["value"] - x[r["query_id"]] @ x[r["image_id"]]) < 1e-4 for r in once.collect()[::20])
    assert twice.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("r")).filter("n > 20 or r <> n").count() == 0
    assert twice.dtypes == once.dtypes


def test_one_description_of_each_image(spark):
    from vistaforge.operators.cells import one_per_id

    rows = spark.createDataFrame([(1, [1.0], 5), (1, [2.0], 3), (1, [3.0], None), (2, [4.0], None), (3, [5.0], 1), (4, None, 1), (4, [6.0], 2)], "id long, vec array<double>, at long")
    assert sorted(tuple(r) for r in one_per_id(rows, "at").collect()) == [(1, [2.0]), (3, [5.0]), (4, None)]
