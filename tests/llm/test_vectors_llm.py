import numpy as np
import pytest

from vistaforge.llm import clusters, neardup, neighbours, subset, vectors
from vistaforge.operators import cells

SCHEMA = "image_id long, global_descs array<float>, album string, id string, vec string, cell int, rank int, group_id string"
DIM = 24


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], a, "x", "y", 1, 2, "z") for i, v, a in rows], SCHEMA)


def collection(seed=0, copies=40, clusters_=6):
    """Clusters with near copies inside, scattered rows, unusable rows and repeats."""
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for c in range(clusters_):
        centre = rng.normal(size=DIM)
        centre /= np.linalg.norm(centre)
        for _ in range(60 if c else 200):
            v = centre + 0.09 * rng.normal(size=DIM)
            rows.append((n, v, f"a{c % 3}"))
            n += 1
    for _ in range(150):
        rows.append((n, rng.normal(size=DIM), None))
        n += 1
    for i in rng.choice(n, copies, replace=False):
        v = rows[i][1] / np.linalg.norm(rows[i][1])
        rows.append((n, v + 0.03 * rng.normal(size=DIM), rows[i][2]))
        n += 1
    for i in range(5):
        rows.append((n, rows[i][1], "a0"))
        n += 1
    good = {i: np.asarray(v, np.float32).astype(float) for i, v, _ in rows}
    rows += [rows[0], rows[1], (n, None, "a0"), (n + 1, [], "a0"), (n + 2, [0.0] * DIM, "a0"), (n + 3, [float("nan")] * DIM, "a0"), (n + 4, [1.0, None] + [0.0] * (DIM - 2), "a0"), (n + 5, [1.0] * 7, "a0"), (n + 6, [float("inf")] * DIM, "a0"), (None, [1.0] * DIM, "a0")]
    return rows, good


def similarities(good):
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ids, x @ x.T


def brute_groups(good, threshold):
    ids, s = similarities(good)
    i, j = np.nonzero(np.triu(s >= threshold, 1))
    return dict(zip(ids.tolist(), ids[vectors.local_roots(len(ids), i, j)].tolist()))


@pytest.mark.parametrize("task_rows", [200_000, 60])
def test_near_duplicates_agree_with_brute_force(spark, task_rows):
    rows, good = collection()
    want = brute_groups(good, 0.95)
    many = {r for r in want.values() if list(want.values()).count(r) > 1}
    got = {r["image_id"]: r["group_id"] for r in neardup.near_duplicate_groups(frame(spark, rows), task_rows=task_rows).collect()}
    assert got == {i: r for i, r in want.items() if r in many}
    pairs = neardup.near_duplicate_pairs(spark.createDataFrame(list(got.items()), "image_id long, group_id long")).collect()
    assert all(r["image_id_a"] < r["image_id_b"] for r in pairs) and len(pairs) == sum(k * (k - 1) // 2 for k in map(list(got.values()).count, many))


def test_near_duplicates_at_unlike_distances_from_the_centre_are_all_found(spark):
    rng, dim = np.random.default_rng(12), 96
    away = lambda n: (u := np.insert(rng.normal(size=(n, dim - 1)), 0, 0, axis=1)) / np.linalg.norm(u, axis=1, keepdims=True)
    at = lambda cosine, u: cosine * np.eye(dim)[0] + np.sqrt(1 - cosine**2) * u
    a, u = away(300), away(300)
    u -= (a * u).sum(axis=1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = np.concatenate([at(0.929, a), at(0.979, 0.55 * a + np.sqrt(1 - 0.55**2) * u), at(0.89, away(3_900))])
    good = {i: v.astype(np.float32).astype(float) for i, v in enumerate(rows)}
    want = brute_groups(good, 0.95)
    got = {r["image_id"]: r["group_id"] for r in neardup.near_duplicate_groups(frame(spark, [(i, v, "a") for i, v in good.items()])).collect()}
    assert got == {i: r for i, r in want.items() if list(want.values()).count(r) > 1} and len(got) >= 600


@pytest.mark.parametrize("rows", [15_000, 500_000, 4_000_000])
@pytest.mark.parametrize("cosine", [0.925, 0.9])
def test_pairs_at_the_threshold_meet_in_cells_of_any_size(rows, cosine):
    rng, n, dim = np.random.default_rng(9), 400, 96
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    norm = 2 - 2 * cosine
    c = 1 - 0.1 / (2 * norm)
    residual = (np.sqrt(norm) * np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])).astype(np.float32)
    met = np.zeros(n, bool)
    for _, keys, _ in neardup.signature_keys(residual, neardup.levels_of(rows, 0), 0.95):
        keys = keys.reshape(2, n, -1)
        met |= (keys[0] == keys[1]).any(axis=1)
    assert met.mean() >= 0.98


@pytest.mark.parametrize("partitions", [3, 300])
def test_one_group_may_hold_a_third_of_all_rows(spark, partitions):
    rng = np.random.default_rng(4)
    base = rng.normal(size=DIM)
    rows = [(i, base, "a") for i in range(400)] + [(400 + i, base + 0.001 * rng.normal(size=DIM), "a") for i in range(400)] + [(1_000 + i, rng.normal(size=DIM), "b") for i in range(800)]
    df = frame(spark, rows).repartition(partitions).cache()
    got = neardup.near_duplicate_groups(df, task_rows=300)
    assert got.count() == 800 and got.select("group_id").distinct().count() == 1
    labels = clusters.cluster_labels(df, task_rows=300)
    assert labels.filter("cluster_id = 0").count() == 800


@pytest.mark.parametrize("task_rows", [200_000, 60])
def test_clusters_agree_with_brute_force(spark, task_rows):
    rows, good = collection(1)
    want = brute_groups(good, 0.7)
    got = {r["image_id"]: r["cluster_id"] for r in clusters.cluster_labels(frame(spark, rows), task_rows=task_rows).collect()}
    assert got.keys() == want.keys()
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= 0.01 * len(want)


@pytest.mark.parametrize("shape", ["scattered", "loose", "tight"])
@pytest.mark.parametrize("threshold", [0.95, 0.7])
def test_parts_of_a_hot_cell_are_small_and_keep_pairs_together(shape, threshold):
    rng, n, dim, size = np.random.default_rng(6), 16_000, 96, 5
    middle = np.zeros(dim) if shape == "scattered" else np.eye(dim)[0]
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    v = unit(middle + {"scattered": 1, "loose": 0.5, "tight": 0.1}[shape] * unit(rng.normal(size=(n, dim))))
    ids, centre = np.arange(n), middle.astype(np.float32)
    way = cells.parts_of_cell(ids[:4_000], v[:4_000], centre, size, threshold, 0.99)
    row, part = way.of(v, ids, centre)
    assert np.bincount(part).max() * size <= 2.2 * n and len(row) <= 4.1 * n
    a, b = cells.partners(v, threshold, 5)
    (ra, pa), (rb, pb) = (way.of(x, np.arange(len(x)), centre) for x in (a, b))
    met = np.zeros(len(a), bool)
    met[np.intersect1d(ra * 10_000 + pa, rb * 10_000 + pb) // 10_000] = True
    if way.pivot is not None:
        met |= (a @ way.pivot >= threshold) & (b @ way.pivot >= threshold)
    assert met.mean() >= 0.98


def test_pairs_at_the_threshold_share_a_cluster_cell():
    rng = np.random.default_rng(8)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    centres = unit(rng.normal(size=(60, 96)))
    v = np.concatenate([unit(centres[rng.integers(0, 60, 4_000)] + 0.055 * rng.normal(size=(4_000, 96))), unit(rng.normal(size=(800, 96)))])
    directions = clusters.principal_directions(v)
    low, up = vectors.cell_limits(v, centres, directions, 0.7, clusters.RECALL)
    sims = lambda x: x @ directions @ (centres @ directions).T
    assert len(vectors.similar_cells(sims(v), low, up)[0]) < 1.5 * len(v)
    a, b = cells.partners(v, 0.7, 5)
    (ra, ca), (rb, cb) = (vectors.similar_cells(sims(x), low, up) for x in (a, b))
    met = np.intersect1d(ra * 1_000 + ca + 1, rb * 1_000 + cb + 1) // 1_000
    assert len(np.unique(met)) >= 0.99 * len(a)


def test_cluster_rows_agree_with_all_pairs():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(1, 16)) + s * rng.normal(size=(n, 16)) for s, n in ((0.2, 700), (0.5, 400), (0.3, 90), (1.0, 300), (0.35, 500))])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(len(v))]
    i, j = np.nonzero(np.triu(v @ v.T >= 0.7, 1))
    assert (clusters.cluster_rows(v) == vectors.local_roots(len(v), i, j)).all()
    assert len(clusters.cluster_rows(v[:0])) == 0 and clusters.cluster_rows(v[:1]).tolist() == [0]


def test_cluster_report(spark):
    rows, good = collection(1)
    df = frame(spark, rows)
    labels = clusters.cluster_labels(df)
    report = clusters.cluster_report(df, labels).collect()
    of = {r["image_id"]: r["cluster_id"] for r in labels.collect()}
    ids, s = similarities(good)
    at = {i: k for k, i in enumerate(ids.tolist())}
    for r in report:
        members = [at[i] for i, c in of.items() if c == r["cluster_id"]]
        assert r["cluster_size"] == len(members)
        mean = s[np.ix_(members, members)].mean(axis=1)
        assert abs(np.sort(mean)[::-1][r["rank"] - 1] - r["centrality"]) < 1e-3
    assert clusters.cluster_pairs(labels, labels.select("image_id").limit(5)).count() <= 10


def test_neighbours_recall(spark):
    rows, good = collection(2)
    ids, s = similarities(good)
    np.fill_diagonal(s, -2)
    df = frame(spark, rows)
    asked = spark.createDataFrame([(int(i),) for i in ids[::5]] + [(int(ids[0]),), (None,), (10**9,)], "query_id long")
    for task_rows in (50_000, 60):
        got = neighbours.nearest(df, asked, 5, task_rows=task_rows).collect()
        assert len(got) == 5 * len(ids[::5])
        found = {(r["query_id"], r["image_id"]) for r in got}
        want = {(int(i), int(ids[j])) for k, i in enumerate(ids) if k % 5 == 0 for j in np.argsort(-s[k])[:5]}
        assert len(found & want) >= 0.95 * len(want)
        assert all(q != i for q, i in found)
    assert neighbours.neighbour_pairs(spark.createDataFrame([(2, 1), (1, 2)], "query_id long, image_id long")).count() == 1


def test_codes_approach_the_vectors():
    x = np.random.default_rng(0).normal(size=(500, 16)).astype(np.float32)
    books = neighbours.train_codebooks(x, 8, 16)
    codes, norms = neighbours.encode(x, books)
    greedy, _ = neighbours.encode(x, books, beam=1)
    decode = lambda c: sum(books[k][c[:, k]] for k in range(8))
    assert np.allclose(np.linalg.norm(decode(codes), axis=1), norms, atol=1e-3)
    assert ((decode(codes) - x) ** 2).sum() <= ((decode(greedy) - x) ** 2).sum() < 0.7 * (x**2).sum()
    scores = neighbours.table_scores(x[:3], books, codes, norms)
    assert np.allclose(scores, x[:3] @ decode(codes).T / norms, atol=1e-3)


def test_subset_is_of_the_size_asked_and_spreads_over_groups(spark):
    rng = np.random.default_rng(0)
    big = rng.normal(size=DIM)
    rows = [(i, big + 0.02 * rng.normal(size=DIM), "a") for i in range(900)]
    for c in range(20):
        small = rng.normal(size=DIM)
        rows += [(1_000 + 10 * c + k, small + 0.02 * rng.normal(size=DIM), "b") for k in range(5)]
    rows += [rows[0], (5_000, None, "a"), (5_001, [0.0] * DIM, None), (None, [1.0] * DIM, "a")]
    asks = spark.createDataFrame([(1, None, 40), (2, "b", 7), (3, "a", 10_000), (4, "none", 5), (5, "a", None), (6, "a", 0), (1, None, 40)], "request_id int, album string, subset_size int")
    got = subset.varied_subset(frame(spark, rows), asks).collect()
    by = {k: [r["image_id"] for r in got if r["request_id"] == k] for k in range(1, 7)}
    assert [len(by[k]) for k in range(1, 7)] == [40, 7, 900, 0, 0, 0]
    assert all(len(set(v)) == len(v) for v in by.values())
    assert sum(i < 900 for i in by[1]) < 15 and len({i // 10 for i in by[1] if i >= 1_000}) >= 12
    again = subset.varied_subset(frame(spark, rows), asks).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_every_member_has_the_most_similar_drawn_row(spark):
    rows, good = collection(5)
    ids, s = similarities(good)
    at = {i: k for k, i in enumerate(ids.tolist())}
    asks = spark.createDataFrame([(1, None, 40), (2, "a1", 9), (3, "none", 3)], "request_id int, album string, subset_size int")
    df = frame(spark, rows)
    drawn = {(r["request_id"], r["image_id"]) for r in subset.varied_subset(df, asks).collect()}
    subset.CHOSEN_BLOCK, kept = 16, subset.CHOSEN_BLOCK
    small = {(r["request_id"], r["image_id"]): r for r in subset.subset_coverage(df, asks).collect()}
    subset.CHOSEN_BLOCK = kept
    got = {(r["request_id"], r["image_id"]): r for r in subset.subset_coverage(df, asks).collect()}
    assert {k for k, r in got.items() if r["chosen"]} == drawn and small.keys() == got.keys()
    assert {i for q, i in got if q == 1} == set(good) and {q for q, _ in got} == {1, 2}
    for (q, i), r in got.items():
        best = max(s[at[i], at[j]] for p, j in drawn if p == q)
        assert abs(r["similarity"] - best) < 1e-5 and abs(s[at[i], at[r["representative_id"]]] - best) < 1e-5 and (q, r["representative_id"]) in drawn
        assert abs(small[q, i]["similarity"] - best) < 1e-5


def test_subset_density_has_no_foreign_rows_in_it(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3_000, DIM)).astype(np.float32)
    v[:400] = v[0] + 0.2 * v[:400]
    asks = spark.createDataFrame([(1, None, 3_000), (2, "b", 3_000)], "request_id int, album string, subset_size int")
    df = frame(spark, [(i, x, "ab"[i % 2]) for i, x in enumerate(v)]).select("image_id", "global_descs", "album")
    unusable = spark.range(10_000, 610_000).selectExpr("id as image_id", "cast(null as array<float>) as global_descs", "'a' as album")
    got = subset.varied_subset(df.union(unusable), asks).collect()
    unit = (v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
    p = np.random.default_rng(subset.SEED).standard_normal((DIM, 20 * subset.REPEATS)).astype(np.float32)
    sign = ((unit @ p) > 0).reshape(3_000, subset.REPEATS, 20)
    for request, own in ((1, np.arange(3_000)), (2, np.arange(1, 3_000, 2))):
        want = np.zeros(len(own))
        for r in range(subset.REPEATS):
            _, at, n = np.unique(np.packbits(sign[own, r], axis=1), axis=0, return_inverse=True, return_counts=True)
            want += n[at.ravel()] / subset.REPEATS
        have = {x["image_id"]: x["density"] for x in got if x["request_id"] == request}
        assert len(have) == len(own) and np.mean([abs(have[i] - w) < 1e-3 for i, w in zip(own.tolist(), want)]) > 0.98


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, [0.0, 0.0], "a")], [(1, [1.0, 2.0], "a")]])
def test_empty_and_tiny_tables(spark, rows):
    df = frame(spark, rows)
    assert neardup.near_duplicate_groups(df).count() == 0
    usable = int(bool(rows) and rows[0][1] == [1.0, 2.0])
    assert clusters.cluster_labels(df).count() == usable
    assert neighbours.nearest(df, spark.createDataFrame([(1,)], "query_id long"), 3).count() == 0
    assert subset.subset_coverage(df, spark.createDataFrame([(1, None, 2)], "request_id int, album string, subset_size int")).count() == usable
    assert subset.varied_subset(df, spark.createDataFrame([(1, None, 2)], "request_id int, album string, subset_size int")).count() == usable
    assert subset.varied_subset(df, spark.createDataFrame([], "request_id int, album string, subset_size int")).count() == 0
