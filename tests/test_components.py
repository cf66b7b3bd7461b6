import numpy as np

from vistaforge.operators.components import connected_components, merge_local_labels
from vistaforge.operators.position import running_total, with_position


def brute(edges):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


def test_chain_hub_and_random(spark):
    rng = np.random.default_rng(3)
    cases = [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 200)], [tuple(map(int, e)) for e in rng.integers(0, 300, (250, 2)) if e[0] != e[1]]]
    for edges in cases:
        df = spark.createDataFrame(edges + edges[:3] + [(None, 5), (7, 7)], "a long, b long")
        got = {r["node"]: r["root"] for r in connected_components(df).collect()}
        assert got == brute(edges)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert merge_local_labels(spark.createDataFrame([], "n long, l long"), "n", "l").count() == 0


def test_labels_meet_at_shared_nodes(spark):
    rows = [(1, 1), (2, 1), (2, 20), (3, 20), (4, 4), (3, 30), (5, 30)]
    got = {r["node"]: r["root"] for r in merge_local_labels(spark.createDataFrame(rows, "n long, l long"), "n", "l").collect()}
    assert len({got[i] for i in (1, 2, 3, 5)}) == 1 and got[4] == 4


def test_positions(spark):
    rows = [(int(k), int(k) % 5) for k in np.random.default_rng(0).permutation(500)]
    df = spark.createDataFrame(rows, "k long, n long")
    assert [r["position"] == r["k"] for r in with_position(df, "k").collect()].count(False) == 0
    want = np.concatenate([[0], np.cumsum([k % 5 for k in range(500)])[:-1]])
    assert all(r["total_before"] == want[r["k"]] for r in running_total(df, "n", "k").collect())


def test_written_tables_are_read_back_with_their_size(spark):
    from vistaforge.session import written

    df = written(spark.range(10).toDF("x"))
    assert sorted(r["x"] for r in df.collect()) == list(range(10)) and written(df.limit(0)).count() == 0
    plan = spark.range(1_000_000).toDF("x").join(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
