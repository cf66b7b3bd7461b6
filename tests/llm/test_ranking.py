import pytest

from vistaforge.llm import ranking

S = "query_id long, image_id long, criterion string, score double, rank int, pct double"
C = "query_id long, image_id long, weakest double"


def run(spark, scores, cand, of=1, criteria=("a", "b")):
    s = spark.createDataFrame([(*r, 1, 0.5) for r in scores], S)
    c = spark.createDataFrame([(*r, 0.1) for r in cand], C)
    out = ranking.leximin_ranking(s, c, list(criteria), of).orderBy("query_id", "rank").collect()
    return [(r["query_id"], r["image_id"]) for r in out]


def test_weakest_score_decides_whatever_the_range(spark):
    scores = [(1, 1, "a", 1e9), (1, 2, "a", 2.0), (1, 3, "a", 1.0), (1, 1, "b", 0.1), (1, 2, "b", 0.2), (1, 3, "b", 0.3)]
    assert run(spark, scores, [(1, 1), (1, 2), (1, 3)])[0] == (1, 2)


def test_missing_scores_are_neutral_and_repeats_count_once(spark):
    scores = [(1, i, "a", float(i)) for i in range(1, 6)] + [(1, i, "b", float(i)) for i in range(1, 5)] + [(1, 5, "b", None), (1, 5, "b", float("nan")), (1, 4, "a", 4.0), (1, 99, "a", 50.0), (1, 3, "c", 1e6), (None, 3, "a", 1.0)]
    got = run(spark, scores, [(1, i) for i in (1, 2, 3, 4, 5, 5)] + [(None, 1), (1, None)])
    assert got == [(1, i) for i in (5, 4, 3, 2, 1)]


def test_ties_go_to_the_least_id_and_candidates_without_scores_stay(spark):
    assert run(spark, [(1, 1, "a", 0.0), (1, 2, "a", 0.0)], [(1, 2), (1, 1), (1, 7)]) == [(1, 1), (1, 2), (1, 7)]
    assert run(spark, [], [(3, 2), (3, 1)]) == [(3, 1), (3, 2)]
    assert run(spark, [(1, 1, "a", 0.0)], []) == []


def test_means_of_several_scores_keep_a_weak_one_from_deciding_alone(spark):
    scores = [(1, i, c, float(i)) for i in range(1, 8) for c in "abc"] + [(1, 8, "a", 9.0), (1, 8, "b", 9.0), (1, 8, "c", 0.0)]
    cand = [(1, i) for i in range(1, 9)]
    assert run(spark, scores, cand, 1, "abc")[-2:] == [(1, 8), (1, 1)]
    assert run(spark, scores, cand, 2, "abc") == [(1, i) for i in (7, 6, 5, 8, 4, 3, 2, 1)]
    assert run(spark, scores, cand, 3, "abc")[2] == (1, 8)


@pytest.mark.parametrize("n", [1, 500])
def test_percentiles_of_one_hot_query(spark, n):
    rows = [(1, i, "a", float(i // 2), 1, 0.0) for i in range(n)]
    got = {r["image_id"]: r["pct"] for r in ranking.percentiles(spark.createDataFrame(rows, S)).collect()}
    for i in range(n):
        below, same = (i // 2) * 2, min(2, n - (i // 2) * 2)
        assert abs(got[i] - (below + same / 2) / n) < 1e-12
