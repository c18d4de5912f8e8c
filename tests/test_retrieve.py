import numpy as np
import pytest

from ledgerloom.operators import retrieve


@pytest.mark.parametrize("floor", [None, 0.3])
def test_top_k_equals_brute_force(spark, floor, monkeypatch):
    rnd = np.random.default_rng(1)
    vectors = rnd.normal(size=(200, 6)).round(2)
    vectors[20:60] = vectors[3]  # ties beyond k
    vectors[70] = 0.0
    points = [(f"p{2**60 + i}", v.tolist()) for i, v in enumerate(vectors)]
    extra = [("none", None), ("gap", [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("short", [1.0, 2.0]), ("empty", [])]
    p = spark.createDataFrame(points + extra, "id string, vector array<double>")
    q = spark.createDataFrame([(2**60 + i, vectors[i].tolist()) for i in (3, 4, 5, 70)], "id long, vector array<double>")
    want = []
    for i in (3, 4, 5):
        n = np.sqrt((vectors * vectors).sum(axis=1))
        score = [(round(float(v @ vectors[i] / n[j] / n[i]), 6), points[j][0]) for j, v in enumerate(vectors) if n[j] > 0]
        near = sorted(((-s, k) for s, k in score if floor is None or s >= floor))[:5]
        want += [(2**60 + i, r, k, -s) for r, (s, k) in enumerate(near, 1)]
    monkeypatch.setattr(retrieve, "SHARD_FLOATS", 200)
    monkeypatch.setattr(retrieve, "BLOCK_SCORES", 50)
    got = sorted(map(tuple, retrieve.top_k(q, p, 5, floor).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")
    assert retrieve.top_k(one, none).count() == retrieve.top_k(none, one).count() == 0
