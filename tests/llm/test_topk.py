import math
import random

import numpy as np
import pytest

from lodestrata.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in ok if i % 100 == 0}:
        best = {}
        for v in (v for i, v in ok if i == q):
            for i, w in ok:
                if i != q:
                    s = sum(a * b for a, b in zip(v, w, strict=False))
                    best[i] = max(best.get(i, s), s)
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2, 16), (1024, 16_384)])
def test_equals_brute_force_with_ties_and_bad_vectors(spark, blocks):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(20)]) for k in range(0, 900, 3)] + [(k, [rng.gauss(0, 1) for _ in range(20)]) for k in range(1, 600, 5)]
    rows += [(1200, None), (1300, []), (1400, [1.0, None]), (1500, [float("nan")] * 20), (1600, [float("inf")] * 20), (None, [1.0] * 20), (1700, [2.0, 1.0]), (300, [0.5] * 20), (1800, [-0.0001] * 20)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = topk.topk(df, df.where("vec_id % 100 = 0"), query_block=blocks[0], candidate_block=blocks[1])
    assert sorted(map(tuple, found.collect())) == brute(rows, 10)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.topk(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert topk.topk(df.where("vec_id > 5"), df.where("vec_id > 5")).count() == 0


def test_pruning_keeps_every_score_that_counts():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-900, 900, (5, 64)).astype(float), rng.integers(-900, 900, (400, 64)).astype(float)
    for i, at, score in topk.block_topk(q, c, np.arange(5) - 9, np.arange(400), 7):
        all_scores = c @ q[i]
        assert set(np.flatnonzero(all_scores >= np.sort(all_scores)[-7])) == set(at.tolist()) and (score == all_scores[at]).all()


def test_large_components_stay_exact_and_scores_fit():
    big = float(2**40)
    q, c = np.array([[big, 3.0]]), np.array([[2.0, 1.0], [2.0, 5.0], [1.0, 9.0]]) * 2.0**20
    (i, at, score), = topk.block_topk(q, c, np.array([-1]), np.arange(3), 2)
    exact = [int(a) * int(big) + int(b) * 3 for a, b in c]
    assert {int(a): int(s) for a, s in zip(at, score, strict=True)} == {k: exact[k] for k in (0, 1)}
    whole = topk._whole(np.array([[2.0**60, -7.0]]), object)
    assert all(type(x) is int for x in whole.ravel())
    with pytest.raises(OverflowError):
        topk._longs(np.array([2**70], object))


def test_floors_of_other_blocks_prune_and_hot_vectors_stay_whole(spark):
    """A third of the rows are one vector; blocks are many and small."""
    rng = random.Random(4)
    rows = [(k, [1.0, 0.5, -0.5, 0.25] * 5 if k % 3 == 0 else [rng.gauss(0, 0.4) for _ in range(20)]) for k in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.topk(df, df.where("vec_id % 100 = 0"), query_block=3, candidate_block=40)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10)
    nrng = np.random.default_rng(2)
    q, c = nrng.integers(-900, 900, (3, 64)).astype(float), nrng.integers(-900, 900, (300, 64)).astype(float)
    for i, at, score in topk.block_topk(q, c, np.arange(3) - 9, np.arange(300), 7, floors=np.array([np.inf, 1e5, -np.inf])):
        scores = c @ q[i]
        want = set(np.flatnonzero(scores >= np.sort(scores)[-7])) & set(np.flatnonzero(scores >= [np.inf, 1e5, -np.inf][i]))
        assert set(at.tolist()) == want
