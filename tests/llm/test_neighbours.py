"""Recall, scores and ties of the neighbour search against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from srcweave.llm import neighbours


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def search(spark, x, **options):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = defaultdict(list)
    for r in neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in found.items()}


def in_order(a, b):
    total = 0.0
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        total += p * q
    return total


@pytest.mark.parametrize("dim", [64, 128])
@pytest.mark.parametrize("rotations", [1, 2])
def test_recall_is_at_least_nine_tenths(spark, dim, rotations):
    x = unit(np.random.default_rng(dim), 3_000, dim)
    found = search(spark, x, every=50, rotations=rotations)
    exact = x[::50] @ x.T
    exact[np.arange(60), np.arange(0, 3_000, 50)] = -np.inf
    best = np.argsort(-exact, axis=1)[:, :20]
    hits = sum(len({i for i, _ in found[50 * q]} & set(best[q].tolist())) for q in range(60))
    assert hits >= 0.9 * 60 * 20, hits / 1_200


def test_equal_vectors_have_equal_scores_and_come_by_id(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_SALT", 64)
    rng = np.random.default_rng(4)
    x = unit(rng, 1_200, 48)
    x[rng.permutation(1_200)[:200]] = x[1]  # a hot group of copies
    x[700:900] = x[100:300]
    for q, got in search(spark, x, k=30).items():
        assert [s for _, s in got] == [in_order(x[q], x[i]) for i, _ in got]
        assert got == sorted(got, key=lambda g: (-g[1], g[0])) and len(got) == 30


def test_copies_beyond_k_leave_the_smallest_ids(spark):
    x = np.repeat(unit(np.random.default_rng(6), 2, 16), 300, axis=0)
    for q, got in search(spark, x, k=25, every=100).items():
        same = [i for i in range(300 * (q // 300), 300 * (q // 300) + 300) if i != q]
        assert [i for i, _ in got] == same[:25]


def test_the_nearest_do_not_depend_on_the_batch():
    rng = np.random.default_rng(8)
    matrix = unit(rng, 500, 64)
    matrix[250:] = matrix[:250]
    ids, wanted = np.arange(500), unit(rng, 40, 64)
    own = np.full(40, -1)
    whole = neighbours.nearest_of(wanted, matrix, own, ids, 7)
    single = [neighbours.nearest_of(wanted[i : i + 1], matrix, own[:1], ids, 7) for i in range(40)]
    assert np.array_equal(whole[1], np.concatenate([s[1] for s in single]))
    assert np.array_equal(whole[2], np.concatenate([s[2] for s in single]))
