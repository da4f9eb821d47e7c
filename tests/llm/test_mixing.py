"""The mix against targets computed without Spark."""

from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from srcweave.llm import mixing

TABLES = Path("/root/testdata")


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """Level filling by bisection on the common level."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    low, high, total = 0.0, 3.0 * sum(sizes.values()) + 1, sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(most * sizes[s], weight[s] * level) for s in names) < total:
            low = level
        else:
            high = level
    return {s: min(most * sizes[s], weight[s] * low) for s in names}


def near_its_targets(got):
    own, taken, lengths = Counter(), Counter(), defaultdict(list)
    for r in got:
        own[r.source] += r["size"]
        taken[r.source] += r.taken
        lengths[r.source].append(r["size"])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
    want = targets(own)
    for r in got:
        assert r.source_size == own[r.source] and r.target == pytest.approx(want[r.source], abs=1e-3)
    return {s: abs(taken[s] - want[s]) / np.median(lengths[s]) for s in want}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_source_is_within_a_median_document_of_its_target(spark, sf):
    if not (TABLES / sf).exists():
        pytest.skip("tables are not here")
    docs = spark.read.parquet(str(TABLES / sf / "documents.parquet"))
    off = near_its_targets(mixing.mix_sources(docs).collect())
    assert max(off.values()) <= 1, off


def test_a_long_document_among_short_ones(spark):
    items = [(i, "w " * (3_000 if i % 50 == 7 else 20 + i % 9), "ab"[i % 2]) for i in range(100)]
    got = mixing.mix_sources(spark.createDataFrame(items, "doc_id long, text string, source string"))
    assert max(near_its_targets(got.collect()).values()) <= 1


def test_a_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_GROUP", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    items = [(None if i % 3 == 0 else i, "w " * (1 + i * i % 97), "abcd"[i % 10 // 3]) for i in range(3_000)]
    got = mixing.mix_sources(spark.createDataFrame(items, "doc_id long, text string, source string")).collect()
    assert len(got) == 3_000 and max(near_its_targets(got).values()) <= 1


def test_copies_are_right_on_average():
    size = np.array([900.0, 500, 300, 120, 60, 50, 40, 30, 20, 10] + [8.0] * 40)
    wanted = np.full(len(size), 0.4)
    rng = np.random.default_rng(1)
    drawn = np.array([mixing.settle(wanted, size, rng.random(len(size)), 3) for _ in range(4_000)])
    assert np.abs(drawn @ size - 0.4 * size.sum()).max() <= 8
    assert np.abs(drawn[:, :3].mean(0) - 0.4).max() < 0.05
