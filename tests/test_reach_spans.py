"""Reachability goes through long chains and rings in spans of depths, not depth by depth."""

import random
from collections import deque

from srcweave.operators import traversal as TV
from srcweave.session import Grown

EDGES = "project_id string, source string, target string"


def walked(pairs, seeds, max_depth=None):
    """Shortest distances by a walk from each seed."""
    next_ = {}
    for a, b in pairs:
        next_.setdefault(a, set()).add(b)
    found = {}
    for seed in seeds:
        depth, queue = {seed: 0}, deque([seed])
        while queue:
            n = queue.popleft()
            for m in next_.get(n, ()):
                if m not in depth and (max_depth is None or depth[n] < max_depth):
                    depth[m] = depth[n] + 1
                    queue.append(m)
        found |= {(seed, n): d for n, d in depth.items()}
    return found


def spans(spark, monkeypatch, search, pairs, seeds, max_depth=None):
    """What is found, and how many tables of waves it took."""
    added, add = [], Grown.add
    monkeypatch.setattr(Grown, "add", lambda self, rows: added.append(1) or add(self, rows))
    edges = spark.createDataFrame([("p", a, b) for a, b in pairs], EDGES)
    rows = search(edges, spark.createDataFrame([("p", s) for s in seeds], "project_id string, id string"), max_depth).collect()
    monkeypatch.undo()
    got = {(r.seed, r.id): r.depth for r in rows}
    assert len(got) == len(rows)
    return got, len(added)


def test_a_ring_takes_rounds_like_its_digits(spark, monkeypatch):
    pairs = [(f"r{i:02}", f"r{(i + 1) % 60:02}") for i in range(60)] + [(f"t{i}", f"t{i + 1}") for i in range(4)] + [("t4", "r07")]
    seeds = [f"r{i:02}" for i in range(0, 60, 7)] + ["t0"]
    got, n_rounds = spans(spark, monkeypatch, TV.reachable, pairs, seeds)
    assert got == walked(pairs, seeds)
    assert n_rounds <= 9  # 65 depths


def test_spans_against_a_walk(spark, monkeypatch):
    rng = random.Random(7)
    ring = [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)]
    chords = [(f"r{rng.randrange(30)}", f"r{rng.randrange(30)}") for _ in range(4)]
    dense = [(f"d{rng.randrange(9)}", f"d{rng.randrange(9)}") for _ in range(30)] + [("r3", "d0"), ("x", "x"), ("d1", "leaf")]
    pairs = sorted({*ring, *chords, *dense})
    seeds = sorted({n for pair in pairs for n in pair} | {"gone"})  # fewer and more than fit one long go alike
    back = [(b, a) for a, b in pairs]
    assert spans(spark, monkeypatch, TV.reachable, pairs, seeds)[0] == walked(pairs, seeds)
    assert spans(spark, monkeypatch, TV.impact_set, pairs, seeds, 5)[0] == walked(back, seeds, 5)
