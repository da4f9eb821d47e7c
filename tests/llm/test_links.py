"""All links of near copies, also of those that other links connect already."""

import numpy as np
import pytest

from srcweave.llm import jaccard


def near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    items = [(500, "alone"), (None, " ".join(base)), (501, None), (600, " ".join(base)), (601, " ".join(base).upper())]
    for i in range(90):  # one group of many different texts, on both sides of the threshold
        own = list(base)
        for at in rng.choice(80, rng.integers(0, 5), replace=False):
            own[at] = f"x{rng.integers(1000)}"
        items.append((i, " ".join(own)))
    items.append(items[-1])
    return items, spark.createDataFrame(items, "doc_id long, text string")


def grams(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(x, y):
    return bool(x) and 100 * len(x & y) >= 75 * len(x | y)


@pytest.mark.parametrize("small", [False, True])
def test_all_links(spark, monkeypatch, small):
    if small:  # several tiles for each group, and few pairs at once
        for name, value in (("TILE_SETS", 8), ("TILE_ROWS", 100), ("TASK_PAIRS", 50), ("CHUNK", 16), ("COLUMNS", 10)):
            monkeypatch.setattr(jaccard, name, value)
    items, docs = near_copies(spark)
    sets = [grams(t) for _, t in items]
    known = [k for k, (i, _) in enumerate(items) if i is not None]
    want = sorted(
        (i is None, i or 0, 0 if i is None else sum(alike(sets[k], sets[m]) for m in known if m != k)) for k, (i, _) in enumerate(items)
    )
    got = jaccard.similar_documents(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_links) for r in got) == want
    least, count = {}, {}
    for k in known:
        least[sets[k]] = min(least.get(sets[k], 10**9), items[k][0])
        count[sets[k]] = count.get(sets[k], 0) + 1
    different = [(x, y) for x in least for y in least if least[x] < least[y] and alike(x, y)]
    assert len(different) > 2 * len(least)
    links = [tuple(r) for r in jaccard.similar_sets(docs).collect()]
    assert sorted(links) == sorted((least[x], least[y], count[x], count[y], len(x & y), len(x | y)) for x, y in different)


def least_reachable(items, sets):
    """The smallest id that links lead to, of each row with an id."""
    label = {k: i for k, (i, _) in enumerate(items) if i is not None}
    changed = True
    while changed:
        changed = False
        for k in label:
            for m in label:
                if (alike(sets[k], sets[m]) or k == m) and label[m] < label[k]:
                    label[k], changed = label[m], True
    return label


@pytest.mark.parametrize("small", [False, True])
def test_components_without_pairs(spark, monkeypatch, small):
    """Also where a cluster is many tiles, so that representatives and the rest are compared in rounds."""
    if small:
        for name, value in (("TILE_SETS", 6), ("TILE_ROWS", 100), ("CHUNK", 16), ("COLUMNS", 10)):
            monkeypatch.setattr(jaccard, name, value)
    items, _ = near_copies(spark)
    rng = np.random.default_rng(6)
    words = [f"k{i}" for i in range(60)]
    for i in range(40):  # a chain: each is like the next, not like those further on
        words = words[:]
        for at in rng.choice(60, 2, replace=False):
            words[at] = f"y{i}_{at}"
        items.append((1000 + i, " ".join(words)))
    docs = spark.createDataFrame(items, "doc_id long, text string")
    sets = [grams(t) for _, t in items]
    want = least_reachable(items, sets)
    assert 3 < len(set(want.values())) < len(want) - 20
    got = jaccard.similar_components(docs.selectExpr("*", "1 AS node", "2 AS label", "3 AS side", "4 AS cluster")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((items[k][0], c) for k, c in want.items())
    assert {r.component_id for r in got if r.doc_id is None} == {None} and len(got) == len(items)
    assert jaccard.similar_components(docs.limit(0)).count() == 0
