"""Spelling variants against a brute-force comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srcweave.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_apart(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def words_of(docs):
    counts = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def groups_of(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows(frame):
    return {tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def corpus(seed, n_docs, letters="etnaé"):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(30)]
    docs = []
    for i in range(n_docs):
        words = []
        for _ in range(120):
            w = rng.choice(stems[: 1 + int(30 * rng.random() ** 3)])
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(letters), rng.choice(letters) + w[at]]) + w[at + 1 :]
            words.append(w.title() if rng.random() < 0.2 else w)
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("node_rows", [200_000, 400, 40])
def test_against_all_pairs(spark, monkeypatch, node_rows):
    """Also with nodes opened down to the last level and laid out in tiles."""
    docs = corpus(node_rows, 40) + [
        (None, "Straßenbahn STRASSENBAHN straßenbahnen"), (5, None), (6, ""), (7, "Ünlängst ünlängst Ünlängst Ünlangst Ünlangst"),
        (8, "x" * 40 + " " + "x" * 41 + " " + "x" * 40 + " " + "x" * 41 + " " + "x" * 17 + "y" + "x" * 23),
    ]
    docs.append(docs[3])  # a repeated row counts again
    words = words_of(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    found = spelling.corpus_words(frame)
    assert {r.word: r.n for r in found.collect()} == words
    assert rows(spelling.variant_groups(found, node_rows=node_rows)) == groups_of(words)


def test_anagrams_in_tiles(spark):
    """All counts equal: nothing to branch on."""
    rng = random.Random(1)
    words = {"".join(rng.sample("etaoins" * 2, 14)): 1 + i % 40 for i in range(300)}
    for w in list(words)[:100]:
        words[w[1:] + "z"] = 500
        words[w[:5] + "q" + w[6:]] = 3
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.variant_groups(frame, node_rows=50)) == groups_of(words)


def test_chain_ties_and_empty(spark):
    words = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "zbcdefg": 10, "abcdefz": 10}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = rows(spelling.variant_groups(frame))
    assert found == groups_of(words)
    assert ("abcdefg", "abcdefgh", "abcdefghij", 1, 3, 10) in found
    assert rows(spelling.variant_groups(frame.limit(0))) == set()
    assert spelling.corpus_words(frame.select(F.lit(1).alias("doc_id"), F.lit("").alias("text"))).count() == 0


def test_vectors_hold_the_budget():
    """One change moves at most one count up and one down, also where counts are cut off."""
    rng = random.Random(2)
    groups = spelling.letter_groups()
    place = {c: g for g, letters in enumerate(groups) for c in letters}
    assert len(place) == 26 + 64
    words = ["".join(rng.choice("eeeeetaé") for _ in range(rng.randint(7, 60))) for _ in range(200)]
    for w in words:
        v = w[:3] + rng.choice(["", "e", "x"]) + w[4:]
        count = lambda s: np.minimum(np.bincount([place[c] for c in s], minlength=15), 15)
        change = count(v) - count(w)
        assert change.max() <= 1 and change.min() >= -1 and np.abs(change).sum() <= 2
    both = spelling.Words(pa.array(["aaaaaaa", "aaaaaaaa", "aaaabaaa", "aaaaaaa"]))
    near, before = both.one_apart(np.array([0, 1, 0, 0]), np.array([1, 2, 2, 3]))
    assert near.tolist() == [True, True, True, False] and before[:3].tolist() == [True, True, True]
