"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from srcweave.llm import decontamination, jaccard, language, mixing, neighbours, quality, secrets, sharding, substrings, token_files
from srcweave.llm.suffix_array import suffix_places

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
LONG = " ".join(f"{WORDS[i * i % 19]}{i % 977}" for i in range(30_000))
TEXT = " ".join(f"{WORDS[(i * 7 + i // 5) % 19]}{i}" for i in range(120))
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, node long, label string, "
    "score double, bucket int, tokens string, spans string, size int, shard int, did long, n int"
)


def rows(items):
    return [(i, t, lang, src, 1, 5, 6, "x", 0.5, 1, "y", "z", 3, 4, 8, 9) for i, t, lang, src in items]


DOCS = [
    (1, TEXT, "en", "b"), (2, TEXT, "en", "a"), (2, TEXT, "en", "a"), (3, TEXT + " tail words", "fr", "b"),
    (4, None, None, None), (5, "", "en", "b"), (6, "  \n\t ", "en", None), (7, "one two", "fr", "a"),
    (8, "One TWO", "en", "c"), (None, "no id here", "en", "c"), (9, LONG, "en", "b"), (10, "ß日本語 テキスト é\n\nA", None, "c"),
    (11, "ab " * 200, "fr", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(DOCS), SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(row):
    return row[1] or ""


def test_suffix_order():
    rng = np.random.default_rng(0)
    texts = [np.append(rng.integers(1, 3, rng.integers(1, 30)), 0) for _ in range(200)]
    offsets = np.cumsum([0, *map(len, texts)])
    places = suffix_places(np.concatenate(texts), offsets)
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        order = sorted(range(len(t)), key=lambda i: tuple(t[i:]))
        assert (places[a:b][order] - a == np.arange(len(t))).all()


def test_substrings(docs, nothing, spark):
    got = substrings.remove_repeats(docs).collect()
    seen, want = set(), []
    unique = {(r[0], text_of(r)) for r in DOCS}
    result = {}
    for i, t in sorted(unique, key=lambda r: (-1 if r[0] is None else r[0])):
        b = t.encode()
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = 1
            seen.add(w)
        gone = gone[: len(b)].astype(bool)
        edges = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        result[i, t] = (len(b), int(gone.sum()), edges, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    want = Counter((r[0], *result[r[0], text_of(r)]) for r in DOCS)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert substrings.remove_repeats(nothing).count() == 0


def test_crowded_anchors_agree(spark, monkeypatch):
    base = TEXT * 3
    items = [(i, f"{i * 7919} {base[: 300 + i]} {i}", "en", "a") for i in range(40)]
    frame = spark.createDataFrame(rows(items), SCHEMA)
    whole = {r.doc_id: r.kept_sha256 for r in substrings.remove_repeats(frame).collect()}
    monkeypatch.setattr(substrings, "CONTEXTS", 3)
    assert {r.doc_id: r.kept_sha256 for r in substrings.remove_repeats(frame).collect()} == whole


def test_trimmed_surroundings_find_the_same():
    rng = np.random.default_rng(4)
    length, anchor = 100, substrings.ANCHOR
    pieces = [bytes(rng.integers(0, 256, 70, dtype=np.uint8)) for _ in range(4)]
    middle = bytes(rng.integers(0, 256, anchor, dtype=np.uint8))
    items = []
    for did in range(60):
        before, behind = (bytearray(pieces[i]) for i in rng.integers(0, 4, 2))
        before[rng.integers(0, 70)] ^= did % 3
        behind[rng.integers(0, 70)] ^= did % 2
        left, right = rng.integers(20, 69, 2)
        if left + right + anchor >= length:
            items.append((did, did, did % 2, 200, 200 - left, bytes(before[-left:]) + middle + bytes(behind[:right])))
    group = pd.DataFrame(items, columns=["did", "tkey", "h", "at", "low", "bytes"]).sort_values("h", kind="stable")

    def covered(part):
        found = substrings._repeats_of(part, length)
        return {(d, p) for d, a, b in zip(found["did"], found["low"], found["high"], strict=True) for p in range(a, b)}

    trimmed = substrings._trimmed(group, length)
    assert trimmed["bytes"].map(len).sum() < group["bytes"].map(len).sum()
    assert covered(trimmed) == covered(group) != set()


def test_decontamination(docs, nothing, spark):
    items = [(1, TEXT[:400]), (2, "one two"), (3, None), (None, "ß日本語"), (5, ""), (1, "テキスト é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontamination.decontaminate(docs, bench).collect()}
    assert got[7, 2].items == ["2"] and got[7, 2].contaminated and got[8, 2].items == ["2"]
    assert got[1, 120].n_hit > 50 and got[1, 120].n_items == 1 and got[1, 120].contaminated
    assert got[4, 0].n_hit == 0 and not got[4, 0].contaminated and got[4, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(got[10, 4].items) == ["1", "null"] and got[10, 4].n_hit == 3
    assert decontamination.decontaminate(docs, bench).count() == len(DOCS)
    assert decontamination.decontaminate(nothing, bench).count() == 0
    assert not any(r.n_hit for r in decontamination.decontaminate(docs, bench.limit(0)).collect())


def test_portions_of_phrases_agree(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(i, TEXT[i * 9 : i * 9 + 200]) for i in range(30)], "item_id long, text string")
    want = Counter(map(str, decontamination.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "PHRASE_BYTES", 1_000)
    assert Counter(map(str, decontamination.decontaminate(docs, bench).collect())) == want


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_jaccard(docs, nothing, spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    items = []
    for i in range(60):  # near copies that form chains, on both sides of the threshold
        own = list(base)
        for at in rng.choice(60, rng.integers(0, 5), replace=False):
            own[at] = f"x{rng.integers(1000)}"
        items.append((100 + i, " ".join(own), "en", "a"))
    every = DOCS + items
    got = jaccard.similar_documents(spark.createDataFrame(rows(every), SCHEMA)).collect()
    sets = [shingles(text_of(r)) for r in every]
    ids, parent = [r[0] for r in every], list(range(len(every)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            same = ids[i] == ids[j] or (sets[i] and 100 * common >= 75 * len(sets[i] | sets[j]))
            if same and ids[i] is not None and ids[j] is not None:
                parent[top(i)] = top(j)
    least = defaultdict(lambda: 10**9)
    for i, d in enumerate(ids):
        least[top(i)] = min(least[top(i)], d if d is not None else 10**9)
    want = Counter((d, len(sets[i]), None if d is None else least[top(i)]) for i, d in enumerate(ids))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard.similar_documents(nothing).count() == 0


def test_secrets(docs, nothing, spark):
    text = (
        "é login: someone then Zx9Zx9Zx9Zx9Zx9Zx9Zx9 at https://host.example/x and password=abcdefgh1 "
        + "pad " * 100 + "Qq1Qq1Qq1Qq1Qq1Qq1Qq1Qq1 AKIAABCDEFGH token=short secret: abc:longer_value1"
    )
    frame = spark.createDataFrame(rows([(1, text, "en", "a"), (2, None, "en", "a"), (2, None, "en", "a")]), SCHEMA)
    got = {r.doc_id: r for r in secrets.scan_secrets(frame).collect()}
    at = text.index("password")
    base = f"assign:{at}:{at + 18}"
    assert got[1].n_assign == 1 and got[1].n_access == 0 and got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    kinds = [s.split(":")[0] for s in got[1].spans.split(",")]
    assert kinds == ["ident", "value", "endpoint", "assign"]  # the second value has no complement in reach
    assert got[2].spans == "" and secrets.scan_secrets(docs).count() == len(DOCS)
    assert secrets.scan_secrets(nothing).count() == 0


def test_mixing(docs, nothing, spark):
    got = mixing.mix_sources(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", text_of(r)))) for r in DOCS)
    assert all(r.copies <= 3 and r.taken == r.copies * r["size"] for r in got)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again)) and mixing.mix_sources(nothing).count() == 0
    items = [(i, "w " * (1 + i % 50), "en", "abc"[i % 10 // 4]) for i in range(9_000)]
    sums, target = Counter(), {}
    for r in mixing.mix_sources(spark.createDataFrame(rows(items), SCHEMA)).collect():
        sums[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(sums[s] - t) <= 50 for s, t in target.items())


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(300)]
    odd = [(300, None), (301, [0.0] * 12), (302, [float("nan")] * 12), (303, [1.0]), (None, [1.0] * 12), (304, [None] * 12), (305, vectors[0][1]), (305, vectors[0][1])]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("bucket", F.lit(1)).withColumn("score", F.lit(1))
    good = {**dict(vectors), 305: vectors[0][1]}
    hits = total = 0
    found = defaultdict(dict)
    for r in neighbours.nearest_neighbours(frame, k=10).collect():
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(found) == {i for i in good if i % 20 == 0}
    for q, ranks in found.items():
        want = sorted((-float(np.dot(good[q], v)), i) for i, v in good.items() if i != q)[:10]
        hits += len({i for _, i in want} & {i for i, _ in ranks.values()})
        total += 10
        assert sorted(ranks) == list(range(1, 11)) and all(abs(np.dot(good[q], good[i]) - s) < 1e-9 for i, s in ranks.values())
    assert hits >= 0.9 * total
    few = frame.where("vec_id < 5")
    assert neighbours.nearest_neighbours(few).count() == 4 and neighbours.nearest_neighbours(frame.limit(0)).count() == 0


def test_language(docs, nothing, spark):
    got = language.identify_languages(docs).collect()
    by = {(r.doc_id, i): r for i, r in enumerate(got)}
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for k, r in by.items() if k[0] in (4, 5, 6)} == {"und"} and {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert language.identify_languages(nothing).count() == 0
    unknown = language.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_slopes_of_the_network():
    rng = np.random.default_rng(0)
    network = language.Network.start(["a", "b"])
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    lengths = np.array([5, 3, 1])
    pieces, target, weight = rng.integers(97, 103, (3, language.PIECE)).astype(np.uint8), np.array([[1.0, 0], [0, 1], [0.5, 0.5]]), np.array([1.0, 2, 1])

    def loss():
        score, _, inside, _ = network.positions(pieces, lengths)
        return -((score * target[None]).sum(2) * inside * (weight / lengths)).sum() / weight.sum()

    slope = network.slopes(pieces, lengths, target, weight)
    for name in network.weights:
        flat = network.weights[name].reshape(-1)
        at = int(np.abs(slope[name]).reshape(-1).argmax())
        old = flat[at]
        flat[at] = old + 1e-3
        up = loss()
        flat[at] = old - 1e-3
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-3 - slope[name].reshape(-1)[at]) < 1e-3


def test_sharding(docs, nothing):
    got = sharding.assign_shards(docs, 7).collect()
    assert Counter((r["size"], r.text_crc32) for r in got) == Counter((len(text_of(r).encode()) + 16, zlib.crc32(text_of(r).encode())) for r in DOCS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sharding.assign_shards(nothing, 7).count() == 0
    keys = np.arange(200_000)
    moved = sharding.jump_hash(keys, 40) != sharding.jump_hash(keys, 41)
    assert abs(moved.mean() - 1 / 41) < 0.003


def test_sharding_in_buckets(spark, monkeypatch):
    frame = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    want = {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(frame, 5).collect()}
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 100)
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(frame, 5).collect()} == want


def test_quality(docs, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (11, 0, 0), (11, 0, 1), (9, 1, None), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score_quality(nothing, labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_marginals_by_all_paths():
    rng = np.random.default_rng(4)
    score, moves, bounds = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    good, _ = quality.marginals(score, bounds, moves)
    for a, b in zip(bounds, bounds[1:], strict=False):
        total, marked = 0.0, np.zeros(b - a)
        for path in np.ndindex(*[2] * (b - a)):
            p = np.array(path)
            weight = np.exp((score[a:b] * p).sum() + sum(moves[x, y] for x, y in zip(p, p[1:], strict=False)))
            total += weight
            marked += weight * p
        assert np.allclose(good[a:b], marked / total)


def test_packing():
    rng = np.random.default_rng(3)
    for values in (
        np.zeros(0, np.uint64), rng.integers(0, 50_257, 10_000), np.zeros(9_000, np.uint64), rng.integers(0, 2, 5_000),
        np.array([2**64 - 1, 0, 2**60 - 1, 2**60, 1, 2**53 + 1, 2**53 - 1], np.uint64), 2 ** rng.integers(0, 63, 5_000),
    ):
        values = np.asarray(values, np.uint64)
        assert (token_files.unpack(token_files.pack(values)) == values).all()


def test_token_files(docs, nothing, spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    hard = [(20, "<|endoftext|> a  b  c d\t\n x'll  ", "en", "a"), (21, "don't\r\n\r\n  é è　 日 <|endoftext|>", "en", "a")]
    frame = docs.unionByName(spark.createDataFrame(rows(hard), SCHEMA))
    token_files.write_token_files(frame, str(tmp_path / "a"), path)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    at = 0
    for r, (_, text) in zip(got, sorted(((-1 if i is None else i, t or "") for i, t, _, _ in DOCS + hard)), strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write_token_files(nothing, str(tmp_path / "b"), path)
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0
