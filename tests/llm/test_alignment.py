"""Aligned tokens against a plain walk over both lists of ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from srcweave.llm import alignment

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokens():
    """Ids and bytes of the tokens of a text under both tokenizers."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    symbols = alignment.byte_symbols()

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def both(text):
        left = a.encode(" " + text, add_special_tokens=False).ids
        right = b.encode(text)
        return (
            [(i, bytes(symbols[c] for c in a.id_to_token(i))) for i in left], [(i, b_bytes(i)) for i in right]
        )

    return both


def groups(text, tokens):
    """The groups, as pairs of lists of ids."""
    if not text:
        return []
    left, right = tokens(text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return []
    out, i, j, at, bt = [], 0, 0, 0, 0
    while i < len(left):
        xs, ys = [], []
        while not xs or at != bt:
            if at <= bt:
                xs.append(left[i][0])
                at += len(left[i][1])
                i += 1
            else:
                ys.append(right[j][0])
                bt += len(right[j][1])
                j += 1
        out.append((xs, ys))
    return out


def expected(docs, tokens):
    found = [(key, groups(text, tokens)) for key, text in docs]
    links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for _, g in found]
    count = Counter(pair for held in links for pair in held)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    rows = []
    for (key, g), held in zip(found, links):
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        rows.append((
            key, sum(len(xs) for xs, _ in g), sum(len(ys) for _, ys in g), len(g), sum(held.values()),
            sum(n for p, n in held.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in held.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return rows


ODD = [
    None, "", " ", "  ", "a ", " a", "a  b", "x\ny", "x \n y ", "a▁b", "<s> x </s> <|endoftext|> <unk> <0x41>",
    "Élan déjà vu — naïve café", "日本語のテキスト", "🙂 🙂🙂 ok", "é x́", "aaaa" * 300, "=" * 999, "12345 67.89", "\t\ttab\r\n", "don't It's we'll",
    "\x00 nul", "end. ", "× ÷ x", "Ñandú ñandú", "﻿mark", "​", "\xa0 x",
]


def corpus(seed, n):
    rng = random.Random(seed)
    words = "thation heanti eroning élletion queaux the of and ou pour 2024 http://x.y/z?a=b foo_bar camelCase naïve".split()
    return [
        (i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", ". ", ", ", "  "]) for _ in range(rng.randint(1, 200))))
        for i in range(n)
    ]


@pytest.mark.parametrize("block_bytes", [4 << 20, 500])
def test_against_a_walk(spark, tokens, block_bytes):
    """Also in blocks so small that most texts are cut into stretches."""
    docs = [(100 + i, t) for i, t in enumerate(ODD)] + corpus(1, 60) + [(None, "null id"), (7, "again"), (7, "again")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    frame = frame.selectExpr("*", "1 AS block", "2 AS pair", "'x' AS groups", "3 AS n_a", "true AS best")
    got = alignment.align_documents(frame, A_PATH, B_PATH, block_bytes=block_bytes)
    want = expected(docs, tokens)
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == Counter(want)
    texts = alignment.token_groups(frame, A_PATH, B_PATH, block_bytes=block_bytes)
    plain = texts.select(*COLUMNS[:5], F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("").alias("h"))
    assert Counter(tuple(r) for r in plain.collect()) == Counter(r[:5] + r[7:] for r in want)


def test_forgetting_segments(spark, tokens, monkeypatch):
    docs = corpus(2, 30)
    aligner = alignment.Aligner(A_PATH, B_PATH)
    monkeypatch.setattr(alignment, "SEGMENTS", 16)
    for key, text in docs:
        data, offsets = alignment._spaced(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        _, fine, written, *_ = aligner.read(data, offsets)
        want = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups(text, tokens))
        assert fine[0] and written[0][:-1].decode() == want


def test_pointers_converge_on_random_cuts():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        a = np.append(np.sort(rng.choice(np.arange(1, size), rng.integers(0, size), False)), size) if size > 1 else np.array([1])
        b = np.append(np.sort(rng.choice(np.arange(1, size), rng.integers(0, size), False)), size) if size > 1 else np.array([1])
        common = np.intersect1d(a, b)
        x, y = alignment.terminals(a, b)
        assert (x == np.searchsorted(common, a)).all() and (y == np.searchsorted(common, b)).all()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(none, A_PATH, B_PATH).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align_documents(blank, A_PATH, B_PATH).orderBy("doc_id").collect()] == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
