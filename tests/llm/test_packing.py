"""Sequences of power-of-two lengths against the tokenizer."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from srcweave.llm import packing
from srcweave.llm.text_arrays import Block, blocks

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "word", "It's 2024; it'll  do.\n\n\tNEXT <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y",
    "Ünlängst Élan élan İstanbul ΣΑΣ ﬁ ① x ́x", "日本語のテキスト 한국어 🙂🙂", "a" * 5000, "lorem ipsum " * 6000, "\x00 \x0b x",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_rebuild_the_documents(spark, tokenizer, tmp_path):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "word"), (None, "word"), (4, "other " * 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    clashing = frame.selectExpr("*", "1 AS part", "2 AS slot", "'x' AS ids", "3 AS bucket", "4 AS length", "5 AS n")
    folder = str(tmp_path / "sequences")
    packing.write_sequences(clashing, folder, PATH, max_tokens=256)
    rows = packing.read_sequences(spark, folder).collect()
    want = defaultdict(int)
    for key, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want[key, tuple(ids)] += 1
        lengths = [256] * (len(ids) // 256) + [1 << b for b in range(7, -1, -1) if len(ids) % 256 & 1 << b]
        assert packing.piece_lengths(np.array([len(ids)]), 256)[0].tolist() == lengths
    # documents from their pieces: those of one id and length by their order
    pieces = defaultdict(lambda: defaultdict(list))
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length == 1 << r.bucket <= 256 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
        pieces[r.doc_id, r.doc_tokens][r.start].append(tuple(ids.tolist()))
    got = defaultdict(int)
    for (key, _), found in pieces.items():
        for parts in zip(*(found[s] for s in sorted(found)), strict=True):
            got[key, sum(parts, ())] += 1
    assert got == want
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_number = [r.bucket for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number, reverse=True)
    bare = packing.read_sequences(spark, folder, with_ids=False).drop("ids_crc32", "bucket")
    assert {tuple(r) for r in bare.collect()} == {(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, 0) for r in rows}


def test_empty_table_and_wrong_length(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, PATH).count() == 0
    packing.write_sequences(none, str(tmp_path / "none"), PATH)
    assert packing.read_sequences(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(none, PATH, max_tokens=1000)


def test_parts_of_a_long_text_have_its_ids(tokenizer):
    """A text far above a block, cut into parts; one without any place to cut stays whole."""
    import pyarrow as pa

    text = "".join(f"Word{i * i % 997} it's\n\n{'é' * (i % 5)} \t" for i in range(4000))
    (block,) = blocks(pa.array([text]), 1 << 30)
    parts = list(packing.parts_of(block, 3000))
    assert len(parts) > 10 and max(len(p.data) for p in parts) < 7000
    assert b"".join(p.data.tobytes() for p in parts) == text.encode()
    encoder = packing.WordIds(PATH, 1 << 16)
    ids = np.concatenate([encoder.encode(p)[0] for p in parts])
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    solid = Block(0, np.full(10_000, 0x61, np.uint8), np.array([0, 10_000]))
    assert [len(p.data) for p in packing.parts_of(solid, 1000)] == [10_000]
    assert encoder.encode(solid)[0].tolist() == tokenizer.encode("a" * 10_000, add_special_tokens=False).ids


def test_random_lengths():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 20_000, 500)
    lengths, counts = packing.piece_lengths(tokens, 4096)
    assert (np.add.reduceat(lengths, np.cumsum(counts) - counts) == tokens).all()
    assert (lengths & (lengths - 1) == 0).all() and lengths.max() <= 4096


def test_words_cut_at_punctuation_and_without_case(tokenizer):
    """Random texts of letters, marks, spaces and special tokens; words met again come from the table."""
    rng = np.random.default_rng(5)
    parts = ["The", "the", "THE", "it's", "don't", ",", ".", "...", "?!", " ", "  ", "\n", "é", "É", "x\u0301", "7", "42", "<", "|", "<|endoftext|>",
             "<|ENDOFTEXT|>", "日本", "·", "\u00a0", "'s", "a:b", "www.x.y/z"]
    encoder = packing.WordIds(PATH, 1 << 12)
    import pyarrow as pa

    for _ in range(60):
        texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(20)]
        if rng.random() < 0.5:
            texts = [t.replace("<|", "") for t in texts]
        (block,) = blocks(pa.array(texts))
        ids, counts = encoder.encode(block)
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
