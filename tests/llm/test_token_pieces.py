"""Pieces of text that op10_token_files encodes: each is encoded once, and their ids are those of the whole text."""

import os

import numpy as np
import pyarrow as pa
import pytest

from srcweave.llm import token_files
from srcweave.llm.text_arrays import blocks


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def encoded(pieces, texts):
    found = [pieces.encode(block) for block in blocks(pa.array(texts))]
    return np.concatenate([ids for ids, _ in found]), np.concatenate([counts for _, counts in found])


def test_a_word_before_punctuation_is_no_new_piece(path):
    pieces = token_files.PieceIds(path)
    encoded(pieces, [" word word. word, word; word: word! word?", " other other. other, other; other: other! other?"])
    assert pieces.numbers.count == 8  # two words and six marks


def test_ids_are_those_of_the_whole_text(path):
    texts = [
        "", ".", "a.b,c:d;e!f?", "Don't, won't.'s it's.'t x.'", "e.g., 3.5 v2.0.1; été. ñ! ×. ÷, A× .a", "end.<|endoftext|>.end <|endoftext|>, x<|end",
        "a.\n\n b,\t c!  　d? e", "́á.  b.­", " ,a .b ;;c ::: d...e", "a\0.b\x7f.c \x1f.",
    ]
    pieces = token_files.PieceIds(path)
    ids, counts = encoded(pieces, texts)
    whole = [e.ids for e in (pieces.tokenizer.encode(t, add_special_tokens=False) for t in texts)]
    assert counts.tolist() == [len(w) for w in whole]
    assert ids.tolist() == [i for w in whole for i in w]


def test_a_worker_encodes_on_its_own_core(path, monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    monkeypatch.setattr(token_files, "_PIECES", {})
    token_files._pieces(path)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
