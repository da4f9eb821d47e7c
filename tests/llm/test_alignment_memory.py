"""What bounds the memory of op11_alignment: a block is aligned in parts, and the parts make the block."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from srcweave.llm import alignment  # noqa: E402

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(seed, rows, words):
    rng = random.Random(seed)
    syllables = "th an er in on at ed re st en ou ing ti ble sh wh nt".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    return [" ".join(word() for _ in range(words)) for _ in range(rows)]


def plain(found):
    """Of each text: sums, whether it is fine, groups as written, links of its pairs."""
    out = []
    for first, sums, fine, written, row, pair, links in found:
        assert first == len(out)
        keys = list(zip(row.tolist(), pair.tolist(), strict=True))
        assert len(set(keys)) == len(keys)
        held = [Counter() for _ in fine]
        for (r, p), n in zip(keys, links.tolist(), strict=True):
            held[r][p] += n
        out += zip(map(tuple, sums.tolist()), fine.tolist(), written, held, strict=True)
    return out


def test_memory_follows_the_part_not_the_block():
    column = pa.array(texts(1, 400, 800))
    aligner = alignment.Aligner(*PATHS)
    tracemalloc.start()
    for _ in alignment._aligned(aligner, column, alignment.BLOCK_BYTES):
        pass
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 45 * len("".join(column.to_pylist()))


def test_parts_make_the_block(monkeypatch):
    """Parts of many texts and of one, long texts in stretches whose pairs are merged, texts that are left out."""
    docs = [None, "", *texts(2, 30, 40), "x" * 999, *texts(3, 2, 3000), "a▁b " + "a b " * 800, "", "a b", *texts(4, 3, 200), None]
    column = pa.array(docs)
    whole = plain(alignment._aligned(alignment.Aligner(*PATHS), column, 1 << 20))
    assert [x[1] for x in whole] == [bool(d) and "▁" not in d for d in docs]
    for size in (100, 1500):
        monkeypatch.setattr(alignment, "PART_BYTES", size)
        assert plain(alignment._aligned(alignment.Aligner(*PATHS), column, 1 << 20)) == whole


def test_rows_grow():
    rows, kept = alignment.Rows(np.int64, 2), []
    for n in (0, 1000, 30, 5000, 0, 1):
        kept.append(np.arange(2 * n).reshape(n, 2))
        rows.add(kept[-1])
        assert np.array_equal(rows.values, np.concatenate(kept))
    rows.clear()
    assert len(rows.values) == 0
