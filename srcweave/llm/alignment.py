"""Tokens of two tokenizers aligned: which stand for the same bytes, and how common each link is.

Both tokenizers cut the same bytes.  Every token points to the token that overlaps it and reaches farthest
to the right; doubling the pointers brings each token to the last one of its group, whose end is an end of
both cuts.  Tokens with the same last token are a group, and all its pairs of tokens are linked.

Texts are worked on in segments that both tokenizers treat alone: a segment starts with a space after a printable
character.  A segment met before is looked up.  Documents are counted per pair of ids in blocks, so
what is shuffled is each distinct pair of a block, not each link; the numbers of documents come back the same way.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcweave.llm.text_arrays import Block, HashNumbers, blocks, ragged, span_hashes
from srcweave.session import as_lookup, write_once

#: Bytes of text of a block, and of the part of it that is aligned at once: what is held beside the tables of a
#: worker follows the part, what is shuffled follows the block.
BLOCK_BYTES, PART_BYTES = 2 << 20, 256 << 10
#: Segments a Python worker remembers (a power of two), and the bytes of text they may have.
SEGMENTS, SEGMENT_BYTES = 1 << 18, 8 << 20
SPACE = "▁"


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group of each token of two cuts of the same bytes, given by the ends of the tokens."""
    n = len(a_ends)
    over_a = np.searchsorted(b_ends, a_ends, "left")  # the token of the other cut that holds the last byte
    over_b = np.searchsorted(a_ends, b_ends, "left")
    own = np.arange(n)
    points = np.concatenate((np.where(b_ends[over_a] > a_ends, n + over_a, own), over_b))
    while True:
        doubled = points[points]
        if np.array_equal(doubled, points):
            break
        points = doubled
    _, group = np.unique(points, return_inverse=True)
    return group[:n], group[n:]


def pairs_of(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray):
    """Group, pair of ids (the first in the upper half) and number of links of the distinct pairs of each group."""
    left, n_left = np.unique(group_a << 32 | ids_a, return_counts=True)
    right, n_right = np.unique(group_b << 32 | ids_b, return_counts=True)
    group = left >> 32
    first = np.searchsorted(right, group << 32)
    sizes = np.searchsorted(right, (group + 1) << 32) - first
    other = ragged(first, sizes)
    mine = np.repeat(np.arange(len(left)), sizes)
    return group[mine], (left[mine] & 0xFFFFFFFF) << 32 | right[other] & 0xFFFFFFFF, n_left[mine] * n_right[other]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def _placed(rows: np.ndarray, pairs: np.ndarray, links: np.ndarray):
    """The distinct pairs, and row, place of the pair and sum of links of the distinct pairs of each row, in this order."""
    known, place = np.unique(pairs, return_inverse=True)
    key, links = _summed(rows * max(len(known), 1) + place, links)
    return known, key // max(len(known), 1), key % max(len(known), 1), links


def _distinct(rows: np.ndarray, pairs: np.ndarray, links: np.ndarray):
    """Row, pair and links, each pair of a row once."""
    known, rows, place, links = _placed(rows, pairs, links)
    return rows, known[place], links


class Rows:
    """An array that grows at its end; it is copied when its length doubles, not each time."""

    def __init__(self, kind: type, width: int = 1):
        self.held = np.empty((1024, width) if width > 1 else 1024, kind)
        self.clear()

    def clear(self) -> None:
        self.count = 0

    def add(self, values: np.ndarray) -> None:
        count = self.count + len(values)
        if count > len(self.held):
            longer = np.empty((max(count, 2 * len(self.held)), *self.held.shape[1:]), self.held.dtype)
            longer[: self.count] = self.held[: self.count]
            self.held = longer
        self.held[self.count : count] = values
        self.count = count

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.count]


class Aligner:
    """Two tokenizers, and the aligned segments seen so far."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        symbols = byte_symbols()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(c in symbols for c in token):
                self.a_bytes[number] = bytes(symbols[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after another character, so texts can't be cut at spaces")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_length = np.fromiter(map(len, self.a_bytes), np.int64)
        self.b_length = np.fromiter(map(len, self.b_bytes), np.int64)
        # an id as it is written before the next id of its side, and before what follows its side
        self.written = [
            [b"%d%c" % (i, mark) for i in range(len(table))]
            for table, marks in ((self.a_bytes, b",|"), (self.b_bytes, b",;")) for mark in marks
        ]
        self.groups: list[bytes] = []
        self.good = Rows(bool)
        #: ids of both sides, groups and links of each segment
        self.sums = Rows(np.int64, 4)
        self.first = Rows(np.int64)
        self.pairs = Rows(np.int64)
        self.links = Rows(np.int64)
        self.clear()

    def clear(self) -> None:
        self.numbers = HashNumbers(2 * SEGMENTS)
        self.text_bytes = 0
        self.groups.clear()
        for rows in (self.good, self.sums, self.first, self.pairs, self.links):
            rows.clear()
        self.first.add(np.zeros(1, np.int64))

    def add(self, hashes: np.ndarray, segments: list[bytes]) -> None:
        """Align distinct new segments."""
        texts = [s.decode("utf-8", "replace") for s in segments]
        found_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        found_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        good = np.array([
            b"".join(map(self.a_bytes.__getitem__, x)) == s == b"".join(map(self.b_bytes.__getitem__, y))
            for s, x, y in zip(segments, found_a, found_b, strict=True)
        ], bool)
        found_a = [x if ok else [] for x, ok in zip(found_a, good.tolist(), strict=True)]
        found_b = [y if ok else [] for y, ok in zip(found_b, good.tolist(), strict=True)]
        n, rows = len(segments), np.arange(len(segments))
        n_a, n_b = (np.fromiter(map(len, f), np.int64, n) for f in (found_a, found_b))
        a = np.fromiter((i for f in found_a for i in f), np.int64, int(n_a.sum()))
        b = np.fromiter((i for f in found_b for i in f), np.int64, int(n_b.sum()))
        group_a, group_b = terminals(np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])) if len(a) else (a, b)
        n_groups = int(group_a[-1]) + 1 if len(a) else 0
        segment = np.zeros(n_groups, np.int64)
        segment[group_a] = np.repeat(rows, n_a)
        group, pair, links = pairs_of(group_a, a, group_b, b)
        # the pairs of a segment, each once: numbered, so that segment and pair fit one key
        known, pair = np.unique(pair, return_inverse=True)
        key, links = _summed(segment[group] * max(len(known), 1) + pair, links)
        owner = key // max(len(known), 1)
        total = np.bincount(owner, links, n).astype(np.int64)
        self.groups += self._written(a, group_a, b, group_b, np.bincount(segment, minlength=n))
        self.good.add(good)
        self.sums.add(np.stack((n_a, n_b, np.bincount(segment, minlength=n), total), axis=1))
        self.first.add(self.first.values[-1] + np.cumsum(np.bincount(owner, minlength=n)))
        self.pairs.add(known[key % max(len(known), 1)])
        self.links.add(links)
        self.numbers.add(hashes)
        self.text_bytes += sum(map(len, segments))

    def _written(self, a, group_a, b, group_b, n_groups) -> list[bytes]:
        """``a1,a2|b1;`` for the groups of each segment."""
        sides = np.concatenate((group_a * 2, group_b * 2 + 1))
        order = np.argsort(sides, kind="stable")
        ids, sides = np.concatenate((a, b))[order].tolist(), sides[order]
        last = np.append(sides[1:] != sides[:-1], True)[: len(sides)]
        kind = ((sides & 1) * 2 + last).tolist()
        parts = [self.written[k][i] for k, i in zip(kind, ids, strict=True)]
        ends = np.searchsorted(sides, 2 * np.cumsum(n_groups)).tolist()
        return [b"".join(parts[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each segment; those that are new are aligned."""
        hashes = span_hashes(data, starts, ends)
        found = self.numbers.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            full = self.numbers.count + len(fresh) > SEGMENTS or self.text_bytes > SEGMENT_BYTES
            if full and self.numbers.count:
                self.clear()
                return self._numbers(data, starts, ends)
            while not self.numbers.room(len(fresh)):  # more in one block than are kept otherwise
                self.numbers = HashNumbers(2 * self.numbers.slots)
            raw = data.tobytes()
            at = new[first]
            self.add(fresh, [raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            found[new] = self.numbers.find(hashes[new])
        return found

    def read(self, data: np.ndarray, offsets: np.ndarray):
        """Texts one after another, each with its space in front.

        Per text: the four sums, whether both tokenizers give its bytes, and its groups as written.  Also row, pair and
        links of the distinct pairs of each text.
        """
        n = len(offsets) - 1
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if len(data):
            seen = np.zeros(len(data), bool)
            seen[1:] = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
            seen[2:] |= data[:-2] == 0xC3
            # the last byte of a text is no cut: a space alone is not what it is after a word
            cut[:-1] |= (data == 0x20) & seen & ~cut[1:]
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1], starts[1:]
        if not len(starts):
            nothing = np.zeros(0, np.int64)
            return np.zeros((n, 4), np.int64), np.zeros(n, bool), [b""] * n, nothing, nothing, nothing
        number = self._numbers(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(n), np.diff(bounds))
        bad = np.bincount(row, ~self.good.values[number], n) > 0
        fine = (np.diff(bounds) > 0) & ~bad
        sums = np.stack([np.bincount(row, self.sums.values[number, i], n) for i in range(4)], axis=1).astype(np.int64)
        sums[~fine] = 0
        every = list(map(self.groups.__getitem__, number.tolist()))
        limits = zip(bounds[:-1].tolist(), bounds[1:].tolist(), fine.tolist(), strict=True)
        written = [b"".join(every[x:y]) if ok else b"" for x, y, ok in limits]
        held = fine[row]
        held, times = _summed((row << 32 | number)[held], np.ones(int(held.sum()), np.int64))
        row, number = held >> 32, held & 0xFFFFFFFF
        first = self.first.values
        sizes = first[number + 1] - first[number]
        at = ragged(first[number], sizes)
        links = np.repeat(times, sizes) * self.links.values[at]
        return sums, fine, written, *_distinct(np.repeat(row, sizes), self.pairs.values[at], links)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each Python worker, kept from task to task."""
    if (byte_path, piece_path) not in _ALIGNERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _ALIGNERS[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _ALIGNERS[byte_path, piece_path]


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each that isn't empty."""
    filled = (np.diff(offsets) > 0).astype(np.int64)
    return np.insert(data, offsets[:-1][filled > 0], 0x20), offsets + np.concatenate(([0], np.cumsum(filled)))


def _stretches(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """One long text cut where segments start."""
    start = 0
    while start < len(data):
        end = min(start + limit, len(data))
        while end < len(data):
            window = data[end - 1 : min(end + limit, len(data) - 1)]  # never at the last byte
            places = np.flatnonzero((window[1:] == 0x20) & (window[:-1] > 0x20) & (window[:-1] < 0x7F))
            if len(places):
                end += int(places[0])
                break
            end = min(end + limit, len(data))
        yield data[start:end]
        start = end


def _long(aligner: Aligner, data: np.ndarray, limit: int):
    """What :meth:`Aligner.read` gives of one long text."""
    sums, written, nothing = np.zeros((1, 4), np.int64), [], np.zeros(0, np.int64)
    pairs, links, waiting = [nothing], [nothing], 0
    for stretch in _stretches(data, limit):
        more, ok, text, _, pair, link = aligner.read(stretch, np.array([0, len(stretch)]))
        if not ok[0]:
            return np.zeros((1, 4), np.int64), np.array([False]), [b""], nothing, nothing, nothing
        sums += more
        written += text
        pairs.append(pair)
        links.append(link)
        waiting += len(pair)
        if waiting > len(pairs[0]) + limit:  # merged as often as their number doubles
            pair, link = _summed(np.concatenate(pairs), np.concatenate(links))
            pairs, links, waiting = [pair], [link], 0
    pair, link = _summed(np.concatenate(pairs), np.concatenate(links))
    return sums, np.array([True]), [b"".join(written)], np.zeros(len(pair), np.int64), pair, link


def _parts(aligner: Aligner, block: Block, limit: int):
    """First row, and what :meth:`Aligner.read` gives, of a few texts of a block at a time."""
    row = 0
    while row < block.rows:
        begin = int(block.offsets[row])
        end = max(int(np.searchsorted(block.offsets, begin + limit, "right")) - 1, row + 1)
        data, offsets = _spaced(block.data[begin : block.offsets[end]], block.offsets[row : end + 1] - begin)
        if end - row > 1 or len(data) <= 2 * limit:
            yield row, *aligner.read(data, offsets)
        else:
            yield row, *_long(aligner, data, limit)
        row = end


def _aligned(aligner: Aligner, column: pa.Array, limit: int):
    """First row, and what :meth:`Aligner.read` gives, of the texts of a column, block by block."""
    for block in blocks(column, limit):
        first, sums, fine, written, rows, pairs, links = zip(*_parts(aligner, block, min(limit, PART_BYTES)), strict=True)
        rows = [row + at for at, row in zip(first, rows, strict=True)]
        texts = [text for part in written for text in part]
        yield block.first, *map(np.concatenate, (sums, fine)), texts, *map(np.concatenate, (rows, pairs, links))


def token_groups(
    docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups`` of each document, in one pass.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of the first and of the second tokenizer, group by group.  The first
    tokenizer reads the text behind a space, which the second adds itself; special tokens in texts are plain text.
    Zeros and an empty string where the text is null or empty, or one of the tokenizers doesn't give its bytes back.
    Null and repeated ids are kept, other columns not read; long texts are worked on in stretches.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)
        for batch in batches:
            for first, sums, _, written, *_ in _aligned(aligner, batch.column(1), block_bytes):
                columns = [batch.column(0).slice(first, len(sums)), *(pa.array(sums[:, i]) for i in range(4))]
                groups = pa.array([w[:-1].decode() for w in written], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, groups], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(align, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string")


#: A block of documents: what is final, its distinct pairs with the documents that hold them, and of each
#: document the places of its pairs (as differences) with their links.
BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, pairs array<long>, holders array<int>, sizes array<int>, places binary, links binary"
)
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative values with as many bytes each as the largest needs; the first byte says how many."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", -1, 1).astype(np.int64)


def aligned_blocks(rows: DataFrame, byte_path: str, piece_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of aligned documents; see :data:`BLOCKS`."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, sums, fine, written, row, pair, links in _aligned(aligner, batch.column(1), block_bytes):
                n = len(sums)
                known, row, place, links = _placed(row, pair, links)
                steps = np.diff(place, prepend=0)
                begins = np.searchsorted(row, np.arange(n))
                begins = begins[np.append(begins[1:], len(row)) > begins]
                steps[begins] = place[begins]
                digests = [hashlib.sha256(w[:-1]).hexdigest() if ok else "" for w, ok in zip(written, fine.tolist(), strict=True)]
                lists = [
                    batch.column(0).slice(first, n).to_pylist(), *(sums[:, i] for i in range(4)), digests,
                    known, np.bincount(place, minlength=len(known)).astype(np.int32),
                    np.bincount(row, minlength=n).astype(np.int32),
                ]
                kinds = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.int32(), pa.int32()]
                columns = [pa.array([number], pa.int64())]
                columns += [pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds, strict=True)]
                columns += [pa.array([_narrow(x)], pa.binary()) for x in (steps, links)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCKS.split(", ")])
                number += 1

    return rows.mapInArrow(align, BLOCKS)


def pair_counts(block_table: DataFrame) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and ``best``, whether no pair of its first id has more."""
    held = block_table.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.*")
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    # a window holds the pairs of one id, at most as many as the other vocabulary
    of_id = Window.partitionBy(F.shiftright("pair", 32))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_id)).alias("best"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents from blocks and the numbers of their pairs."""
    for batch in batches:
        get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for at in range(batch.num_rows):
            doc_ids = get["doc_ids"][at].values
            n = len(doc_ids)
            sizes = get["sizes"][at].values.to_numpy(zero_copy_only=False).astype(np.int64)
            found = get["found"][at].values
            best_sum, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if found is not None and len(found):
                place = found.field("place").to_numpy(zero_copy_only=False)
                count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
                count[place] = found.field("n").to_numpy(zero_copy_only=False)
                best[place] = found.field("best").to_numpy(zero_copy_only=False)
                steps = _wide(get["places"][at].as_py())
                links = _wide(get["links"][at].as_py())
                row = np.repeat(np.arange(n), sizes)
                walked = np.cumsum(steps)
                begins = np.cumsum(sizes) - sizes
                before = np.where(begins > 0, walked[begins - 1], 0) if len(walked) else np.zeros(n, np.int64)
                place = walked - before[row]
                total = np.concatenate(([0], np.cumsum(links * count[place])))
                count_sum = total[begins + sizes] - total[begins]
                total = np.concatenate(([0], np.cumsum(links * best[place])))
                best_sum = total[begins + sizes] - total[begins]
            yield pa.RecordBatch.from_arrays([
                doc_ids, *(get[c][at].values for c in ("n_a", "n_b", "n_groups", "n_links")),
                pa.array(best_sum), pa.array(count_sum), get["groups_sha256"][at].values,
            ], [f.split()[0] for f in ALIGNED.split(", ")])


def align_documents(
    docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Each document with its tokens aligned and its links weighed; see :data:`ALIGNED`.

    As :func:`token_groups`, with the checksum of ``groups``.  ``n_best`` counts the links whose pair of ids is held by as
    many documents as any pair of its first id, ``count_sum`` adds these numbers over all links.  A row is a
    document, so rows of a repeated id count each.  An empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = write_once(aligned_blocks(rows, byte_path, piece_path, block_bytes))
    counts = as_lookup(pair_counts(found))
    asked = found.select("block", F.posexplode("pairs").alias("place", "pair"))
    numbers = asked.join(counts, "pair").groupBy("block").agg(
        F.collect_list(F.struct("place", "n", "best")).alias("found")  # at most the pairs of one block
    )
    kept = found.drop("pairs", "holders").join(numbers, "block", "left")
    return kept.mapInArrow(_finish, ALIGNED)
