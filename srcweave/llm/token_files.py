"""Texts to token ids in Simple-8b files, and back."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcweave.llm.text_arrays import IS_SPACE, Block, HashNumbers, blocks, ragged, span_hashes
from srcweave.session import shared_dir

#: How many values of how many bits a word of the file holds, by selector.  Selector 0 marks
#: an escape: the next word is one value of more than 60 bits as it is.
PACKING = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
           (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: Values that are packed together; words never cross from one stretch into the next.
STRETCH = 4_096
#: Ids after which a block of the file ends with the document.
BLOCK_IDS = 1 << 18
MAGIC = 0x53385731


def pack(values: np.ndarray) -> bytes:
    """Values as a block: magic, number of values, stretches, words before each, words.

    In each stretch the selector that takes most of the next values goes first; the stretches
    advance side by side, so the work is done on arrays.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    lanes = -(-n // STRETCH)
    size = np.clip(n - np.arange(lanes) * STRETCH, 0, STRETCH)
    padded = np.zeros(lanes * STRETCH + STRETCH, np.uint64)
    padded[:n] = values
    bits = np.full(len(padded), 64, np.uint8)
    bits[:n] = np.where(values > 0, np.frexp(values.astype(np.float64))[1], 1)
    for b in range(20, int(values.max()).bit_length() if n else 0):  # rounding to doubles may cross a power of two
        bits[:n] = np.where(values >= np.uint64(1 << b), np.maximum(bits[:n], b + 1), bits[:n])
    room = np.tile(np.arange(STRETCH, 0, -1, np.int16), lanes + 1)
    selector = np.zeros(len(padded), np.uint8)
    for s in range(len(PACKING) - 1, 0, -1):
        count, width = PACKING[s]
        fits = bits <= width
        length = 1
        while length < count and fits.any():  # all of ``length`` values from here on fit
            step = min(length, count - length)
            fits[:-step] &= fits[step:]
            fits[-step:] = False
            length += step
        if length < count:
            continue
        selector[fits & (room >= count)] = s
    counts = np.array([c for c, _ in PACKING], np.int64)
    lane, here = np.arange(lanes), np.zeros(lanes, np.int64)
    picked = []
    while len(lane):
        at = lane * STRETCH + here
        picked.append(at)
        here = here + counts[selector[at]]
        go = here < size[lane]
        lane, here = lane[go], here[go]
    at = np.sort(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
    chosen = selector[at].astype(np.int64)
    wide = chosen == 0
    place = np.arange(len(at)) + np.cumsum(wide) - wide
    words = np.zeros(len(at) + int(wide.sum()), np.uint64)
    words[place[wide] + 1] = padded[at[wide]]
    for s, (count, width) in enumerate(PACKING):
        own = np.flatnonzero(chosen == s)
        if not s or not len(own):
            continue
        word = np.full(len(own), s << 60, np.uint64)
        for i in range(count):
            word |= padded[at[own] + i] << np.uint64(i * width)
        words[place[own]] = word
    before = np.searchsorted(at, np.arange(lanes) * STRETCH)
    before = np.append(place, len(words))[before]
    head = np.array([MAGIC, n, lanes], np.uint32)
    return head.tobytes() + before.astype(np.uint32).tobytes() + words.tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The values of a block."""
    magic, n, lanes = np.frombuffer(payload, np.uint32, 3).tolist()
    if magic != MAGIC:
        raise ValueError("not a block of packed ids")
    before = np.frombuffer(payload, np.uint32, lanes, 12).astype(np.int64)
    words = np.frombuffer(payload, np.uint64, -1, 12 + 4 * lanes) if n else np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == 0).tolist():  # escapes are rare
        if not raw[at]:
            raw[at + 1] = True
    selector[raw] = 0
    counts = np.array([c for c, _ in PACKING], np.int64)[selector]
    counts[(selector == 0) | raw] = raw[(selector == 0) | raw]
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.zeros(n, np.uint64)
    # what stands before a stretch gives where its words go, so stretches could be read alone
    if lanes and (starts[before] != np.arange(lanes) * STRETCH).any():
        raise ValueError("offsets do not agree with the words")
    out[starts[raw]] = words[raw]
    for s, (count, width) in enumerate(PACKING):
        own = np.flatnonzero((selector == s) & ~raw)
        if not s or not len(own):
            continue
        mask = np.uint64((1 << width) - 1)
        for i in range(count):
            out[starts[own] + i] = (words[own] >> np.uint64(i * width)) & mask
    return out


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?")] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def piece_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a piece of text begins at each byte, or ends there; see :class:`PieceIds`."""
    before = np.zeros(len(data), bool)
    before[1:] = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    before[2:] |= data[:-2] == 0xC3  # the second byte of a letter (or × or ÷)
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1] = IS_SPACE[data] & before
    cut[1:-1] |= _PUNCTUATION[data[1:]] & _ASCII_LETTER[data[:-1]]
    cut[offsets] = True
    return cut


class PieceIds:
    """Ids of pieces of text, with those of pieces seen before in a table.

    A text may be cut before white space that follows a printable ASCII or Latin-1
    character, and between an ASCII letter and a mark of punctuation, where a run of letters
    always ends: pre-tokenization always starts a new token there, and what stands before
    doesn't change what comes after.  So the ids of a text are those of its pieces.
    """

    def __init__(self, path: str, slots: int = 1 << 21):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.numbers = HashNumbers(self.slots)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def add(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Encode distinct new pieces."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum()))
        pieces = self.numbers.count
        n, m = pieces + len(texts), self.used + len(flat)
        while len(self.starts) < n:
            self.starts = np.resize(self.starts, 2 * len(self.starts))
            self.lengths = np.resize(self.lengths, 2 * len(self.lengths))
        while len(self.ids) < m:
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : m] = flat
        self.lengths[pieces:n] = lengths
        self.starts[pieces:n] = self.used + np.cumsum(lengths) - lengths
        self.numbers.add(hashes)
        self.used = m

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, and how many each text has."""
        data, offsets = block.data, block.offsets
        starts = np.flatnonzero(piece_cuts(data, offsets))
        starts, ends = starts[:-1], starts[1:]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(block.rows, np.int64)
        hashes = span_hashes(data, starts, ends)
        piece = self.numbers.find(hashes)
        new = np.flatnonzero(piece < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            if not self.numbers.room(len(fresh)):
                self.clear()
                fresh, first = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
            raw = data.tobytes()
            bounds = zip(starts[new[first]].tolist(), ends[new[first]].tolist(), strict=True)
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in bounds]
            while not self.numbers.room(len(fresh)):  # a very long text
                self.slots *= 2
                self.clear()
            self.add(fresh, texts)
            piece[new] = self.numbers.find(hashes[new])
        lengths = self.lengths[piece]
        ids = self.ids[ragged(self.starts[piece], lengths)]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


_PIECES: dict[str, PieceIds] = {}


def _pieces(path: str) -> PieceIds:
    """One table of pieces for each Python worker, kept from task to task."""
    if path not in _PIECES:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _PIECES[path] = PieceIds(path)
    return _PIECES[path]


FILE_SCHEMA = (
    "part int, block int, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"
)


def encoded_blocks(
    docs: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Blocks of packed ids of all documents, by rising key; see :func:`write_token_files`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, number = _pieces(tokenizer), TaskContext.get().partitionId(), 0
        keys, lengths, ids = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal number
            flat = np.concatenate(ids)
            columns = [
                pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                pa.array([keys], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([len(flat)], pa.int64()), pa.array([pack(flat)], pa.binary()),
            ]
            number += 1
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "doc_ids", "lengths", "n_ids", "payload"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                flat, counts = pieces.encode(block)
                stops = np.cumsum(counts)
                whole = np.insert(flat, stops, end_id)
                counts, stops = counts + 1, stops + np.arange(1, block.rows + 1)
                row = 0
                while row < block.rows:
                    room = BLOCK_IDS - sum(map(len, ids))
                    base = stops[row] - counts[row]
                    end = min(int(np.searchsorted(stops, base + max(1, room))) + 1, block.rows)
                    keys += names[block.first + row : block.first + end]
                    lengths += counts[row:end].tolist()
                    ids.append(whole[base : stops[end - 1]])
                    row = end
                    if sum(map(len, ids)) >= BLOCK_IDS:
                        yield flush()
                        keys, lengths, ids = [], [], []
        if keys:
            yield flush()

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    return ordered.mapInArrow(encode, FILE_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write a folder of token files.

    Part files follow each other in the order of the keys (null first, repeated keys by
    text).  A row of a part file is a block: its place (``part``, ``block``), the keys and
    numbers of ids of its documents, and ``payload``, the packed ids (see :func:`pack`).
    Each document ends with ``end_id``.  A null text is empty; an empty table gives no blocks.
    """
    encoded_blocks(docs, tokenizer, **options).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = unpack(batch.column(4)[row].as_buffer().to_pybytes()).astype("<u4")
                lengths = batch.column(3)[row].values.to_numpy(zero_copy_only=False)
                stops = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[row].as_py()] * n, pa.int32()), pa.array([batch.column(1)[row].as_py()] * n, pa.int32()),
                     batch.column(2)[row].values, pa.array(stops - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                    ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    docs = files.select("part", "block", "doc_ids", "lengths", "payload").mapInArrow(
        decode, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = files.select("part", "block", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("part_base")
    )
    starts = heads.select(
        "part", "block", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("block_base")
    ).join(parts, "part")
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("part_base") + F.col("block_base") + F.col("inside")).alias("start"),
        "n_tokens", "ids_crc32",
    )


def fresh_folder(spark) -> str:
    """A new place for token files in the folder that driver and executors share."""
    import uuid

    return f"{shared_dir(spark)}/token_files/{uuid.uuid4().hex}"
