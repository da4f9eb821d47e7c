"""Documents packed into training sequences of power-of-two lengths.

A document of n tokens is written in binary: as many pieces of ``max_tokens`` as fit, then one
piece for each set bit of what is left, longest first.  Every piece is a sequence of its own,
and sequences of equal length form a bucket, from which batches without any padding are drawn.
So no sequence holds two documents, and no token is padding.

Encoding is one pass without a shuffle.  :func:`write_sequences` lays the sequences out by bucket;
:func:`read_sequences` numbers them in the order bucket, part of the write, place in the part, from
counts alone: the ids of tokens are never moved for it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcweave.llm.text_arrays import BLOCK_BYTES, IS_SPACE, LOWER, Block, blocks, ragged, span_hashes
from srcweave.llm.token_files import PieceIds, piece_cuts
from srcweave.session import shared_dir

#: Pieces handed to Spark at once, by the tokens they hold.
BATCH_TOKENS = 1 << 20

SEQUENCES = (
    "doc_id long, start long, length long, doc_tokens long, part int, slot long, ids binary, bucket int"
)

#: Words encoded in one call, with a special token between them.
JOINED = 50

_ENCODERS: dict[str, "WordIds"] = {}


def _encoder(path: str) -> WordIds:
    """One table of encoded words for each Python worker, kept from task to task."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _ENCODERS[path] = WordIds(path, 1 << 20)
    return _ENCODERS[path]


class Ids(NamedTuple):
    ids: list[int]


class Joined:
    """A tokenizer that encodes many short texts in one call, with a special token between them."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        special = [(i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark = min(special) if special else None

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> Iterator[Ids]:
        if self.mark is None or any("<" in t for t in texts):
            yield from self.tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)
            return
        number, mark = self.mark
        joined = [mark.join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
        for encoding in self.tokenizer.encode_batch_fast(joined, add_special_tokens=add_special_tokens):
            ids, start = encoding.ids, 0
            for end in [i for i, x in enumerate(ids) if x == number] + [len(ids)]:
                yield Ids(ids[start:end])
                start = end + 1


class WordIds(PieceIds):
    """Ids of texts under a tokenizer that drops white space and case, with those of words seen before in a table.

    Texts are cut as :class:`PieceIds` does.  A piece is known by its lower-case bytes without the space before it.
    """

    def __init__(self, path: str, slots: int):
        super().__init__(path, slots)
        self.tokenizer = Joined(self.tokenizer)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, and how many each text has."""
        data, offsets = block.data, block.offsets
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(block.rows, np.int64)
        if not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():  # the text of a special token has its case
            data = LOWER[data]
        starts = np.flatnonzero(piece_cuts(data, offsets))
        starts, ends = starts[:-1], starts[1:]
        bounds = np.searchsorted(starts, offsets)
        starts = starts + IS_SPACE[data[starts]]
        hashes = span_hashes(data, starts, ends)
        piece = self.numbers.find(hashes)
        new = np.flatnonzero(piece < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            if not self.numbers.room(len(fresh)):
                self.clear()
                fresh, first = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
            while not self.numbers.room(len(fresh)):  # a very long text
                self.slots *= 2
                self.clear()
            raw = data.tobytes()
            spans = zip(starts[new[first]].tolist(), ends[new[first]].tolist(), strict=True)
            self.add(fresh, [raw[a:b].decode("utf-8", "replace") for a, b in spans])
            piece[new] = self.numbers.find(hashes[new])
        lengths = self.lengths[piece]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[ragged(self.starts[piece], lengths)], np.diff(total[bounds])


def piece_lengths(tokens: np.ndarray, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the pieces of documents with so many tokens, and how many pieces each has."""
    powers = max_tokens >> np.arange(1, max_tokens.bit_length())
    bits = (tokens[:, None] & powers[None, :]) > 0
    whole = tokens // max_tokens
    counts = whole + bits.sum(axis=1)
    lengths = np.full(int(counts.sum()), max_tokens, np.int64)
    row, bit = np.nonzero(bits)
    nth = np.cumsum(bits, axis=1)[row, bit] - 1
    lengths[(np.cumsum(counts) - counts + whole)[row] + nth] = powers[bit]
    return lengths, counts


def parts_of(block: Block, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A long text cut where a new token always starts: before white space after a printable character.

    A block of ordinary texts stays as it is.  Without such a place within ``limit`` bytes the
    cut is at the next one.
    """
    data = block.data
    if block.rows > 1 or len(data) <= limit:
        yield block
        return
    start = 0
    while start < len(data):
        end = min(start + limit, len(data))
        while end < len(data):
            window = data[end - 1 : end + limit]
            places = np.flatnonzero(IS_SPACE[window[1:]] & (window[:-1] > 0x20) & (window[:-1] < 0x7F))
            if len(places):
                end += int(places[0])
                break
            end = min(end + limit, len(data))
        yield Block(block.first, data[start:end], np.array([0, end - start]))
        start = end


def _encoded(encoder: WordIds, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ids with the end ids, and numbers of ids of the texts, block by block."""
    for block in blocks(column):
        found = [encoder.encode(part) for part in parts_of(block)]
        if len(found) == 1:
            flat, counts = found[0]
        else:  # one long text
            flat = np.concatenate([ids for ids, _ in found])
            counts = np.array([len(flat)], np.int64)
        yield block.first, np.insert(flat, np.cumsum(counts), end_id).astype("<u4"), counts + 1


def pack_documents(
    docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 2,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The sequences of all documents, one row each.

    ``doc_id``, ``start`` (tokens of the document before the piece), ``length`` (a power of two, at most
    ``max_tokens``), ``doc_tokens``, ``part`` and ``slot`` (the task, and the place among those of equal length
    in it), ``ids`` (little-endian unsigned 32-bit) and ``bucket`` (the power).

    Each row of ``docs`` is packed, also with a null or repeated id.  A null or empty text is the end id
    alone.  Texts are encoded whole; one longer than a block is encoded in parts that give the same ids, so
    memory grows with its ids only.  An empty table gives no rows; other columns are not read.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        used = np.zeros(max_tokens.bit_length(), np.int64)
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            for first, ids, tokens in _encoded(encoder, batch.column(1), end_id):
                lengths, counts = piece_lengths(tokens, max_tokens)
                ends = np.cumsum(lengths)
                row = np.repeat(np.arange(len(tokens)), counts)
                starts = ends - lengths - (np.cumsum(tokens) - tokens)[row]
                bucket = np.round(np.log2(lengths)).astype(np.int32)
                slot = np.zeros(len(lengths), np.int64)
                for power in range(len(used)):
                    own = np.flatnonzero(bucket == power)
                    slot[own] = used[power] + np.arange(len(own))
                    used[power] += len(own)
                cut = 0
                while cut < len(lengths):
                    base = ends[cut] - lengths[cut]
                    stop = max(cut + 1, int(np.searchsorted(ends, base + BATCH_TOKENS, "right")))
                    here = slice(cut, stop)
                    offsets = np.concatenate(([0], ends[here] - base)) * 4
                    raw = np.ascontiguousarray(ids[base : ends[stop - 1]])
                    payload = pa.Array.from_buffers(
                        pa.binary(), stop - cut, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)]
                    )
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array(first + row[here])), pa.array(starts[here]), pa.array(lengths[here]),
                        pa.array(tokens[row[here]]), pa.array(np.full(stop - cut, part, np.int32)),
                        pa.array(slot[here]), payload, pa.array(bucket[here]),
                    ], names=[f.split()[0] for f in SEQUENCES.split(", ")])
                    cut = stop

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(pack, SEQUENCES)


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, **options) -> None:
    """Write the sequences as a folder of Parquet files, a subfolder for each length (``bucket=…``).

    A task writes one file into each bucket, and a lost task is written anew with the same rows, so the
    files don't depend on retries.  Edge cases are those of :func:`pack_documents`.
    """
    pack_documents(docs, tokenizer, **options).write.partitionBy("bucket").parquet(folder)


def read_sequences(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The sequences of a folder, numbered gapless from 0 over all buckets, the longest bucket first.

    ``sequence_id`` is the number, ``offset`` the place of the piece in it: 0, as a sequence is one piece.
    ``ids_crc32`` is the checksum of ``ids``.  Where only it is wanted, ``with_ids=False`` keeps the ids out
    of the join that brings the numbers.
    """
    files = spark.read.schema(SEQUENCES).parquet(folder)
    bases = files.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    buckets = bases.groupBy("bucket").agg(F.sum("n").alias("n"))
    longest_first = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # a row per length
    buckets = buckets.select("bucket", F.coalesce(F.sum("n").over(longest_first), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("bucket", "part", F.coalesce(F.sum("n").over(in_bucket), F.lit(0)).alias("earlier")).join(
        buckets, "bucket"
    )
    rows = files.withColumn("ids_crc32", F.crc32("ids"))
    rows = rows if with_ids else rows.drop("ids")
    return rows.join(bases, ["bucket", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", "ids_crc32", "bucket",
        (F.col("before") + F.col("earlier") + F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def fresh_folder(spark: SparkSession) -> str:
    """A new place for sequences in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/sequences/{uuid.uuid4().hex}"
