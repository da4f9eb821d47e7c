"""Whole columns of text as byte arrays: the numpy side of the Arrow operators.

An Arrow batch of texts is already one byte buffer with offsets.  Work is done on
blocks of such buffers of a bounded number of bytes (a longer single text is a block
of its own), so the memory of a task does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once in one task.
BLOCK_BYTES = 2 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64

#: A random 64-bit value for each byte value.
BYTE_VALUES = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)

#: Space, and the control characters from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Block:
    """Some rows of a text column: ``data[offsets[i]:offsets[i + 1]]`` is row ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def large_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of texts with 64-bit offsets; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of at most ``limit`` bytes, or one row."""
    text = large_text(column)
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield Block(
            row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        )
        row = end


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finalizer of splitmix64)."""
    return _mix_in_place(values.astype(np.uint64, copy=True))


def _mix_in_place(v: np.ndarray) -> np.ndarray:
    v += _GOLDEN
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            factor = np.full(size, _BASE, np.uint64)
            factor[0] = 1
            _POWERS = np.multiply.accumulate(factor)
            factor[1:] = pow(_BASE, -1, 2**64)
            _INVERSES = np.multiply.accumulate(factor)
    return _POWERS, _INVERSES


#: Another such table, for a second hash.
OTHER_VALUES = np.random.default_rng(20240608).integers(0, 2**64, 256, dtype=np.uint64)


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """What :func:`span_hashes` takes its hashes from."""
    powers, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = values[data]
    terms *= powers[: len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None
) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    sums = prefix_sums(data) if sums is None else sums
    _, inverses = _powers(len(data) + 1)
    h = sums[ends] - sums[starts]
    h *= inverses[starts]
    h += (ends - starts).astype(np.uint64) * _GOLDEN
    return _mix_in_place(h)


def fixed_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` bytes from each position on, where there are so many."""
    n = len(sums) - 1 - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, inverses = _powers(len(sums))
    h = sums[width:] - sums[:n]
    h *= inverses[:n]
    h += np.uint64(width * int(_GOLDEN) % 2**64)
    return _mix_in_place(h)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes; none crosses a row."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside & edge[:n]
    begins[1:] |= inside[1:] & ~inside[:-1]
    stops = inside & edge[1:]
    stops[:-1] |= inside[:-1] & ~inside[1:]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


def per_row(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``bounds`` so that row i has the sorted positions ``bounds[i]:bounds[i + 1]``."""
    return np.searchsorted(positions, offsets, "left")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] … starts[i] + lengths[i] - 1`` of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class HashNumbers:
    """Numbers 0, 1, 2 … for distinct 64-bit hashes: an open-addressing table on arrays."""

    def __init__(self, slots: int = 1 << 20):
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.numbers = np.full(self.slots, -1, np.int32)
        self.count = 0

    def room(self, more: int) -> bool:
        return 2 * (self.count + more) <= self.slots

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it is new."""
        last = self.slots - 1
        slot = (hashes & np.uint64(last)).astype(np.int64)
        found = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            at = slot[todo]
            number = self.numbers[at]
            hit = (self.keys[at] == hashes[todo]) & (number >= 0)
            found[todo[hit]] = number[hit]
            todo = todo[~hit & (number >= 0)]
            slot[todo] = (slot[todo] + 1) & last
        return found

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Number distinct new hashes in their order."""
        last, number = self.slots - 1, np.arange(self.count, self.count + len(hashes))
        slot, todo = (hashes & np.uint64(last)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            at = slot[todo]
            free = np.flatnonzero(self.numbers[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.numbers[at[won]], self.keys[at[won]] = number[todo[won]], hashes[todo[won]]
            lost = np.ones(len(todo), bool)
            lost[won] = False
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & last
        self.count += len(hashes)
        return number
