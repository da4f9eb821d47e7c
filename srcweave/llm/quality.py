"""Document quality from a linear-chain conditional random field over the lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.llm.text_arrays import BLOCK_BYTES, IS_SPACE, Block, blocks, per_row, runs, span_hashes

#: Labelled documents that the model is fitted to, at most, and neighbouring lines of each.
SAMPLE_DOCS, SAMPLE_LINES = 4_000, 64
STEPS = 200


def _class(*members: range | int) -> np.ndarray:
    table = np.zeros(256, bool)
    for m in members:
        table[list(m) if isinstance(m, range) else m] = True
    return table


UPPER, LOWER_CASE, DIGIT = _class(range(0x41, 0x5B)), _class(range(0x61, 0x7B)), _class(range(0x30, 0x3A))
HIGH, STOP, COMMA = _class(range(0x80, 0x100)), _class(0x2E), _class(0x2C)
SYMBOL = _class(range(0x21, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x7F)) & ~STOP & ~COMMA
CLASSES = (UPPER, LOWER_CASE, DIGIT, HIGH, STOP, COMMA, SYMBOL, IS_SPACE)
#: Features of a line by itself; each is also taken from the line before and after.
OWN = len(CLASSES) + 7


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their weights (bytes plus one), and the bounds of the rows.

    A text has at least one line; an empty text has one empty line.
    """
    data, offsets = block.data, block.offsets
    n = len(data)
    breaks = np.flatnonzero(data == 0x0A)
    per_text = np.diff(per_row(breaks, offsets)) + 1
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    size = ends - starts
    share = 1.0 / np.maximum(size, 1)
    columns = []
    for member in CLASSES:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(member[data], out=total[1:])
        columns.append((total[ends] - total[starts]) * share)
    begin, end = runs(~IS_SPACE[data], offsets)
    hashes = span_hashes(data, begin, end)
    line = np.searchsorted(starts, begin, "right") - 1
    words = np.bincount(line, minlength=len(starts))
    same = np.zeros(len(begin), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    single = end - begin == 1
    odd_end = SYMBOL[data[end - 1]] if len(end) else np.zeros(0, bool)
    each = 1.0 / np.maximum(words, 1)
    for marked in (same, single, odd_end):
        columns.append(np.bincount(line[marked], minlength=len(starts)) * each)
    columns.append(np.log1p(size))
    columns.append(np.log1p(words))
    columns.append(np.minimum(size * each, 40.0))
    columns.append((size == 0).astype(float))
    own = np.stack(columns, 1)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[bounds[:-1]], last[bounds[1:] - 1] = True, True
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = own[first], own[last]
    return np.concatenate((own, before, after), 1), size + 1.0, bounds


@dataclass
class Field:
    """Weights of a linear-chain field with the states bad (0) and good (1)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights + self.bias


def marginals(score: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the probability of good; of each pair of neighbours the four probabilities.

    Forward-backward with scaling; all texts advance side by side.  The pair of lines i and
    i + 1 stands at i.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    start, sizes = bounds[:-1][order], lengths[order]
    peak = np.maximum(score, 0)
    local = np.stack((np.exp(-peak), np.exp(score - peak)), 1)
    pass_ = np.exp(moves - moves.max())
    ahead, back = np.empty_like(local), np.ones_like(local)
    longest = int(sizes[0]) if len(sizes) else 0
    live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(longest)]
    for t in range(longest):
        at = start[: live[t]] + t
        now = local[at] if not t else (ahead[at - 1] @ pass_) * local[at]
        ahead[at] = now / now.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        now = (back[at + 1] * local[at + 1]) @ pass_.T
        back[at] = now / now.sum(1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(1)
    pairs = np.zeros((len(score), 2, 2))
    inner = np.ones(len(score), bool)
    inner[bounds[1:] - 1] = False
    i = np.flatnonzero(inner)
    joint = ahead[i][:, :, None] * pass_ * (local[i + 1] * back[i + 1])[:, None, :]
    pairs[i] = joint / joint.sum((1, 2), keepdims=True)
    return good, pairs


def fit(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, steps: int = STEPS, l2: float = 1e-4) -> Field:
    """Maximize the conditional likelihood; all lines of a text carry its label."""
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = (features - mean) / scale
    lengths = np.diff(bounds)
    y = np.repeat(labels, lengths).astype(float)
    weight = np.repeat(1.0 / lengths, lengths) / len(lengths)
    inner = np.ones(len(y), bool)
    inner[bounds[1:] - 1] = False
    seen = np.zeros((2, 2))
    for state in (0, 1):
        seen[state, state] = weight[inner & (y == state)].sum()
    values = np.zeros(x.shape[1] + 5)
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        w, bias, moves = values[:-5], values[-5], values[-4:].reshape(2, 2)
        good, pairs = marginals(x @ w + bias, bounds, moves)
        error = weight * (y - good)
        slope = np.concatenate((
            x.T @ error - l2 * w, [error.sum()], (seen - (pairs * weight[:, None, None]).sum(0)).ravel() - l2 * values[-4:],
        ))
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        values = values + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(mean, scale, values[:-5], float(values[-5]), values[-4:].reshape(2, 2))


def _training_lines(rows: DataFrame, docs: int, lines: int) -> list:
    """Features of neighbouring lines of a bounded number of labelled rows."""
    window = max(1, lines)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for block in blocks(batch.column(2)):
                x, _, bounds = line_features(block)
                out = []
                for r in range(block.rows):
                    a, b = int(bounds[r]), int(bounds[r + 1])
                    if b - a > window:
                        a += (a * 2654435761 + b) % (b - a - window + 1)
                        b = a + window
                    out.append(x[a:b].ravel().tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), pa.array(labels[block.first : block.first + block.rows], pa.int32()), pa.array(out, pa.list_(pa.float64()))],
                    ["doc_id", "label", "x"],
                )

    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(docs)
    return sample.mapInArrow(extract, "doc_id long, label int, x array<double>").collect()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> Field | None:
    """A field fitted to a bounded sample of the labelled rows; None without both labels.

    Rows whose ``crc32(doc_id)`` is 1 modulo 3 are never learned from.  Of a labelled
    document with several labels the largest counts.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("label")
    )
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    size = marks.where(learn).count()
    if not size:
        return None
    # about twice the sample by hash, so that few texts are moved before the exact sample is taken
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 2.0 * sample / size) + 1)
    rows = docs.where(keep).join(F.broadcast(marks.where(learn & keep)), "doc_id").select("doc_id", "label", "text")
    found = _training_lines(rows, sample, lines)
    if len({r["label"] for r in found}) < 2:
        return None
    x = [np.array(r["x"]).reshape(-1, 3 * OWN) for r in found]
    bounds = np.concatenate(([0], np.cumsum([len(v) for v in x])))
    return fit(np.concatenate(x), bounds, np.array([r["label"] for r in found]))


def score_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES, row: str | None = None,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher is better) and ``predicted`` of each row.

    ``row`` names a column of longs that tells the rows apart; it comes last, as ``row``.

    The score is the mean of the lines' probabilities of good, weighted by their bytes.  It
    is a function of the text alone.  The model is fitted on at most ``sample`` labelled
    documents and ``lines`` neighbouring lines of each; every text is scored whole.

    Null and empty texts are one empty line; repeated rows get a row each; without labels of
    both kinds all scores are 0.5; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        *([F.col(row).cast("long").alias("row")] if row else []),
    )
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels, sample, lines))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for block in blocks(batch.column(1), BLOCK_BYTES // 2):
                if field is None:
                    scores.append(np.full(block.rows, 0.5))
                    continue
                x, weight, bounds = line_features(block)
                good, _ = marginals(field.score(x), bounds, field.moves)
                total = np.concatenate(([0.0], np.cumsum(good * weight)))
                mass = np.concatenate(([0.0], np.cumsum(weight)))
                scores.append(np.clip(np.diff(total[bounds]) / np.diff(mass[bounds]), 0.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores)), *batch.columns[2:]],
                ["doc_id", "score", *batch.schema.names[2:]],
            )

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.mapInArrow(score, "doc_id long, score double" + (", row long" if row else "")).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *(["row"] if row else []),
    )
