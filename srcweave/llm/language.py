"""Language of texts from a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcweave.llm.text_arrays import IS_SPACE, Block, HashNumbers, blocks, per_row, runs, span_hashes
from srcweave.session import broadcast_if_small, write_once

#: Documents of a language that are learned from, at most, and words drawn from each.
SAMPLE_DOCS, SAMPLE_WORDS = 400, 200
#: Bytes that the network reads at once; longer words are read in pieces.
PIECE = 24
EMBED, HIDDEN, EPOCHS, BATCH, RATE = 12, 16, 4, 256, 4e-3
#: Pieces read side by side.
CHUNK = 8_192

IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """Weights: bytes to gates (``embed``, ``inward``), state to gates, states to languages."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def start(languages: list[str], seed: int = 3) -> Network:
        rng, h = np.random.default_rng(seed), HIDDEN
        w = {"embed": rng.normal(0, 0.3, (256, EMBED))}
        for way in "fb":
            w[f"inward_{way}"] = rng.normal(0, EMBED**-0.5, (EMBED, 3 * h))
            w[f"state_{way}"] = rng.normal(0, h**-0.5, (h, 3 * h))
            w[f"bias_{way}"] = np.zeros(3 * h)
        w["out"] = rng.normal(0, (2 * h) ** -0.5, (2 * h, len(languages)))
        w["out_bias"] = np.zeros(len(languages))
        return Network(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def _read(self, pieces: np.ndarray, live: list[int], way: str, keep: list | None) -> np.ndarray:
        """States at all positions in one direction; pieces go from long to short."""
        w, h = self.weights, HIDDEN
        table = w["embed"] @ w[f"inward_{way}"] + w[f"bias_{way}"]
        inner = w[f"state_{way}"]
        states = np.zeros((len(live), len(pieces), h), np.float32)
        now = np.zeros((len(pieces), h), np.float32)
        steps = range(len(live)) if way == "f" else range(len(live) - 1, -1, -1)
        for t in steps:
            old = now[: live[t]]
            x, u = table[pieces[: live[t], t]], old @ inner
            gates = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            if keep is not None:
                keep.append((t, old.copy(), z, r, new, u[:, 2 * h :]))
            now[: live[t]] = states[t, : live[t]] = new + z * (old - new)
        return states

    def positions(self, pieces: np.ndarray, lengths: np.ndarray, keep: tuple | None = None):
        """Log probabilities of the languages at each position, and what they came from."""
        live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths[0]))]
        both = np.concatenate((
            self._read(pieces, live, "f", keep and keep[0]), self._read(pieces, live, "b", keep and keep[1]),
        ), 2)
        score = both @ self.weights["out"] + self.weights["out_bias"]
        score -= score.max(2, keepdims=True)
        score -= np.log(np.exp(score).sum(2, keepdims=True))
        inside = np.arange(len(live))[:, None] < lengths[None, :]
        return score, both, inside, live

    def pooled(self, pieces: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum of the log probabilities over the positions of each piece."""
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros((len(pieces), len(self.languages)), np.float32)
        for at in range(0, len(pieces), CHUNK):
            own = order[at : at + CHUNK]
            score, _, inside, _ = self.positions(pieces[own], lengths[own])
            out[own] = (score * inside[:, :, None]).sum(0)
        return out

    def slopes(self, pieces: np.ndarray, lengths: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Backpropagation through time of the cross-entropy at every position."""
        w, h, kept = self.weights, HIDDEN, ([], [])
        score, both, inside, live = self.positions(pieces, lengths, kept)
        d_score = (np.exp(score) - target[None]) * (inside * (weight / lengths))[:, :, None]
        d_score = (d_score / weight.sum()).astype(np.float32)
        slope = {k: np.zeros_like(v) for k, v in w.items()}
        slope["out"] = np.tensordot(both, d_score, ((0, 1), (0, 1)))
        slope["out_bias"] = d_score.sum((0, 1))
        d_both = d_score @ w["out"].T
        for way, trace, part in (("f", kept[0], d_both[:, :, :h]), ("b", kept[1], d_both[:, :, h:])):
            inner, carried = w[f"state_{way}"], np.zeros((len(pieces), h), np.float32)
            d_table = np.zeros((256, 3 * h), np.float32)
            for t, old, z, r, new, u in reversed(trace):
                d = part[t, : live[t]] + carried[: live[t]]
                d_new = d * (1 - z) * (1 - new**2)
                d_z, d_r = d * (old - new) * z * (1 - z), d_new * u * r * (1 - r)
                d_gates = np.concatenate((d_z, d_r, d_new * r), 1)
                slope[f"state_{way}"] += old.T @ d_gates
                carried[: live[t]] = d * z + d_gates @ inner.T
                d_x = np.concatenate((d_z, d_r, d_new), 1)
                np.add.at(d_table, pieces[: live[t], t], d_x)
            slope[f"bias_{way}"] = d_table.sum(0)
            slope[f"inward_{way}"] = w["embed"].T @ d_table
            slope["embed"] += d_table @ w[f"inward_{way}"].T
        return slope


def fit(words: dict[tuple[str, bytes], int], epochs: int = EPOCHS, seed: int = 3) -> Network | None:
    """A network fitted to counted words; languages weigh the same."""
    languages = sorted({lang for lang, _ in words})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    rows: dict[bytes, np.ndarray] = {}
    for (lang, word), n in sorted(words.items()):
        rows.setdefault(word, np.zeros(len(languages)))[number[lang]] += n
    keys, target = list(rows), np.stack(list(rows.values()))
    target = target / target.sum(0)
    weight = target.sum(1)
    target, weight = (target / weight[:, None]).astype(np.float32), weight / weight.mean()
    weight = np.minimum(weight, 50.0).astype(np.float32)
    lengths = np.array([len(k) for k in keys])
    pieces = np.zeros((len(keys), PIECE), np.uint8)
    for i, k in enumerate(keys):
        pieces[i, : len(k)] = np.frombuffer(k, np.uint8)
    network, rng = Network.start(languages, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    step, total = 0, epochs * -(-len(keys) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(keys))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            own = own[np.argsort(-lengths[own], kind="stable")]
            slope = network.slopes(pieces[own], lengths[own], target[own], weight[own])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for k, g in slope.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                network.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return network


def pieces_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces: words with a letter, long ones cut every few bytes."""
    starts, ends = runs(~IS_SPACE[block.data], block.offsets)
    count = -(-(ends - starts) // PIECE)
    if (count > 1).any():
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        starts, ends = np.repeat(starts, count) + nth * PIECE, np.repeat(ends, count)
        ends = np.minimum(ends, starts + PIECE)
    letters = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(IS_LETTER[block.data], out=letters[1:])
    some = letters[ends] > letters[starts]
    return starts[some], ends[some]


def _matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = np.minimum(starts[:, None] + np.arange(PIECE), max(len(data) - 1, 0))
    return np.where(np.arange(PIECE) < (ends - starts)[:, None], data[at], 0).astype(np.uint8)


def has_letter(block: Block) -> np.ndarray:
    """Rows with a letter of any script."""
    ascii_ = IS_LETTER[block.data] & (block.data < 0x80)
    high = block.data >= 0x80
    a, h = (np.concatenate(([0], np.cumsum(m))) for m in (ascii_, high))
    found = a[block.offsets[1:]] > a[block.offsets[:-1]]
    for r in np.flatnonzero(~found & (h[block.offsets[1:]] > h[block.offsets[:-1]])).tolist():
        text = block.data[block.offsets[r] : block.offsets[r + 1]].tobytes().decode("utf-8", "replace")
        found[r] = any(c.isalpha() for c in text)
    return found


class Reader:
    """Log probabilities of pieces; those of pieces read before are looked up."""

    def __init__(self, network: Network):
        self.network, self.seen = network, HashNumbers()
        self.known = np.zeros((1 << 12, len(network.languages)), np.float32)

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece its log probabilities, its length, and the bounds of the rows."""
        starts, ends = pieces_of(block)
        hashes = span_hashes(block.data, starts, ends)
        number = self.seen.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            if not self.seen.room(len(fresh)):
                self.seen = HashNumbers(max(self.seen.slots, 4 << int(len(hashes)).bit_length()))
                new = np.arange(len(hashes))
                fresh, first = np.unique(hashes, return_index=True)
            at = new[first]
            values = self.network.pooled(_matrix(block.data, starts[at], ends[at]), ends[at] - starts[at])
            own = self.seen.add(fresh)
            while len(self.known) <= own[-1]:
                self.known = np.resize(self.known, (2 * len(self.known), self.known.shape[1]))
            self.known[own] = values
            number[new] = self.seen.find(hashes[new])
        return self.known[number], ends - starts, per_row(starts, block.offsets)


def _sample(rows: DataFrame, docs: int, words: int) -> dict[tuple[str, bytes], int]:
    """Counted words of a bounded number of documents of each language, spread over their texts.

    The counts of few languages are broadcast, so texts are sampled where they are scanned and the rest
    of them is not shuffled.
    """
    counts = broadcast_if_small(write_once(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))))
    share = F.least(F.lit(1.0), F.lit(3.0 * docs) / F.col("n"))
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) <= share * 1_000_000
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    few = rows.join(counts, "lang").where(near).withColumn("at", F.row_number().over(by_hash))
    few = few.where(F.col("at") <= docs).select("lang", "text")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                starts, ends = pieces_of(block)
                bounds = per_row(starts, block.offsets)
                out_l, out_w = [], []
                for r in range(block.rows):
                    a, b = int(bounds[r]), int(bounds[r + 1])
                    at = np.arange(a, b)
                    if b - a > words:
                        at = np.sort(np.random.default_rng(b - a).choice(at, words, replace=False))
                    out_l += [langs[block.first + r]] * len(at)
                    out_w += [block.data[starts[i] : ends[i]].tobytes() for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(out_l, pa.string()), pa.array(out_w, pa.binary())], ["lang", "word"])

    drawn = few.mapInArrow(draw, "lang string, word binary").groupBy("lang", "word").count()
    return {(r["lang"], bytes(r["word"])): r["count"] for r in drawn.toLocalIterator()}


def identify_languages(
    docs: DataFrame, sample: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS,
    key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of each row.

    The network reads every word forwards and backwards and labels each byte with
    probabilities of the languages; the mean of their logarithms over all bytes of a
    text gives its probabilities, of which the largest is the score.  A word that occurs
    again has the same labels, so a task reads each once.

    It is fitted to at most ``words`` words of each of ``sample`` documents per language whose
    ``crc32(doc_id)`` is not 0 modulo 5; the prediction depends on the text alone.  Null
    texts and texts without a letter get ``und`` and 0, as do all when no language is
    known; repeated rows get a row each; an empty table gives no rows; other columns are not read.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    learn = rows.where((crc != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(fit(_sample(learn, sample, words)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        reader = Reader(network) if network else None
        for batch in batches:
            names, scores = [], []
            for block in blocks(batch.column(1)):
                letter = has_letter(block)
                if reader is None:
                    names += ["und"] * block.rows
                    scores.append(np.zeros(block.rows))
                    continue
                value, length, bounds = reader(block)
                total = np.concatenate((np.zeros((1, value.shape[1])), np.cumsum(value, 0, dtype=np.float64)))
                mass = np.concatenate(([0], np.cumsum(length)))
                mean = np.diff(total[bounds], axis=0) / np.maximum(np.diff(mass[bounds]), 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                names += [network.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                scores.append(np.where(letter, p.max(1), 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))],
                ["doc_id", "lang_pred", "score"],
            )

    held_out = F.coalesce(crc == 0, F.lit(False)).alias("held_out")
    return rows.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out, "lang_pred", "score"
    )
