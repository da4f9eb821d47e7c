"""Benchmark phrases in training documents, found through an FM-index of each shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.llm.fm_index import FMIndex
from srcweave.llm.text_arrays import LOWER, Block, blocks, per_row, row_of, runs, span_hashes

#: Bytes of text that one index covers, about.
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text that are searched for at once; more are searched in turn.
PHRASE_BYTES = 8 << 20

#: Bytes of words once A-Z is lower case: digits, a-z, and all of other scripts.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_STATE = (
    "doc_id long, n_words long, hit_starts array<long>, hit_ends array<long>, items array<string>"
)


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and the bounds of each row among them."""
    data = LOWER[block.data]
    starts, ends = runs(IS_WORD[data], block.offsets)
    return span_hashes(data, starts, ends), per_row(starts, block.offsets)


@dataclass
class Phrases:
    """Distinct windows of some items, in numbers of the words that occur in them."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    item_bounds: np.ndarray
    items: np.ndarray
    names: list[str]

    @staticmethod
    def of(names: list[str], texts: list[str | None], window: int) -> Phrases:
        hashes, bounds = [], [np.zeros(1, np.int64)]
        for block in blocks(pa.array(texts, pa.string())):
            h, b = words_of(block)
            bounds.append(b[1:] + sum(map(len, hashes)))
            hashes.append(h)
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        bounds = np.concatenate(bounds)
        vocabulary, number = np.unique(flat, return_inverse=True)
        rows: dict[tuple[int, ...], set[int]] = {}
        number = (number + 1).tolist()
        for item, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            for at in range(a, max(b - window, a) + 1 if b > a else a):
                rows.setdefault(tuple(number[at : min(at + window, b)]), set()).add(item)
        lengths = np.array([len(r) for r in rows], np.int64)
        windows = np.zeros((len(rows), window), np.int64)
        for i, r in enumerate(rows):
            windows[i, window - len(r) :] = r
        sets = [sorted(s) for s in rows.values()]
        return Phrases(
            vocabulary, windows, lengths, np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64),
            np.array([i for s in sets for i in s], np.int64), names,
        )

    def find(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """Bounds of the rows among the words, starts and ends of hit words, items by row.

        Words outside the phrases cut the sequence into stretches.  A stretch shorter than the
        shortest phrase can't hold one and is left out of the index.
        """
        hashes, bounds = words_of(block)
        found: list[set[str]] = [set() for _ in range(block.rows)]
        none = np.zeros(0, np.int64)
        if not len(self.windows) or not len(hashes):
            return bounds, none, none, found
        place = np.searchsorted(self.vocabulary, hashes)
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == hashes
        starts, ends = runs(known, bounds)
        long_ = ends - starts >= self.lengths.min()
        starts, ends = starts[long_], ends[long_]
        if not len(starts):
            return bounds, none, none, found
        size = ends - starts + 1  # with a separator
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first - starts, size)
        symbols = np.where(at < np.repeat(ends, size), place[np.minimum(at, len(place) - 1)] + 1, 0)
        phrase, position = FMIndex(symbols, len(self.vocabulary)).occurrences(self.windows, self.lengths)
        word = at[position]
        delta = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(delta, word, 1)
        np.add.at(delta, word + self.lengths[phrase], -1)
        row = row_of(word, bounds)
        for r, p in np.unique(np.stack((row, phrase), 1), axis=0).tolist():
            found[r].update(self.names[i] for i in self.items[self.item_bounds[p] : self.item_bounds[p + 1]])
        hit_starts, hit_ends = runs(np.cumsum(delta[:-1]) > 0, bounds)
        return bounds, hit_starts, hit_ends, found


def _join_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1) if len(starts) else np.zeros(0, int)
    return starts[new].tolist(), reach[last].tolist()


def _search(docs: DataFrame, phrases: Phrases, more: bool) -> DataFrame:
    """Add what some phrases hit to what earlier ones have."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    later = "n_words" in docs.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for block in blocks(batch.column("text"), SHARD_BYTES):
                bounds, starts, ends, items = wanted.find(block)
                lows, highs = per_row(starts, bounds), per_row(ends - 1, bounds)
                own = batch.slice(block.first, block.rows)
                old = own.select(["hit_starts", "hit_ends", "items"]).to_pylist() if later else None
                spans, names = [], []
                for r in range(block.rows):
                    a, b = starts[lows[r] : lows[r + 1]] - bounds[r], ends[highs[r] : highs[r + 1]] - bounds[r]
                    if old:
                        a, b = np.append(old[r]["hit_starts"], a), np.append(old[r]["hit_ends"], b)
                        items[r].update(old[r]["items"])
                    spans.append(_join_spans(a.astype(np.int64), b.astype(np.int64)))
                    names.append(sorted(items[r]))
                columns = [
                    own.column("doc_id"), pa.array(np.diff(bounds)),
                    pa.array([s[0] for s in spans], pa.list_(pa.int64())),
                    pa.array([s[1] for s in spans], pa.list_(pa.int64())),
                    pa.array(names, pa.list_(pa.string())),
                ]
                labels = ["doc_id", "n_words", "hit_starts", "hit_ends", "items"]
                if more:
                    columns, labels = [*columns, own.column("text")], [*labels, "text"]
                yield pa.RecordBatch.from_arrays(columns, labels)

    return docs.mapInArrow(find, _STATE + (", text string" if more else ""))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Which words of each document stand in a phrase of the benchmark.

    Words are runs of digits, letters and all characters above ASCII, with A-Z in lower
    case.  A phrase is ``window`` consecutive words of an item; an item of fewer words, but not
    none, is one phrase.  Of each row come ``doc_id``, ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256``, ``contaminated`` (some hit, and hits times ``share`` reach the words), the merged
    hit spans ``hit_starts`` and ``hit_ends`` in words, and ``items``.

    Each task indexes its documents in shards of bounded size and searches all phrases backwards at
    once.  The benchmark is a stated query set: it is read to the driver in portions of
    bounded size, each broadcast in turn.

    Null and empty texts have no words; repeated rows get a row each; repeated items count
    once by id, an item without id as "null"; empty tables give no rows or no hits; other
    columns are not read.  Words are compared by 64-bit hashes.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"),
        F.col(item_text).cast("string").alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = max(1, -(-total // PHRASE_BYTES))
    for at in range(portions):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(portions)) == at).collect()
        phrases = Phrases.of([r["item"] for r in own], [r["text"] for r in own], window)
        rows = _search(rows, phrases, at < portions - 1)

    @F.pandas_udf("string")
    def digest(names: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names])

    hit = F.aggregate(
        F.zip_with("hit_starts", "hit_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y
    )
    return rows.withColumn("n_hit", hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        digest("items").alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        "hit_starts", "hit_ends", "items",
    )


#: The fixed columns in DuckDB, by joining all windows.
DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), o AS (
  SELECT doc_id, i, n, item FROM (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
  ) JOIN p USING (n, phrase)
), h AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM o) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
