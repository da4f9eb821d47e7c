"""Remove long strings that occur earlier in the corpus, found through suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.llm.scratch import Scratch
from srcweave.llm.suffix_array import suffix_places
from srcweave.llm.text_arrays import OTHER_VALUES, Block, blocks, fixed_hashes, mix, prefix_sums, ragged, span_hashes

#: Bytes of an anchor.  An anchor is the least of the strings of this length in some window.
ANCHOR = 32
#: Bytes of text worked on at once: about 60 bytes of arrays for each.
BLOCK_BYTES = 1 << 20
#: Different surroundings of one anchor that go into one suffix array, at most; the windows
#: of anchors with more are compared one by one instead.
CONTEXTS = 256
#: Bytes of suffix arrays that a task builds at once (their numbers should stay in a core's cache), and anchors in one bucket, about.
ARRAY_BYTES, BUCKET_ANCHORS = 1 << 18, 2_000_000
#: Ids that may be broadcast.
SMALL = 200_000

_NONE = np.uint64(2**64 - 1)


def _spread(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` neighbouring values, at the first of them."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def anchors(
    block: Block, length: int, sums: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a block, their rows, and the least hash of each window.

    Of the short strings within every ``length`` bytes of a row those with the least hash are
    anchors, so equal long strings have equal anchors at equal places.  The least hashes are 0
    where no window begins, and stand behind as many zeros as a window has places less one.
    """
    none = np.zeros(0, np.int64)
    n, span = len(block.data), length - ANCHOR + 1
    if n < length:
        return none, none.astype(np.uint64), none, none.astype(np.uint64)
    h = fixed_hashes(prefix_sums(block.data) if sums is None else sums, ANCHOR)
    least = _spread(h, span, np.minimum)
    size = np.diff(block.offsets)
    inside = np.zeros(len(least), bool)
    inside[ragged(block.offsets[:-1], np.maximum(size - length + 1, 0))] = True
    least[~inside] = 0
    edge = np.zeros(span - 1, np.uint64)
    least = np.concatenate((edge, least, edge))
    at = np.flatnonzero((_spread(least, span, np.maximum) == h) & (h > 0))
    return at, h[at], np.searchsorted(block.offsets, at, "right") - 1, least


def _own_windows(at: np.ndarray, h: np.ndarray, least: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first window begins in which an anchor's hash is the least, and the number of those windows.

    They are neighbours: only a smaller hash on either side ends them.
    """
    first, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(least, span) if len(at) else least
    for a in range(0, len(at), 4096):
        own = windows[at[a : a + 4096]] == h[a : a + 4096, None]
        first[a : a + 4096], count[a : a + 4096] = own.argmax(1), own.sum(1)
    return at - span + 1 + first, count


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``did``, ``tkey`` and ``text``: rows equal in both id and text are one document."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), content.alias("text")).select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.xxhash64("text").alias("tkey"), "text", "doc_id"
    )


def _first_counts(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """For each block: anchors that occur in it more than once, by row, and all distinct ones by bucket.

    A bucket row holds 32 bits of each anchor (which nearly identify it there), its place
    among the bucket's anchors of its row, and whether it is repeated in the block.
    """
    schema = "bucket int, dids binary, tkeys binary, counts binary, marks binary, places binary, repeated binary"
    names = ["bucket", "dids", "tkeys", "counts", "marks", "places", "repeated"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in blocks(batch.column(2), BLOCK_BYTES):
                at, h, row, _ = anchors(block, length)
                bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((at, bucket))
                h, row, bucket = h[order], row[order], bucket[order]
                start = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])))) if len(h) else np.zeros(0, int)
                place = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
                _, first, number, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                many = times[number] > 1
                sent = np.zeros(len(h), bool)
                sent[first] = True
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                columns: list[list] = [[] for _ in names]

                def put(no: int, own: np.ndarray, full: bool) -> None:
                    if not len(own):
                        return
                    new = np.flatnonzero(np.concatenate(([True], row[own][1:] != row[own][:-1])))
                    owners = block.first + row[own[new]]
                    values = (
                        no, ids[owners].tobytes(), texts[owners].tobytes(),
                        np.diff(np.append(new, len(own))).astype(np.int32).tobytes(),
                        h[own].astype(np.uint32).tobytes() if full else b"", place[own].astype(np.uint32).tobytes(),
                        many[own].tobytes() if full else b"",
                    )
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)

                for b in range(buckets):
                    own = np.arange(cut[b], cut[b + 1])
                    put(b, own[sent[own]], True)
                    put(-1 - b, own[many[own]], False)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names)

    return docs.select("did", "tkey", "text").mapInArrow(send, schema)


def _rows_of(part: pd.DataFrame, keep: np.ndarray | None) -> pd.DataFrame:
    """``did``, ``tkey``, ``bucket`` and ``places`` for each row of a document in bucket rows."""
    ids, texts = np.frombuffer(b"".join(part["dids"]), np.int64), np.frombuffer(b"".join(part["tkeys"]), np.int64)
    counts = np.frombuffer(b"".join(part["counts"]), np.int32).astype(np.int64)
    places = np.frombuffer(b"".join(part["places"]), np.uint32)
    per_row = np.array([len(x) // 8 for x in part["dids"]], np.int64)
    bucket = np.repeat(part["bucket"].to_numpy().astype(np.int64), per_row)
    if keep is not None:
        total = np.concatenate(([0], np.cumsum(keep)))
        ends = np.cumsum(counts)
        counts, places = total[ends] - total[ends - counts], places[keep]
    ends = np.cumsum(counts)
    raw, some = places.tobytes(), counts > 0
    parts = [raw[4 * (b - c) : 4 * b] for b, c in zip(ends[some].tolist(), counts[some].tolist(), strict=True)]
    bucket = np.where(bucket < 0, -1 - bucket, bucket)
    return pd.DataFrame({"did": ids[some], "tkey": texts[some], "bucket": bucket[some].astype(np.int32), "places": parts})


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """The anchors of a bucket that also stand elsewhere."""
    marks = np.frombuffer(b"".join(group["marks"]), np.uint32)
    repeated = np.frombuffer(b"".join(group["repeated"]), bool)
    _, number, times = np.unique(marks, return_inverse=True, return_counts=True)
    often = (times > 1) | (np.bincount(number, repeated, len(times)) > 0)
    # those repeated in their own block are known there already
    return _rows_of(group, often[number] & ~repeated)


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        if len(part):
            yield _rows_of(part, None)


_PLACES = "did long, tkey long, bucket int, places binary"
_FOUND = "did long, tkey long, h long, c long, at long, low long, high long"


def _with_texts(docs: DataFrame, lists: DataFrame, few: bool) -> DataFrame:
    """Documents that have a list, with it; ids proven few are broadcast, so other texts stay where they are."""
    if few:
        docs = docs.join(F.broadcast(lists.select("did", "tkey")), ["did", "tkey"], "left_semi")
    return docs.dropDuplicates(["did", "tkey"]).join(lists, ["did", "tkey"])


def _picked(block: Block, lists: list, length: int, buckets: int) -> tuple[np.ndarray, ...]:
    """Row, hash, hash of the surroundings, place, and bounds of the surroundings of the listed anchors.

    Surroundings are the windows in which the anchor has the least hash; other windows belong
    to other anchors.
    """
    sums = prefix_sums(block.data)
    at, h, row, least = anchors(block, length, sums)
    bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((at, bucket, row))
    r, b = row[order], bucket[order]
    start = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (b[1:] != b[:-1])))) if len(h) else np.zeros(0, int)
    begin = {(x, y): s for x, y, s in zip(r[start].tolist(), b[start].tolist(), start.tolist(), strict=True)}
    keep = np.zeros(len(h), bool)
    for i in range(block.rows):
        for part in lists[block.first + i]:
            places = np.frombuffer(part["places"], np.uint32).astype(np.int64)
            keep[order[begin[i, part["bucket"]] + places]] = True
    at, h, row = at[keep], h[keep], row[keep]
    left = block.offsets[:-1][row]
    low, count = _own_windows(at, h, least, length - ANCHOR + 1)
    high = low + count + length - 1
    c = mix(span_hashes(block.data, low, high, sums) + (at - low).astype(np.uint64))
    return block.first + row, h, c, at - left, low - left, high - left


def _occurrences(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Shared anchors with the hash of their surroundings, and spans (``h`` null) that repeat in one batch."""
    names = ["did", "tkey", "h", "c", "at", "low", "high"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3).to_pylist()
            parts = [_picked(block, lists, length, buckets) for block in blocks(batch.column(2), BLOCK_BYTES)]
            if not parts:
                continue
            owner, h, c, at, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, texts[owner], ids[owner], c, h))
            again = np.zeros(len(h), bool)
            again[1:] = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
            again[order] = again.copy()
            # of those that repeat one in this batch only the bytes they cover are sent
            doc, start, end = _join_windows(owner[again], low[again], high[again])
            nothing = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(texts[doc]), nothing, nothing, nothing, pa.array(start), pa.array(end)], names)
            own = ~again
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner[own]]), pa.array(texts[owner[own]]), pa.array(h[own].view(np.int64)), pa.array(c[own].view(np.int64)),
                 *[pa.array(x[own]) for x in (at, low, high)]],
                names,
            )

    return docs.select("did", "tkey", "text", "lists").mapInArrow(find, _FOUND)


_CUT = "did long, tkey long, h long, at long, low long, bytes binary, w1 long, w2 long"


def _cut_out(docs: DataFrame, length: int) -> DataFrame:
    """The surroundings of anchors: whole for suffix arrays, or as hashes of their windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3).to_pylist()
            for block in blocks(batch.column(2), BLOCK_BYTES):
                raw, whole, single = block.data.tobytes(), [], []
                for r in range(block.rows):
                    base = int(block.offsets[r])
                    for s in lists[block.first + r]:
                        (single if s["hot"] else whole).append((block.first + r, s["h"], s["low"], base + s["low"], base + s["high"], s["at"]))
                kept = [batch.column(i).take(pa.array([w[0] for w in whole], pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *[pa.array([w[i] for w in whole], pa.int64()) for i in (1, 5, 2)],
                     pa.array([raw[w[3] : w[4]] for w in whole], pa.binary()), *[pa.nulls(len(whole), pa.int64())] * 2],
                    ["did", "tkey", "h", "at", "low", "bytes", "w1", "w2"],
                )
                if not single:
                    continue
                from_, to = (np.array([w[i] for w in single], np.int64) for i in (3, 4))
                count = to - from_ - length + 1
                begin = ragged(from_, count)
                owner = np.repeat(np.array([w[0] for w in single], np.int64), count)
                pair, once = np.unique(np.stack((owner, begin), 1), axis=0, return_index=True)
                begin, owner = pair[:, 1], pair[:, 0]
                first = span_hashes(block.data, begin, begin + length)
                second = span_hashes(block.data, begin, begin + length, prefix_sums(block.data, OTHER_VALUES))
                kept = [batch.column(i).take(pa.array(owner)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *[pa.nulls(len(begin), pa.int64())] * 2, pa.array(begin - block.offsets[:-1][owner - block.first]),
                     pa.nulls(len(begin), pa.binary()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))],
                    ["did", "tkey", "h", "at", "low", "bytes", "w1", "w2"],
                )

    return docs.select("did", "tkey", "text", "lists").mapInArrow(cut, _CUT)


def _join_windows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans of each document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    big = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(end + doc * big) if len(end) else end
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + doc[1:] * big > reach[:-1]
    new[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(doc) - 1) if len(doc) else first
    return doc[first], start[first], reach[last] - doc[first] * big


def _shared_length(h: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The most bytes that the side of an anchor's surroundings has in common with one of the others'."""
    keys = np.pad(sides, ((0, 0), (0, -sides.shape[1] % 8))).view(">u8")
    order = np.lexsort((*keys.T[::-1], h))
    differ = sides[order][1:] != sides[order][:-1]
    common = np.where(differ.any(1), differ.argmax(1), sides.shape[1])
    common[h[order][1:] != h[order][:-1]] = 0
    edge = np.zeros(1, np.int64)
    most = np.empty(len(h), np.int64)
    most[order] = np.maximum(np.append(edge, common), np.append(common, edge))
    return most


def _trimmed(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """Surroundings cut to what may stand in others of the same anchor; those too short for a window go.

    A window has some bytes before its anchor and some behind.  It can only stand elsewhere if
    others have as many in common with it on both sides.
    """
    sizes = group["bytes"].map(len).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(group["bytes"]), np.uint8)
    h, low = group["h"].to_numpy(), group["low"].to_numpy()
    before, side = group["at"].to_numpy() - low, length - ANCHOR
    anchor = np.cumsum(sizes) - sizes + before
    behind = sizes - before - ANCHOR
    steps, padded = np.arange(side), np.append(data, np.zeros(1, np.uint8))
    left = padded[np.where(steps < before[:, None], anchor[:, None] - 1 - steps, len(data))]
    left = np.minimum(_shared_length(h, left), before)
    right = padded[np.where(steps < behind[:, None], anchor[:, None] + ANCHOR + steps, len(data))]
    right = np.minimum(_shared_length(h, right), behind)
    keep = left + ANCHOR + right >= length
    group = group[keep].assign(low=(low + before - left)[keep])
    begin, end = (before - left)[keep].tolist(), (before + ANCHOR + right)[keep].tolist()
    return group.assign(bytes=[x[a:b] for x, a, b in zip(group["bytes"], begin, end, strict=True)])


def _repeats(length: int):
    """Windows of some surroundings that also begin earlier, by the suffix arrays of each anchor's."""

    def find(group: pd.DataFrame) -> pd.DataFrame:
        parts = []
        group = _trimmed(group.iloc[np.argsort(group["h"].to_numpy(), kind="stable")], length)
        if not len(group):
            return pd.DataFrame({name: np.zeros(0, np.int64) for name in ("did", "tkey", "low", "high")})
        sizes = group["bytes"].map(len).to_numpy()
        new = np.flatnonzero(np.concatenate(([True], np.diff(group["h"].to_numpy()) != 0)))
        by_anchor = np.add.reduceat(sizes, new)
        # texts of like sizes together: they end together
        order = np.argsort(by_anchor, kind="stable")
        portion = np.empty(len(new), np.int64)
        portion[order] = np.cumsum(by_anchor[order]) // ARRAY_BYTES
        portion = np.repeat(portion, np.diff(np.append(new, len(group))))
        for no in np.unique(portion):
            parts.append(_repeats_of(group[portion == no], length))
        found = pd.concat(parts)
        return _merged(found) if len(found) else found

    return find


def _repeats_of(group: pd.DataFrame, length: int) -> pd.DataFrame:
    sizes = group["bytes"].map(len).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(group["bytes"]), np.uint8)
    first = np.cumsum(sizes) - sizes
    h = group["h"].to_numpy()
    # each text ends with a separator (1), those of one anchor with the least symbol (0)
    symbols = np.ones(len(data) + len(sizes), np.int16)
    place = first + np.arange(len(sizes))
    symbols[ragged(place, sizes)] = data.astype(np.int16) + 2
    last = np.flatnonzero(np.append(h[1:] != h[:-1], True))
    ends = place[last] + sizes[last] + 1
    symbols[ends - 1] = 0
    offsets = np.concatenate(([0], ends))
    order = np.empty(len(symbols), np.int64)
    order[suffix_places(symbols, offsets)] = np.arange(len(symbols))
    where = np.full(len(symbols), -1, np.int64)
    where[ragged(place, sizes)] = np.arange(len(data))
    long_ = np.zeros(len(data), bool)
    long_[ragged(first, np.maximum(sizes - length + 1, 0))] = True
    at = where[order]
    at = at[at >= 0]
    at = at[long_[at]]
    window = fixed_hashes(prefix_sums(data), length)[at]
    row = np.searchsorted(first, at, "right") - 1
    equal = np.zeros(len(at), bool)
    equal[1:] = (window[1:] == window[:-1]) & (h[row[1:]] == h[row[:-1]])
    ids, number = np.unique(np.stack((group["did"].to_numpy(), group["tkey"].to_numpy()), 1), axis=0, return_inverse=True)
    doc, start = number.ravel()[row], group["low"].to_numpy()[row] + at - first[row]
    big = int(start.max()) + 1 if len(start) else 1
    when = doc * big + start
    begins = np.flatnonzero(~equal)
    least = np.repeat(np.minimum.reduceat(when, begins), np.diff(np.append(begins, len(when)))) if len(when) else when
    later = when > least
    doc, start, end = _join_windows(doc[later], start[later], start[later] + length)
    return pd.DataFrame({"did": ids[doc, 0], "tkey": ids[doc, 1], "low": start, "high": end})


_SPAN = "did long, tkey long, low long, high long"


def repeated_spans(docs: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """``did``, ``tkey``, ``spans`` (overlapping ones) of bytes in strings that begin earlier; number of rows."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-2 * total // ((length - ANCHOR + 2) * BUCKET_ANCHORS)))
    counted = scratch.write(_first_counts(docs, length, buckets))
    elsewhere = counted.where("bucket >= 0").groupBy("bucket").applyInPandas(_shared, _PLACES)
    here = counted.where("bucket < 0").mapInPandas(_listed, _PLACES)
    lists, n = scratch.write_counted(elsewhere.unionByName(here).groupBy("did", "tkey").agg(
        F.collect_list(F.struct("bucket", "places")).alias("lists")
    ))
    scratch.drop(counted)
    found = scratch.write(_occurrences(_with_texts(docs, lists, n <= SMALL), length, buckets))
    scratch.drop(lists)
    known = found.where("h IS NOT NULL")
    first = scratch.write(known.groupBy("h", "c").agg(
        F.min(F.struct("did", "tkey", "at", "low", "high")).alias("f"), F.count(F.lit(1)).alias("n")
    ))
    within = found.where("h IS NULL").select("did", "tkey", "low", "high")
    again = known.join(first.where("n > 1").select("h", "c", "f"), ["h", "c"]).where(
        F.struct("did", "tkey", "at") > F.struct("f.did", "f.tkey", "f.at")
    ).select("did", "tkey", "low", "high")
    plain = scratch.write(within.unionByName(again).mapInPandas(_merge_portions, _SPAN))
    scratch.drop(found)
    several = first.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    asked, n = scratch.write_counted(first.join(several, "h").select(
        "h", "f.did", "f.tkey", "f.at", "f.low", "f.high", (F.col("contexts") > CONTEXTS).alias("hot")
    ).groupBy("did", "tkey").agg(F.collect_list(F.struct("h", "at", "low", "high", "hot")).alias("lists")))
    scratch.drop(first)
    cut, size = scratch.write_counted(
        _cut_out(_with_texts(docs, asked, n <= SMALL), length), F.sum(F.coalesce(F.octet_length("bytes"), F.lit(0)))
    )
    scratch.drop(asked)
    slots = max(8, -(-size // (16 * ARRAY_BYTES)))
    arrays = cut.where("bytes IS NOT NULL").groupBy(F.pmod(F.xxhash64("h"), F.lit(slots))).applyInPandas(_repeats(length), _SPAN)
    windows = cut.where("w1 IS NOT NULL").select("w1", "w2", "did", "tkey", "low")
    least = windows.groupBy("w1", "w2").agg(F.min(F.struct("did", "tkey", "low")).alias("f"), F.count(F.lit(1)).alias("n"))
    crowded = windows.join(least.where("n > 1").select("w1", "w2", "f"), ["w1", "w2"]).where(
        F.struct("did", "tkey", "low") > F.col("f")
    ).select("did", "tkey", "low", (F.col("low") + length).alias("high"))
    # the others are merged already: a second step in Python behind the arrays would give each task a second worker
    spans = plain.unionByName(arrays).unionByName(crowded.mapInPandas(_merge_portions, _SPAN))
    spans, n = scratch.write_counted(spans.groupBy("did", "tkey").agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    scratch.drop(cut, plain)
    return spans, n


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text."""
    for batch in batches:
        spans = batch.column(2).to_pylist() if batch.num_columns > 2 else None
        for block in blocks(batch.column(1), BLOCK_BYTES):
            raw, columns = block.data.tobytes(), [[], [], [], [], [], []]
            for r in range(block.rows):
                base, stop = int(block.offsets[r]), int(block.offsets[r + 1])
                starts = ends = np.zeros(0, np.int64)
                own = spans[block.first + r] if spans else None
                if own:
                    pairs = np.array([(s["low"], s["high"]) for s in own], np.int64)
                    _, starts, ends = _join_windows(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                digest, here = hashlib.sha256(), base
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    digest.update(raw[here : base + a])
                    here = base + b
                digest.update(raw[here:stop])
                for column, value in zip(columns, (stop - base, int((ends - starts).sum()), len(starts), digest.hexdigest(), starts.tolist(), ends.tolist()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, block.rows), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"],
            )


def _merged(part: pd.DataFrame) -> pd.DataFrame:
    """Overlapping spans of one document as one."""
    ids, number = np.unique(part[["did", "tkey"]].to_numpy(), axis=0, return_inverse=True)
    doc, low, high = _join_windows(number.ravel(), part["low"].to_numpy(), part["high"].to_numpy())
    return pd.DataFrame({"did": ids[doc, 0], "tkey": ids[doc, 1], "low": low, "high": high})


def _merge_portions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Overlapping spans that a task holds of one document become one before they are shuffled."""
    for part in batches:
        if len(part):
            yield _merged(part)


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the removed runs of each row.

    A byte goes if a string of ``length`` bytes that covers it also begins earlier: in a
    document of smaller id, or before it in the same one.  Strings may overlap, never cross
    documents, and are judged on the input.  The digest is that of the bytes left.

    1. Equal strings have equal anchors, so only anchors that stand at two places matter.  They are
       counted in bulk, dealt to buckets whose number follows the corpus; a block sends each once.
    2. Of anchors with equal surroundings all but the first have all their strings removed:
       equal surroundings are collapsed before anything else is shuffled.
    3. The different surroundings of an anchor, cut to what others have in common with them on either
       side, form a suffix array (Lyndon grouping); strings that
       are neighbours in its order and equal keep their earliest place.  An anchor with more than
       ``CONTEXTS`` of them has its strings grouped by two hashes instead, which is exact too
       and never holds them in one task.

    Null and empty texts have no bytes; a null id comes before all others; rows equal in id and
    text count as one document and get the same result, rows equal in id only go by a hash of
    their text; an empty table gives no rows; other columns are not read.  Strings are compared
    by 64-bit hashes of them and of their anchors.
    """
    rows = _named(docs, key, text)
    spans, n = repeated_spans(rows, length, Scratch(docs.sparkSession))
    if n > SMALL:
        return rows.join(spans, ["did", "tkey"], "left").select("doc_id", "text", "spans").mapInArrow(_keep, _RESULT)
    ids = F.broadcast(spans.select("did", "tkey"))
    changed = rows.join(ids, ["did", "tkey"], "left_semi").join(spans, ["did", "tkey"])
    same = rows.join(ids, ["did", "tkey"], "left_anti").select("doc_id", "text").mapInArrow(_keep, _RESULT)
    return same.unionByName(changed.select("doc_id", "text", "spans").mapInArrow(_keep, _RESULT))
