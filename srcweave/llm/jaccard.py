"""Documents whose word shingles are similar, joined under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcweave.llm.components import connected
from srcweave.llm.text_arrays import IS_SPACE, LOWER, Block, blocks, mix, per_row, ragged, runs, span_hashes
from srcweave.session import broadcast_if_small, write_counted, write_once

#: Tokens that one bucket holds, about; their number of buckets follows the corpus.
BUCKET_TOKENS = 2_000_000
#: Share of the token hashes that the first order looks at.  More than 1 - threshold is
#: needed for it to rule anything out.
SAMPLED = 0.35
#: Rows of one id that may be broadcast.
SMALL = 200_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Columns of the bitmap of a set.
BITS = tuple(f"bits{i}" for i in range(8))
#: Sets, and tokens of sets, that one side of a tile holds, about; a larger group is dealt to several tiles.
TILE_SETS, TILE_TOKENS = 512, 500_000
#: Rows of tiles that are paired in one task, and pairs that are compared in one task, about.
TILE_ROWS, TASK_PAIRS = 50_000, 1_000_000
#: Groups of a set by which two sets that share several are paired in one of them only.
SIGNS = 4
#: Pairs that are filtered at once, and columns of tokens that are counted at once.
CHUNK, COLUMNS = 200_000, 4_096
_NONE = 2**63 - 1
_BLOBS = "bucket int, nodes binary, counts binary, tokens binary"


def token_sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of each row, and the bounds of the rows."""
    data = LOWER[block.data]
    starts, ends = runs(~IS_SPACE[data], block.offsets)
    words = span_hashes(data, starts, ends)
    bounds = per_row(starts, block.offsets)
    n = np.diff(bounds)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    factors = mix(np.arange(width, dtype=np.uint64) + _FACTORS[0])
    whole = sum((padded[i : i + len(words)] * factors[i] for i in range(width)), np.zeros(len(words), np.uint64))
    whole = mix(whole)
    out, sizes = [], np.zeros(block.rows, np.int64)
    for r in np.flatnonzero(n).tolist():
        a, b = int(bounds[r]), int(bounds[r + 1])
        if b - a >= width:
            own = np.unique(whole[a : b - width + 1])
        else:
            own = mix(np.array([int((words[a:b] * factors[: b - a]).sum())], np.uint64) + _FACTORS[b - a])
        out.append(own)
        sizes[r] = len(own)
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate(([0], np.cumsum(sizes)))


def set_keys(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    keys = []
    for salt in (_FACTORS[1], _FACTORS[2]):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ salt))))
        keys.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def may_miss(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n that a similar one may lack."""
    return n - -(-percent * n // 100)


def blob_rows(nodes: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, buckets: int, short: bool) -> pa.RecordBatch:
    """Tokens dealt to buckets by hash: for each bucket its sets, how many tokens of each, and the tokens.

    ``short`` keeps 32 bits of a token, which within a bucket nearly identify it.
    """
    owner = np.repeat(np.arange(len(nodes)), np.diff(bounds))
    bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [[], [], [], []]
    for b in range(buckets):
        at = order[cut[b] : cut[b + 1]]
        if not len(at):
            continue
        own = owner[at]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        columns[0].append(b)
        columns[1].append(nodes[own[first]].tobytes())
        columns[2].append(np.diff(np.append(first, len(own))).astype(np.int32).tobytes())
        columns[3].append((tokens[at].astype(np.uint32) if short else tokens[at]).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
        ["bucket", "nodes", "counts", "tokens"],
    )


def read_blobs(group: pd.DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of a bucket, how many tokens of each, and the tokens."""
    nodes = np.frombuffer(b"".join(group["nodes"]), np.int64)
    counts = np.frombuffer(b"".join(group["counts"]), np.int32).astype(np.int64)
    return nodes, counts, np.frombuffer(b"".join(group["tokens"]), kind)


def _documents(docs: DataFrame, width: int, low: int) -> DataFrame:
    """``doc_id``, ``n``, ``sampled`` (tokens below ``low``), and the two hashes of the set."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                tokens, bounds = token_sets(block, width)
                a, b = set_keys(tokens, bounds)
                below = np.concatenate(([0], np.cumsum(tokens < np.uint64(low))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), pa.array(np.diff(bounds)), pa.array(np.diff(below[bounds])), pa.array(a), pa.array(b)],
                    ["doc_id", "n", "sampled", "node", "check"],
                )

    return docs.mapInArrow(summarize, "doc_id long, n long, sampled long, node long, check long")


def _sampled_blobs(docs: DataFrame, width: int, low: int, buckets: int) -> DataFrame:
    """Tokens below ``low`` of all sets; a task sends each set once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                tokens, bounds = token_sets(block, width)
                nodes, _ = set_keys(tokens, bounds)
                keep = tokens < np.uint64(low)
                inside = np.concatenate(([0], np.cumsum(keep)))[bounds]
                tokens, size = tokens[keep], np.diff(inside)
                nodes, first = np.unique(nodes, return_index=True)
                tokens = tokens[ragged(inside[:-1][first], size[first])]
                yield blob_rows(nodes, tokens, np.concatenate(([0], np.cumsum(size[first]))), buckets, True)

    return docs.mapInArrow(send, _BLOBS)


def _shared_counts(group: pd.DataFrame) -> pd.DataFrame:
    """How many tokens of each set other sets have too."""
    nodes, counts, tokens = read_blobs(group, np.uint32)
    known, number = np.unique(nodes, return_inverse=True)
    pairs = np.unique(tokens.astype(np.uint64) << np.uint64(32) | np.repeat(number, counts).astype(np.uint64))
    token = pairs >> np.uint64(32)
    same = np.zeros(len(pairs), bool)
    same[1:] = token[1:] == token[:-1]
    same[:-1] |= same[1:]
    shared = np.bincount((pairs[same] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(known))
    return pd.DataFrame({"node": known[shared > 0], "shared": shared[shared > 0]})


def _bitmaps(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set 512 bits: whether an odd number of its tokens falls on each."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = row * 512 + (tokens & np.uint64(511)).astype(np.int64)
    odd = (np.bincount(at, minlength=512 * (len(bounds) - 1)) & 1).astype(np.uint8)
    return np.packbits(odd).reshape(-1, 64).view(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node``, ``n`` and ``tokens`` (sorted 64-bit hashes) of the wanted sets, from one document each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                tokens, bounds = token_sets(block, width)
                nodes, _ = set_keys(tokens, bounds)
                raw = tokens.tobytes()
                parts = [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                asked = batch.column(0).slice(block.first, block.rows)
                bits = _bitmaps(tokens, bounds)
                yield pa.RecordBatch.from_arrays(
                    [asked, pa.array(nodes), pa.array(np.diff(bounds)), pa.array(parts, pa.binary()), *[pa.array(b) for b in bits.T]],
                    ["asked", "node", "n", "tokens", *BITS],
                )

    few = docs.join(broadcast_if_small(wanted, SMALL), "doc_id")
    built = few.select("asked", "text").mapInArrow(build, "asked long, node long, n long, tokens binary, " + ", ".join(f"{b} long" for b in BITS))
    return built.where(F.col("asked") == F.col("node")).drop("asked")


def _set_blobs(sets: DataFrame, buckets: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column(1).to_numpy()
                tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
                yield blob_rows(batch.column(0).to_numpy(), tokens, np.concatenate(([0], np.cumsum(n))), buckets, True)

    return sets.select("node", "n", "tokens").mapInArrow(send, _BLOBS)


def _frequencies(group: pd.DataFrame) -> pd.DataFrame:
    """In how many sets the tokens of each set occur, in the order of its tokens in this bucket."""
    nodes, counts, tokens = read_blobs(group, np.uint32)
    _, number, times = np.unique(tokens, return_inverse=True, return_counts=True)
    raw = np.minimum(times, 65_535).astype(np.uint16)[number].tobytes()
    ends = np.cumsum(counts)
    parts = [raw[2 * (b - c) : 2 * b] for b, c in zip(ends.tolist(), counts.tolist(), strict=True)]
    return pd.DataFrame({"node": nodes, "bucket": group["bucket"].iloc[0], "times": parts})


def _rare_first_blobs(sets: DataFrame, buckets: int, percent: int) -> DataFrame:
    """The prefixes of all sets under the order by frequency, without tokens of one set only."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, out = [], []
            for node, raw, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tokens = np.frombuffer(raw, np.uint64)
                bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                times = np.empty(len(tokens), np.uint16)
                times[np.argsort(bucket, kind="stable")] = np.frombuffer(b"".join(p["times"] for p in parts), np.uint16)
                prefix = np.lexsort((tokens, times))[: int(may_miss(np.int64(len(tokens)), percent)) + 1]
                prefix = prefix[times[prefix] > 1]
                if len(prefix):
                    nodes.append(node)
                    out.append(tokens[prefix])
            if nodes:
                sizes = np.cumsum([0, *map(len, out)])
                yield blob_rows(np.array(nodes, np.int64), np.concatenate(out), sizes, buckets, False)

    return sets.select("node", "tokens", "parts").mapInArrow(send, _BLOBS)


def _groups(group: pd.DataFrame) -> pd.DataFrame:
    """Sets that share a prefix token; tokens with the same sets make one group."""
    nodes, counts, tokens = read_blobs(group, np.uint64)
    owner = np.repeat(nodes, counts)
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, int)
    size = np.diff(np.append(first, len(tokens)))
    if not len(first):
        return pd.DataFrame({"gid": np.zeros(0, np.int64), "node": np.zeros(0, np.int64)})
    name = mix(np.add.reduceat(mix(owner.view(np.uint64) ^ _FACTORS[3]), first) + size.astype(np.uint64))
    _, once = np.unique(name, return_index=True)
    once = once[size[once] > 1]
    return pd.DataFrame({"gid": np.repeat(name[once], size[once]).view(np.int64), "node": owner[ragged(first[once], size[once])]})


def _parts(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """``parts`` of each ``gid`` whose sets (``node``) don't fit in one part."""
    parts = groups.join(sizes, "node").groupBy("gid").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum("n") / TILE_TOKENS)).cast("int").alias("parts")
    )
    return broadcast_if_small(write_once(parts.where("parts > 1")), SMALL)


def _part_of(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.coalesce("parts", F.lit(1))).cast("int")


def _tiles(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of each group, dealt by a hash to parts of bounded size; a tile holds two parts, or one twice.

    A row is a set (``node``, its size, bitmap and least groups) in a tile (``gid``, ``i``, ``j``); ``part`` is its own.
    """
    outline = write_once(sets.select("node", "n", *BITS))
    signs = groups.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("gid")), 1, SIGNS).alias("signs"))
    signs = write_once(outline.join(signs, "node").select(
        "node", "n", *BITS, *[F.coalesce(F.get("signs", F.lit(k)), F.lit(_NONE)).alias(f"sign{k}") for k in range(SIGNS)]
    ))
    dealt = groups.join(_parts(groups, outline.select("node", "n")), "gid", "left").withColumn("part", _part_of("node"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return dealt.select(
        "gid", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node"
    ).join(signs, "node")


def _pairs(percent: int):
    """Pairs of the sets of a tile that may be similar.

    Their sizes must fit, and each bit in which they differ is a token that one of them lacks,
    of which similar sets have (1 - s) / (1 + s) of their sizes' sum at most.  A pair of which
    both have a lesser group among their signs is left to that one.
    """

    def pair(tiles: pd.DataFrame) -> pd.DataFrame:
        tiles = tiles.sort_values(["gid", "i", "j", "part"])
        gid, i, j, part, node, n = (tiles[c].to_numpy() for c in ("gid", "i", "j", "part", "node", "n"))
        bits = np.stack([tiles[c].to_numpy() for c in BITS], 1).view(np.uint64)
        signs = np.stack([tiles[f"sign{k}"].to_numpy() for k in range(SIGNS)], 1)
        at = np.arange(len(gid))
        new = np.ones(len(gid), bool)
        new[1:] = (gid[1:] != gid[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        first, tile = np.flatnonzero(new), np.cumsum(new) - 1
        end = np.append(first[1:], len(gid))[tile]
        right = (first + np.add.reduceat((part == i).astype(np.int64), first))[tile]
        begin = np.where(i == j, at + 1, np.where(part == i, right, end))
        many = end - begin
        cuts = np.searchsorted(np.cumsum(many) // CHUNK, np.arange(1, int(many.sum()) // CHUNK + 1))
        out = [(np.zeros(0, np.int64),) * 2]
        for rows in np.split(at, cuts):
            x, y = np.repeat(rows, many[rows]), ragged(begin[rows], many[rows])
            fit = (n[x] * 100 >= n[y] * percent) & (n[y] * 100 >= n[x] * percent)
            x, y = x[fit], y[fit]
            seen = np.zeros(len(x), bool)
            for k in range(SIGNS):
                sign = signs[x, k]
                less = sign < gid[x]
                for m in range(SIGNS):
                    seen |= less & (sign == signs[y, m])
            x, y = x[~seen], y[~seen]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            fit = apart * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
            out.append((x[fit], y[fit]))
        x, y = (np.concatenate(v) for v in zip(*out, strict=True))
        return pd.DataFrame({
            "gid": gid[x], "i": i[x], "j": j[x], "a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])
        })

    return pair


def common_tokens(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens the sets ``a[k]`` and ``b[k]`` have in common.

    Of few pairs, those that share no token of the prefixes under two more orders, by rising and
    by falling hash, get 0: they can't be similar.  Of many, all are counted by products of matrices.
    """
    if len(a) < 4 * len(sets):
        common = np.zeros(len(a), np.int64)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = sets[x], sets[y]
            p, q = (int(may_miss(np.int64(len(v)), percent)) + 1 for v in (x, y))
            if np.isin(x[:p], y[:q]).any() and np.isin(x[-p:], y[-q:]).any():
                common[k] = len(np.intersect1d(x, y, assume_unique=True))
        return common
    owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number, owner = number[times[number] > 1], owner[times[number] > 1]
    _, number = np.unique(number, return_inverse=True)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    total = np.zeros((len(sets), len(sets)))
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        p, q = np.searchsorted(number, [low, low + COLUMNS])
        held = np.zeros((len(sets), int(number[q - 1]) - low + 1), np.float32)
        held[owner[p:q], number[p:q] - low] = 1
        total += held @ held.T
    return total[a, b].astype(np.int64)


def _similar(percent: int):
    """The pairs of tiles that are similar, with the number of common tokens."""

    def compare(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        pairs, sets = pairs.sort_values("tile"), sets.sort_values(["tile", "node"])
        a, b, nodes, n = pairs["a"].to_numpy(), pairs["b"].to_numpy(), sets["node"].to_numpy(), sets["n"].to_numpy()
        names, first = np.unique(pairs["tile"].to_numpy(), return_index=True)
        ends = np.append(first[1:], len(pairs))
        low, high = (np.searchsorted(sets["tile"].to_numpy(), names, side) for side in ("left", "right"))
        common, total = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for p, q, u, v in zip(first.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
            x, y = np.searchsorted(nodes[u:v], a[p:q]), np.searchsorted(nodes[u:v], b[p:q])
            own = [np.frombuffer(raw, np.uint64) for raw in sets["tokens"].iloc[u:v]]
            common[p:q] = common_tokens(own, x, y, percent)
            total[p:q] = n[u:v][x] + n[u:v][y]
        fit = (common > 0) & (100 * common >= percent * (total - common))
        return pd.DataFrame({"a": a[fit], "b": b[fit], "common": common[fit]})

    return compare


def _links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of similar sets: ``a`` < ``b`` and ``common``, the number of tokens of both.

    Every two sets that share a group are paired, in tiles of bounded size, so a hot group is
    spread over many tasks.  The pairs are then compared by component, in tiles too, so the tokens
    of a set travel once unless its component is large.
    """
    tiles, rows = write_counted(_tiles(groups, sets))
    bucket = F.pmod(F.xxhash64("gid", "i", "j"), F.lit(max(8, -(-rows // TILE_ROWS)))).alias("bucket")
    pairs = tiles.groupBy(bucket).applyInPandas(_pairs(percent), "gid long, i int, j int, a long, b long")
    pairs, many = write_counted(pairs.select("a", "b").distinct())
    near = write_once(connected(pairs).select(F.col("label").alias("gid"), "node"))
    sizes = sets.select("node", "n")
    placed = pairs.join(near.withColumnRenamed("node", "a"), "a").join(_parts(near, sizes), "gid", "left")
    i, j = _part_of("a"), _part_of("b")
    pairs = write_once(placed.select(F.xxhash64("gid", F.least(i, j), F.greatest(i, j)).alias("tile"), "a", "b"))
    asked = pairs.select("tile", F.explode(F.array("a", "b")).alias("node")).distinct()
    asked, tokens = write_counted(asked.join(sizes, "node"), F.sum("n"))
    bucket = F.pmod(F.xxhash64("tile"), F.lit(max(8, -(-tokens // BUCKET_TOKENS), -(-many // TASK_PAIRS)))).alias("bucket")
    held = asked.select("tile", "node").join(sets.select("node", "n", "tokens"), "node")
    similar = pairs.groupBy(bucket).cogroup(held.groupBy(bucket)).applyInPandas(_similar(percent), "a long, b long, common long")
    return write_once(similar)


# Components without a row for each pair ---------------------------------------------


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number in the component of each of n numbers, under the links ``a``, ``b``."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(label, before):
            return label


def _fitting(x: np.ndarray, y: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sizes fit and whose bitmaps differ in no more bits than similar sets may; see :func:`_pairs`."""
    fit = (n[x] * 100 >= n[y] * percent) & (n[y] * 100 >= n[x] * percent)
    at = np.flatnonzero(fit)
    apart = np.bitwise_count(bits[x[at]] ^ bits[y[at]]).sum(1, dtype=np.int64)
    fit[at] = apart * (100 + percent) <= (n[x[at]] + n[y[at]]) * (100 - percent)
    return fit


_STARS = "node long, root long, links long"


def _stars(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Sets with links: the first of their component, and how many links each has; a row for a set, none for a link."""
    root, links = _roots(len(nodes), a, b), np.bincount(np.concatenate((a, b)), minlength=len(nodes))
    held = np.flatnonzero(links)
    return pd.DataFrame({"node": nodes[held], "root": nodes[root[held]], "links": links[held]})


def _candidate_stars(percent: int):
    """:func:`_pairs`, but of each tile only which sets hang together."""
    pair = _pairs(percent)

    def star(tiles: pd.DataFrame) -> pd.DataFrame:
        found = pair(tiles)
        nodes, number = np.unique(np.concatenate((found["a"].to_numpy(), found["b"].to_numpy())), return_inverse=True)
        return _stars(nodes, number[: len(found)], number[len(found) :])

    return star


def _linked(percent: int):
    """The similar sets of tiles, compared exactly; of each tile only which sets hang together.

    In a tile all sets of ``side`` 0 are compared, or, where there are any, those of ``side`` 1 with those of side 0; sets
    of equal ``label`` hang together already.
    """

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tile", "side", "node"])
        tile, side, node, n, label = (rows[c].to_numpy() for c in ("tile", "side", "node", "n", "label"))
        bits = np.stack([rows[c].to_numpy() for c in BITS], 1).view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        out = []
        for u, v in zip(first.tolist(), [*first[1:].tolist(), len(tile)], strict=True):
            size = v - u
            split = int((side[u:v] == 0).sum())
            # the pairs of a row: with all after it, or from side 0 with all of side 1
            at = np.arange(size)
            begin = at + 1 if split == size else np.where(at < split, split, size)
            many = size - begin
            x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            cuts = np.searchsorted(np.cumsum(many) // CHUNK, np.arange(1, int(many.sum()) // CHUNK + 1))
            for part in np.split(np.arange(size), cuts):
                i, j = np.repeat(part, many[part]), ragged(begin[part], many[part])
                i, j = (z[label[u:v][i] != label[u:v][j]] for z in (i, j))
                fit = _fitting(i, j, n[u:v], bits[u:v], percent)
                x.append(i[fit])
                y.append(j[fit])
            x, y = np.concatenate(x), np.concatenate(y)
            if not len(x):
                continue
            own = [np.frombuffer(raw, np.uint64) for raw in rows["tokens"].iloc[u:v]]
            common = common_tokens(own, x, y, percent)
            fit = (common > 0) & (100 * common >= percent * (n[u:v][x] + n[u:v][y] - common))
            out.append(_stars(node[u:v], x[fit], y[fit]))
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "root", "links")})
        return pd.concat([empty, *out], ignore_index=True)

    return link


def _compared(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stars of tiles, given as rows ``tile, side, node, label``; written once."""
    asked, tokens = write_counted(asked.join(sets.select("node", "n"), "node"), F.sum("n"))
    bucket = F.pmod(F.xxhash64("tile"), F.lit(max(8, -(-tokens // BUCKET_TOKENS)))).alias("bucket")
    held = asked.drop("n").join(sets, "node")
    return write_once(held.groupBy(bucket).applyInPandas(_linked(percent), _STARS))


def _merged(labels: DataFrame, stars: DataFrame) -> DataFrame:
    """``node, cluster, label`` after what a round found: labels that hang together become the least of them."""
    own = labels.select("node", "label")
    ends = stars.where("node <> root").join(own.toDF("node", "a"), "node").join(own.toDF("root", "b"), "root")
    merged = connected(ends.where("a <> b").select("a", "b"))
    return write_once(
        labels.join(merged.toDF("label", "least"), "label", "left").select(
            "node", "cluster", F.coalesce("least", "label").alias("label")
        )
    )


def _components(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``label``, the least node reachable by similar sets, of the sets that have any.

    The sets that share a group are first only clustered, by what their bitmaps allow; then

    1. a cluster is dealt to parts of bounded size, and the sets of each part are compared: most clusters are one part;
    2. of the others the set with most links stands for each label, and these are compared in parts, until
       nothing more hangs together: near copies then have one label;
    3. sets of other labels than the most common one of their cluster are compared with all of it.

    So every two sets of a cluster are compared or hang together already, and rows grow with the sets.
    """
    tiles, rows = write_counted(_tiles(groups, sets))
    bucket = F.pmod(F.xxhash64("gid", "i", "j"), F.lit(max(8, -(-rows // TILE_ROWS)))).alias("bucket")
    candidates = tiles.groupBy(bucket).applyInPandas(_candidate_stars(percent), _STARS)
    near = connected(write_once(candidates.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()))
    labels = write_once(near.select("node", F.col("label").alias("cluster"), F.col("node").alias("label")))
    sizes = sets.select("node", "n")
    parts = _parts(labels.select(F.col("cluster").alias("gid"), "node"), sizes).withColumnRenamed("gid", "cluster")
    dealt = labels.join(parts, "cluster", "left").withColumn("part", _part_of("node"))
    tile = F.xxhash64("cluster", "part").alias("tile")
    stars = _compared(dealt.select(tile, F.lit(0).alias("side"), "node", "label"), sets, percent)
    labels = _merged(labels, stars)
    large = labels.join(parts.select("cluster"), "cluster", "left_semi")
    links = stars.groupBy("node").agg(F.sum("links").alias("links"))
    before = None
    while True:
        of_label = large.join(links, "node", "left").groupBy("cluster", "label").agg(
            F.max_by("node", F.struct(F.coalesce("links", F.lit(0)), "node")).alias("node"), F.count(F.lit(1)).alias("sets")
        )
        of_label, many = write_counted(of_label)
        open_clusters = of_label.groupBy("cluster").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("sets", "label")).alias("major")).where("labels > 1")
        open_clusters, n_open = write_counted(open_clusters)
        if not n_open or many == before:
            break
        before = many
        asked = of_label.join(open_clusters, "cluster").withColumn("parts", F.ceil(F.col("labels") / TILE_SETS).cast("int"))
        stars = _compared(asked.select(F.xxhash64("cluster", _part_of("node")).alias("tile"), F.lit(0).alias("side"), "node", "label"), sets, percent)
        labels = _merged(labels, stars)
        large = labels.join(parts.select("cluster"), "cluster", "left_semi")
    if n_open:
        labels = _merged(labels, _compared(_rest(large.join(open_clusters.drop("labels"), "cluster"), sizes), sets, percent))
    return labels.select("node", "label")


def _rest(open_sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tiles of the sets with another label than the most common one, each with a part of its cluster."""
    minor = F.col("label") != F.col("major")
    counted = open_sets.join(sizes, "node").groupBy("cluster", minor.alias("minor")).agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum("n") / TILE_TOKENS)).cast("int").alias("parts")
    )
    counted = counted.groupBy("cluster").agg(
        F.max(F.when(F.col("minor"), F.col("parts"))).alias("minors"), F.max(F.when(~F.col("minor"), F.col("parts"))).alias("majors")
    )
    rows = open_sets.join(write_once(counted), "cluster").withColumns({
        "minor": minor, "part": F.pmod(F.xxhash64("node"), F.when(minor, F.col("minors")).otherwise(F.col("majors"))).cast("int")
    })
    # a tile is a part of the minor sets (side 1) with a part of the others (side 0), or two parts of the minor ones
    side_1 = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda j: F.struct(F.lit("x").alias("kind"), F.col("part").alias("i"), j.alias("j"), F.lit(1).alias("side")))
    with_later = F.transform(
        F.sequence(F.lit(0), F.col("minors") - 1),
        lambda j: F.struct(
            F.lit("m").alias("kind"), F.least("part", j).alias("i"), F.greatest("part", j).alias("j"),
            F.when(j < F.col("part"), 1).otherwise(0).alias("side"),
        ),
    )
    side_0 = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: F.struct(F.lit("x").alias("kind"), i.alias("i"), F.col("part").alias("j"), F.lit(0).alias("side")))
    places = F.when(F.col("minor"), F.concat(side_1, with_later)).otherwise(side_0)
    placed = rows.select("cluster", "node", "label", F.inline(places))
    return placed.select(F.xxhash64("cluster", "kind", "i", "j").alias("tile"), "side", "node", "label")


# Candidates ------------------------------------------------------------------------


def _grouped(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The summaries of all rows, the distinct sets (``least`` id and number of ``rows``), those that may have partners, and their groups."""
    low = int(SAMPLED * 2**64)
    every = write_once(_documents(rows, width, low))
    sets = every.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("node", "check", "n", "sampled").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")
    )
    sets, total = write_counted(sets, F.sum("sampled"))
    with_id = rows.where(F.col("doc_id").isNotNull())
    buckets = max(8, -(-total // BUCKET_TOKENS))
    shared = _sampled_blobs(with_id, width, low, buckets).groupBy("bucket").applyInPandas(_shared_counts, "node long, shared long")
    shared = shared.groupBy("node").agg(F.sum("shared").alias("shared"))
    missing = F.col("n") - F.ceil(F.col("n") * percent / 100)
    alive = sets.join(shared, "node", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("sampled") - missing)
    wanted = write_once(alive.select(F.col("least").alias("doc_id"), F.col("node").alias("asked")))
    kept, tokens = write_counted(_sets(with_id, wanted, width).dropDuplicates(["node"]), F.sum("n"))
    buckets = max(8, -(-tokens // BUCKET_TOKENS))
    times = _set_blobs(kept, buckets).groupBy("bucket").applyInPandas(_frequencies, "node long, bucket int, times binary")
    parts = times.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("bucket", "times"))).alias("parts"))
    prefixes = _rare_first_blobs(kept.join(parts, "node"), buckets, percent)
    groups = write_once(prefixes.groupBy("bucket").applyInPandas(_groups, "gid long, node long").distinct())
    return every, sets, kept, groups


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def similar_documents(
    docs: DataFrame, width: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``n_links`` of each row.

    Words are what stands between white space, with A-Z in lower case.  The set of a text are
    its distinct shingles of ``width`` words, or its whole sequence if it has fewer.  Texts
    are linked when the common shingles are ``percent`` hundredths of all of both; the
    component is the smallest id reachable by links, ``n_links`` the number of other rows linked to the row itself.

    Equal sets are one node.  Nodes are filtered under several global orders of the tokens:

    1. by hash, over all sets: of the tokens with the smallest hashes, a set that has a
       partner shares all but the few that the partner may lack, so others go at once;
    2. by frequency among the rest, rarest first: candidates share a token of their prefixes;
    3. and 4. by rising and by falling hash: candidates share a token of these prefixes too.

    Sizes and bitmaps rule out more.  What passes all is compared exactly: every pair, also of sets that
    other links connect already.  Tokens travel in bulk, dealt to buckets whose
    number follows the corpus.

    Null, empty and blank texts have no set and no links; a row without id has no links and
    no component; repeated rows are linked as equal texts are; an empty table gives no rows;
    other columns are not read.  Words and shingles are compared by 64-bit hashes.
    """
    every, sets, kept, groups = _grouped(_rows(docs, key, text), width, percent)
    links = _links(groups, kept, percent)
    labels = write_once(connected(links))
    members = labels.join(sets.select("node", "least"), "node")
    least = members.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = labels.join(least, "label").select("node", "component_id")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(sets.select(F.col("node").alias("b"), "rows"), "b").groupBy(F.col("a").alias("node")).agg(
        F.sum("rows").alias("near")
    )
    of_set = write_once(sets.join(linked, "node", "left").join(near, "node", "left").select(
        "node", "check", F.coalesce("component_id", "least").alias("component_id"),
        (F.coalesce("near", F.lit(0)) + F.col("rows") - 1).alias("n_links"),
    ))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return every.join(of_set, ["node", "check"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("n_links")).otherwise(0).alias("n_links"),
    )


def similar_components(
    docs: DataFrame, width: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row: :func:`similar_documents` without the numbers of links.

    Who has how many links isn't asked, so sets that hang together already are not compared again, and no
    row is made for a pair; a group of near copies costs in proportion to its size.  Edge cases are those of :func:`similar_documents`.
    """
    every, sets, kept, groups = _grouped(_rows(docs, key, text), width, percent)
    members = _components(groups, kept, percent)
    least = members.join(sets.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("component_id"))
    linked = members.join(write_once(least), "label").select("node", "component_id")
    of_set = write_once(sets.join(linked, "node", "left").select(
        "node", "check", F.coalesce("component_id", "least").alias("component_id")
    ))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return every.join(of_set, ["node", "check"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id")
    )


def similar_sets(
    docs: DataFrame, width: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The links of :func:`similar_documents` between different sets of shingles, each once.

    ``doc_id`` and ``other_id`` are the smallest ids with these sets, ``n_rows`` and ``other_rows`` the
    numbers of rows that have them, ``n_common`` and ``n_all`` the numbers of shingles of both and of either.
    """
    _, sets, kept, groups = _grouped(_rows(docs, key, text), width, percent)
    links = _links(groups, kept, percent)
    named = sets.select("node", "least", "n", "rows")
    both = links.join(named.toDF("a", "least_a", "n_a", "rows_a"), "a").join(named.toDF("b", "least_b", "n_b", "rows_b"), "b")
    first = F.col("least_a") <= F.col("least_b")
    return both.select(
        F.least("least_a", "least_b").alias("doc_id"), F.greatest("least_a", "least_b").alias("other_id"),
        F.when(first, F.col("rows_a")).otherwise(F.col("rows_b")).alias("n_rows"),
        F.when(first, F.col("rows_b")).otherwise(F.col("rows_a")).alias("other_rows"),
        F.col("common").alias("n_common"), (F.col("n_a") + F.col("n_b") - F.col("common")).alias("n_all"),
    )


#: The same rows in DuckDB: all pairs that share a shingle, and their closure.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r(node, seen) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT l.a, r.seen FROM r JOIN l ON l.b = r.node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) USING (doc_id) LEFT JOIN n USING (doc_id)
"""
