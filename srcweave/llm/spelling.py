"""Spelling variants: words one letter apart, found in a trie of letter-group counts.

Letters are dealt to groups, and a word is the vector of its counts of each group.  One inserted, deleted or
replaced letter changes that vector by a surplus of at most one in one group and a deficit of at most one in
another.  The trie branches on the counts, group by group; a word walks it depth first with that budget, and
the words at the leaves it reaches are compared letter by letter.

The upper levels of the trie are the partitioning: a node with few rows is worked on by one task, a node with
many is opened one level further, and what is still crowded with all counts equal is laid out in tiles.  A pair is
met once: only a surplus may be spent first, so the word whose vector is smaller in order walks to the other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcweave.llm.text_arrays import ragged
from srcweave.session import write_counted, write_once

#: Letters a run consists of, once A-Z is lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-zÀ-ÿ"
#: Groups of letters, which are the levels of the trie.
LEVELS = 15
#: Counts above this are alike; the difference of two counts doesn't grow by it.
TOP = 15
#: The level on which partitioning starts.
FIRST_LEVEL = 4
#: Rows of a node above which it is opened.
NODE_ROWS = 200_000
#: Words of a node below which they are compared at once.
LEAF_WORDS = 12
#: Pairs and walks worked on at once.
CHUNK = 1 << 19


def letter_groups() -> list[str]:
    """The letters of each group: common ones apart, rare ones dealt back over them, others by code point."""
    by_use = "etaoinshrdlucmfwypvbgkqjxz"
    groups = [list(by_use[g]) for g in range(LEVELS)]
    for at, letter in enumerate(by_use[LEVELS:]):
        groups[LEVELS - 1 - at].append(letter)
    for code in range(0xC0, 0x100):
        groups[code % LEVELS].append(chr(code))
    return ["".join(g) for g in groups]


def corpus_words(
    docs: DataFrame, min_length: int = 7, min_count: int = 2, key: str = "doc_id", text: str = "text", noise: int = 31
) -> DataFrame:
    """``word`` and ``n`` of the words of all texts with at least so many letters and occurrences.

    A word is a run of letters with A-Z in lower case.  Where the checksum of ``<id>:<run>`` is divisible by
    ``noise``, the letter it points to is left out, which plants misspellings (0: none).  Null texts have no words; a null
    id reads as empty; repeated rows count each.  Counting is combined before the shuffle, so frequent words don't weigh.
    """
    lower = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1))).alias("run"),
    )
    word = F.col("run")
    if noise:
        code = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (code % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(code % noise == 0, cut).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(
        F.count("*").alias("n")
    )
    return counted.where(F.col("n") >= min_count)


def _vector(word: Column) -> Column:
    """Counts of all groups in one long, four bits each, the first group on top."""
    counts = [
        F.least(F.length(word) - F.length(F.translate(word, g, "")), F.lit(TOP)).cast("long") for g in letter_groups()
    ]
    return reduce(lambda high, low: high * (TOP + 1) + low, counts)


def _count(vector: Column, level: int) -> Column:
    return F.shiftright(vector, 4 * (LEVELS - 1 - level)).bitwiseAND(TOP)


def _step(rows: DataFrame, level: int) -> DataFrame:
    """Walk all rows down one level: ``spent`` is 0, 1 after the surplus, 2 after surplus and deficit."""
    count, spent = _count(F.col("vector"), level), F.col("spent")

    def child(change: int, after) -> Column:
        return F.struct((F.col("node") * (TOP + 1) + count + change).alias("node"), after.cast("int").alias("spent"))

    children = F.array_compact(F.array(
        child(0, spent), F.when((spent == 0) & (count < TOP), child(1, F.lit(1))),
        F.when((spent == 1) & (count > 0), child(-1, F.lit(2))),
    ))
    return rows.select("word", "n", "vector", F.explode(children).alias("c")).select("word", "n", "vector", "c.node", "c.spent")


def _tiled(rows: DataFrame, node_rows: int) -> DataFrame:
    """Rows of nodes in which nothing is left to branch on: a grid of those at home by those that ask."""
    crowded = rows.groupBy("node").agg(F.count("*").alias("rows")).where(F.col("rows") > node_rows).select(
        "node", F.ceil(F.col("rows") / node_rows).cast("int").alias("side")
    )
    own = F.pmod(F.xxhash64("word"), F.col("side")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    joined = rows.join(write_once(crowded), "node", "left").withColumn("side", F.coalesce("side", F.lit(1)))
    plain = joined.where("side = 1").select(*rows.columns, F.lit(0).alias("tile"), (F.col("spent") == 0).alias("home"), F.lit(True).alias("asks"))
    asking = joined.where("side > 1").withColumn("other", every).select(
        *rows.columns, (own * F.col("side") + F.col("other")).alias("tile"), F.lit(False).alias("home"), F.lit(True).alias("asks")
    )
    at_home = joined.where("side > 1 AND spent = 0").withColumn("other", every).select(
        *rows.columns, (F.col("other") * F.col("side") + own).alias("tile"), F.lit(True).alias("home"), F.lit(False).alias("asks")
    )
    return plain.unionByName(asking).unionByName(at_home)


def _placed(words: DataFrame, node_rows: int) -> DataFrame:
    """Every word at its own node and at those its budget reaches, with the depth of the node."""
    rows = words.select("word", "n", _vector(F.col("word")).alias("vector"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("spent"))
    for level in range(FIRST_LEVEL):
        rows = _step(rows, level)
    done = []
    for level in range(FIRST_LEVEL, LEVELS):
        crowded, found = write_counted(
            rows.groupBy("node").agg(F.count("*").alias("rows")).where(F.col("rows") > node_rows).select("node")
        )
        rest = rows if not found else rows.join(crowded, "node", "left_anti")
        done.append(rest.select(
            "word", "n", "vector", "node", "spent", F.lit(0).alias("tile"), (F.col("spent") == 0).alias("home"),
            F.lit(True).alias("asks"), F.lit(level).alias("level"),
        ))
        if not found:
            break
        rows = write_once(_step(rows.join(crowded, "node"), level).select("word", "n", "vector", "node", "spent"))
    else:
        done.append(_tiled(rows, node_rows).withColumn("level", F.lit(LEVELS)))
    return reduce(DataFrame.unionByName, done)


class Words:
    """Words as bytes, one for each letter."""

    def __init__(self, column: pa.Array):
        data = [w.encode("latin-1") for w in column.to_pylist()]
        self.length = np.fromiter(map(len, data), np.int64, len(data))
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(data) + b"\0", np.uint8)
        self.head, self.tail = np.zeros(len(data), np.uint32), np.zeros(len(data), np.uint32)
        # the change stands in one half only, so the ends of one side are equal
        reach = int(min(3, max(1, (self.length.min(initial=7) - 1) // 2)))
        for i in range(reach):
            self.head = self.head << 8 | self.data[self.start + i]
            self.tail = self.tail << 8 | self.data[self.start + self.length - 1 - i]

    def _same(self, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
        """How many of at most ``left`` bytes from the positions on are equal."""
        equal, todo = np.zeros(len(a), np.int64), np.flatnonzero(left > 0)
        while len(todo):
            at = equal[todo]
            todo = todo[self.data[a[todo] + at] == self.data[b[todo] + at]]
            equal[todo] += 1
            todo = todo[equal[todo] < left[todo]]
        return equal

    def one_apart(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether words differ by exactly one letter, and whether the first stands before the second."""
        lu, lv = self.length[u], self.length[v]
        maybe = (np.abs(lu - lv) <= 1) & ((self.head[u] == self.head[v]) | (self.tail[u] == self.tail[v]))
        result, before = np.zeros(len(u), bool), np.zeros(len(u), bool)
        at = np.flatnonzero(maybe)
        u, v, lu, lv = u[at], v[at], lu[at], lv[at]
        su, sv = self.start[u], self.start[v]
        common = self._same(su, sv, np.minimum(lu, lv))
        skip_u, skip_v = (lu >= lv).astype(np.int64), (lv >= lu).astype(np.int64)
        rest = np.maximum(lu - common - skip_u, 0)
        good = (rest == lv - common - skip_v) & ((lu != lv) | (common < lu))
        check = np.flatnonzero(good)
        same = self._same((su + common + skip_u)[check], (sv + common + skip_v)[check], rest[check])
        good[check] = same == rest[check]
        result[at] = good
        ended_u, ended_v = common >= lu, common >= lv
        byte_u = np.where(ended_u, -1, self.data[np.minimum(su + common, len(self.data) - 1)].astype(np.int64))
        byte_v = np.where(ended_v, -1, self.data[np.minimum(sv + common, len(self.data) - 1)].astype(np.int64))
        before[at] = byte_u < byte_v
        return result, before


def _walk(vectors: np.ndarray, asked: np.ndarray, spent: np.ndarray, node: int, level: int):
    """Depth-first walks in the trie of sorted ``vectors`` from one node: chunks of (who asks, from, to)."""
    stack = [(level, i, min(i + CHUNK // 8, len(asked))) for i in range(0, len(asked), CHUNK // 8)]
    stack = [(lv, np.arange(a, b), np.full(b - a, node, np.int64), spent[a:b]) for lv, a, b in stack]
    while stack:
        at, who, place, used = stack.pop()
        shift = 4 * (LEVELS - at)
        lo = np.searchsorted(vectors, place << shift)
        hi = np.searchsorted(vectors, (place + 1) << shift)
        leaf = (hi - lo <= LEAF_WORDS) | (at == LEVELS)
        found = leaf & (hi > lo)
        yield who[found], lo[found], hi[found]
        go = ~leaf
        who, place, used = who[go], place[go], used[go]
        if not len(who):
            continue
        count = asked[who] >> (4 * (LEVELS - 1 - at)) & TOP
        up = np.flatnonzero((used == 0) & (count < TOP))
        down = np.flatnonzero((used == 1) & (count > 0))
        base = place << 4
        who = np.concatenate((who, who[up], who[down]))
        place = np.concatenate((base + count, base[up] + count[up] + 1, base[down] + count[down] - 1))
        used = np.concatenate((used, np.ones(len(up), used.dtype), np.full(len(down), 2, used.dtype)))
        for i in range(0, len(who), CHUNK):
            stack.append((at + 1, who[i : i + CHUNK], place[i : i + CHUNK], used[i : i + CHUNK]))


NEAR = "word string, n_near long, near_n long, near_word string"


def _near_in_node(table: pa.Table) -> pa.Table:
    """For each word of a node that has a near one there: how many, and the most frequent (least of several)."""
    table = table.combine_chunks()
    get = lambda name: table.column(name).to_numpy()
    vector, n, spent = get("vector"), get("n"), get("spent")
    home, asks = np.flatnonzero(get("home")), np.flatnonzero(get("asks"))
    home = home[np.argsort(vector[home], kind="stable")]
    words = Words(table.column("word"))
    ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(home):
        node, level = int(get("node")[0]), int(get("level")[0])
        for who, lo, hi in _walk(vector[home], vector[asks], spent[asks], node, level):
            sizes = hi - lo
            ends = np.cumsum(sizes)
            cut = 0
            while cut < len(who):
                stop = max(cut + 1, int(np.searchsorted(ends, ends[cut] - sizes[cut] + CHUNK, "right")))
                u = asks[np.repeat(who[cut:stop], sizes[cut:stop])]
                v = home[ragged(lo[cut:stop], sizes[cut:stop])]
                ahead = vector[v] >= vector[u]
                u, v = u[ahead], v[ahead]
                near, before = words.one_apart(u, v)
                near &= (vector[v] > vector[u]) | before
                ones.append(u[near])
                others.append(v[near])
                cut = stop
    u, v = np.concatenate(ones), np.concatenate(others)
    me, other = np.concatenate((u, v)), np.concatenate((v, u))
    text = table.column("word").to_numpy()
    place = np.empty(len(text), np.int64)  # of each word in the order of code points
    place[np.argsort(text.astype(object), kind="stable")] = np.arange(len(text))
    order = np.lexsort((place[other], -n[other], me))
    me, other = me[order], other[order]
    first = np.flatnonzero(np.concatenate(([True], me[1:] != me[:-1]))) if len(me) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(me)))
    return pa.table({
        "word": pa.array(text[me[first]], pa.string()), "n_near": pa.array(counts, pa.int64()),
        "near_n": pa.array(n[other[first]], pa.int64()), "near_word": pa.array(text[other[first]], pa.string()),
    })


def variant_groups(words: DataFrame, times: int = 10, node_rows: int = NODE_ROWS) -> DataFrame:
    """Each of the distinct ``word`` (with its number ``n``) with what it may be a variant of.

    ``n_near`` near words (exactly one letter inserted, deleted or replaced); ``form``, the near word of largest
    ``n`` (the least in code-point order of several), if it has at least ``times`` the occurrences, and ``form_n``;
    ``root``, where following the forms ends, the word itself if it has none.  Words consist of letters up to
    U+00FF, with at least three of them.  Of very frequent letters or vectors nothing is left out: see the
    module.  A word of any length is compared whole.  An empty table gives no rows; other columns are not read.
    """
    words = write_once(words.select("word", F.col("n").cast("long").alias("n")))
    nodes = _placed(words, node_rows).groupBy("level", "node", "tile")
    near = nodes.applyInArrow(_near_in_node, NEAR).groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("form"))).alias("best"),
    )
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("top"), F.col("best.form").alias("top_word")
    )
    enough = F.col("top") >= times * F.col("n")
    found = write_once(joined.select(
        "word", "n", "n_near", F.when(enough, F.col("top_word")).alias("form"), F.when(enough, F.col("top")).alias("form_n")
    ))
    roots = _followed(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _followed(steps: DataFrame) -> DataFrame:
    """``root`` of each word by doubling; occurrences grow with each form, so there are no rings."""
    roots = write_once(steps)
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped, moved = write_counted(
            roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            F.sum(F.col("moved").cast("long")),
        )
        roots = stepped.drop("moved")
        if not moved:
            return roots
