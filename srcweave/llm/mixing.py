"""Mix sources to target weights by pivotal dependent rounding of copy numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcweave.llm.text_arrays import IS_SPACE, blocks, mix, per_row, runs
from srcweave.session import write_once

#: Documents of one size class of a source that are paired in one task, about.
ROWS_PER_GROUP = 4_096
#: Nodes whose residuals one node of the reduction tree combines.
FAN_IN = 64
#: Documents of a size class that each node leaves open for the root, beside its residual.
SPARE = 32
#: A probability this near to 0 or 1 is taken as integral.
EPSILON = 1e-9
_OPEN = "doc_id long, source string, size long, target double, source_size long, class int, copies long, p double, bucket long"


def word_counts(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``doc_id``, ``source`` and ``size``, the number of words between white space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.zeros(0, np.int64)]
            for block in blocks(batch.column(2)):
                starts, _ = runs(~IS_SPACE[block.data], block.offsets)
                sizes.append(np.diff(per_row(starts, block.offsets)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(sizes), pa.int64())],
                ["doc_id", "source", "size"],
            )

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.col(text).cast("string").alias("text"),
    )
    return rows.mapInArrow(count, "doc_id long, source string, size long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Words that each source should give.

    Sources by code point, null last, have the weights in turn.  Together they share
    ``share`` of all words; none is asked for more than ``most`` times what it has, and what
    that leaves over goes to the others by weight.  With the sources in the order in which
    they meet their bound, the common level is the largest of (what is left) / (weight left).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = totals.withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1),
    )
    rising = Window.orderBy(F.lit(most) * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (
        F.lit(share) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    leveled = weighted.withColumn("level", level).withColumn("top", F.max("level").over(everything))
    return leveled.select(
        "source", "source_size",
        F.least(F.lit(most) * F.col("source_size"), F.col("weight") * F.col("top")).alias("target"),
    )


def _unit(seed: int, ids: np.ndarray, salt: int) -> np.ndarray:
    start = (seed * 0x9E3779B97F4A7C15 + salt * 0xBF58476D1CE4E5B9) % 2**64
    with np.errstate(over="ignore"):
        h = mix(mix(ids.astype(np.int64).view(np.uint64)) + np.uint64(start))
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(p: np.ndarray, size: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """Pivotal rounding of probabilities with sizes; at most one stays fractional.

    Two fractional entries exchange mass so that ``sum(p * size)`` and each expected value
    stay, until one of the two is 0 or 1.
    """
    p = p.copy()
    open_ = -1
    for j in np.flatnonzero((p > EPSILON) & (p < 1 - EPSILON)).tolist():
        if open_ < 0:
            open_ = j
            continue
        i, ratio = open_, size[j] / size[open_]
        up, down = min(1 - p[i], ratio * p[j]), min(p[i], ratio * (1 - p[j]))
        if coins[j] * (up + down) < down:
            p[i], p[j] = p[i] + up, p[j] - up / ratio
        else:
            p[i], p[j] = p[i] - down, p[j] + down / ratio
        for k in (i, j):
            p[k] = 0.0 if p[k] <= EPSILON else 1.0 if p[k] >= 1 - EPSILON else p[k]
        open_ = next((k for k in (i, j) if 0.0 < p[k] < 1.0), -1)
    return p


def _ordered(group: pd.DataFrame, seed: int, salt: int) -> pd.DataFrame:
    ids = group["doc_id"].fillna(-1).to_numpy().astype(np.int64)
    return group.iloc[np.lexsort((group["size"], ids, _unit(seed, ids, salt)))]


def _round_group(seed: int, level: int):
    """One node of the tree: all but ``SPARE`` documents of a size class are paired."""

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = _ordered(group, seed, 2 * level)
        ids = group["doc_id"].fillna(-1).to_numpy().astype(np.int64)
        p = group["p"].to_numpy(copy=True)
        p[SPARE:] = pivot(p[SPARE:], group["size"].to_numpy(np.float64)[SPARE:], _unit(seed, ids, 2 * level + 1)[SPARE:])
        whole = (p == 0) | (p == 1)
        return group.assign(
            copies=group["copies"] + np.where(whole, p, 0).astype(np.int64),
            p=np.where(whole, 0.0, p), bucket=group["bucket"] // FAN_IN,
        )

    return rounded


def settle(wanted: np.ndarray, size: np.ndarray, coins: np.ndarray, most: int) -> np.ndarray:
    """Whole copies, 0 to ``most``, of documents from long to short, so that the words come near what is wanted.

    The words that one document takes too many or too few are spread over the shorter
    ones by size; a number that these could not make good any more is not drawn.
    """
    left, after = float((wanted * size).sum()), np.append(np.cumsum(size[::-1])[::-1], 0.0)
    planned = np.append(np.cumsum((wanted * size)[::-1])[::-1], 0.0)
    copies = np.zeros(len(size), np.int64)
    for i in range(len(size)):
        x = min(max(wanted[i] + (left - planned[i]) / after[i], 0.0), float(most))
        n = int(x) + int(coins[i] < x - int(x))
        low = int(np.ceil((left - most * after[i + 1]) / size[i] - EPSILON))
        high = int(np.floor(left / size[i] + EPSILON))
        n = min(max(n, low), high) if low <= high else int(np.rint(left / size[i]))
        copies[i] = min(max(n, 0), most)
        left -= copies[i] * size[i]
    return copies


def _settle_source(seed: int, most: int):
    """The root of a source's tree: a few documents of each of its size classes."""

    def settled(group: pd.DataFrame) -> pd.DataFrame:
        group = _ordered(group, seed, -2).sort_values("size", ascending=False, kind="stable")
        ids = group["doc_id"].fillna(-1).to_numpy().astype(np.int64)
        wanted = group["copies"].to_numpy(np.float64) + group["p"].to_numpy()
        return group.assign(
            copies=settle(wanted, group["size"].to_numpy(np.float64), _unit(seed, ids, -1), most), p=0.0,
        )

    return settled


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0,
    seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies`` and ``taken`` of each row.

    A document of a source with target t and size s is wanted t / s times.  The whole part is
    given to all; the fractional parts are rounded by pairing documents of one source and
    size class (powers of two): groups of a bounded number of documents leave one fractional document
    each and ``SPARE`` untouched ones, a tree of such groups leaves as many of the class.  The root
    rounds these few from long to short at random and carries the words over or short
    to the shorter ones, so a source differs from its target by less than one short document where
    it has enough of them.  No document is taken more than ``most`` times.  Coins depend on
    seed and key only: reruns agree.

    A null text has size 0, and documents without words are never taken; the null source is
    a source; repeated rows are rows of their own, and those with a null id are dealt to groups by their
    place in the table; an empty table gives no rows; other columns are not read.
    """
    sizes = write_once(word_counts(docs, key, text, source).withColumn("class", F.length(F.bin("size"))))
    totals = write_once(sizes.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    targets = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    classes = totals.join(
        targets.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))
    )
    classes = write_once(classes.select(
        "of", F.col("class").alias("in_class"), "source_size", "target", F.ceil(F.col("n") / ROWS_PER_GROUP).alias("groups")
    ))
    groups = classes.agg(F.max("groups")).first()[0] or 1
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id"))
    rows = sizes.withColumn("row", F.monotonically_increasing_id()).join(
        classes, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("in_class"))
    ).withColumn("r", wanted).select(
        "doc_id", "source", "size", "target", "source_size", "class",
        F.when(F.col("size") > 0, F.floor(F.col("r") + F.lit(EPSILON))).otherwise(0).alias("copies"),
        F.when(F.col("size") > 0, F.greatest(F.col("r") - F.floor(F.col("r") + F.lit(EPSILON)), F.lit(0.0))).otherwise(0.0).alias("p"),
        F.pmod(place, "groups").alias("bucket"),
    )
    fractional = (F.col("p") > EPSILON) & (F.col("p") < 1 - EPSILON)
    done, level = [rows.where(~fractional)], 0
    pending = rows.where(fractional)
    while True:
        out = write_once(pending.groupBy("source", "class", "bucket").applyInPandas(_round_group(seed, level), _OPEN))
        done.append(out.where(~fractional))
        pending = out.where(fractional)
        if groups == 1:
            break
        groups, level = -(-groups // FAN_IN), level + 1
    done.append(write_once(pending.groupBy("source").applyInPandas(_settle_source(seed, int(most + EPSILON)), _OPEN)))
    mixed = done[0]
    for part in done[1:]:
        mixed = mixed.unionByName(part)
    return mixed.select(
        "doc_id", "size", "source", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
