"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcweave.session import write_once

#: Rows of one shard that are numbered in one task, about.
ROWS_PER_BUCKET = 50_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key.

    Adding a shard moves only the keys that the new shard takes.
    """
    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    here = np.zeros(len(key), np.int64)
    active = np.arange(len(key))
    ahead = np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(active):
            here[active] = ahead
            key[active] = key[active] * np.uint64(2862933555777941757) + np.uint64(1)
            step = 2.0**31 / ((key[active] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead = np.floor((here[active] + 1) * step).astype(np.int64)
            active, ahead = active[ahead < shards], ahead[ahead < shards]
    return here


def assign_shards(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Key, size, checksum, shard, slot and the shard after one more is appended, by row.

    ``size`` is the UTF-8 bytes of the text plus 16 (null: no bytes), ``text_crc32`` the
    checksum of those bytes, ``slot`` numbers the rows of a shard from 0 without gaps in the
    order of key, checksum and size.  A null key is placed like key -1 and numbered first.
    Repeated rows share a shard and get a slot each; an empty table gives no rows; other
    columns, whatever their names, are not read.

    Rows of a shard are numbered in buckets, ranges of (key, checksum, size) whose number grows with
    the table, so a key of many rows is split too; the offsets of the buckets come from their counts.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    content = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(content) + 16).cast("long").alias("size"),
        F.crc32(content).cast("long").alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    buckets = -(-docs.count() // (ROWS_PER_BUCKET * shards))
    if buckets > 1:
        rows = write_once(rows.repartitionByRange(buckets, *order).withColumn("bucket", F.spark_partition_id()))
    else:
        rows = rows.withColumn("bucket", F.lit(0))

    def by_jump(n: int):
        @F.pandas_udf("int")
        def shard_of(k: pd.Series) -> pd.Series:
            return pd.Series(jump_hash(k.to_numpy(), n))

        return shard_of(F.coalesce("doc_id", F.lit(-1)))

    placed = rows.withColumns({"shard": by_jump(shards), "grown_shard": by_jump(shards + 1)})
    in_bucket = Window.partitionBy("shard", "bucket").orderBy(*order)
    numbered = placed.withColumn("at", F.row_number().over(in_bucket) - 1)
    if buckets > 1:
        before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1
        )
        offsets = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
            "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
        )
        numbered = numbered.join(offsets, ["shard", "bucket"])
    else:
        numbered = numbered.withColumn("base", F.lit(0))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("base") + F.col("at")).cast("long").alias("slot"), "grown_shard",
    )
