"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcweave.session import write_counted, write_once

#: Indexed rows of one bucket that are compared in one task, about.
ROWS_PER_SALT = 4_096
#: Rows kept in one slot, about, and the fewest slots that buckets are dealt to.
ROWS_PER_SLOT, MIN_SLOTS = 16_384, 24
#: Query by candidate products held at once in a task, and pairs whose product is summed anew.
PRODUCTS, PAIRS = 4_000_000, 100_000
#: Tables, and probes in each, for a number of rotations: enough for a recall of 0.9 with random vectors, the
#: hardest, of 64 dimensions.  More dimensions take more probes, by their ratio for each rotation.
TABLES, PROBES = {1: 12, 2: 16}, {1: 10, 2: 400}


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (their length is a power of 2)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(vectors: np.ndarray, table: int, part: int, seed: int) -> np.ndarray:
    """A pseudo-rotation: three rounds of random signs and a Hadamard transform."""
    d = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), d))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.random.default_rng([seed, table, part]).choice((-1.0, 1.0), (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def probe(vectors: np.ndarray, table: int, parts: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes`` best buckets of each vector in one table, the own bucket first.

    A bucket is a signed axis for each of ``parts`` rotations.  Later probes lose least in
    the sum of the squared distances to the axes.
    """
    best, loss = np.zeros((len(vectors), 1), np.int64), np.zeros((len(vectors), 1))
    for part in range(parts):
        x = rotate(vectors, table, part, seed)
        x = np.concatenate((x, -x), 1)
        take = min(probes, x.shape[1])
        axes = np.argsort(-x, axis=1, kind="stable")[:, :take]
        height = np.take_along_axis(x, axes, 1)
        loss = (loss[:, :, None] + (height[:, :1] - height)[:, None, :]).reshape(len(vectors), -1)
        best = (best[:, :, None] * x.shape[1] + axes[:, None, :]).reshape(len(vectors), -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        best, loss = np.take_along_axis(best, order, 1), np.take_along_axis(loss, order, 1)
    return best


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``vec`` (doubles) of the rows that take part."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kind = vectors.schema[embedding].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("vec")
    )
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def hashed(rows: DataFrame, tables: int, parts: int, probes: int, seed: int) -> DataFrame:
    """Each row once for every bucket that it is kept in or looks into."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                matrix = _matrix(batch.column(1))
                for table in range(tables):
                    keys = probe(matrix, table, parts, probes, seed)
                    rows_at = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel() * tables + table), batch.column(0).take(rows_at),
                         batch.column(1).take(rows_at)],
                        ["bucket", "vec_id", "vec"],
                    )

    return rows.mapInArrow(assign, f"bucket long, vec_id long, vec {rows.schema['vec'].dataType.simpleString()}")


def _split(rows: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """The places of the rows of each bucket and salt, by rising id."""
    bucket, salt, ids = (rows[c].to_numpy() for c in ("bucket", "salt", "vec_id"))
    order = np.lexsort((ids, salt, bucket))
    new = np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(salt[order]) != 0)) + 1
    return {(int(bucket[at[0]]), int(salt[at[0]])): at for at in np.split(order, new) if len(at)}


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last.

    A matrix product adds in an order that depends on the shapes it meets; this one gives a pair the same
    value wherever it is met.
    """
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        total += left[:, j] * right[:, j]
    return total


def nearest_of(wanted: np.ndarray, matrix: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """Query places, candidate places and scores of the k nearest; ``ids`` rise.

    Matrix products choose all candidates that may be among the k nearest whatever the rounding; their scores are
    then summed in a fixed order and ranked again, ties by id.
    """
    rough = wanted @ matrix.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    take = min(k, len(ids))
    kth = np.partition(rough, len(ids) - take, axis=1)[:, len(ids) - take]
    # both sums err by at most d * eps * |q| * |c|
    slack = 4 * matrix.shape[1] * np.finfo(np.float64).eps
    slack = slack * np.linalg.norm(wanted, axis=1) * np.linalg.norm(matrix, axis=1).max()
    q, c = np.nonzero((rough >= (kth - slack)[:, None]) & (rough > -np.inf))
    score = np.concatenate([np.zeros(0), *(
        products(wanted[q[at : at + PAIRS]], matrix[c[at : at + PAIRS]]) for at in range(0, len(q), PAIRS)
    )])
    order = np.lexsort((c, -score, q))
    first = np.searchsorted(q[order], q[order])
    order = order[np.arange(len(order)) - first < k]
    return q[order], c[order], score[order]


def _best(k: int):
    """The k nearest in each bucket of a slot for each query that looks there, by exact products."""

    def nearest(queries: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        looks = _split(queries)
        for where, places in _split(kept).items():
            if where not in looks:
                continue
            ids = kept["vec_id"].to_numpy()[places]
            matrix = np.stack(kept["vec"].to_numpy()[places]).astype(np.float64)
            asked = queries["vec_id"].to_numpy()[looks[where]]
            wanted = np.stack(queries["vec"].to_numpy()[looks[where]]).astype(np.float64)
            step = max(1, PRODUCTS // len(ids))
            for at in range(0, len(asked), step):
                own = asked[at : at + step]
                q, c, score = nearest_of(wanted[at : at + step], matrix, own, ids, k)
                out["query_id"].append(own[q])
                out["vec_id"].append(ids[c])
                out["score"].append(score)
        return pd.DataFrame({
            c: np.concatenate(v) if v else np.zeros(0, t)
            for (c, v), t in zip(out.items(), (np.int64, np.int64, np.float64), strict=True)
        })

    return nearest


def _compare(queries: DataFrame, kept: DataFrame, k: int, slots: int) -> DataFrame:
    """Queries against kept rows of the same bucket and salt; a slot holds many small buckets."""
    slot = F.pmod(F.xxhash64("bucket", "salt"), F.lit(slots)).alias("slot")
    return queries.groupBy(slot).cogroup(kept.groupBy(slot)).applyInPandas(
        _best(k), "query_id long, vec_id long, score double"
    )


def _merge(found: DataFrame, k: int) -> DataFrame:
    per_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(per_query))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(
    vectors: DataFrame, k: int = 20, every: int = 20, rotations: int = 1,
    tables: int | None = None, probes: int | None = None, seed: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the k nearest found.

    Queries are the rows whose id is a multiple of ``every``, candidates all rows but the query's
    own; the score is the inner product of the original vectors in double precision, ties go to the smaller
    id, and a pair has the same score wherever it is met.  Each vector is kept in one bucket of each table; a query
    looks into ``probes`` buckets of each.  A bucket is a signed axis for each of ``rotations``; two give many small
    buckets, of which a query must probe more.  Neither follows the number of rows, so recall doesn't either;
    tables and probes that are not given follow the dimension and the rotations.  Hot buckets are split
    by salt, with the queries repeated for each salt.  A query that has found fewer than k is compared with all rows.

    Rows with a null id, or vectors that are null, zero, of another length than most (the
    longer of two lengths as frequent), or hold null or non-finite components take no part.
    Rows that repeat an id count once, by their best score.  Empty tables give no rows.
    """
    rows, count = write_counted(usable(vectors, vec_id, embedding))
    spark, empty = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], empty)
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    dim = lengths.orderBy(F.col("n").desc(), F.col("d").desc()).first()["d"]
    rows = rows.where(F.size("vec") == dim)
    if rotations not in TABLES:
        raise ValueError("one or two rotations")
    parts, tables = rotations, tables or TABLES[rotations]
    probes = probes or -(-PROBES[rotations] * max(dim, 64) ** rotations // 64**rotations)
    asked = rows.where(F.col("vec_id") % every == 0)
    slots = max(MIN_SLOTS, -(-count * tables // ROWS_PER_SLOT))
    index = hashed(rows, tables, parts, 1, seed)
    salts = write_once(
        index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select(
            "bucket", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts")
        )
    )
    index = index.join(salts, "bucket").withColumn("salt", F.pmod(F.xxhash64("vec_id"), "salts")).drop("salts")
    looks = hashed(asked, tables, parts, probes, seed).join(salts, "bucket").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))
    ).drop("salts")
    found = write_once(_merge(_compare(looks, index, k, slots), k))
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short, missing = write_counted(
        asked.join(full, asked["vec_id"] == full["query_id"], "left_anti").select("vec_id", "vec")
    )
    if not missing:
        return found
    salted = -(-count // ROWS_PER_SALT)
    everything = rows.select(F.lit(0).cast("long").alias("bucket"), F.pmod(F.xxhash64("vec_id"), F.lit(salted)).alias("salt"), "vec_id", "vec")
    repeated = short.select(
        F.lit(0).cast("long").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salted - 1).cast("long"))).alias("salt"), "vec_id", "vec"
    )
    exact = _merge(_compare(repeated, everything, k, salted), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(exact)
