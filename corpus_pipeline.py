"""The documents through five operators, in order; each stage works on what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.llm import decontamination, jaccard, mixing, quality, sharding
from srcweave.session import write_once


#: How the key of a row is named while it passes the stages, and the mark by which later stages know it.  Ids may be null
#: or repeated, the key is neither.
ROW, MARK = "pipeline_row", "srcweave.pipeline.row"


def _free(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows and the name of their key: as they come from a stage, or written once with a new one, so that it stays.

    A column of the documents that only has the key's name is one like others.
    """
    marked = [f.name for f in docs.schema.fields if MARK in f.metadata]
    if marked:
        return docs, marked[0]
    row = _free(docs, ROW)
    return write_once(docs.select("*", F.monotonically_increasing_id().alias(row, metadata={MARK: True}))), row


def _only(docs: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows whose key is in the one column of ``kept``, which holds each key once."""
    name = _free(docs, "kept_row")
    return docs.join(kept.toDF(name), F.col(row) == F.col(name)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject."""
    docs, row = _keyed(docs)
    scores = quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), row=row)
    return _only(docs, row, scores.where("predicted = 1").select("row"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by similar shingles the one with the smallest id, of several the first; null ids come last."""
    docs, row = _keyed(docs)
    found = jaccard.similar_components(docs, key=row).select(F.col("doc_id").alias("key"), "component_id")
    ids = docs.select(F.col(row).alias("key"), "doc_id")
    ranked = found.join(ids, "key").select(
        "component_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("rank")
    )
    return _only(docs, row, ranked.groupBy("component_id").agg(F.min("rank").alias("least")).select("least.key"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark doesn't contaminate."""
    docs, row = _keyed(docs)
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=row)
    return _only(docs, row, found.where(~F.col("contaminated").cast("boolean")).select("doc_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of its source takes it."""
    docs, row = _keyed(docs)
    key, number, each = (_free(docs, n) for n in ("mixed_row", "mixed_copies", "mixed_copy"))
    copies = mixing.mix_sources(docs, key=row).where(F.col("copies") > 0).select(
        F.col("doc_id").alias(key), F.col("copies").cast("int").alias(number)
    )
    return docs.join(copies, F.col(row) == F.col(key)).select(
        *docs.columns, F.explode(F.sequence(F.lit(1), F.col(number))).alias(each)
    ).drop(each)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each copy kept."""
    return sharding.assign_shards(docs, 40)


STAGES = [
    ("quality", good_quality), ("near_duplicates", unlike), ("decontamination", uncontaminated),
    ("mixing", mixed), ("sharding", sharded),
]

#: A trained model and rounding by coins have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = write_once(docs)
    return docs
