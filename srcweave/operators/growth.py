"""Counts over time: snapshots, their differences and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_counts(rows: DataFrame, day: Column, kind: Column) -> DataFrame:
    """Number of rows of each kind per project and day."""
    return rows.groupBy("project_id", day.alias("snapshot"), kind.alias("type")).agg(
        F.count("*").alias("n")
    )


def component_snapshot(comps: DataFrame, taken_on: Column) -> DataFrame:
    """One row per project: the counts a metrics log keeps."""
    return comps.groupBy("project_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("type") == "file").alias("files"),
        F.count_if(F.col("type") == "class").alias("classes"),
        F.count_if(F.col("type") == "function").alias("functions"),
    ).withColumn("snapshot", taken_on)


def growth_delta(snapshots: DataFrame) -> DataFrame:
    """Change of each count since the snapshot before it.

    Input rows are aggregates, so a window holds one row per snapshot.
    """
    order = Window.partitionBy("project_id", "type").orderBy("snapshot")
    before = F.lag("n").over(order)
    return snapshots.select(
        "project_id", "snapshot", "type", "n", before.alias("n_before"),
        (F.col("n") - before).alias("delta"),
    )
