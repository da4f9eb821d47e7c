"""Writers: reports as JSON lines or Parquet by project, SARIF rows, metrics logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(sections: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One folder per section, one JSON object per row, partitioned by project.

    Rows of a large project stay spread over the tasks that hold them.
    """
    for name, rows in sections.items():
        rows.write.mode(mode).partitionBy("project_id").option("ignoreNullFields", "false").json(
            f"{path.rstrip('/')}/{name}"
        )


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fact or result table as Parquet by project, so later scans prune."""
    rows.write.mode(mode).partitionBy("project_id").parquet(path)


def append_metrics(snapshot: DataFrame, path: str) -> None:
    """Add a snapshot to a JSON-lines log."""
    snapshot.write.mode("append").json(path)


class SnapshotLog:
    """A log of snapshots to which a batch can be appended again without counting twice.

    A batch is written to a folder of its own attempt; then a line of the manifest names the attempt.  Readers
    take the attempt that the manifest names last for each batch, so they see a batch whole or not at all, and a
    batch that runs again takes the place of what it wrote.  Folders of attempts that nobody names may be removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, batch: str) -> None:
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/attempt={attempt}")
        line = self.spark.range(1).select(
            F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at")
        )
        line.write.mode("append").parquet(f"{self.path}/manifest")

    def read(self) -> DataFrame:
        """The rows of all batches, with ``batch``, as they are now.

        The manifest has a line for each append, so it is read here, and its folders are named one by one: frames read at
        different times then differ for Spark too, which takes scans of one root for the same.
        """
        lines = self.spark.read.parquet(f"{self.path}/manifest")
        named = lines.groupBy("batch").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt")).collect()
        places = [f"{self.path}/data/attempt={r.attempt}" for r in named]
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*places)
        batches = self.spark.createDataFrame(named, "batch string, attempt string")
        return rows.join(F.broadcast(batches), "attempt").drop("attempt")
