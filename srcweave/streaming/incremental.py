"""Files and events that arrive over time.

Each run takes what is new (``availableNow``), keeps its progress in a checkpoint
in the shared folder, and writes result tables there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.operators.findings import secret_lines
from srcweave.plans import corpus_text as CT
from srcweave.session import shared_dir
from srcweave.sources.corpus import explode_lines, keep_scanned


def file_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A supplied table as a stream of arriving Parquet files.

    The table is one file or a folder of part files; a pattern as path takes both.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def append_results(stream: DataFrame, work: str) -> DataFrame:
    """Run a stateless stream over what is available and read the results back."""
    run = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{work}/progress").option("path", f"{work}/results")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{work}/results")


def scan_stream(files: DataFrame) -> DataFrame:
    """Secrets in arriving files: the batch expressions on a stream."""
    return secret_lines(explode_lines(files))


def scan_arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Scan all files that a walk would reach, as their parts arrive."""
    parts = file_stream(spark, folder, "part")
    arriving = CT.arriving_files(parts, spark.read.parquet(f"{folder}/part.parquet").count())
    return append_results(scan_stream(keep_scanned(arriving)), f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}")


def gate(found: DataFrame) -> DataFrame:
    """Exit code of each project that had a finding."""
    return found.groupBy("project_id").agg(F.count("*").alias("n_blocking")).withColumn(
        "exit_code", F.lit(2)
    )


def window_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts by type and time window of the events at hand."""
    return (
        events.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("event_type").alias("type"), "n")
    )


def growth_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts by type from the stream of events.

    Each batch writes the counts of its own events under its number and the counts add up, so no
    event is too late and no state is kept; a batch that runs again replaces what it wrote.
    """
    events = file_stream(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    work = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        window_counts(batch).write.mode("overwrite").parquet(f"{work}/counts/batch={number}")

    run = (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    counts = spark.read.schema("window_start timestamp, type string, n bigint, batch int").parquet(
        f"{work}/counts"
    )
    total = counts.groupBy("window_start", "type").agg(F.sum("n").alias("n"))
    return total.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
