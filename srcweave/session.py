"""Session helpers: settings for scale, lineage cuts and size-checked broadcast."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings a cluster job should start with.  AQE splits skewed join
#: partitions and coalesces small ones; the Arrow batch bound keeps the
#: Python workers' memory flat when files are large.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.files.maxPartitionBytes": "134217728",
}

#: Largest dimension (in rows) that may be broadcast after it was counted.
BROADCAST_ROW_LIMIT = 100_000


def build_session(
    app_name: str = "srcweave", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with :data:`SETTINGS`; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary one.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    configured = configured or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not configured and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="srcweave-"))
        current = spark.sparkContext.getCheckpointDir()
    return configured or current


def write_once(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, survives lost executors, and the
    table prunes columns and has a known size, so small ones are broadcast by the
    optimizer and large ones are not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_counted(df: DataFrame, metric: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`write_once`, and an aggregate of the rows (their number by default).

    The aggregate is observed while the table is written: no second job.
    """
    seen = Observation()
    metric = F.count(F.lit(1)) if metric is None else metric
    table = write_once(df.observe(seen, metric.alias("n")))
    return table, int(seen.get["n"] or 0)


class Grown:
    """One table to which rounds append, so that no plan grows with their number."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self.folder = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.folder)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder)

    def add_counted(self, rows: DataFrame, metric: Column) -> int:
        """:meth:`add`, and an aggregate of the rows that is observed while they are written."""
        seen = Observation()
        self.add(rows.observe(seen, metric.alias("n")))
        return int(seen.get["n"] or 0)

    @property
    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)


class Scratch:
    """Writes tables to the shared folder and removes them again.

    What was shuffled to make a table is not needed once it is written.  Spark deletes
    shuffle files when their owner is collected as garbage in the driver, so that is asked for after
    each write; otherwise all shuffles of a long operator stay on the disks until its end.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, *by: str) -> DataFrame:
        """The table, in a folder for each value of some columns."""
        path = f"{shared_dir(self.spark)}/tables/{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(table)] = table, path
        self.collect()
        return table

    def write_counted(self, df: DataFrame, metric: Column | None = None) -> tuple[DataFrame, int]:
        """The table, and an aggregate of its rows (their number by default), observed while writing."""
        seen = Observation()
        metric = F.count(F.lit(1)) if metric is None else metric
        table = self.write(df.observe(seen, metric.alias("n")))
        return table, int(seen.get["n"] or 0)

    def collect(self) -> None:
        """Let what was shuffled and is used up go."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            jvm, (_, path) = self.spark.sparkContext._jvm, self.tables.pop(id(table))
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def drop_all(self) -> None:
        self.drop(*[table for table, _ in self.tables.values()])
        self.collect()


def as_lookup(df: DataFrame) -> DataFrame:
    """A table to look keys up in, written once.

    AQE splits a hot key of the probe side only when both sides of the join come
    straight from a shuffle.  An aggregate that already sits on the join keys would
    stand in the way; a written table does not, and its known size lets the
    optimizer broadcast it when it is small.
    """
    return write_once(df)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of rows that will be expensive to work on.

    Only for inputs with fewer splits than cores; others stay where they are.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only when it is proven to hold at most ``max_rows`` rows.

    The proof reads at most ``max_rows + 1`` rows.  A larger frame is returned
    as it is, so the join shuffles and AQE may split its skewed partitions.
    """
    if df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
