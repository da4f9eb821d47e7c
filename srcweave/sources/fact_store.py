"""Facts kept by the content they were read from, so that equal files are parsed once."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.schemas import PARSED
from srcweave.sources.python_facts import python_facts
from srcweave.sources.script_facts import script_facts
from srcweave.sources.sinks import SnapshotLog


class FactStore:
    """A table of facts of one language, keyed by the digest of the text.

    :meth:`facts` parses the texts that no row of the table holds, appends them, and gives every file the facts
    of its text: in any project, under any path, in any later scan.  Digests are whole (256 bits).  A batch that was not
    committed is not seen; two scans at once may both parse a text, whose facts are then read once.
    """

    def __init__(self, spark: SparkSession, path: str, language: str = "python"):
        self.log, self.language = SnapshotLog(spark, path), language

    def _known(self) -> DataFrame | None:
        try:
            return self.log.read().drop("batch")
        except AnalysisException:  # nothing was appended yet
            return None

    def facts(self, files: DataFrame) -> DataFrame:
        digest = F.coalesce(F.sha2("content", 256), F.lit("no content"))
        keyed = files.where(F.col("language") == self.language).withColumn("digest", digest)
        texts = keyed.select("digest", "content", "language").dropDuplicates(["digest"])
        known = self._known()
        if known is not None:
            texts = texts.join(known.select("digest"), "digest", "left_anti")
        named = texts.select(F.lit("").alias("project_id"), F.col("digest").alias("file_path"), "content", "language")
        parsed = python_facts(named) if self.language == "python" else script_facts(named)
        fresh = parsed.withColumnRenamed("file_path", "digest").drop("project_id")
        self.log.append(fresh, uuid.uuid4().hex)
        once = self._known().dropDuplicates(["digest"])
        columns = [f.split()[0] for f in _top_level(PARSED)]
        return keyed.select("project_id", "file_path", "digest").join(once.hint("merge"), "digest").select(*columns)

    def size(self) -> int:
        known = self._known()
        return 0 if known is None else known.count()


def _top_level(ddl: str) -> list[str]:
    """The columns of a DDL text, not those inside types."""
    parts, depth, start = [], 0, 0
    for at, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(ddl[start:at].strip())
            start = at + 1
    return [*parts, ddl[start:].strip()]
