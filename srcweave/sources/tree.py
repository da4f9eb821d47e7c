"""Parallel listing and reading of folder trees.

Spark's file sources leave out names that start with an underscore, among them
every package's ``__init__.py``, and list skipped folders before dropping them.
Here each level of the tree is one job that lists the folders found by the level
before, and the files are read by as many tasks as their bytes need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.functions.paths import extension
from srcweave.session import write_counted

#: ``error`` says why an entry can't be read; a folder that can't be listed has the size -1.
_ENTRIES = "path string, is_dir boolean, size bigint, error string"
_ARROW_ENTRIES = pa.schema(
    [("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("error", pa.string())]
)
#: What is a fact about a file; anything else fails the task, so that it is tried again.
_LASTING = (FileNotFoundError, PermissionError, NotADirectoryError)
_TASK_BYTES = 64 * 1024 * 1024
_BATCH_BYTES = 16 * 1024 * 1024


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of each folder; one that cannot be listed is a row with the error."""
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            store, inner = fs.FileSystem.from_uri(folder)
            try:
                infos = store.get_file_info(fs.FileSelector(inner))
            except _LASTING as problem:
                row = {"path": folder, "is_dir": False, "size": -1, "error": f"{type(problem).__name__}: {problem}"}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW_ENTRIES)
                continue
            known = (fs.FileType.File, fs.FileType.Directory)
            yield pa.RecordBatch.from_pylist(
                [
                    {"path": f"{folder}/{i.base_name}", "size": i.size or 0,
                     "is_dir": i.type == fs.FileType.Directory,
                     "error": None if i.type in known else "no file or folder behind this name"}
                    for i in infos
                ],
                schema=_ARROW_ENTRIES,
            )


def list_tree(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str],
    skip_dirs: Sequence[str],
    max_depth: int | None = None,
) -> tuple[DataFrame, int]:
    """Files below ``root`` with one of the extensions (``path, size, error``), and their total size.

    Folders named in ``skip_dirs`` are not entered; ``max_depth`` folders may lie
    between the root and a file, any number without it.
    """
    name = F.substring_index("path", "/", -1)
    ext = extension(F.col("path"))
    width = spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([(root,)], "path string")
    levels, total = [], 0
    while max_depth is None or len(levels) <= max_depth:
        entries = folders.mapInArrow(_list_folders, _ENTRIES).where(~name.isin(*skip_dirs))
        wanted = entries.where(F.col("is_dir") | ext.isin(*extensions) | (F.col("size") < 0))
        level, n_bytes = write_counted(wanted, F.sum(F.greatest("size", F.lit(0))))
        levels.append(level.where("not is_dir").select("path", "size", "error"))
        total += n_bytes
        folders = level.where("is_dir").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition(width, "path")
    return reduce(DataFrame.unionByName, levels), total


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("project_id", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())]
    )
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            content, error = None, row["error"]
            if error is None:
                store, inner = fs.FileSystem.from_uri(row["path"])
                try:
                    with store.open_input_stream(inner) as stream:
                        content = stream.read()
                except _LASTING as problem:
                    error = f"{type(problem).__name__}: {problem}"
            held.append({**row, "content": content, "error": error})
            size += len(content or b"")
            if size >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_contents(listed: DataFrame, n_bytes: int) -> DataFrame:
    """Contents of listed files, spread so that a task reads a bounded share; null, with ``error``, of what can't be read."""
    width = max(listed.sparkSession.sparkContext.defaultParallelism, n_bytes // _TASK_BYTES + 1)
    return listed.repartition(width, "path").mapInArrow(
        _read_batches, "project_id string, path string, content binary, error string"
    )
