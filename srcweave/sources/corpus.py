"""Scans of source trees into the table of files, and views of that table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.functions import paths as P
from srcweave.sources.tree import list_tree, read_contents

# Fixed values ---------------------------------------------------------------
PYTHON_EXTENSIONS = (".py",)
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
DETECT_PYTHON_EXTENSIONS = (".py", ".pyw")
PYTHON_SKIP_DIRS = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", "env", "dist", ".tox",
    ".mypy_cache", ".pytest_cache", ".eggs", "*.egg-info",
)
DETECT_SKIP_DIRS = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", ".tox", ".mypy_cache",
)
#: Never entered: what is in them is no source of the project in any language.
SCRIPT_SKIP_DIRS = ("node_modules", ".git")
PYTHON_MAX_DEPTH = 15
DETECT_MAX_DEPTH = 10
# ---------------------------------------------------------------------------


def language_of(ext: Column) -> Column:
    return (
        F.when(ext.isin(*PYTHON_EXTENSIONS), "python")
        .when(ext.isin(*SCRIPT_EXTENSIONS), "typescript")
        .otherwise("other")
    )


def as_source_files(raw: DataFrame) -> DataFrame:
    """Complete ``(project_id, file_path, content)`` to the table of files."""
    path = F.col("file_path")
    ext = P.extension(path)
    return raw.select(
        "project_id",
        "file_path",
        P.dir_name(path).alias("dir"),
        P.base_name(path).alias("base_name"),
        ext.alias("ext"),
        language_of(ext).alias("language"),
        "content",
        F.size(F.split("content", "\n")).alias("n_lines"),
        *[c for c in ("error",) if c in raw.columns],
    )


def keep_scanned(
    files: DataFrame,
    skip_dirs: Sequence[str] = PYTHON_SKIP_DIRS,
    max_depth: int = PYTHON_MAX_DEPTH,
    root_depth: int | Column = 1,
) -> DataFrame:
    """Files a directory walk would reach: skipped folders and the depth cap apply."""
    path = F.col("file_path")
    return files.where(
        ~P.in_skipped_dir(path, skip_dirs) & (P.depth_below(path, root_depth) <= max_depth)
    )


def from_table(
    rows: DataFrame, project: str = "project_id", path: str = "file_path", content: str = "content"
) -> DataFrame:
    """The table of files from any table that holds paths and texts.

    Undecodable bytes of a binary column become U+FFFD, so no file is lost to its
    encoding.
    """
    return as_source_files(
        rows.select(
            F.col(project).alias("project_id"), F.col(path).alias("file_path"),
            F.make_valid_utf8(F.col(content).cast("string")).alias("content"),
            *[c for c in ("error",) if c in rows.columns],
        )
    )


def read_files(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] = PYTHON_EXTENSIONS + SCRIPT_EXTENSIONS,
    skip_dirs: Sequence[str] = PYTHON_SKIP_DIRS,
    max_depth: int | None = PYTHON_MAX_DEPTH,
) -> DataFrame:
    """Scan a folder of projects: each first-level folder is one project.

    ``skip_dirs`` and ``max_depth`` hold for Python files; other files lie anywhere but in
    :data:`SCRIPT_SKIP_DIRS`.  What can't be read is a row with ``error`` and without content.  A folder
    without any source file is an error.
    """
    root = root.rstrip("/")
    others = [e for e in extensions if e not in PYTHON_EXTENSIONS]
    entered, deepest = (SCRIPT_SKIP_DIRS, None) if others else (skip_dirs, max_depth)
    listed, n_bytes = list_tree(spark, root, extensions, entered, None if deepest is None else deepest + 1)
    if listed.isEmpty():
        raise FileNotFoundError(f"no source files below {root}")
    inside = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    python = P.extension(F.col("path")).isin(*PYTHON_EXTENSIONS)
    reached = ~P.in_skipped_dir(inside, skip_dirs)
    if max_depth is not None:
        reached = reached & (P.depth_below(inside, 1) <= max_depth)
    named = listed.where(~python | reached).select(F.substring_index(inside, "/", 1).alias("project_id"), "path", "error")
    return from_table(read_contents(named, n_bytes), path="path")


def without_vendored(files: DataFrame) -> DataFrame:
    return files.where(~P.is_vendored(F.col("file_path")))


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select(
        "project_id", "file_path", F.posexplode(F.split("content", "\n")).alias("pos", "line")
    ).select("project_id", "file_path", (F.col("pos") + 1).alias("line_no"), "line")


def detect_language(files: DataFrame, override: str | None = None) -> DataFrame:
    """Majority language of each project; a tie or nothing at all is TypeScript."""
    ext = P.extension(F.col("file_path"))
    if override and override != "auto":
        language = F.lit(override)
    else:
        language = F.when(F.col("n_py") > F.col("n_ts"), "python").otherwise("typescript")
    return (
        files.groupBy("project_id")
        .agg(
            F.count_if(ext.isin(*SCRIPT_EXTENSIONS)).alias("n_ts"),
            F.count_if(ext.isin(*DETECT_PYTHON_EXTENSIONS)).alias("n_py"),
        )
        .withColumn("language", language)
    )


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("project_id", "file_path", "error")
