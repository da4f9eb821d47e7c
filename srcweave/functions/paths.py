"""Path arithmetic on slash-separated file paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Parent folder; ``.`` for a bare name and ``/`` for a top-level one."""
    head = F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)
    return (
        F.when(~F.contains(path, F.lit("/")), F.lit("."))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot, empty for none or a dotfile."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def group_name(path: Column) -> Column:
    """Name of the folder that holds the file: the cluster label."""
    folder = dir_name(path)
    return F.when(folder == "/", F.lit("")).otherwise(base_name(folder))


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def depth_below(path: Column, root_depth: int | Column = 1) -> Column:
    """Number of folders between a root with ``root_depth`` segments and the file."""
    return F.size(path_parts(path)) - root_depth - 1


def in_skipped_dir(path: Column, skip_dirs: Sequence[str]) -> Column:
    folders = F.slice(path_parts(path), F.lit(1), F.size(path_parts(path)) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(d) for d in skip_dirs]))


def is_vendored(path: Column) -> Column:
    """Third-party or declaration-only file."""
    return F.contains(path, F.lit("node_modules")) | F.endswith(path, F.lit(".d.ts"))


def module_path(path: Column) -> Column:
    """The path without ``.py``: the key relative imports resolve to."""
    return F.regexp_replace(path, r"\.py$", "")


def module_names(path: Column) -> Column:
    """Every dotted suffix of a Python file's path, longest first."""
    parts = F.split(module_path(path), "/")
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")
    )
    return F.filter(suffixes, lambda m: (m != "") & ~F.startswith(m, F.lit(".")))
