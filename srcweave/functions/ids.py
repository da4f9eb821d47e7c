"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: hex digits of the digest kept in an id.
DIGEST_CHARS = 8

#: Between the parts of a key; no path or name holds it.
KEY_SEPARATOR = "\x1f"


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def short_digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, DIGEST_CHARS)


def component_id(kind: Column | str, path: Column, name: Column) -> Column:
    """``kind-safe(name)-digest`` over the lower-cased ``kind:path:name``."""
    kind = _text(kind)
    safe = F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", "-"))
    key = F.lower(F.concat_ws(":", kind, path, name))
    return F.concat_ws("-", kind, safe, short_digest(key))


def component_key(kind: Column | str, path: Column, name: Column) -> Column:
    """What a component is known by in joins: kind, path and name, whole.

    Lower case, as ids are: names that differ in case only are one component.  The id is its label, of which
    many components may share one.
    """
    return F.concat_ws(KEY_SEPARATOR, _text(kind), F.lower(path), F.lower(name))


def component_end(end: str, kind: Column | str, path: Column, name: Column) -> list[Column]:
    """One end of an edge: its id, and its key as ``<end>_key``."""
    return [component_id(kind, path, name).alias(end), component_key(kind, path, name).alias(f"{end}_key")]


def file_end(end: str, path: Column) -> list[Column]:
    """The end of an edge that is the file of a path; needs no lookup."""
    return component_end(end, "file", path, F.substring_index(path, "/", -1))


def relationship_id(source: Column, target: Column, kind: Column | str) -> Column:
    """``rel-kind-digest`` over ``source:target:kind``, case kept."""
    kind = _text(kind)
    return F.concat_ws("-", F.lit("rel"), kind, short_digest(F.concat_ws(":", source, target, kind)))


def finding_id(path: Column, slug: Column | str, line: Column) -> Column:
    """Id of a finding: a component id whose name is ``slug-line``."""
    return component_id("finding", path, F.concat_ws("-", _text(slug), line.cast("string")))


def file_id(path: Column) -> Column:
    """Id of the file component of a path; needs no lookup."""
    return component_id("file", path, F.substring_index(path, "/", -1))


def bucket_of(key: Column, n_buckets: Column) -> Column:
    """Even, engine-independent bucket number in ``[0, n_buckets)``."""
    return F.conv(short_digest(key), 16, 10).cast("bigint") % n_buckets
