"""Relationships: names and module paths resolved to components by equi-joins.

The build sides hold one row per key (``max``/``max_by`` with map-side
combine) and are written once, so a join never multiplies rows; a hot name only makes
the probe side uneven, which AQE splits.  Order is the file path, then the place in the file.  Joins and groupings use
the whole key of a component (kind, path, name); its short id goes along as a label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcweave.functions import ids
from srcweave.functions import paths as P
from srcweave.operators.components import kind_order
from srcweave.operators.keys import keyed_edges
from srcweave.session import as_lookup

_EDGE = (
    "project_id", "source", "source_key", "target", "target_key", "type", "file_path", "ord", "import_specifiers",
)


# Deduplication --------------------------------------------------------------


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; combines map-side, so hot keys stay cheap."""
    value = F.struct(*[c for c in rows.columns if c not in keys])
    picked = rows.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("v"))
    return picked.select(*keys, "v.*").select(*rows.columns)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    value = F.struct(*[c for c in rows.columns if c not in keys])
    picked = rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("v"))
    return picked.select(*keys, "v.*").select(*rows.columns)


def component_index(comps: DataFrame) -> DataFrame:
    """One component per key: names that differ only in case share one, the last stays."""
    rows = comps.select("project_id", "key", "id", "type", "name", "file_path", "ord").withColumn(
        "kind_no", kind_order(F.col("type"))
    )
    return last_wins(rows, ["project_id", "key"], ["file_path", "kind_no", "ord"]).drop("kind_no")


def resolve_ids(refs: DataFrame, comps: DataFrame) -> DataFrame:
    """Keep the references ``(file_path, ref_type, ref_name)`` that name a component."""
    keyed = refs.withColumn(
        "key", ids.component_key(F.col("ref_type"), F.col("file_path"), F.col("ref_name"))
    )
    index = component_index(comps).select(
        "project_id", "key", "id", F.col("type").alias("found_type"), F.col("name").alias("found_name")
    )
    return keyed.join(as_lookup(index), ["project_id", "key"])


def name_map(comps: DataFrame) -> DataFrame:
    """``(project, name)`` to the last non-file component of that name."""
    rows = comps.where("type <> 'file'").select(
        "project_id", "name", "id", "key", F.col("type").alias("found_type"), "file_path", "ord",
        kind_order(F.col("type")).alias("kind_no"),
    )
    return last_wins(rows, ["project_id", "name"], ["file_path", "kind_no", "ord"]).select(
        "project_id", "name", "id", "key", "found_type", "file_path"
    )


# Python imports -------------------------------------------------------------


def module_map(files: DataFrame) -> DataFrame:
    """Every dotted suffix, and the exact path, of each Python file to the file."""
    path = F.col("file_path")
    keys = F.concat(P.module_names(path), F.array(P.module_path(path)))
    return (
        files.select("project_id", F.explode(F.array_distinct(keys)).alias("module"), "file_path")
        .groupBy("project_id", "module")
        .agg(F.max("file_path").alias("target_path"))
    )


def module_names(files: DataFrame) -> DataFrame:
    """Dotted names only, last path wins."""
    return module_map(files).where(~F.contains("module", F.lit("/")))


def relative_keys(path: Column, module: Column, level: Column, names: Column) -> Column:
    """Exact paths a relative import may mean, best first."""
    folder = P.path_parts(P.dir_name(path))
    kept = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - level + 1, F.lit(0)))
    stem = F.concat_ws("/", F.array_join(kept, "/"), F.nullif(F.replace(module, F.lit("."), F.lit("/")), F.lit("")))
    bare = F.transform(names, lambda n: F.concat_ws("/", stem, n))
    named = F.array(stem, F.concat(stem, F.lit("/__init__")))
    return F.when(module == "", bare).otherwise(named)


def import_refs(parsed: DataFrame) -> DataFrame:
    """Import statements with the module keys they may resolve to."""
    rows = parsed.select("project_id", "file_path", F.inline("imports"))
    keys = F.when(
        F.col("level") > 0,
        relative_keys(F.col("file_path"), F.col("module"), F.col("level"), F.col("names")),
    ).otherwise(F.array("module"))
    return rows.withColumn("keys", keys)


def resolved_imports(parsed: DataFrame) -> DataFrame:
    """One row per import and the file it means.

    ``from . import a, b`` names several modules, other forms one.
    """
    refs = import_refs(parsed).select(
        "project_id", "file_path", "module", "level", "names", "line", "ord",
        F.posexplode("keys").alias("rank", "key"),
    )
    known = as_lookup(module_map(parsed).withColumnRenamed("module", "key"))
    # The size of parsed rows is guessed from what they were derived from: unasked, they would go through the driver.
    hits = refs.join(known.hint("merge"), ["project_id", "key"])
    several = (F.col("level") > 0) & (F.col("module") == "")
    slot = F.when(several, F.col("rank")).otherwise(F.lit(0))
    hits = hits.withColumn("slot", slot)
    best = first_wins(hits, ["project_id", "file_path", "ord", "slot"], ["rank"])
    return best.select(
        "project_id", "file_path", "module", "level", "line", "ord", "slot", "target_path",
        F.when(several, F.array(F.element_at("names", F.col("slot") + 1)))
        .otherwise(F.col("names")).alias("names"),
    )


def import_edges(parsed: DataFrame) -> DataFrame:
    hits = resolved_imports(parsed)
    return hits.select(
        "project_id",
        *ids.file_end("source", F.col("file_path")),
        *ids.file_end("target", F.col("target_path")),
        F.lit("imports").alias("type"),
        "file_path",
        (F.col("ord") * 1000 + F.col("slot")).cast("bigint").alias("ord"),
        F.when(F.size("names") > 0, F.col("names")).alias("import_specifiers"),
    )


# Inheritance and calls ------------------------------------------------------


def inherit_edges(
    parsed: DataFrame, comps: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """Bases by name; the first one that resolves is extended, the rest implemented."""
    names = as_lookup(name_map(comps)) if names is None else names
    bases = (
        parsed.select("project_id", "file_path", F.inline("decls"))
        .where("kind = 'class'")
        .select(
            "project_id", "file_path", "ord",
            *ids.component_end("source", "class", F.col("file_path"), F.col("name")),
            F.posexplode("bases").alias("pos", "base"),
        )
    )
    targets = names.select(
        "project_id", F.col("name").alias("base"), F.col("id").alias("target"), F.col("key").alias("target_key")
    )
    hits = bases.join(targets, ["project_id", "base"])
    one_class = Window.partitionBy("project_id", "source_key", "ord")
    kind = F.when(F.col("pos") == F.min("pos").over(one_class), "extends").otherwise("implements")
    return hits.select(
        "project_id", "source", "source_key", "target", "target_key", kind.alias("type"), "file_path",
        (F.lit(2_000_000_000) + F.col("ord").cast("bigint") * 1000 + F.col("pos")).alias("ord"),
        F.lit(None).cast("array<string>").alias("import_specifiers"),
    )


def call_refs(parsed: DataFrame) -> DataFrame:
    """Distinct (caller, called name) pairs of each file, reduced before any shuffle."""
    pairs = F.array_distinct(
        F.transform(
            F.filter("calls", lambda c: c["caller"].isNotNull() & c["callee_name"].isNotNull()),
            lambda c: F.struct(
                c["caller"].alias("caller"), c["caller_kind"].alias("caller_kind"),
                c["callee_name"].alias("callee_name"),
            ),
        )
    )
    rows = parsed.select("project_id", "file_path", F.inline(pairs))
    return rows.select(
        "project_id", "file_path", "callee_name",
        *ids.component_end("source", F.col("caller_kind"), F.col("file_path"), F.col("caller")),
    )


def call_edges(
    parsed: DataFrame, comps: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """Calls by bare name to the last component of that name; never to oneself."""
    names = as_lookup(name_map(comps)) if names is None else names
    targets = names.select(
        "project_id", F.col("name").alias("callee_name"), F.col("id").alias("target"), F.col("key").alias("target_key")
    )
    return (
        call_refs(parsed)
        .join(targets, ["project_id", "callee_name"])
        .where("source_key <> target_key")
        .select(
            "project_id", "source", "source_key", "target", "target_key", F.lit("calls").alias("type"), "file_path",
            F.lit(4_000_000_000).alias("ord"),
            F.lit(None).cast("array<string>").alias("import_specifiers"),
        )
    )


# All of them ----------------------------------------------------------------


def relationships(*edge_sets: DataFrame) -> DataFrame:
    """Bag union of edge sets, ids added, the first of each edge kept.

    An edge is the whole keys of its ends and its type; the short ids are labels, and edges may share one.
    """
    edges = reduce(DataFrame.unionByName, [keyed_edges(e).select(*_EDGE) for e in edge_sets])
    keyed = edges.withColumn(
        "id", ids.relationship_id(F.col("source"), F.col("target"), F.col("type"))
    )
    kept = first_wins(
        keyed, ["project_id", "source_key", "target_key", "type"], ["file_path", "ord"]
    )
    return kept.select(
        "project_id", "id", "source", "target", "type", "import_specifiers", "source_key", "target_key"
    )


def python_relationships(parsed: DataFrame, comps: DataFrame) -> DataFrame:
    names = as_lookup(name_map(comps))
    return relationships(
        import_edges(parsed), inherit_edges(parsed, comps, names), call_edges(parsed, comps, names)
    )


def duplicate_check(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row count against distinct key count, per project."""
    per_key = rows.groupBy("project_id", *[k for k in keys if k != "project_id"]).agg(
        F.count("*").alias("c")
    )
    return per_key.groupBy("project_id").agg(
        F.sum("c").alias("n_rows"), F.count("*").alias("n_keys"),
        F.count_if(F.col("c") > 1).alias("n_repeated"),
    )
