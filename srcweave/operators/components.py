"""Components: files and their top-level declarations, built without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcweave.functions import ids
from srcweave.functions.paths import base_name
from srcweave.schemas import METADATA

#: Order of the kinds inside one file; later ones win name look-ups.
_KIND_ORDER = ("file", "class", "function", "interface", "type-alias", "enum")


def is_private(name: Column) -> Column:
    return F.startswith(name, F.lit("_"))


def _has(values: Column, *words: str) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(w) for w in words]))


def visible_params(params: Column) -> Column:
    """Parameters without the implicit receiver."""
    return F.filter(params, lambda p: ~p["name"].isin("self", "cls"))


def _visibility(name: Column, modifiers: Column, python: bool) -> Column:
    if python:
        return F.when(is_private(name), "private").otherwise("public")
    return (
        F.when(_has(modifiers, "private"), "private")
        .when(_has(modifiers, "protected"), "protected")
        .otherwise("public")
    )


def method_infos(methods: Column, python: bool = True) -> Column:
    return F.transform(
        methods,
        lambda m: F.struct(
            m["name"].alias("name"),
            (visible_params(m["params"]) if python else m["params"]).alias("parameters"),
            F.coalesce(m["return_type"], F.lit("unknown")).alias("return_type"),
            _visibility(m["name"], m["modifiers"], python).alias("visibility"),
            (
                _has(m["decorators"], "staticmethod", "classmethod")
                if python
                else _has(m["modifiers"], "static")
            ).alias("is_static"),
            m["is_async"].alias("is_async"),
        ),
    )


def distinct_by_name(properties: Column) -> Column:
    """Keep the first property of each name, in order."""
    names = F.transform(properties, lambda p: p["name"])
    return F.filter(properties, lambda p, i: F.array_position(names, p["name"]) == i + 1)


def property_infos(properties: Column, python: bool = True) -> Column:
    return F.transform(
        distinct_by_name(properties),
        lambda p: F.struct(
            p["name"].alias("name"),
            p["type"].alias("type"),
            _visibility(p["name"], p["modifiers"], python).alias("visibility"),
            (F.lit(False) if python else _has(p["modifiers"], "static")).alias("is_static"),
            (F.lit(False) if python else _has(p["modifiers"], "readonly")).alias("is_readonly"),
        ),
    )


def first_base(bases: Column) -> Column:
    return F.get(bases, F.lit(0))


def other_bases(bases: Column) -> Column:
    return F.slice(bases, F.lit(2), F.greatest(F.size(bases), F.lit(1)))


def _file_entry() -> Column:
    return F.struct(
        F.lit("file").alias("kind"),
        base_name(F.col("file_path")).alias("name"),
        F.lit(1).alias("start_line"),
        F.col("n_lines").alias("end_line"),
        F.lit(-1).alias("ord"),
        F.struct(
            F.col("n_lines").alias("loc"),
            F.lit(False).alias("is_exported"),
            F.lit(False).alias("is_default"),
            *[F.lit(None).alias(c) for c in (
                "decorators", "parameters", "return_type", "properties", "methods",
                "extends", "implements")],
        ).cast(METADATA).alias("metadata"),
    )


def _decl_entry(d: Column, python: bool) -> Column:
    is_class = d["kind"] == "class"
    exported = (
        F.when(is_class, F.lit(True)).otherwise(~is_private(d["name"]))
        if python
        else d["is_exported"]
    )
    implemented = other_bases(d["bases"]) if python else d["ifaces"]
    has_props = is_class if python else d["kind"].isin("class", "interface")
    return F.struct(
        d["kind"].alias("kind"),
        d["name"].alias("name"),
        d["start_line"].alias("start_line"),
        d["end_line"].alias("end_line"),
        d["ord"].alias("ord"),
        F.struct(
            (d["end_line"] - d["start_line"] + 1).alias("loc"),
            exported.alias("is_exported"),
            d["is_default"].alias("is_default"),
            d["decorators"].alias("decorators"),
            F.when(d["kind"] == "function", d["params"]).alias("parameters"),
            d["return_type"].alias("return_type"),
            F.when(has_props, property_infos(d["properties"], python)).alias("properties"),
            F.when(is_class, method_infos(d["methods"], python)).alias("methods"),
            F.when(is_class, first_base(d["bases"])).alias("extends"),
            F.when(is_class, implemented).alias("implements"),
        ).cast(METADATA).alias("metadata"),
    )


def components(parsed: DataFrame, language: str = "python") -> DataFrame:
    """File and declaration components of every parsed file, one pass."""
    python = language == "python"
    entries = F.concat(
        F.array(_file_entry()),
        F.transform(F.col("decls"), lambda d: _decl_entry(d, python)),
    )
    rows = parsed.select("project_id", "file_path", F.explode(entries).alias("e"))
    return rows.select(
        "project_id",
        ids.component_id(F.col("e.kind"), F.col("file_path"), F.col("e.name")).alias("id"),
        ids.component_key(F.col("e.kind"), F.col("file_path"), F.col("e.name")).alias("key"),
        F.col("e.name").alias("name"),
        F.col("e.kind").alias("type"),
        "file_path",
        F.col("e.start_line").alias("start_line"),
        F.col("e.end_line").alias("end_line"),
        F.col("e.ord").alias("ord"),
        F.col("e.metadata").alias("metadata"),
    )


def kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in _KIND_ORDER]), kind)


# Filters and size checks ----------------------------------------------------


def of_type(comps: DataFrame, kind: str) -> DataFrame:
    return comps.where(F.col("type") == kind)


def exported_functions(comps: DataFrame) -> DataFrame:
    return comps.where("type = 'function' and metadata.is_exported")


def large_classes(comps: DataFrame, min_methods: int = 10) -> DataFrame:
    n = F.size("metadata.methods")
    return (
        comps.where((F.col("type") == "class") & (n >= min_methods))
        .select("project_id", "id", "name", "file_path", n.alias("n_methods"))
    )


def complex_functions(comps: DataFrame, min_params: int = 5) -> DataFrame:
    n = F.size("metadata.parameters")
    return (
        comps.where((F.col("type") == "function") & (n >= min_params))
        .select("project_id", "id", "name", "file_path", n.alias("n_params"))
    )


def large_files(comps: DataFrame, min_loc: int = 300) -> DataFrame:
    loc = F.col("metadata.loc")
    return (
        comps.where((F.col("type") == "file") & (loc >= min_loc))
        .select("project_id", "id", "name", "file_path", loc.alias("loc"))
    )


def leaf_files(comps: DataFrame) -> DataFrame:
    """Files without any declaration of their own."""
    inner = comps.where("type <> 'file'").select("project_id", "file_path")
    return comps.where("type = 'file'").join(inner, ["project_id", "file_path"], "left_anti")


def count_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id", "type").agg(F.count("*").alias("n"))
