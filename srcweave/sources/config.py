"""Rule configuration: JSON files to options and to a rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.operators.rules import RuleOptions
from srcweave.schemas import CONFIG_FILE


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Configuration documents, with or without an outer ``security`` object."""
    nested = f"{CONFIG_FILE}, security struct<{_as_struct(CONFIG_FILE)}>"
    raw = spark.read.schema(nested).option("multiLine", "true").json(path)
    names = [f.name for f in raw.schema.fields if f.name != "security"]
    return raw.select(*[F.coalesce(F.col(f"security.{n}"), F.col(n)).alias(n) for n in names])


def _as_struct(ddl: str) -> str:
    """Column DDL as the inside of a struct type: ``name type`` to ``name:type``."""
    depth, out, name_done = 0, [], False
    for ch in ddl.strip():
        depth += (ch == "<") - (ch == ">")
        if depth == 0 and ch == ",":
            name_done = False
        elif depth == 0 and ch == " " and not name_done and out and out[-1] not in ", ":
            ch, name_done = ":", True
        out.append(ch)
    return "".join(out)


def rule_config(config: DataFrame) -> DataFrame:
    """One row per configured rule; absent switches mean enabled."""
    rows = config.select(F.explode("rules").alias("rule_id", "setting"))
    return rows.select(
        "rule_id", F.coalesce("setting.enabled", F.lit(True)).alias("enabled"),
        F.col("setting.severity").alias("severity"),
    )


def project_config(docs: DataFrame) -> DataFrame:
    """Configuration of each project from the text of its document (``project_id, json``), with or without the outer object.

    ``min_severity``, ``rules`` (a map to ``enabled`` and ``severity``) and ``error``, for a text that is no JSON; of
    several documents of a project the first in order of their texts holds.
    """
    one = docs.groupBy("project_id").agg(F.min("json").alias("json"))
    parsed = one.select("project_id", "json", F.try_parse_json("json").alias("doc"))
    nested = F.try_variant_get("doc", "$.security", "variant")
    doc = parsed.select("project_id", "json", F.coalesce(nested, F.col("doc")).alias("doc"))
    rules = "map<string,struct<enabled:boolean,severity:string>>"
    return doc.select(
        "project_id", F.try_variant_get("doc", "$.minSeverity", "string").alias("min_severity"),
        F.coalesce(F.try_variant_get("doc", "$.rules", rules), F.create_map().cast(rules)).alias("rules"),
        F.when(F.col("doc").isNull(), F.concat(F.lit("no JSON: "), F.substring("json", 1, 80))).alias("error"),
    )


def with_flags(config: DataFrame, min_severity: str | None = None, disable: tuple[str, ...] = ()) -> DataFrame:
    """The configuration of each project with what the caller sets, which wins."""
    off = F.map_from_arrays(
        F.array(*[F.lit(r) for r in disable]).cast("array<string>"),
        F.array(*[F.struct(F.lit(False).alias("enabled"), F.lit(None).cast("string").alias("severity")) for _ in disable]).cast(
            "array<struct<enabled:boolean,severity:string>>"
        ),
    )
    kept = F.map_filter("rules", lambda rule, _: ~rule.isin(*disable)) if disable else F.col("rules")
    return config.withColumns({
        "rules": F.map_concat(kept, off), "min_severity": F.coalesce(F.lit(min_severity), "min_severity"),
    })


def rule_options(
    config: DataFrame | None = None,
    min_severity: str | None = None,
    disable: tuple[str, ...] = (),
) -> RuleOptions:
    """Options of one configuration document; arguments win over the file."""
    row = config.first() if config is not None else None
    doc = row.asDict(recursive=True) if row else {}
    rules = doc.get("rules") or {}
    off = {r for r, s in rules.items() if s and s.get("enabled") is False}
    return RuleOptions(
        min_severity=min_severity or doc.get("minSeverity"),
        disabled=frozenset(off | set(disable)),
        severity={r: s["severity"] for r, s in rules.items() if s and s.get("severity")},
        custom_sources=tuple(doc.get("customSources") or ()),
        custom_sinks={k: tuple(v) for k, v in (doc.get("customSinks") or {}).items()},
        router_names=tuple(doc.get("customRouterNames") or ()),
        trusted_middleware=tuple(doc.get("trustedMiddleware") or ()),
        false_positives=tuple(doc.get("falsePositivePatterns") or ()),
    )
