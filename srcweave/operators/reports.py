"""Report projections: the tables and documents a reader of the analysis gets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.functions import severity as S
from srcweave.functions.ids import bucket_of
from srcweave.operators.rules import DESCRIPTIONS, PYTHON_RULES, RULE_TABLE, SCRIPT_RULES
from srcweave.session import as_lookup

# Fixed value: version written into reports.
REPORT_VERSION = "0.1.0"


def sarif_results(found: DataFrame) -> DataFrame:
    """One SARIF result per finding."""
    return found.select(
        "project_id",
        F.col("rule_id").alias("ruleId"),
        F.col("description").alias("message"),
        S.sarif_level(F.col("severity")).alias("level"),
        F.col("file_path").alias("uri"),
        F.col("start_line").alias("startLine"),
        F.col("end_line").alias("endLine"),
    )


def sarif_rules(projects: DataFrame, language: str) -> DataFrame:
    """The rules of a language, for the run of each project."""
    chosen = PYTHON_RULES if language == "python" else SCRIPT_RULES
    rules = F.array(*[
        F.struct(F.lit(r).alias("id"), F.lit(RULE_TABLE[r][0]).alias("shortDescription"), F.lit(DESCRIPTIONS[r]).alias("fullDescription"))
        for r in chosen
    ])
    return projects.select("project_id", F.inline(rules))


def report_findings(found: DataFrame) -> DataFrame:
    """The findings table of the text report."""
    return found.select(
        "project_id", F.upper("severity").alias("severity"), F.col("rule_id").alias("rule"),
        "title", F.col("file_path").alias("file"), F.col("start_line").alias("line"),
    )


def report_summary(comps: DataFrame, relationships: DataFrame) -> DataFrame:
    """Totals per project; a project without relationships has 0."""
    sizes = comps.groupBy("project_id").agg(
        F.count_if(F.col("type") == "file").alias("total_files"),
        F.count("*").alias("total_components"),
    )
    linked = relationships.groupBy("project_id").agg(F.count("*").alias("total_relationships"))
    return sizes.join(linked, "project_id", "left").fillna(0, ["total_relationships"])


def report_json(summary: DataFrame, posture: DataFrame) -> DataFrame:
    """The head document of each project's report.

    The lists of a report have no bound, so they are documents of their own:
    see :func:`section_parts` and :func:`srcweave.sources.sinks.write_report`.
    """
    joined = summary.join(posture, "project_id")
    document = F.struct(
        F.struct(
            F.lit(REPORT_VERSION).alias("version"), F.col("project_id").alias("analyzedPath"),
            F.col("total_files").alias("totalFiles"),
            F.col("total_components").alias("totalComponents"),
            F.col("total_relationships").alias("totalRelationships"),
        ).alias("metadata"),
        F.struct("score", "grade", "summary").alias("security"),
    )
    return joined.select("project_id", F.to_json(document).alias("json"))


def section_parts(
    rows: DataFrame, section: str, key: str = "id", per_part: int = 1000
) -> DataFrame:
    """A list section as JSON arrays of about ``per_part`` items each.

    Items are spread by a hash of their key, so a project of any size is written
    by many tasks.
    """
    sizes = rows.groupBy("project_id").agg(
        F.ceil(F.count("*") / F.lit(per_part)).cast("bigint").alias("n_parts")
    )
    items = F.struct(*rows.columns)
    placed = rows.select("project_id", key, items.alias("item")).join(
        as_lookup(sizes), "project_id"
    )
    placed = placed.withColumn("part", bucket_of(F.col(key), F.col("n_parts")))
    # Without this the grouping would keep the join's partitions: one project, one task.
    return (
        placed.repartition("project_id", "part")
        .groupBy("project_id", "part")
        .agg(F.to_json(F.sort_array(F.collect_list("item")), {"ignoreNullFields": "false"}).alias("json"))
        .select("project_id", F.lit(section).alias("section"), "part", "json")
    )
