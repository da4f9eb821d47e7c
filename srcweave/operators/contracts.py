"""Contract checks: how many rows of a table break each of its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcweave import schemas as SC


def not_null(*columns: str) -> dict[str, Column]:
    return {f"{c} is null": F.col(c).isNull() for c in columns}


def within(column: str, words: tuple[str, ...]) -> dict[str, Column]:
    return {f"{column} not in list": ~F.col(column).isin(*words)}


CONTRACTS = {
    "components": lambda: not_null("project_id", "id", "name", "type", "file_path")
    | within("type", SC.COMPONENT_TYPES)
    | {"lines out of order": F.col("end_line") < F.col("start_line")},
    "relationships": lambda: not_null("project_id", "id", "source", "target", "type")
    | within("type", SC.RELATIONSHIP_TYPES),
    "findings": lambda: not_null("project_id", "id", "rule_id", "severity", "file_path")
    | within("severity", SC.SEVERITIES)
    | {"lines out of order": F.col("end_line") < F.col("start_line")},
    "nodes": lambda: not_null("project_id", "id", "label", "type", "group")
    | within("type", SC.COMPONENT_TYPES)
    | {"size below 1": F.col("size") < 1},
    "edges": lambda: not_null("project_id", "id", "source", "target", "type", "weight")
    | within("type", SC.RELATIONSHIP_TYPES)
    | {"weight below 1": F.col("weight") < 1},
    "posture": lambda: not_null("project_id", "score", "grade")
    | within("grade", SC.GRADES)
    | {"score out of range": ~F.col("score").between(0, 100)},
}


def contract_check(rows: DataFrame, table: str) -> DataFrame:
    """``(table, check, n_rows, n_violations)`` from one aggregate over the rows."""
    checks = CONTRACTS[table]()
    names = list(checks)
    counts = rows.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(checks[name]).alias(f"c{i}") for i, name in enumerate(names)],
    )
    listed = F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("n_violations"))
        for i, name in enumerate(names)
    ])
    return counts.select(F.lit(table).alias("table"), "n_rows", F.inline(listed))
