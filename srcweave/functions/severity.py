"""Severity scale, scoring weights, grades and report levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
SEVERITY_WEIGHT = {"critical": 25, "high": 15, "medium": 8, "low": 3, "info": 0}
SARIF_LEVEL = {
    "critical": "error",
    "high": "error",
    "medium": "warning",
    "low": "note",
    "info": "none",
}
GRADE_FLOOR = {"A": 90, "B": 80, "C": 70, "D": 60}
LOWEST_GRADE = "F"
EDGE_WEIGHT = {"extends": 3, "implements": 3, "imports": 2, "calls": 1, "uses-type": 1}
# ---------------------------------------------------------------------------


def _lookup(column: Column, table: dict, default=None) -> Column:
    expr = None
    for key, value in table.items():
        test = column == key
        expr = F.when(test, F.lit(value)) if expr is None else expr.when(test, F.lit(value))
    return expr.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_RANK)


def severity_weight(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_WEIGHT, 0)


def sarif_level(severity: Column) -> Column:
    return _lookup(severity, SARIF_LEVEL)


def edge_weight(kind: Column) -> Column:
    return _lookup(kind, EDGE_WEIGHT, 1)


def clamp_score(deductions: Column) -> Column:
    """100 minus the deductions, kept within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - deductions)).cast("int")


def grade(score: Column) -> Column:
    expr = None
    for letter, floor in GRADE_FLOOR.items():
        test = score >= floor
        expr = F.when(test, letter) if expr is None else expr.when(test, letter)
    return expr.otherwise(LOWEST_GRADE)


def at_least(severity: Column, minimum: str) -> Column:
    return severity_rank(severity) >= SEVERITY_RANK[minimum]
