"""Posture of each project: score, grade, summary, gate and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcweave.functions import severity as S
from srcweave.operators.findings import severity_counts

# Texts of the summary -------------------------------------------
NO_FINDINGS = {
    "python": "No security findings detected. Static analysis passed all Python rules.",
    "typescript": "No security findings detected. Static analysis passed all rules.",
}
SUMMARY = (
    "Found %d security issues: %d critical, %d high, %d medium, %d low. Score: %d/100 (%s)."
)
# ---------------------------------------------------------------------------


def posture(found: DataFrame, projects: DataFrame, language: str = "python") -> DataFrame:
    """One row per project; a project without findings scores 100."""
    names = ["total", *S.SEVERITY_RANK]
    # A project may be a file: counts, whose size is only guessed, do not go through the driver.
    counted = projects.select("project_id").join(severity_counts(found).hint("merge"), "project_id", "left")
    counted = counted.fillna(0, names)
    weighted = None
    for name, weight in S.SEVERITY_WEIGHT.items():
        part = F.col(name) * weight
        weighted = part if weighted is None else weighted + part
    scored = counted.withColumn("score", S.clamp_score(weighted))
    graded = scored.withColumn("grade", S.grade(F.col("score")))
    return graded.withColumn("summary", summary_text(language))


def summary_text(language: str = "python") -> Column:
    text = F.format_string(SUMMARY, "total", "critical", "high", "medium", "low", "score", "grade")
    return F.when(F.col("total") == 0, NO_FINDINGS[language]).otherwise(text)


def security_gate(found: DataFrame, projects: DataFrame, minimum: str = "info") -> DataFrame:
    """Exit code of each project: 2 when any finding reaches the threshold, else 0."""
    counts = found.groupBy("project_id").agg(
        F.count_if(S.at_least(F.col("severity"), minimum)).alias("n_blocking")
    )
    joined = projects.select("project_id").join(counts, "project_id", "left").fillna(
        0, ["n_blocking"]
    )
    failed = F.col("n_blocking") > 0
    return joined.select(
        "project_id", "n_blocking", failed.alias("failed"),
        F.when(failed, 2).otherwise(0).alias("exit_code"),
    )


def posture_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Scores before and after by project; a project may be in one of them only."""
    b = before.select("project_id", F.col("score").alias("score_before"))
    a = after.select("project_id", F.col("score").alias("score_after"))
    return b.join(a, "project_id", "full_outer").select(
        "project_id", "score_before", "score_after",
        (F.col("score_after") - F.col("score_before")).alias("change"),
        F.coalesce(F.col("score_after") < F.col("score_before"), F.lit(False)).alias("regressed"),
    )
