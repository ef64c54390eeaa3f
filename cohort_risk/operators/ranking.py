"""Top-k and comparisons.

Top-k uses ``orderBy(...).limit(k)`` (TakeOrderedAndProject: a bounded
per-task heap, never a global sort). Per-group top-k uses ``row_number() <=
k``; Spark plans a partial ``WindowGroupLimit`` before the shuffle, so even a
branch that holds a third of all students ships only k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import aggregates as A

ALERT_COLUMNS = ["student_id", "name", "risk_probability", "gpa", "branch", "year", "section"]


def checked_broadcast(small: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``max_rows`` rows."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def top_high_risk(df: DataFrame, k: int = 5) -> DataFrame:
    """The k high-risk students with the highest risk probability (G1);
    ties broken by student_id (T11)."""
    return (
        df.filter(F.col("risk_category") == "High Risk")
        .select(*ALERT_COLUMNS)
        .orderBy(F.desc("risk_probability"), "student_id")
        .limit(k)
    )


def remaining_high_risk(df: DataFrame, k: int = 5) -> DataFrame:
    """How many high-risk students are not shown in the top-k list."""
    n = F.count(F.lit(1))
    return df.filter(F.col("risk_category") == "High Risk").agg(
        F.greatest(n - F.lit(k), F.lit(0)).cast("bigint").alias("remaining")
    )


def top_high_risk_by_branch(df: DataFrame, k: int = 5) -> DataFrame:
    """G1 for every branch at once."""
    w = Window.partitionBy("branch").orderBy(F.desc("risk_probability"), F.col("student_id"))
    return (
        df.filter((F.col("risk_category") == "High Risk") & F.col("branch").isNotNull())
        .select(*ALERT_COLUMNS)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def top_combinations(df: DataFrame, k: int = 5) -> DataFrame:
    """First k rows of the branch x year x section table (highest high-risk %
    first), then only those with a high-risk share above 0 (G2): the limit
    comes before the filter, as on the dashboard."""
    ranked = A.combined_risk_stats(df).limit(k)
    return ranked.filter(F.col("high_risk_pct") > 0)


def alert_band(avg_risk) -> F.Column:
    from .. import schema as S

    return (
        F.when(avg_risk > S.ALERT_CRITICAL, F.lit("CRITICAL"))
        .when(avg_risk > S.ALERT_WARNING, F.lit("WARNING"))
        .otherwise(F.lit("NORMAL"))
    )


def most_at_risk_branch(df: DataFrame) -> DataFrame:
    """The branch with the most high-risk students and its alert band."""
    top = A.high_risk_by_branch(df).limit(1)
    return top.withColumn("alert", alert_band(F.col("avg_risk_pct")))


def student_vs_branch(df: DataFrame) -> DataFrame:
    """Each student's GPA and risk against the *rounded* branch averages
    (G6, T14). The branch averages are a partial aggregate, broadcast when
    there are few branches, so the student table isn't moved; with more
    branches the join shuffles and AQE splits a skewed branch."""
    avgs = checked_broadcast(A.branch_comparison(df).select("branch", "avg_gpa", "avg_risk_pct"))
    j = df.select("student_id", "branch", "gpa", "risk_probability").join(avgs, "branch", "inner")
    gpa_diff = F.col("gpa") - F.col("avg_gpa")
    risk_diff = F.col("risk_probability") - F.col("avg_risk_pct")
    return j.select(
        "student_id",
        "branch",
        F.bround(gpa_diff, 6).alias("gpa_diff"),
        F.bround(risk_diff, 6).alias("risk_diff"),
        F.when(gpa_diff > 0, F.lit("above")).otherwise(F.lit("below")).alias("gpa_position"),
        F.when(risk_diff < 0, F.lit("below")).otherwise(F.lit("above")).alias("risk_position"),
    )
