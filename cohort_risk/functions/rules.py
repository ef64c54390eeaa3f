"""Row-level rule expressions (labels, categories, indicators, factor arrays,
subject risk). Everything returns a ``Column`` built from Catalyst
expressions, so it stays inside whole-stage codegen; no Python UDFs.

NULL/NaN policy: a missing value never satisfies a threshold. Doubles are
normalised NaN -> NULL first (Spark orders NaN above every number), then each
comparison is wrapped in ``coalesce(..., false)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def has(df: DataFrame, col: str) -> bool:
    return col in df.columns


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(F.col(f.name)), F.lit(None).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def is_true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def any_true(conds) -> Column:
    return reduce(lambda a, b: a | b, [is_true(c) for c in conds])


def _cmp(col: Column, op: str, value) -> Column:
    if op == "<":
        return col < F.lit(value)
    if op == ">":
        return col > F.lit(value)
    return col == F.lit(value)


# ---------------------------------------------------------------- labels ----


def risk_label(df: DataFrame) -> Column:
    """2 / 1 / 0 rule label on the raw (not yet imputed) values."""
    high = any_true(F.col(c) < F.lit(t) for c, t in S.LABEL_HIGH.items() if has(df, c))
    med = any_true(F.col(c) < F.lit(t) for c, t in S.LABEL_MEDIUM.items() if has(df, c))
    return F.when(high, F.lit(2)).when(med, F.lit(1)).otherwise(F.lit(0))


def model_category(score: Column) -> Column:
    """0/1/2 -> name, anything else -> 'Unknown' (C2)."""
    return (
        F.when(score == 0, F.lit("Low Risk"))
        .when(score == 1, F.lit("Medium Risk"))
        .when(score == 2, F.lit("High Risk"))
        .otherwise(F.lit("Unknown"))
    )


def agent_category(score: Column) -> Column:
    """0 -> Low, 1 -> Medium, anything else (NULL included) -> High."""
    return (
        F.when(is_true(score == 0), F.lit("Low Risk"))
        .when(is_true(score == 1), F.lit("Medium Risk"))
        .otherwise(F.lit("High Risk"))
    )


# ------------------------------------------------------------ indicators ----


def gpa_trend() -> Column:
    return F.col("gpa") - F.col("previous_semester_gpa")


def performance_score() -> Column:
    return (
        F.col("gpa") * 0.3
        + F.col("attendance_rate") * 0.2
        + F.col("assignment_completion") * 0.2
        + F.col("quiz_scores") / 100 * 0.2
        + F.col("participation_score") / 100 * 0.1
    )


def engagement_score() -> Column:
    return (
        F.col("lms_activity") / 20 * 0.4
        + F.col("office_hours_visits") / 10 * 0.3
        + F.col("study_group_participation") * 0.3
    )


def with_risk_indicators(df: DataFrame) -> DataFrame:
    """gpa_trend, performance/engagement scores and four flags."""
    out = df.withColumns(
        {
            "gpa_trend": gpa_trend(),
            "performance_score": performance_score(),
            "engagement_score": engagement_score(),
        }
    )
    return out.withColumns({name: is_true(F.col(c) < F.lit(t)) for name, (c, t) in S.INDICATOR_THRESHOLDS.items()})


def severity(col: str, hi: float, mid: float) -> Column:
    c = F.col(col)
    return F.when(is_true(c < F.lit(hi)), F.lit(1.0)).when(is_true(c < F.lit(mid)), F.lit(0.5)).otherwise(F.lit(0.0))


def with_severity(df: DataFrame) -> DataFrame:
    """Severity 1 / 0.5 / 0 per factor; absent factor column -> 0."""
    return df.withColumns(
        {f"{c}_severity": severity(c, hi, mid) if has(df, c) else F.lit(0.0) for c, hi, mid in S.SEVERITY_FACTORS}
    )


def severity_long(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The severity matrix in long form: one row per (student, factor)."""
    keep = keep or ["student_id"]
    wide = with_severity(df).select(*keep, *[F.col(f"{c}_severity").alias(c) for c, _, _ in S.SEVERITY_FACTORS])
    return wide.unpivot(keep, [c for c, _, _ in S.SEVERITY_FACTORS], "factor", "severity")


# ---------------------------------------------------------- factor arrays ----


def _ordered_names(pairs) -> Column:
    """Array of the names whose condition holds, in declaration order."""
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs])
    return F.filter(arr, lambda x: x.isNotNull())


def plan_factors(df: DataFrame) -> Column:
    """The eight intervention-plan factors (C9). An absent column takes its
    default (which flags LMS and office hours, T3); a NULL value never flags."""
    pairs = []
    for name, col, op, thr, default in S.PLAN_FACTORS:
        value = F.col(col) if has(df, col) else F.lit(default)
        pairs.append((name, is_true(_cmp(value, op, thr))))
    return _ordered_names(pairs)


def chart_factors() -> Column:
    """The five dashboard factors."""
    return _ordered_names([(name, is_true(F.col(c) < F.lit(t))) for name, c, t in S.CHART_FACTORS])


# ------------------------------------------------------------- subjects ----


def subject_level(att: Column, perf: Column) -> Column:
    hi_a, hi_p = S.SUBJECT_HIGH
    md_a, md_p = S.SUBJECT_MEDIUM
    return (
        F.when(any_true([att < F.lit(hi_a), perf < F.lit(hi_p)]), F.lit("High Risk"))
        .when(any_true([att < F.lit(md_a), perf < F.lit(md_p)]), F.lit("Medium Risk"))
        .otherwise(F.lit("Low Risk"))
    )


def subject_rows(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Unpivot the 5 x (attendance, performance) pairs into one row per
    (student, subject) with its risk level (C11). A subject whose pair of
    columns is absent yields no row. Narrow: no shuffle."""
    keep = keep or ["student_id"]
    present = [s for s in S.SUBJECTS if has(df, f"{s}_attendance") and has(df, f"{s}_performance")]
    if not present:
        return df.select(*keep).limit(0).withColumns(
            {"subject": F.lit(None).cast("string"), "attendance": F.lit(None).cast("double"),
             "performance": F.lit(None).cast("double")}
        )
    structs = F.array(
        *[
            F.struct(
                F.lit(s).alias("subject"),
                F.col(f"{s}_attendance").cast("double").alias("attendance"),
                F.col(f"{s}_performance").cast("double").alias("performance"),
            )
            for s in present
        ]
    )
    rows = df.select(*keep, F.inline(structs))
    return rows.withColumn("subject_risk", subject_level(F.col("attendance"), F.col("performance")))


def subject_advice(level: Column) -> Column:
    """Pending-decision advice text by level."""
    expr = None
    for lvl, text in S.SUBJECT_ADVICE.items():
        expr = (F.when(level == lvl, F.lit(text)) if expr is None else expr.when(level == lvl, F.lit(text)))
    return expr


# ---------------------------------------------------------------- email ----


def email_valid(col: Column) -> Column:
    """Anchored email pattern; NULL / empty -> false."""
    return is_true(col.rlike(S.EMAIL_PATTERN))


