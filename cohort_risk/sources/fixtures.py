"""Deterministic student, decision and model-pair views derived from the
driver's TPC-H-ish tables (see FIXTURES.md).

Each column is one SQL expression over ``orders`` / ``lineitem``; the same
strings mean the same thing in Spark and DuckDB, so the oracle builds its CTEs
from this module and both engines start from identical inputs. The views are
pure projections: Catalyst prunes unused columns down to the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import compiled_projections

# One row per `orders` row.
STUDENT_EXPRS = [
    ("student_id", "'STU_' || lpad(cast(o_orderkey as varchar(12)), 9, '0')"),
    ("name", "'Student ' || cast(o_orderkey as varchar(12))"),
    (
        "email",
        "case when o_orderkey % 41 = 0 then 'not-an-email' "
        "else 'student' || cast(o_orderkey as varchar(12)) || '@university.edu' end",
    ),
    (
        "department",
        "case o_orderkey % 6 when 0 then 'Computer Science' when 1 then 'Mathematics' "
        "when 2 then 'Physics' when 3 then 'Chemistry' when 4 then 'Biology' else 'Engineering' end",
    ),
    (
        "branch",
        "case (o_orderkey * 5 + o_custkey) % 8 when 0 then 'Computer Science' "
        "when 1 then 'Information Technology' when 2 then 'Electronics' when 3 then 'Mechanical' "
        "when 4 then 'Civil' when 5 then 'Electrical' when 6 then 'Chemical' else 'Aerospace' end",
    ),
    (
        "year",
        "case (o_orderkey * 7 + o_custkey * 3) % 11 % 4 when 0 then '1st Year' "
        "when 1 then '2nd Year' when 2 then '3rd Year' else '4th Year' end",
    ),
    ("section", "substr('ABCDE', cast((o_orderkey * 3 + o_custkey) % 5 as int) + 1, 1)"),
    (
        "semester",
        "case o_orderkey % 3 when 0 then 'Fall 2024' when 1 then 'Spring 2024' else 'Summer 2024' end",
    ),
    ("gpa", "case when o_orderkey % 53 = 0 then null else (200 + (o_orderkey * 7919 + o_custkey * 31) % 201) / 100.0e0 end"),
    (
        "attendance_rate",
        "case when o_orderkey % 59 = 0 then null else (65 + (o_orderkey * 6151 + o_custkey * 17) % 36) / 100.0e0 end",
    ),
    ("assignment_completion", "(55 + (o_orderkey * 4513 + o_custkey * 13) % 46) / 100.0e0"),
    (
        "quiz_scores",
        "case when o_orderkey % 61 = 0 then null else cast((o_orderkey * 3559 + o_custkey * 19) % 61 + 40 as double) end",
    ),
    ("participation_score", "cast((o_orderkey * 2741 + o_custkey * 23) % 71 + 30 as double)"),
    ("lms_activity", "cast((o_orderkey * 1949 + o_custkey * 3) % 31 as int)"),
    ("late_submissions", "cast((o_orderkey * 1213 + o_custkey * 5) % 7 as int)"),
    ("office_hours_visits", "cast((o_orderkey * 983 + o_custkey * 7) % 8 as int)"),
    ("study_group_participation", "((o_orderkey * 769 + o_custkey * 11) % 101) / 100.0e0"),
    ("previous_semester_gpa", "(190 + (o_orderkey * 5443 + o_custkey * 29) % 211) / 100.0e0"),
    ("math_attendance", "(50 + (o_orderkey * 331 + o_custkey * 37) % 51) / 100.0e0"),
    ("math_performance", "cast(40 + (o_orderkey * 337 + o_custkey * 41) % 61 as double)"),
    ("physics_attendance", "(50 + (o_orderkey * 347 + o_custkey * 43) % 51) / 100.0e0"),
    ("physics_performance", "cast(40 + (o_orderkey * 349 + o_custkey * 47) % 61 as double)"),
    ("chemistry_attendance", "(50 + (o_orderkey * 353 + o_custkey * 53) % 51) / 100.0e0"),
    ("chemistry_performance", "cast(40 + (o_orderkey * 359 + o_custkey * 59) % 61 as double)"),
    ("english_attendance", "(50 + (o_orderkey * 367 + o_custkey * 61) % 51) / 100.0e0"),
    ("english_performance", "cast(40 + (o_orderkey * 373 + o_custkey * 67) % 61 as double)"),
    ("programming_attendance", "(50 + (o_orderkey * 379 + o_custkey * 71) % 51) / 100.0e0"),
    ("programming_performance", "cast(40 + (o_orderkey * 383 + o_custkey * 73) % 61 as double)"),
    ("risk_probability_fixture", "(40 + (o_orderkey * 401 + o_custkey * 79) % 61) / 1.0e0"),
]

# Ingest ordinal: the position of the row in the source (first/last semantics).
STUDENT_ORDINAL = ("ordinal", "o_orderkey")

# One row per `lineitem` row: an append-only decision log.
DECISION_EXPRS = [
    (
        "student_id",
        "'STU_' || lpad(cast(l_orderkey + case when l_orderkey % 97 = 0 then 100000000 else 0 end "
        "as varchar(12)), 9, '0')",
    ),
    (
        "subject",
        "case l_linenumber when 1 then 'math' when 2 then 'physics' when 3 then 'chemistry' "
        "when 4 then 'english' when 5 then 'programming' else null end",
    ),
    ("status", "case when l_returnflag = 'R' then 'declined' else 'approved' end"),
    ("decided_at", "l_shipdate"),
    ("tie1", "l_partkey"),
    ("tie2", "l_suppkey"),
    ("tie3", "l_extendedprice"),
    ("tie4", "l_linenumber"),
    # stored with the decision: the name and category shown when it was made
    ("student_name", "'Student ' || cast(l_orderkey as varchar(12))"),
    (
        "decided_category",
        "case (l_orderkey + l_partkey) % 3 when 0 then 'Low Risk' when 1 then 'Medium Risk' else 'High Risk' end",
    ),
]
DECISION_ORDER = ["decided_at", "tie1", "tie2", "tie3", "tie4"]

MODEL_PAIR_EXPRS = [
    ("id", "o_orderkey"),
    ("label", "cast((o_orderkey * 17 + o_custkey) % 3 as int)"),
    (
        "prediction",
        "case when (o_orderkey * 29 + o_custkey * 5) % 10 < 8 then cast((o_orderkey * 17 + o_custkey) % 3 as int) "
        "else cast((o_orderkey + o_custkey) % 3 as int) end",
    ),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    compiled_projections(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _project(df: DataFrame, exprs) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in exprs])


def students(spark: SparkSession, sf_dir: str, with_fixture_probability: bool = True, with_ordinal: bool = False) -> DataFrame:
    exprs = list(STUDENT_EXPRS)
    if not with_fixture_probability:
        exprs = [e for e in exprs if e[0] != "risk_probability_fixture"]
    if with_ordinal:
        exprs.append(STUDENT_ORDINAL)
    return _project(_table(spark, sf_dir, "orders"), exprs)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_table(spark, sf_dir, "lineitem"), DECISION_EXPRS)


def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_table(spark, sf_dir, "orders"), MODEL_PAIR_EXPRS)


def sql_select(exprs, table: str) -> str:
    """The same projection as SQL text (used by the DuckDB oracle)."""
    cols = ",\n  ".join(f"{e} AS {n}" for n, e in exprs)
    return f"SELECT\n  {cols}\nFROM {table}"
