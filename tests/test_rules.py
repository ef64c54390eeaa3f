"""Golden plan, threshold boundaries and the NULL / NaN / absent-column traps."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_risk import schema as S
from cohort_risk.functions import rules as R
from cohort_risk.operators import interventions as I
from cohort_risk.operators import quality as Q


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("student_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("gpa", T.DoubleType()),
        T.StructField("attendance_rate", T.DoubleType()),
        T.StructField("assignment_completion", T.DoubleType()),
        T.StructField("quiz_scores", T.DoubleType()),
        T.StructField("participation_score", T.DoubleType()),
        T.StructField("lms_activity", T.IntegerType()),
        T.StructField("late_submissions", T.IntegerType()),
        T.StructField("risk_score", T.IntegerType()),
    ]
)


def test_golden_high_risk_plan(spark):
    """The sample student of the reference demo (no office-hours column)."""
    df = _df(spark, [("S1", "John Doe", 2.1, 0.65, 0.55, 45.0, 30.0, 3, 5, 2)], SAMPLE_SCHEMA)
    full = I.with_analysis(df)
    a = full.first()
    assert full.select(F.map_keys("timeline").alias("k")).first().k == ["immediate", "week_1", "month_1", "ongoing"]
    assert a.plan_category == "High Risk"
    assert a.risk_factors == [name for name, *_ in S.PLAN_FACTORS]  # all 8, office hours absent -> flagged
    recs = S.BASE_RECOMMENDATIONS["High Risk"] + [t for _, t in S.FACTOR_RECOMMENDATIONS]
    assert a.recommendations == recs
    tl = dict(a.timeline)
    assert tl["immediate"] == recs[0:2]
    assert tl["week_1"] == [recs[1]]
    assert tl["month_1"] == []
    assert tl["ongoing"] == [recs[3], recs[5]]
    assert a.estimated_duration == "4-8 weeks" and a.priority_level == "High Risk"
    assert len(a.success_metrics) == 7
    assert a.next_steps == S.NEXT_STEPS["High Risk"]


def test_medium_and_low_timelines(spark):
    rows = [("S2", "M", 3.5, 0.95, 0.95, 90.0, 90.0, 10, 0, 1), ("S3", "L", 3.5, 0.95, 0.95, 90.0, 90.0, 10, 0, 0)]
    df = _df(spark, rows, SAMPLE_SCHEMA).withColumn("office_hours_visits", F.lit(2))
    m, low = sorted(I.with_analysis(df).collect(), key=lambda r: r.student_id)
    med = S.BASE_RECOMMENDATIONS["Medium Risk"]
    assert m.risk_factors == [] and m.recommendations == med
    assert dict(m.timeline) == {"week_1": [med[0]], "month_1": [med[3], med[4]], "ongoing": [med[2]]}
    assert dict(low.timeline) == {"ongoing": S.BASE_RECOMMENDATIONS["Low Risk"]}
    assert low.success_metrics == [] and low.estimated_duration == "2-4 weeks"


def test_summary_text_layout(spark):
    df = _df(spark, [("S1", "John Doe", 2.1, 0.65, 0.55, 45.0, 30.0, 3, 5, 2)], SAMPLE_SCHEMA)
    a = I.with_analysis(df)
    text = a.select(I.summary_text(F.col("name")).alias("t")).first().t
    ind = " " * 8
    factors = ", ".join(name for name, *_ in S.PLAN_FACTORS)
    recs = S.BASE_RECOMMENDATIONS["High Risk"][:3]
    steps = S.NEXT_STEPS["High Risk"][:3]
    expected = f"""
{ind}**Student Risk Analysis Summary for John Doe**
{ind}
{ind}**Risk Level:** High Risk
{ind}
{ind}**Key Risk Factors Identified:**
{ind}{factors}
{ind}
{ind}**Recommended Interventions:**
{ind}{chr(10).join(f'• {r}' for r in recs)}
{ind}
{ind}**Next Steps:**
{ind}{chr(10).join(f'• {s}' for s in steps)}
{ind}""".strip()
    assert text == expected


@pytest.mark.parametrize(
    "gpa,att,comp,label",
    [
        (2.49, 0.9, 0.9, 2), (2.5, 0.9, 0.9, 1), (2.99, 0.9, 0.9, 1), (3.0, 0.9, 0.9, 0),
        (3.5, 0.69, 0.9, 2), (3.5, 0.7, 0.9, 1), (3.5, 0.8, 0.9, 0),
        (3.5, 0.9, 0.59, 2), (3.5, 0.9, 0.6, 1), (3.5, 0.9, 0.75, 0),
        (None, 0.9, 0.9, 0), (float("nan"), 0.9, 0.9, 0), (None, None, None, 0),
    ],
)
def test_label_boundaries_null_and_nan(spark, gpa, att, comp, label):
    schema = "gpa double, attendance_rate double, assignment_completion double"
    df = R.nan_to_null(spark.createDataFrame([(gpa, att, comp)], schema))
    assert df.select(R.risk_label(df).alias("s")).first().s == label


def test_nan_never_flags(spark):
    """Spark orders NaN above every number; after normalisation it flags nothing."""
    df = spark.createDataFrame([(float("nan"),)], "gpa double")
    assert df.select((F.col("gpa") > 3).alias("x")).first().x is True  # the raw trap
    clean = R.nan_to_null(df)
    assert clean.select(R.is_true(F.col("gpa") < 2.5).alias("x")).first().x is False


def test_absent_column_defaults_vs_null_values(spark):
    """Absent LMS / office-hours columns flag; NULL values do not."""
    base = spark.createDataFrame([("a", 3.5, 0.9, 0.9, 90.0, 90.0)], "student_id string, gpa double, attendance_rate double, assignment_completion double, quiz_scores double, participation_score double")
    f1 = base.select(R.plan_factors(base).alias("f")).first().f
    assert f1 == ["Minimal LMS Engagement", "No Office Hours Visits"]
    with_nulls = base.withColumns({"lms_activity": F.lit(None).cast("int"), "office_hours_visits": F.lit(None).cast("int"), "late_submissions": F.lit(None).cast("int")})
    assert with_nulls.select(R.plan_factors(with_nulls).alias("f")).first().f == []


def test_category_mappings(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "s int")
    got = df.select(R.model_category(F.col("s")).alias("m"), R.agent_category(F.col("s")).alias("a")).collect()
    assert [r.m for r in got] == ["Low Risk", "Medium Risk", "High Risk", "Unknown", "Unknown"]
    assert [r.a for r in got] == ["Low Risk", "Medium Risk", "High Risk", "High Risk", "High Risk"]


def test_severity_and_subject_boundaries(spark):
    df = spark.createDataFrame([(2.5, 0.7, 0.8, 60.0, 75.0)], "gpa double, attendance_rate double, assignment_completion double, quiz_scores double, participation_score double")
    r = R.with_severity(df).first()
    assert (r.gpa_severity, r.attendance_rate_severity, r.assignment_completion_severity, r.quiz_scores_severity, r.participation_score_severity) == (0.5, 0.5, 0.0, 0.5, 0.0)
    s = spark.createDataFrame([(0.6, 50.0), (0.59, 90.0), (0.75, 65.0), (0.74, 90.0), (None, None)], "a double, p double")
    lv = [x.l for x in s.select(R.subject_level(F.col("a"), F.col("p")).alias("l")).collect()]
    assert lv == ["Medium Risk", "High Risk", "Low Risk", "Medium Risk", "Low Risk"]


def test_validation_messages_and_inclusive_bounds(spark):
    schema = "student_id string, name string, gpa double, attendance_rate double, assignment_completion double, quiz_scores double, participation_score double"
    edges = spark.createDataFrame([("a", "n", 0.0, 0.0, 1.0, 100.0, 5.0), ("b", "m", 4.0, 1.0, 0.0, 0.0, 5.0)], schema)
    v = Q.validation_verdict(edges).first()
    assert v.ok is True and v.messages == []
    bad = spark.createDataFrame([("a", "n", 4.01, -0.01, 1.01, 100.5, 5.0)], schema)
    v = Q.validation_verdict(bad).first()
    assert v.ok is False and v.messages == [m for *_, m in S.RANGE_RULES]
    nulls = spark.createDataFrame([("a", "n", None, 0.5, 0.5, 50.0, 5.0)], schema)
    assert Q.validation_verdict(nulls).first().messages == ["GPA values must be between 0 and 4"]
    missing = spark.createDataFrame([("a", 3.0, 0.5, 0.5, 5.0)], "student_id string, gpa double, attendance_rate double, assignment_completion double, participation_score double")
    assert Q.validation_verdict(missing).first().messages == ["Missing required columns: name, quiz_scores"]


def test_median_imputation_matches_pandas(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (5.0,), (None,)], "x double")
    out = [r.x for r in Q.impute_median(df, ["x"]).collect()]
    assert out[-1] == 3.0  # pandas / numpy median, not the ML Imputer's 2.0 (T8)


def test_label_before_imputation(spark):
    """A NULL gpa contributes nothing to the label even if its median is low."""
    df = spark.createDataFrame([(None, 0.9, 0.9), (2.0, 0.9, 0.9), (2.1, 0.9, 0.9)], "gpa double, attendance_rate double, assignment_completion double")
    rows = Q.prepare(df).collect()
    assert rows[0].risk_score == 0 and math.isclose(rows[0].gpa, 2.05)


def test_email_pattern(spark):
    df = spark.createDataFrame([("a.b@uni.edu",), ("not-an-email",), ("x@y.c",), (None,), ("",)], "email string")
    assert [r.v for r in df.select(R.email_valid(F.col("email")).alias("v")).collect()] == [True, False, False, False, False]


def test_medians_of_diverse_and_of_few_values(spark):
    df = spark.range(0, 10001).selectExpr(
        "case when id = 0 then null else cast(id as double) end as x",
        "case when id = 0 then null else cast(id % 3 as double) end as y", "cast(null as double) as z",
    )
    assert Q.column_medians(df, ["x", "y", "z"]) == {"x": 5000.5, "y": 1.0, "z": None}


@pytest.mark.parametrize("n,p", [(20001, 0.5), (20000, 0.5), (5000, 0.25), (1, 0.5), (2, 0.5)])
def test_exact_quantile_matches_percentile(spark, n, p):
    df = spark.range(n).selectExpr("rand(7) * 1000 - 300 + case when id % 5 = 0 then 1e6 else 0 end as v")
    want = df.agg(F.percentile("v", p).alias("q")).first().q
    assert Q.exact_quantile(df, "v", p, bins=16) == pytest.approx(want, rel=0, abs=1e-9)


def test_exact_quantile_hot_value(spark):
    df = spark.range(30000).selectExpr("case when id % 3 = 0 then 42.0 else rand(3) end as v")
    assert Q.exact_quantile(df, "v", 0.5, bins=8) == df.agg(F.median("v")).first()[0]


def test_exact_quantile_ends_on_infinities_and_extreme_ranges(spark):
    inf = float("inf")
    values = [-inf, -1.7e308, -1.0, 0.0, 5e-324, 1e-300, 2.0, 1.7e308, inf, inf, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted(v for v in values if v is not None and v == v)
    for k, v in enumerate(want):
        assert Q.exact_quantile(df, "v", k / (len(want) - 1), bins=4) == v
    assert Q.exact_quantile(spark.createDataFrame([(float(i),) for i in range(20)] + [(inf,)], "v double"), "v") == 10.0


def test_fixed_text_prints_as_python_does(spark):
    from cohort_risk.functions.numeric import fixed_text

    values = [0.0, 0.125, 2.675, 1.005, 2.5, 3.5, 99.95, 0.045, 100.0, 3.14159, -1.25, 0.999, 1e6 + 0.125, 12345.675, 0.35]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[fixed_text(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2)]).collect()
    for r in rows:
        assert (r.d0, r.d1, r.d2) == (f"{r.v:.0f}", f"{r.v:.1f}", f"{r.v:.2f}")
