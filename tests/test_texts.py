"""Messages written out in full (the SQL side shares its text constants with
the library, so these are the independent check)."""

from pyspark.sql import functions as F

from cohort_risk.operators import interventions as I


def _bodies(spark, with_plan=False):
    rows = [("approved", "Mathematics"), ("approved", None), ("declined", "Mathematics"), ("declined", None)]
    df = spark.createDataFrame(rows, "status string, subject string")
    recs = F.array(*[F.lit(f"step {i}") for i in range(1, 8)]) if with_plan else None
    body = I.email_body(F.col("status"), F.lit("Ada"), F.col("subject"), F.lit("🔴 High Risk"), recs)
    out = df.select("status", "subject", body.alias("body"), I.email_subject_line(F.col("status"), F.col("subject")).alias("line")).collect()
    return {(r.status, r.subject): (r.line, r.body) for r in out}


CLOSING = """
Please expect to hear from your academic advisor within the next 2-3 business days to discuss the next steps.

If you have any questions, please don't hesitate to contact your academic advisor or the student support office.

Best regards,
Academic Support Team
            """


def test_notifications(spark):
    got = _bodies(spark)
    assert got["approved", "Mathematics"] == (
        "Academic Support Update - Mathematics - Approved Intervention",
        """
Dear Ada,

We are writing to inform you that your academic support intervention for **Mathematics** has been APPROVED by your academic advisor.

Subject: Mathematics
Risk Level: 🔴 High Risk
Status: APPROVED

This means that we will be providing you with additional academic support specifically for Mathematics to help you succeed in your studies.

"""
        + CLOSING,
    )
    assert got["approved", None] == (
        "Academic Support Update - Approved Intervention",
        """
Dear Ada,

We are writing to inform you that your academic support intervention has been APPROVED by your academic advisor.

Risk Level: 🔴 High Risk
Status: APPROVED

This means that we will be providing you with additional academic support to help you succeed in your studies.

"""
        + CLOSING,
    )
    assert got["declined", "Mathematics"] == (
        "Academic Support Update - Mathematics - Declined Intervention",
        """
Dear Ada,

We are writing to inform you that your academic support intervention for **Mathematics** has been DECLINED at this time.

Subject: Mathematics
Risk Level: 🔴 High Risk
Status: DECLINED

This means that we believe you are currently on track in Mathematics and do not require additional intervention at this moment.

However, we will continue to monitor your academic progress in Mathematics, and if you feel you need additional support, please don't hesitate to reach out to your academic advisor.

Best regards,
Academic Support Team
                """,
    )
    assert got["declined", None] == (
        "Academic Support Update - Declined Intervention",
        """
Dear Ada,

We are writing to inform you that your academic support intervention has been DECLINED at this time.

Risk Level: 🔴 High Risk
Status: DECLINED

This means that we believe you are currently on track and do not require additional intervention at this moment.

However, we will continue to monitor your academic progress, and if you feel you need additional support, please don't hesitate to reach out to your academic advisor.

Best regards,
Academic Support Team
                """,
    )


def test_plan_of_five_items_is_listed(spark):
    body = _bodies(spark, with_plan=True)["approved", None][1]
    assert "Your personalized support plan includes:\n1. step 1\n2. step 2\n3. step 3\n4. step 4\n5. step 5\n" in body and "step 6" not in body
    assert "personalized" not in _bodies(spark, with_plan=True)["declined", None][1]


def test_banners_and_alerts(spark):
    df = spark.createDataFrame([("High Risk", 80.1), ("Medium Risk", 80.0), ("Low Risk", 60.0), (None, 60.1)], "c string, r double")
    got = [tuple(r) for r in df.select(I.category_banner(F.col("c")).alias("b"), I.branch_alert_message(F.lit("Civil"), F.col("r")).alias("a")).collect()]
    assert got == [
        ("🚨 **HIGH RISK STUDENT** - Immediate intervention required!", "🚨 **CRITICAL:** Civil has extremely high risk levels!"),
        ("⚠️ **MEDIUM RISK STUDENT** - Monitoring and support recommended", "⚠️ **WARNING:** Civil requires immediate attention!"),
        ("✅ **LOW RISK STUDENT** - Regular monitoring sufficient", None),
        ("✅ **LOW RISK STUDENT** - Regular monitoring sufficient", "⚠️ **WARNING:** Civil requires immediate attention!"),
    ]


def test_summary(spark):
    df = spark.createDataFrame(
        [("Ada", "Low Risk", [], ["r1", "r2", "r3", "r4"], ["n1", "n2"])],
        "name string, plan_category string, risk_factors array<string>, recommendations array<string>, next_steps array<string>",
    )
    gap = "\n        \n        "
    assert df.select(I.summary_text(F.col("name")).alias("s")).first().s == (
        f"**Student Risk Analysis Summary for Ada**{gap}**Risk Level:** Low Risk{gap}**Key Risk Factors Identified:**\n        "
        f"No specific risk factors identified{gap}**Recommended Interventions:**\n        • r1\n• r2\n• r3{gap}**Next Steps:**\n        • n1\n• n2"
    )
