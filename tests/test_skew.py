"""A third of all decisions on one student: results equal a brute-force
pandas computation on the small fixture."""

import pandas as pd
from pyspark.sql import functions as F

from cohort_risk.operators import decisions as D
from cohort_risk.plans import views as V
from cohort_risk.sources.fixtures import DECISION_ORDER

from .conftest import SF_SMALL


def _skewed(spark):
    log = V.decisions(spark, SF_SMALL)
    hot = (F.hash("tie1", "tie2", "tie4") % 3) == 0
    return log.withColumn("student_id", F.when(hot, F.lit("STU_HOT")).otherwise(F.col("student_id")))


def _pdf(df):
    p = df.toPandas()
    p["subject"] = p["subject"].fillna("<overall>")
    return p


def test_hot_key_share(spark):
    log = _skewed(spark)
    share = log.filter(F.col("student_id") == "STU_HOT").count() / log.count()
    assert 0.28 < share < 0.38


def test_current_decisions_under_skew(spark):
    log = _skewed(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = _pdf(D.current_decisions(log).select("student_id", "subject", "status", "decided_at"))
    p = _pdf(log).sort_values(DECISION_ORDER)
    want = p.groupby(["student_id", "subject"], as_index=False).tail(1)[["student_id", "subject", "status", "decided_at"]]
    key = ["student_id", "subject"]
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))


def test_change_history_under_skew(spark):
    log = _skewed(spark)
    got = _pdf(D.decision_changes(log, bucket="hour"))
    p = _pdf(log).sort_values(["student_id", "subject", *DECISION_ORDER])
    g = p.groupby(["student_id", "subject"])
    p["previous_status"] = g["status"].shift(1)
    p["changed_from"] = g["decided_at"].shift(1)
    want = p[p["previous_status"].notna() & (p["previous_status"] != p["status"])]
    cols = ["student_id", "subject", "status", "decided_at", "previous_status", "changed_from"]
    norm = lambda d: d[cols].sort_values(cols).reset_index(drop=True).astype(str)
    assert len(got) > 100
    pd.testing.assert_frame_equal(norm(got), norm(want))


def test_buckets_split_the_hot_key_and_the_log_moves_once(spark):
    log = _skewed(spark)
    months = log.filter(F.col("student_id") == "STU_HOT").select("subject", F.date_trunc("month", "decided_at")).distinct().count()
    assert months >= 4  # the hot student's history is spread over several groups
    plan = D.decision_changes(log)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan
