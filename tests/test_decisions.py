"""Latest decision per key, change history, day arithmetic, joins."""

import datetime as dt

from pyspark.sql import functions as F

from cohort_risk.operators import decisions as D

SCHEMA = "student_id string, subject string, status string, decided_at timestamp_ntz, tie1 bigint, tie2 bigint, tie3 double, tie4 int"


def _log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def t(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_latest_wins_by_time_not_arrival(spark):
    rows = [
        ("S1", None, "approved", t(3), 1, 1, 1.0, 1),
        ("S1", None, "declined", t(1), 1, 1, 1.0, 1),  # arrives later, is older
        ("S1", "math", "declined", t(2), 1, 1, 1.0, 1),
        ("S1", "math", "approved", t(2), 2, 1, 1.0, 1),  # same time, tie broken by tie1
    ]
    cur = {(r.student_id, r.subject): r.status for r in D.current_decisions(_log(spark, rows)).collect()}
    assert cur == {("S1", None): "approved", ("S1", "math"): "approved"}


def test_cleared_at_cutoff(spark):
    rows = [("S1", None, "approved", t(1), 1, 1, 1.0, 1), ("S2", None, "declined", t(5), 1, 1, 1.0, 1)]
    cur = D.current_decisions(_log(spark, rows), cleared_at="2024-01-03 00:00:00").collect()
    assert [r.student_id for r in cur] == ["S2"]


def test_change_history(spark):
    rows = [
        ("S1", None, "approved", t(1), 1, 1, 1.0, 1),
        ("S1", None, "approved", t(2), 1, 1, 1.0, 1),
        ("S1", None, "declined", t(3), 1, 1, 1.0, 1),
        ("S1", None, "approved", t(4), 1, 1, 1.0, 1),
    ]
    ch = sorted(D.decision_changes(_log(spark, rows)).collect(), key=lambda r: r.decided_at)
    assert [(r.previous_status, r.status, r.changed_from) for r in ch] == [
        ("approved", "declined", t(2)),
        ("declined", "approved", t(3)),
    ]


def test_days_since_is_elapsed_seconds(spark):
    """23:00 on day 1 -> 01:00 on day 3 is 1 whole day, not 2."""
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23),)], "ts timestamp_ntz")
    r = df.select(D.days_since(F.col("ts"), "2024-01-03 01:00:00").alias("d"), F.datediff(F.lit("2024-01-03"), F.col("ts")).alias("dd")).first()
    assert (r.d, r.dd) == (1, 2)


def test_kpis_count_orphans_detail_drops_them(spark):
    students = spark.createDataFrame(
        [("S1", "A", "a@b.cd", "Civil", "1st Year", "A", "Fall 2024", 2.0, "High Risk", 1)],
        "student_id string, name string, email string, branch string, year string, section string, semester string, gpa double, risk_category string, ordinal int",
    )
    log = _log(spark, [("S1", None, "approved", t(1), 1, 1, 1.0, 1), ("S9", None, "declined", t(1), 1, 1, 1.0, 1)])
    k = D.decision_kpis(log).first()
    assert (k.total_decisions, k.approved, k.declined, k.approval_rate) == (2, 1, 1, 50.0)
    det = D.decision_detail(log, students).collect()
    assert [r.student_id for r in det] == ["S1"] and det[0].status == "Approved" and det[0].gpa == "2.00"
    assert [r.student_id for r in D.orphan_decisions(log, students).collect()] == ["S9"]


def test_duplicate_student_ids_first_and_last(spark):
    st = spark.createDataFrame([("S1", "first", 1), ("S1", "second", 2)], "student_id string, name string, ordinal int")
    assert D.first_students(st).first().name == "first"
    assert D.latest_students(st).first().name == "second"


def test_empty_decisions_rate_is_zero(spark):
    k = D.decision_kpis(_log(spark, [])).first()
    assert (k.total_decisions, k.approval_rate) == (0, 0.0)


def test_change_history_within_and_across_buckets(spark):
    rows = [
        ("S1", "math", "approved", dt.datetime(2024, 1, 1, 9), 1, 1, 1.0, 1),
        ("S1", "math", "declined", dt.datetime(2024, 1, 1, 17), 1, 1, 1.0, 1),  # same day
        ("S1", "math", "declined", dt.datetime(2024, 1, 4, 9), 1, 1, 1.0, 1),  # no flip
        ("S1", "math", "approved", dt.datetime(2024, 2, 1, 9), 1, 1, 1.0, 1),  # flip across empty days
        ("S2", None, "declined", dt.datetime(2024, 1, 1, 9), 1, 1, 1.0, 1),
        ("S2", None, "approved", dt.datetime(2024, 1, 2, 9), 1, 1, 1.0, 1),
    ]
    for bucket in ("month", "day", "hour", "year"):
        ch = D.decision_changes(_log(spark, rows), bucket=bucket).collect()
        got = sorted((r.student_id, r.status, r.previous_status, r.changed_from) for r in ch)
        assert got == [
            ("S1", "approved", "declined", dt.datetime(2024, 1, 4, 9)),
            ("S1", "declined", "approved", dt.datetime(2024, 1, 1, 9)),
            ("S2", "approved", "declined", dt.datetime(2024, 1, 1, 9)),
        ], bucket


def test_days_since_ignores_session_time_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23),)], "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert df.select(D.days_since(F.col("ts"), "2024-01-03 01:00:00").alias("d")).first().d == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
