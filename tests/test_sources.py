"""CSV upload path, generator statistics, sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from cohort_risk import schema as S
from cohort_risk.operators import quality as Q
from cohort_risk.sources import files as FS
from cohort_risk.sources import generator as G


def _csv(text):
    d = tempfile.mkdtemp(prefix="csv-")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_required_only_upload_and_missing_optional(spark):
    p = _csv("student_id,name,gpa,attendance_rate,assignment_completion,quiz_scores,participation_score\nS1,A,3.1,0.9,0.8,70,60\n")
    up = FS.read_students_csv(spark, p)
    assert up.rows.count() == 1 and up.rejected.count() == 0
    assert "lms_activity" in up.missing and "gpa" not in up.missing
    full = FS.complete_columns(up.rows)
    assert set(S.STUDENT_COLUMNS) <= set(full.columns)
    assert dict(full.dtypes)["lms_activity"] == "int"


def test_malformed_value_is_quarantined_not_fatal(spark):
    p = _csv("student_id,name,gpa,attendance_rate,assignment_completion,quiz_scores,participation_score\nS1,A,abc,0.9,0.8,70,60\nS2,B,3.0,0.9,0.8,70,60\n")
    up = FS.read_students_csv(spark, p)
    assert [r.student_id for r in up.rows.collect()] == ["S2"]
    assert [(r.bad_columns, r.gpa) for r in up.rejected.collect()] == [(["gpa"], "abc")]
    assert up.rows.select("student_id").count() == 1  # pruning does not let the bad row back in


def test_out_of_range_file_messages(spark):
    p = _csv("student_id,name,gpa,attendance_rate,assignment_completion,quiz_scores,participation_score\nS1,A,4.01,-0.01,1.01,100.5,60\n")
    v = Q.validation_verdict(FS.read_students_csv(spark, p).rows).first()
    assert v.messages == [m for *_, m in S.RANGE_RULES]


def test_generator_distributions(spark):
    df = G.generate_students(spark, 20000, partitions=4)
    assert df.count() == 20000 and df.select("student_id").distinct().count() == 20000
    s = df.agg(
        F.min("gpa").alias("gmin"), F.max("gpa").alias("gmax"), F.avg("attendance_rate").alias("att"),
        F.avg("lms_activity").alias("lms"), F.avg("study_group_participation").alias("sg"),
        F.countDistinct("branch").alias("nb"), F.min("quiz_scores").alias("qmin"), F.max("quiz_scores").alias("qmax"),
    ).first()
    assert 0.0 <= s.gmin and s.gmax <= 4.0 and 0.0 <= s.qmin and s.qmax <= 100.0
    assert abs(s.att - 0.8) < 0.01  # Beta(8, 2) mean
    assert abs(s.lms - 15) < 0.2  # Poisson(15)
    assert abs(s.sg - 0.3) < 0.01  # Beta(3, 7)
    assert s.nb == 8
    again = G.generate_students(spark, 20000, partitions=4)
    assert again.agg(F.sum("gpa")).first()[0] == df.agg(F.sum("gpa")).first()[0]  # seeded, reproducible


def test_synthesized_missing_features(spark):
    df = spark.createDataFrame([(3.0,)] * 2000, "gpa double")
    out = Q.synthesize_missing_features(df)
    s = out.agg(F.avg("late_submissions").alias("late"), F.avg("office_hours_visits").alias("oh"), F.max("previous_semester_gpa").alias("pmax")).first()
    assert abs(s.late - 2) < 0.15 and abs(s.oh - 3) < 0.2 and s.pmax <= 4.0


def test_sinks_roundtrip(spark):
    df = G.generate_students(spark, 50).withColumns({"risk_score": F.lit(1), "risk_category": F.lit("Medium Risk"), "risk_probability": F.lit(50.0)})
    base = tempfile.mkdtemp(prefix="sink-")
    FS.write_original(df, f"{base}/orig")
    back = spark.read.option("header", True).csv(f"{base}/orig")
    assert "risk_score" not in back.columns and back.count() == 50
    path = FS.write_approval_report(df.select("student_id"), base)
    assert "intervention_approval_report_" in path and spark.read.option("header", True).csv(path).count() == 50
    assert [r.ordinal for r in FS.preview(df, 5).collect()] == [1, 2, 3, 4, 5]


def test_decision_log_partitioned_by_date(spark):
    from cohort_risk.operators import decisions as D
    from cohort_risk.plans import views as V

    from .conftest import SF_SMALL

    base = tempfile.mkdtemp(prefix="log-")
    FS.write_decision_log(V.decisions(spark, SF_SMALL), f"{base}/log", mode="overwrite")
    log = spark.read.parquet(f"{base}/log")
    recent = log.filter(F.col("decision_date") >= F.lit("1997-01-01").cast("date"))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(decision_date" in plan
    cur = D.current_decisions(log.drop("decision_date")).count()
    assert cur == D.current_decisions(V.decisions(spark, SF_SMALL)).count()


HEAD = "student_id,name,gpa,attendance_rate,assignment_completion,quiz_scores,participation_score"


def test_csv_agrees_with_pandas(spark):
    """Column order per file, 15.0 in an integer column, missing-value words,
    doubled quotes, commas and line breaks inside quotes, quoted headers."""
    import pandas as pd

    d = tempfile.mkdtemp(prefix="csv-")
    texts = {
        "a.csv": HEAD + ',lms_activity\nS1,"O""Neil, Jo",2.0,0.8,0.5,70,60,15.0\nS2,"two\nlines",NA,0.9,0.8,70,60,\n',
        "b.csv": '"student_id","name","attendance_rate","gpa","assignment_completion","quiz_scores","participation_score"\nS3,C,0.7,3.5,0.6,n/a,NULL\n',
    }
    for n, t in texts.items():
        with open(os.path.join(d, n), "w") as f:
            f.write(t)
    up = FS.read_students_csv(spark, d)
    assert up.rejected.count() == 0
    got = {r.student_id: r.asDict() for r in up.rows.collect()}
    want = pd.concat([pd.read_csv(os.path.join(d, n)) for n in texts])
    for r in want.to_dict("records"):
        for c, v in r.items():
            assert got[r["student_id"]][c] == (None if pd.isna(v) else v), (r["student_id"], c)
    assert got["S1"]["lms_activity"] == 15 and got["S3"]["gpa"] == 3.5


def test_fractional_value_in_an_integer_column_is_rejected(spark):
    up = FS.read_students_csv(spark, _csv(HEAD + ",lms_activity\nS1,A,3.0,0.9,0.8,70,60,15.5\n"))
    assert [r.bad_columns for r in up.rejected.collect()] == [["lms_activity"]]


def test_repeated_header_names_and_empty_folder(spark):
    assert FS.parse_header('a,"b,c",a,a') == ["a", "b,c", "a.1", "a.2"]
    assert FS.read_students_csv(spark, _csv("")).rows.count() == 0


def test_generated_ids(spark):
    ids = [r.student_id for r in G.generate_students(spark, 10001).select("student_id").collect()]
    assert ids[0] == "STU_0001" and ids[-2:] == ["STU_10000", "STU_10001"]


def test_a_lookup_opens_few_row_groups(spark):
    """Scan metrics: rows read of a table of many row groups, by id and by name."""
    import tempfile

    from pyspark.sql import functions as F

    from cohort_risk.operators import decisions as D
    from cohort_risk.sources import files as FS

    path = tempfile.mkdtemp(prefix="lookup-") + "/t"
    n = 200_000
    df = spark.range(n).select(F.format_string("S%09d", "id").alias("student_id"), F.sha1(F.col("id").cast("string")).alias("name"), F.col("id").alias("ordinal"))
    FS.write_lookup(df.repartition(4, "name"), path, row_group_bytes=1 << 18)
    table = spark.read.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for found in (D.lookup(table, student_id="S000123456"), D.lookup(table, name=df.filter("id = 123456").first().name)):
            assert [r.ordinal for r in found.collect()] == [123456]
            leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
            assert leaves.apply(0).metrics().apply("numOutputRows").value() < n / 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_csv_files_are_split_unless_quotes_run_over_lines(spark):
    import os
    import tempfile

    from cohort_risk.sources import files as FS

    d = tempfile.mkdtemp(prefix="split-")
    with open(f"{d}/plain.csv", "w") as f:
        f.write(HEAD + "\n" + "".join(f'S{i},"A ""{i}""",3.0,0.9,0.8,70,60\n' for i in range(4000)))
    with open(f"{d}/breaks.csv", "w") as f:
        f.write(HEAD + "\n" + "".join(f'T{i},"two\nlines {i}",3.0,0.9,0.8,70,60\n' for i in range(50)))
    assert {odd: [os.path.basename(x) for x in files] for (_, odd), files in FS.read_headers(spark, d).items()} == {False: ["plain.csv"], True: ["breaks.csv"]}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        up = FS.read_students_csv(spark, d)
        names = {r.student_id: r.name for r in up.rows.select("student_id", "name").collect()}
        assert FS.read_students_csv(spark, f"{d}/plain.csv").rows.rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert names == {f"S{i}": f'A "{i}"' for i in range(4000)} | {f"T{i}": f"two\nlines {i}" for i in range(50)} and up.rejected.count() == 0
