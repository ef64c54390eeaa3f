"""End-to-end batch job over the fixture tables."""

import tempfile

from cohort_risk.plans import jobs
from cohort_risk.sources import fixtures as FX

from .conftest import SF_SMALL


def test_batch_job_end_to_end(spark):
    base = tempfile.mkdtemp(prefix="job-")
    FX.students(spark, SF_SMALL, with_fixture_probability=False, with_ordinal=True).write.parquet(f"{base}/students")
    FX.decisions(spark, SF_SMALL).write.parquet(f"{base}/decisions")
    written = jobs.run(spark, f"{base}/students", f"{base}/out", f"{base}/model", f"{base}/decisions", "random_forest")
    scored = spark.read.parquet(written["scored_students"])
    assert scored.count() == 1500
    assert spark.read.parquet(written["range_violation_rows"]).count() > 0  # NULL gpa / attendance / quiz rows
    assert spark.read.parquet(written["validation_verdict"]).first().ok is False
    assert set(r.semester for r in scored.select("semester").distinct().collect()) == {"Fall 2024", "Spring 2024", "Summer 2024"}
    assert spark.read.parquet(written["branch_risk_stats"]).count() == 8
    assert spark.read.parquet(written["approval_detail"]).count() > 0
    # second run loads the saved model instead of training
    again = jobs.run(spark, f"{base}/students", f"{base}/out2", f"{base}/model", model_type="random_forest")
    assert spark.read.parquet(again["scored_students"]).count() == scored.count()


def test_library_helpers(spark):
    import json

    from pyspark.sql import functions as F

    from cohort_risk.operators import model as M
    from cohort_risk.operators import quality as Q
    from cohort_risk.plans import views as V
    from cohort_risk.session import cluster_conf

    conf = cluster_conf(100 * 2**40, 8000)  # 100 TB on 8000 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 64000 and conf["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
    assert int(cluster_conf(10 << 20, 8)["spark.sql.shuffle.partitions"]) == 16
    # B5 + B6: numeric medians, absent engagement features synthesised
    raw = spark.createDataFrame([(3.0, None), (2.0, 0.9), (None, 0.7)], "gpa double, attendance_rate double")
    pre = Q.preprocess(raw).collect()
    assert [r.gpa for r in pre] == [3.0, 2.0, 2.5] and {"lms_activity", "previous_semester_gpa"} <= set(pre[0].asDict())
    # Scoring with the persisted feature list; an absent feature is filled with the training median
    data = V.scored(spark, SF_SMALL)
    res, _ = M.train(data, "random_forest")
    meds = {c: 1.0 for c in res.features}
    out = M.score_new(res.model, data.drop("late_submissions"), meds)
    assert out.count() == data.count() and out.filter(F.col("prediction_score").isNull()).count() == 0
    # analysis export
    from cohort_risk.operators import interventions as I

    js = I.with_analysis(data).select(F.to_json(I.analysis_struct()).alias("j")).first().j
    doc = json.loads(js)
    assert doc["analysis_complete"] is True and "timeline" in doc["intervention_plan"]


def test_job_command_line(spark, capsys):
    base = tempfile.mkdtemp(prefix="jobcli-")
    FX.students(spark, SF_SMALL, with_fixture_probability=False).write.parquet(f"{base}/students")
    jobs.main(["--students", f"{base}/students", "--out", f"{base}/out", "--model", f"{base}/model", "--model-type", "random_forest"])
    printed = capsys.readouterr().out
    assert "scored_students" in printed and "intervention_plans" in printed
    assert spark.read.parquet(f"{base}/out/intervention_plans").count() == 1500


HEAD = "student_id,name,gpa,attendance_rate,assignment_completion,quiz_scores,participation_score"


def _upload(header, rows):
    base = tempfile.mkdtemp(prefix="upload-")
    with open(f"{base}/in.csv", "w") as f:
        f.write("\n".join([header, *rows]) + "\n")
    return base


def _students(n):
    return [f"S{i},N{i},{1.5 + i % 26 / 10:.1f},{0.5 + i % 50 / 100:.2f},{0.4 + i % 60 / 100:.2f},{40 + i % 60},{30 + i % 70}" for i in range(n)]


def test_upload_of_the_required_columns_only(spark):
    """Absent features aren't learned from and keep their defaults."""
    base = _upload(HEAD, _students(300))
    written = jobs.run(spark, f"{base}/in.csv", f"{base}/out", f"{base}/model", model_type="random_forest")
    assert spark.read.parquet(written["scored_students"]).count() == 300
    plans = spark.read.parquet(written["intervention_plans"]).select("risk_factors").collect()
    first = {x for p in plans for x in p.risk_factors}
    every = set.intersection(*[set(p.risk_factors) for p in plans])
    assert len(every) >= 2 and every <= first  # the LMS and office hours defaults flag everyone
    assert spark.read.parquet(written["validation_verdict"]).first().ok is True


def test_upload_without_required_columns_is_named(spark):
    base = _upload("student_id,gpa,attendance_rate,assignment_completion,participation_score", ["S1,3.0,0.9,0.8,60"])
    written = jobs.run(spark, f"{base}/in.csv", f"{base}/out", f"{base}/model")
    v = spark.read.parquet(written["validation_verdict"]).first()
    assert v.ok is False and v.messages[0] == "Missing required columns: name, quiz_scores" and "scored_students" not in written


def test_wholly_null_feature_and_duplicate_ids(spark):
    from cohort_risk.operators import interventions as I

    rows = [r + "," for r in _students(300)]
    base = _upload(HEAD + ",lms_activity", rows + ["S1,Later,3.9,0.99,0.99,99,99,"])
    written = jobs.run(spark, f"{base}/in.csv", f"{base}/out", f"{base}/model", model_type="random_forest")
    scored = spark.read.parquet(written["scored_students"])
    assert scored.count() == 301
    # of the rows of one student the last in the file counts
    from cohort_risk.operators import decisions as D

    assert D.latest_students(scored.select("student_id", "name", "ordinal")).filter("student_id = 'S1'").first().name == "Later"
    assert I.notification_outbox(FX.decisions(spark, SF_SMALL), _with_duplicates(spark)).count() == I.notification_outbox(
        FX.decisions(spark, SF_SMALL), _with_duplicates(spark, 0)
    ).count()


def _with_duplicates(spark, n=300):
    from cohort_risk.plans import views as V

    s = V.scored(spark, SF_SMALL, with_ordinal=True)
    from pyspark.sql import functions as F

    return s.unionByName(s.limit(n).withColumn("ordinal", F.col("ordinal") + 10**9)) if n else s


def test_shared_view_follows_its_source(spark):
    import shutil

    from cohort_risk.plans import views as V

    base = tempfile.mkdtemp(prefix="source-")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    orders.write.parquet(f"{base}/orders.parquet")
    assert V.scored(spark, base).count() == 1500
    orders.limit(100).write.mode("append").parquet(f"{base}/orders.parquet")
    spark.catalog.clearCache()
    assert V.scored(spark, base).count() == 1600
    shutil.rmtree(f"{base}/orders.parquet")
    orders.limit(700).write.parquet(f"{base}/orders.parquet")
    assert V.scored(spark, base).count() == 700


def test_lookup_by_id_and_name(spark):
    from cohort_risk.operators import decisions as D
    from cohort_risk.plans import views as V

    s = V.scored(spark, SF_SMALL, with_ordinal=True)
    r = s.orderBy("ordinal").first()
    assert D.lookup(s, r.student_id).first().name == r.name and D.lookup(s, name=r.name).first().student_id == r.student_id
    plan = D.lookup(s, r.student_id)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(student_id), EqualTo(student_id," in plan
    assert D.lookup(s, "nobody").count() == 0
