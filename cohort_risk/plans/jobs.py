"""Batch job: the application's upload -> score -> report flow as one Spark
job over whole tables, writing its outputs as tables.

    spark-submit ... -m cohort_risk.plans.jobs --students in/ --decisions log/ --out out/ --model models/risk [--retrain]

Steps: read students (CSV upload path or Parquet), quarantine malformed
rows, report range violations, label + impute, load the current version of the model
(train a first one, or a new one with ``--retrain``), score, write the
scored table partitioned by semester, then the dashboard aggregates, the
approval report and the notification outbox.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import decisions as D
from ..operators import interventions as I
from ..operators import model as M
from ..operators import model_store as MS
from ..operators import quality as Q
from ..sources import files as FS


def load_students(spark: SparkSession, path: str) -> FS.Upload:
    """The uploaded rows with their ingest ordinal (file order), what was
    rejected, and which declared columns are present, from CSV or Parquet."""
    if path.endswith(".csv") or path.rstrip("/").endswith("csv"):
        up = FS.read_students_csv(spark, path)
    else:
        df = spark.read.parquet(path)
        up = FS.Upload(df, df.limit(0), df.columns, [c for c in FS.S.STUDENT_COLUMNS if c not in df.columns])
    if "ordinal" not in up.rows.columns:
        up.rows = up.rows.withColumn("ordinal", F.monotonically_increasing_id())
    return up


def run(spark: SparkSession, students_path: str, out_dir: str, model_path: str, decisions_path: str | None = None,
        model_type: str = M.DEFAULT_MODEL, retrain: bool = False) -> dict[str, str]:
    out = out_dir.rstrip("/")
    up = load_students(spark, students_path)
    uploaded, rejected = up.rows, up.rejected
    written = {}

    def write(name: str, df: DataFrame, partition: list[str] | None = None) -> None:
        w = df.write.mode("overwrite")
        if partition:
            w = w.partitionBy(*partition)
        w.parquet(f"{out}/{name}")
        written[name] = f"{out}/{name}"

    write("rejected_rows", rejected)
    # the verdict sees the columns as uploaded, so a missing one is named (B1)
    write("validation_verdict", Q.validation_verdict(uploaded))
    if Q.missing_required_columns(uploaded):
        return written
    # As in the application's upload flow, every parseable row is scored
    # (NULLs are imputed); range validation is reported, not enforced.
    rows = FS.complete_columns(uploaded, leave=FS.S.FEATURE_COLUMNS)
    _, violations = Q.quarantine(rows)
    prepared = Q.prepare(rows)
    if retrain or MS.current(spark, model_path) is None:
        result, version = MS.retrain(spark, model_path, prepared, model_type)
        model = result.model
        write("model_training", spark.createDataFrame([(version.name, version.generation, model_type, result.accuracy)], "version string, generation int, model_type string, accuracy double"))
    else:
        model, version = MS.load_or_train(spark, model_path, prepared, model_type)
    scored = M.score_for_dashboard(model, prepared)
    absent = [c for c in FS.S.FEATURE_COLUMNS if c in up.missing and c in scored.columns]
    scored = scored.drop(*absent)  # NULL stand-ins a loaded model asked for
    FS.write_scored(scored, f"{out}/scored_students", fmt="parquet")  # partitioned by semester
    written["scored_students"] = f"{out}/scored_students"
    scored = spark.read.parquet(written["scored_students"])  # reuse the written table, lineage cut
    write("range_violation_rows", violations.select("student_id", "violations"))
    write("branch_risk_stats", A.branch_risk_stats(scored))
    write("risk_grouping_sets", A.risk_grouping_sets(scored))
    write("risk_distribution", A.risk_distribution(scored))
    write("factor_by_branch", A.factor_by_branch(scored))
    plans = I.with_analysis(scored)
    write("intervention_plans", plans.select("student_id", "plan_category", "risk_factors", "recommendations", "timeline",
                                             "next_steps", "success_metrics", "estimated_duration",
                                             I.summary_text(F.col("name")).alias("summary"),
                                             F.to_json(I.analysis_struct()).alias("analysis_json")))
    if decisions_path:
        log = spark.read.parquet(decisions_path)
        write("current_decisions", D.current_decisions(log))
        current = spark.read.parquet(written["current_decisions"])  # the reports start from the written state
        write("approval_detail", D.decision_detail(current, scored))
        write("branch_decision_summary", D.branch_decision_summary(current, scored))
        write("notification_outbox", I.notification_outbox(log, scored))
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--students", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--model", required=True)
    ap.add_argument("--decisions")
    ap.add_argument("--model-type", default=M.DEFAULT_MODEL, choices=["random_forest", "gbt"])
    ap.add_argument("--retrain", action="store_true", help="train on these students and publish a new version")
    a = ap.parse_args(argv)
    from ..session import build_session

    spark = build_session()
    for name, path in run(spark, a.students, a.out, a.model, a.decisions, a.model_type, a.retrain).items():
        print(name, path)


if __name__ == "__main__":
    main()
