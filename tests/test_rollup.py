"""Partial states per source file: equal to the full run after appends, rewrites and deletes."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cohort_risk.operators import aggregates as A
from cohort_risk.operators import rollup as RU
from cohort_risk.plans import views as V

from .conftest import SF_SMALL


def _same(spark, source, store):
    full, merged = spark.read.parquet(source), RU.states(spark, source, store)
    for ours, theirs in (
        (RU.kpi_overview(merged), A.kpi_overview(full)), (RU.risk_stats_by(merged, ["branch"]), A.branch_risk_stats(full)),
        (RU.risk_stats_by(merged, ["year"]).orderBy("year"), A.year_risk_stats(full)), (RU.risk_distribution(merged), A.risk_distribution(full)),
    ):
        assert ours.columns == theirs.columns and ours.collect() == theirs.collect()


def test_only_new_files_are_read_and_results_equal_a_full_run(spark):
    base = tempfile.mkdtemp(prefix="rollup-")
    source, store = f"{base}/scored", f"{base}/store"
    df = V.scored(spark, SF_SMALL).withColumn("half", F.pmod(F.xxhash64("student_id"), F.lit(3)))
    df.filter("half = 0").repartition(3).write.parquet(source)
    assert RU.refresh(spark, source, store) == 3 and RU.refresh(spark, source, store) == 0
    _same(spark, source, store)
    df.filter("half = 1").repartition(2).write.mode("append").parquet(source)
    with pytest.raises(ValueError, match="refresh"):
        RU.states(spark, source, store)
    assert RU.refresh(spark, source, store) == 2  # the files of the append
    _same(spark, source, store)
    # a rewritten table: old states no longer count
    df.filter("half = 2").repartition(2).write.mode("overwrite").parquet(source)
    spark.catalog.refreshByPath(source)
    assert RU.refresh(spark, source, store) == 2
    _same(spark, source, store)


def test_a_refresh_that_stopped_half_way_counts_nothing(spark):
    base = tempfile.mkdtemp(prefix="rollup-")
    source, store = f"{base}/scored", f"{base}/store"
    V.scored(spark, SF_SMALL).coalesce(1).write.parquet(source)
    with pytest.raises(FileNotFoundError):
        RU.states(spark, source, store)
    RU.refresh(spark, source, store)
    # states without a file list: what a stopped refresh leaves
    part = spark.read.parquet(f"{store}/states/*").withColumn("part", F.lit("stopped"))
    part.write.parquet(f"{store}/states/stopped")
    _same(spark, source, store)
