"""Partition-count invariance and cross-query identities."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from cohort_risk.operators import aggregates as A
from cohort_risk.plans import views as V
from tools.oracle_check import rows_of

from .conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_partition_invariance(spark, name):
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = E.queries()[name](spark, SF_SMALL)
        out.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]


def test_grouping_sets_equal_union_of_group_bys(spark):
    s = V.scored(spark, SF_SMALL)
    gs = A.risk_grouping_sets(s)
    for set_id, keys in ((3, ["branch"]), (5, ["year"]), (6, ["section"])):
        part = gs.filter(f"set_id = {set_id}").select(*keys, "total_students", "high_risk_count", "high_risk_pct")
        ref = A.risk_stats_by(s, keys).select(*keys, "total_students", "high_risk_count", "high_risk_pct")
        assert sorted(part.collect()) == sorted(ref.collect())


def test_category_counts_sum_to_n(spark):
    s = V.scored(spark, SF_SMALL)
    dist = A.risk_distribution(s).collect()
    assert sum(r.n_students for r in dist) == s.count()
    assert abs(sum(r.pct for r in dist) - 100) < 1e-6


def test_box_summary_equals_percentile(spark):
    s = V.scored(spark, SF_SMALL)
    got = {(r.risk_category, r.metric): tuple(r)[2:] for r in A.box_summary(s).collect()}
    for m in A.BOX_COLUMNS:
        q = F.percentile(F.col(m), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
        for r in s.groupBy("risk_category").agg(F.count(m).alias("n"), q.alias("q")).collect():
            assert got[r.risk_category, m] == (r.n, *[round(v, 6) for v in r.q])


def test_empty_slice_kpis_are_null_not_errors(spark):
    k = A.kpi_slice(V.scored(spark, SF_SMALL), branch="No Such Branch").first()
    assert (k.total_students, k.high_risk_count, k.high_risk_pct, k.avg_gpa) == (0, 0, None, None)
    d = A.risk_level_slice(V.scored(spark, SF_SMALL).limit(0), "High Risk").first()
    assert (d.n_students, d.avg_risk_pct) == (0, 0.0)


def test_correlation_constant_nan_and_missing(spark):
    df = spark.range(100).selectExpr("cast(id as double) as a", "cast(id * 2 + 1 as double) as b", "1.0d as c", "if(id % 2 = 0, double('NaN'), id) as d")
    got = {(r.col_x, r.col_y): (r.n, r.corr) for r in A.correlation_long(df, ["a", "b", "c", "d"]).collect()}
    assert got[("a", "b")] == (100, 1.0) and got[("a", "c")] == (100, None) and got[("b", "c")] == (100, None)
    assert got[("a", "d")] == (50, 1.0)
    assert [(r.n, r.corr) for r in A.correlation_long(df.limit(0), ["a", "b"]).collect()] == [(0, None)]
    with_null = df.withColumn("b", F.when(F.col("a") == 3, None).otherwise(F.col("b")))
    got = {(r.col_x, r.col_y): (r.n, r.corr) for r in A.correlation_long(with_null, ["a", "b"]).collect()}
    assert got[("a", "b")] == (99, 1.0)  # pairwise complete rows only


def test_empty_table_gives_zero_and_null_not_errors(spark):
    from cohort_risk.operators import decisions as D
    from cohort_risk.operators import quality as Q

    empty = V.scored(spark, SF_SMALL).limit(0)
    v = Q.validation_verdict(empty).first()
    assert v.ok is True and v.messages == []
    m = A.intervention_metrics(empty).first()
    assert (m.total_students, m.high_risk, m.high_risk_pct) == (0, 0, None)
    assert A.branch_risk_stats(empty).count() == 0 and A.risk_grouping_sets(empty).count() == 0
    assert Q.impute_features(empty).count() == 0
    assert D.decision_kpis(V.decisions(spark, SF_SMALL).limit(0)).first().approval_rate == 0.0
