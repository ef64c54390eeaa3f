"""Two-scan quantile selection: same values as a full sort, rows read and jobs counted."""

import pytest
from pyspark.sql import functions as F

from cohort_risk.operators import quality as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def want(df, keys, probs=PROBS):
    base = df.filter("v IS NOT NULL AND NOT isnan(v)")
    rows = base.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
    return {tuple(r[k] for k in keys): (r.n, r.q) for r in rows}


def same(got, expected):
    assert got.keys() == expected.keys()
    for g, (n, qs) in expected.items():
        assert got[g][0] == n and got[g][1] == pytest.approx(qs, rel=1e-14, abs=1e-300), g


SHAPES = {
    "continuous": "rand(7) * 1000 - 300",
    "heavy tail": "exp(20 * randn(3))",
    "a third is one value": "case when id % 3 = 0 then 42.0 else rand(3) * 100 end",
    "few values": "cast(id % 4 as double)",
    "missing": "case when id % 5 = 0 then null when id % 7 = 0 then double('NaN') else rand(2) end",
    "constant": "3.5D",
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("slack", [Q.SKETCH_SLACK, 0.0])
def test_quantiles_equal_a_full_sort(spark, shape, slack):
    """Without slack some brackets miss their ranks; the values are still exact."""
    df = spark.range(30011).selectExpr("nullif(id % 4, 3) as g", f"{SHAPES[shape]} as v").persist()
    same(Q.sketched_quantiles(df, ["g"], "v", PROBS, slack=slack), want(df, ["g"]))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 22, 21])
def test_few_rows(spark, n):
    df = spark.range(n).selectExpr("'a' as g", "cast(id * id as double) as v")
    same(Q.sketched_quantiles(df, ["g"], "v", PROBS), want(df, ["g"]))


def test_ranks_beyond_every_bracket(spark):
    """A sketch of eight values is far off; nothing but the counted rows decides."""
    df = spark.range(20000).selectExpr("'a' as g", "rand(11) as v").persist()
    same(Q.sketched_quantiles(df, ["g"], "v", PROBS, k=8, slack=0.0), want(df, ["g"]))


def test_infinities(spark):
    inf = float("inf")
    values = [-inf, -1.7e308, -1.0, 0.0, 5e-324, 1e-300, 2.0, 1.7e308, inf, inf, None, float("nan")]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    ordered = sorted(v for v in values if v is not None and v == v)
    got = Q.sketched_quantiles(df, ["g"], "v", [i / (len(ordered) - 1) for i in range(len(ordered))])
    assert got == {("a",): (len(ordered), ordered)}


def test_only_groups_with_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None), ("c", None)], "g string, v double")
    assert Q.sketched_quantiles(df, ["g"], "v", [0.5], missing_only=True) == {("b",): (1, [1.0])}


@pytest.mark.parametrize("expr", ["rand(5)", "exp(20 * randn(3))", "case when id % 3 = 0 then 0.25 else rand(9) end"])
def test_two_scans_and_as_many_jobs_at_every_size(spark, expr):
    sc, jobs = spark.sparkContext, []
    for n in (50_000, 800_000):
        read = sc.accumulator(0)

        def counted(batches, read=read):
            for b in batches:
                read.add(b.num_rows)
                yield b

        df = spark.range(n).selectExpr("id % 2 as g", f"{expr} as v").mapInArrow(counted, "g long, v double")
        sc.setJobGroup(f"quantiles {n} {expr}", "")
        try:
            Q.sketched_quantiles(df, ["g"], "v", [0.1, 0.25, 0.5, 0.75, 0.9])
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"quantiles {n} {expr}")))
        assert read.value == 2 * n
    assert jobs[0] == jobs[1] <= 16  # a job for each shuffle stage and broadcast
