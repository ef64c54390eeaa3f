"""Spark ML model: split, training, probabilities, importances, persistence."""

import tempfile

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohort_risk.operators import model as M
from cohort_risk.plans import views as V

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def trained(spark):
    data = V.scored(spark, SF_SMALL)
    res, test = M.train(data, "random_forest")
    return data, res, test


def test_split_is_stratified(spark):
    data = V.scored(spark, SF_SMALL)
    tr, te = M.stratified_split(data)
    n = {r.risk_score: r["count"] for r in data.groupBy("risk_score").count().collect()}
    t = {r.risk_score: r["count"] for r in te.groupBy("risk_score").count().collect()}
    assert t == M.test_counts(n) and sum(t.values()) == -(-sum(n.values()) // 5)
    assert tr.count() + te.count() == data.count()


def test_accuracy_probability_importance(spark, trained):
    data, res, test = trained
    assert res.accuracy >= 0.85
    sums = test.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert sums.agg(F.min("s"), F.max("s")).first() == pytest.approx((1.0, 1.0))
    imp = M.feature_importance(res.model, res.features)
    assert sum(v for _, v in imp) == pytest.approx(1.0)
    rp = test.agg(F.min("risk_probability_model"), F.max("risk_probability_model")).first()
    assert 100 / 3 - 1e-9 <= rp[0] and rp[1] <= 100 + 1e-9


def test_persistence_roundtrip(spark, trained):
    data, res, _ = trained
    path = tempfile.mkdtemp(prefix="model-") + "/m"
    M.save(res, path)
    loaded = M.load(path)
    assert M.model_features(loaded) == res.features
    a = M.score(res.model, data).select("student_id", "prediction_score").orderBy("student_id").collect()
    b = M.score(loaded, data).select("student_id", "prediction_score").orderBy("student_id").collect()
    assert a == b
    assert M.load_or_train(spark, path, data, "random_forest") is not None
    with pytest.raises(ValueError, match="random_forest, not gbt"):
        M.load_or_train(spark, path, data, "gbt")


def test_unreadable_model_is_not_overwritten(spark, trained):
    import os

    path = tempfile.mkdtemp(prefix="model-") + "/m"
    M.save(trained[1], path)
    (part,) = [f for f in os.listdir(f"{path}/metadata") if f.startswith("part-")]
    with open(f"{path}/metadata/{part}", "w") as f:
        f.write("not a model")
    with pytest.raises(Exception):  # noqa: B017
        M.load_or_train(spark, path, trained[0], "random_forest")
    assert open(f"{path}/metadata/{part}").read() == "not a model"


def test_folds_are_stratified_and_nulls_take_saved_medians(spark, trained):
    data, res, _ = trained
    folds = M.fold_column(data).groupBy("risk_score", "fold").count().collect()
    size = {r.risk_score: r["count"] for r in data.groupBy("risk_score").count().collect()}
    assert len(folds) == 15 and all(abs(r["count"] / size[r.risk_score] - 0.2) < 0.02 for r in folds)
    blank = data.limit(5).withColumns({c: F.lit(None).cast("double") for c in res.features})
    out = M.score_new(res.model, blank.drop(res.features[0])).select("prediction_score").collect()
    assert len({r.prediction_score for r in out}) == 1


def test_training_report(spark):
    data = V.scored(spark, SF_SMALL)
    rep = M.training_report(data, "random_forest", k=2)
    assert 0.8 < rep["cv_mean"] <= 1 and rep["cv_std"] >= 0 and rep["accuracy"] >= 0.85
    assert sum(v for _, v in rep["importances"]) == pytest.approx(1.0)
    assert rep["confusion"].count() > 0 and rep["report"].count() > 0


def test_missing_class_fails_clearly(spark):
    data = V.scored(spark, SF_SMALL).filter(F.col("risk_score") != 0)
    with pytest.raises(ValueError, match="lack risk classes"):
        M.train(data)


def test_boosted_probabilities(spark):
    data = V.scored(spark, SF_SMALL)
    res, test = M.train(data, "gbt")
    assert res.accuracy >= 0.85
    s = test.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert s == pytest.approx((1.0, 1.0))


def test_forest_importances_from_nodes_equal_the_librarys(spark, trained):
    _, res, _ = trained
    nodes = M.node_relation(spark, res.model)
    by_nodes = {r.feature: r.importance for r in M.importance_by_nodes(nodes, res.features, False).collect()}
    assert by_nodes == pytest.approx(dict(M.feature_importance(res.model, res.features)))
    assert nodes.select("tree").distinct().count() == 100


def test_retrain_publishes_a_version_and_leaves_running_readers_alone(spark):
    from unittest import mock

    from cohort_risk import schema as S
    from cohort_risk.operators import model_store as MS

    data = V.scored(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="store-") + "/risk"
    assert MS.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        MS.load(spark, root)
    with mock.patch.dict(S.RF_PARAMS, {"numTrees": 5}):
        first, v1 = MS.load_or_train(spark, root, data, "random_forest")
        pinned, version = MS.load(spark, root)
        before = M.score(pinned, data).select("student_id", "p_high_risk").orderBy("student_id")
        rows = before.collect()
        retrained, v2 = MS.retrain(spark, root, data.filter("gpa > 2.2"), "random_forest")
    assert version == v1 and retrained.accuracy >= 0.8
    assert before.collect() == rows  # a reader pinned to a version keeps it
    assert MS.current(spark, root) == v2 and v2.generation == v1.generation + 1
    assert M.score(MS.load(spark, root)[0], data).select("student_id", "p_high_risk").orderBy("student_id").collect() != rows
    assert M.score(MS.load(spark, root, v1)[0], data).select("student_id", "p_high_risk").orderBy("student_id").collect() == rows
    # a version that a stopped retrain left behind is no version
    spark.range(1).write.parquet(f"{root}/versions/unfinished")
    assert MS.current(spark, root) == v2 and len(MS.versions(spark, root)) == 2
    with pytest.raises(ValueError, match="not gbt"):
        MS.load_or_train(spark, root, data, "gbt")


def test_split_is_exact_at_every_bin_size_and_for_repeated_ids(spark):
    from unittest import mock

    df = spark.range(3000).select(F.concat(F.lit("S"), "id").alias("student_id"), (F.col("id") % 7 % 3).cast("int").alias("risk_score"))
    sizes = {r[0]: r[1] for r in df.groupBy("risk_score").count().collect()}
    wanted, seen = M.test_counts(sizes), set()
    for read in (1, 50, 10_000):  # through all passes, some, none
        with mock.patch.object(M, "READ_ROWS", read):
            flagged = M.split_flag(df).filter("is_test")
            assert {r[0]: r[1] for r in flagged.groupBy("risk_score").count().collect()} == wanted
            seen.add(frozenset(r[0] for r in flagged.select("student_id").collect()))
    assert len(seen) == 1
    # sklearn's shares: 10, 5 and 2 rows of 17 give ceil(3.4) = 4 test rows, the odd one to the largest remainder
    assert M.test_counts({0: 10, 1: 5, 2: 2}) == {0: 2, 1: 1, 2: 1} and M.test_counts({0: 1}) == {0: 1}
    same = df.withColumn("student_id", F.lit("S1")).unionByName(df.limit(0))
    with mock.patch.object(M, "READ_ROWS", 10):
        flags = M.split_flag(same).groupBy("risk_score", "is_test").count().collect()
    assert all(r.is_test for r in flags) and len(flags) == 3  # rows of an id fall on one side


def test_training_rows_of_one_file_are_dealt_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(M, "DEALT_ROWS", 100)
    one = spark.range(1000).coalesce(1)
    dealt, wanted = M.dealt_out(one), min(10, spark.sparkContext.defaultParallelism)
    held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == wanted and max(held) < 2 * 1000 / wanted and dealt.distinct().count() == 1000
    assert M.dealt_out(dealt) is dealt  # even already
    few, none = spark.range(150).coalesce(1), spark.range(0)
    assert M.dealt_out(few) is few and M.dealt_out(none) is none


def test_scaler_medians_are_exact_and_selected_without_a_list_of_values(spark, monkeypatch):
    """A quantile summary of a millionth keeps up to a million values a column and task."""
    def refused(*_):
        raise AssertionError("percentile_approx")

    monkeypatch.setattr(M.F, "percentile_approx", refused)
    rows = [(float(i * 37 % 1000), None if i % 3 else float(i), None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    exprs = M.standardize_exprs(df, ["a", "b", "c"], with_medians=True)
    for c, median in (("a", 499.0), ("b", 498.0), ("c", 0.0)):  # the lower of two in the middle
        assert f", {median!r})" in exprs[c]


def test_large_parts_of_training_rows_are_dealt_to_more_than_the_cores(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(M, "DEALT_ROWS", 10)
    monkeypatch.setattr(M.B, "MANY_ROWS", 50)
    rows = spark.range(0, 400 * cores, 1, cores)
    dealt = M.dealt_out(rows)
    assert dealt.rdd.getNumPartitions() == 8 * cores and dealt.count() == 400 * cores
    assert M.dealt_out(dealt) is dealt
