"""Softmax boosting: trees against a brute force of their own, both ways of finishing nodes, folds, persistence."""

import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohort_risk.operators import boosting as B
from cohort_risk.operators import model as M


def brute_force(x, y, rounds, depth, eta=0.1, reg=1.0, min_child=1.0):
    """Nested (feature, threshold, left, right) or value, splits tried one by one."""
    margin, out = np.zeros((len(x), 3)), []

    def grow(rows, g, h, level):
        total = (g[rows].sum(), h[rows].sum())
        best = (0, None)
        for f in range(x.shape[1]) if level < depth else []:
            for t in np.unique(x[:, f])[1:]:  # of splits alike for these rows the smallest threshold
                left = rows[x[rows, f] < t]
                gl, hl = g[left].sum(), h[left].sum()
                gr, hr = total[0] - gl, total[1] - hl
                if hl >= min_child and hr >= min_child:
                    gain = gl**2 / (hl + reg) + gr**2 / (hr + reg) - total[0] ** 2 / (total[1] + reg)
                    if gain > 1e-6 and gain > best[0] + 1e-9 * max(best[0], 1):
                        best = (gain, (f, t))
        if best[1] is None:
            return -eta * total[0] / (total[1] + reg)
        f, t = best[1]
        return f, t, grow(rows[x[rows, f] < t], g, h, level + 1), grow(rows[x[rows, f] >= t], g, h, level + 1), best[0]

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        e = np.exp(margin)
        p = e / e.sum(1, keepdims=True)
        trees = [grow(np.arange(len(x)), p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k]), 0) for k in range(3)]
        margin += np.array([[value(t, row) for t in trees] for row in x])
        out.append(trees)
    return out, margin


def nested(tree, node=0):
    depth = len(tree.value).bit_length() - 1
    level = (node + 1).bit_length() - 1
    if level < depth and tree.feature[node] >= 0:
        return int(tree.feature[node]), tree.threshold[node], nested(tree, 2 * node + 1), nested(tree, 2 * node + 2), tree.gain[node]
    return tree.value[(node + 1) * 2 ** (depth - level) - 2**depth]


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == b[:2] and np.isclose(a[4], b[4], rtol=1e-9) and same(a[2], b[2]) and same(a[3], b[3])
    return np.isclose(a, b, rtol=1e-9, atol=1e-12)


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(4)
    x = np.column_stack((r.normal(size=240).round(2), r.integers(0, 5, 240), r.normal(size=240), np.ones(240)))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * r.normal(size=240) > 0.8).astype(int) + (x[:, 2] > 0.9)
    rows = [(*map(float, row), int(k), i % 3) for i, (row, k) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, d double, y int, f int").repartition(3)


FEATURES = ["a", "b", "c", "d"]


@pytest.mark.parametrize("local_rows", [0, 60, 1000])
def test_trees_equal_brute_force_however_nodes_are_finished(small, local_rows):
    x, y, df = small
    (rounds,), _ = B.fit(df, FEATURES, "y", rounds=3, depth=3, local_rows=local_rows)
    expected, _ = brute_force(x, y, 3, 3)
    for r in range(3):
        for k in range(3):
            assert same(nested(rounds[r][k]), expected[r][k])


def test_scores_are_the_softmax_of_one_model_and_survive_saving(spark, small):
    x, y, df = small
    (rounds,), _ = B.fit(df, FEATURES, "y", rounds=4, depth=3)
    stage = B.BoostedTrees(B.node_rows(rounds, FEATURES), FEATURES)
    _, margin = brute_force(x, y, 4, 3)
    e = np.exp(margin)
    expected = {tuple(row): p for row, p in zip(x.tolist(), e / e.sum(1, keepdims=True), strict=True)}
    path = tempfile.mkdtemp(prefix="boost-") + "/m"
    PipelineModel([stage]).save(path)
    for model in (PipelineModel([stage]), PipelineModel.load(path)):
        for r in model.transform(df).select(*FEATURES, vector_to_array("probability").alias("p"), "prediction").collect():
            assert np.allclose(r.p, expected[r.a, r.b, r.c, r.d], atol=1e-12) and r.prediction == np.argmax(r.p)
    # the saved nodes are a relation: gains per feature are those of the importances
    nodes = spark.read.parquet(f"{path}/stages/0_{stage.uid}/nodes")
    assert nodes.filter("feature IS NULL").count() == nodes.filter("feature IS NOT NULL").count() + 12  # 12 trees
    by_nodes = {r.feature: r.importance for r in M.importance_by_nodes(M.node_relation(spark, PipelineModel([stage])), FEATURES, True).collect()}
    assert by_nodes == pytest.approx(dict(stage.importances())) and by_nodes["d"] == 0


def test_folds_fitted_together_equal_folds_fitted_alone(small):
    x, y, df = small
    models, held = B.fit(df, FEATURES, "y", rounds=3, depth=3, fold="f", folds=3)
    for m in range(3):
        alone = df.filter(F.col("f") != m)
        expected, _ = brute_force(x[np.arange(240) % 3 != m], y[np.arange(240) % 3 != m], 1, 3)
        n, right = held[m]
        assert n == 80 and right > 50
        (one,), _ = B.fit(alone, FEATURES, "y", rounds=1, depth=3)
        for k in range(3):  # cut points come from all rows, so splits fall between the same rows but not at the same value
            assert np.isclose(nested(models[m][0][k])[4], nested(one[0][k])[4], rtol=1e-9) and same(nested(one[0][k]), expected[0][k])


def test_missing_values_and_bounds(spark, small):
    _, _, df = small
    holes = df.withColumn("a", F.when(F.col("f") == 0, F.lit(None)).otherwise(F.col("a"))).withColumn("c", F.when(F.col("f") == 1, F.lit(float("nan"))).otherwise(F.col("c")))
    (rounds,), _ = B.fit(holes, FEATURES, "y", rounds=2, depth=2)
    stage = B.BoostedTrees(B.node_rows(rounds, FEATURES), FEATURES)
    assert stage.transform(holes).filter("prediction IS NULL").count() == 0
    with pytest.raises(ValueError, match="bins"):
        B.fit(df, FEATURES, "y", max_bins=1000)


def test_quantile_cuts_stay_within_the_bins(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    a, b = B.quantile_cuts(df, ["a", "b"], 16)
    assert 10 <= len(a) <= 15 and len(b) == 0 and (np.diff(a) > 0).all()


def test_rows_of_one_file_are_dealt_to_all_cores(small, monkeypatch):
    assert B.block_tasks(720_000, 12) == 12 and B.block_tasks(7_200_000, 12) == 24 and B.block_tasks(240, 8) == 1
    x, y, df = small
    monkeypatch.setattr(B, "FEW_ROWS", 60)
    monkeypatch.setattr(B, "LOCAL_BYTES", 0)  # and nodes are finished by whichever way moves less
    dealt, repartition = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *c: dealt.append((n, c)) or repartition(self, n, *c))
    (rounds,), _ = B.fit(df.coalesce(1), FEATURES, "y", rounds=2, depth=3, local_rows=60)
    assert dealt[0] == (min(4, df.sparkSession.sparkContext.defaultParallelism), ())
    expected, _ = brute_force(x, y, 2, 3)
    for r in range(2):
        for k in range(3):
            assert same(nested(rounds[r][k]), expected[r][k])


def test_only_the_smaller_child_of_a_node_is_added_up(monkeypatch):
    r = np.random.default_rng(7)
    bins = r.integers(0, 30, (4, 4000)).astype(np.uint8)
    g, h = r.normal(size=4000) + (bins[1] > 9) - 0.5 * (bins[2] > 20), np.full(4000, 0.25)
    added, histogram = [], B.histogram
    monkeypatch.setattr(B, "histogram", lambda slot, bins, *rest: added.append(bins.shape[1]) or histogram(slot, bins, *rest))
    tree = B.grow_in_memory(bins, g, h, 5, 30)
    rows = np.arange(4000)
    assert (tree.feature >= 0).sum() > 20 and sum(added) <= 4000 + 4 * 2000
    for node in range(31):  # the sums kept for a node are those of its rows
        of_node = rows[B.places(tree, bins, (node + 1).bit_length() - 1) == node]
        if node == 0 or tree.feature[(node - 1) // 2] >= 0:
            assert np.allclose(tree.sums[node], [g[of_node].sum(), h[of_node].sum(), len(of_node)], rtol=1e-9)


def test_a_fit_leaves_no_checkpoint_files(small, monkeypatch):
    from pathlib import Path

    _, _, df = small
    monkeypatch.setattr(B, "CUT_LINEAGE", 2)
    spark = df.sparkSession
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    files = lambda: {x for x in Path(folder).rglob("part-*")}
    before = files()
    B.fit(df, FEATURES, "y", rounds=5, depth=2, fold="f", folds=3)
    assert files() <= before


def test_a_model_scores_rows_by_thresholds_counted_once(spark, small):
    """Trees of bins give what the thresholds say, at a threshold, beyond all and for missing values."""
    _, _, df = small
    (rounds,), _ = B.fit(df, FEATURES, "y", rounds=3, depth=3)
    stage = B.BoostedTrees(B.node_rows(rounds, FEATURES), FEATURES)
    cuts, trees = stage.trees()
    assert len(trees) == 9 and all((np.diff(c) > 0).all() for c in cuts)
    own = [(float(t), 2.0, float(cuts[2][i % len(cuts[2])]), 1.0) for i, t in enumerate(cuts[0])] + [(-1e9, 9.0, None, 1.0), (float("inf"), None, float("nan"), None)]
    table = spark.createDataFrame(own, "a double, b double, c double, d double")

    def value(tree, row, node=0):
        if node >= len(tree.feature) or tree.feature[node] < 0:
            return tree.value[(node + 1) * 2 ** (3 - ((node + 1).bit_length() - 1)) - 8]
        v = row[tree.feature[node]]
        return value(tree, row, 2 * node + (1 if v is not None and v < tree.threshold[node] else 2))

    for r in stage.transform(table).select(*FEATURES, vector_to_array("rawPrediction").alias("m")).collect():
        assert np.allclose(r.m, [sum(value(own[k], r[:4]) for own in rounds) for k in range(3)], atol=1e-12)


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_margins_are_kept_every_few_rounds_only(small, monkeypatch, local_rows):
    from pyspark import RDD

    x, y, df = small
    monkeypatch.setattr(B, "KEEP", 3)
    kept, persist = [], RDD.persist
    monkeypatch.setattr(RDD, "persist", lambda self, *a: kept.append(1) or persist(self, *a))
    (rounds,), _ = B.fit(df, FEATURES, "y", rounds=7, depth=3, local_rows=local_rows)
    if local_rows:  # a job for each round: the first state, after round 3, after round 6
        assert len(kept) == 3
    expected, _ = brute_force(x, y, 7, 3)
    for r in range(7):
        for k in range(3):
            assert same(nested(rounds[r][k]), expected[r][k])


def test_a_row_moves_its_bins_and_one_number():
    r = np.random.default_rng(3)
    bins, label, fold = r.integers(0, 20, (4, 500)).astype(np.uint8), r.integers(0, 3, 500).astype(np.uint8), np.full(500, 255, np.uint8)
    margin = r.normal(size=(1, 3, 500))
    margin[0, 1, :5] = 2000  # probabilities of exactly 0 and 1
    local = [(0, k, 0, 0) for k in range(3)]
    moved = list(B._rows_of([[B.Tree.empty(3)] * 3], local, 3, 20, B._advance([], 3))(7, [(bins, label, fold, margin)] * 2))
    p = B.probabilities(margin[0])
    for key, (task, block, *own) in moved:
        g, h = p[key] - (label == key), np.maximum(2 * p[key] * (1 - p[key]), 1e-16)
        assert task == 7
        if block < 0:  # the sums of both blocks
            assert np.allclose(own[0], 2 * B.histogram(np.zeros(500, np.int64), bins, g, h, 1, 20)[:, 0], rtol=1e-12)
        else:
            assert sum(a.nbytes for a in own) == 500 * (4 + 8)
            assert all((a == b).all() for a, b in zip(B._gradients(own[1]), (g, h), strict=True))
    assert sorted((key, x[1]) for key, x in moved) == [(k, b) for k in range(3) for b in (-1, 0, 1)]


def test_scoring_needs_no_package_on_the_executors(small, monkeypatch):
    import pickle

    from pyspark import SparkContext

    _, _, df = small
    (rounds,), _ = B.fit(df, FEATURES, "y", rounds=1, depth=2)
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    assert B.BoostedTrees(B.node_rows(rounds, FEATURES), FEATURES).transform(df).count() == 240
    assert sent and b"cohort_risk" not in pickle.dumps(sent)


def test_cut_points_come_from_summaries_of_bounded_size(spark, monkeypatch):
    df = spark.range(0, 30_000, 1, 7).select(F.rand(3).alias("a"), (F.rand(4) * 30).cast("int").alias("b"), F.when(F.rand(5) < 0.3, None).otherwise(F.randn(6)).alias("c"), F.lit(None).cast("double").alias("d")).cache()

    def exact(c):
        v = np.sort(np.array([r[0] for r in df.select(F.col(c).cast("double")).dropna().collect()]))
        return np.unique([v[max(int(np.ceil(i / 255 * len(v))), 1) - 1] for i in range(256)])[1:]

    for c, cuts in zip("abc", B.quantile_cuts(df, ["a", "b", "c", "d"]), strict=False):
        assert np.array_equal(cuts, exact(c))
    assert not len(B.quantile_cuts(df, ["d"])[0])
    monkeypatch.setattr(B, "SUMMARY", 1000)
    monkeypatch.setattr(B, "MEET", 3)
    values, counts = B._thinned([(np.arange(5000.0), np.arange(5000))] * 2, 1000)
    assert len(values) <= 1000 and counts.sum() == 2 * np.arange(5000).sum()
    a, b = B.quantile_cuts(df, ["a", "b"])
    assert np.array_equal(b, exact("b"))
    v = np.sort(np.array([r.a for r in df.select("a").collect()]))
    assert len(a) == 255 and max(abs(np.searchsorted(v, x) / 30_000 - (i + 1) / 255) for i, x in enumerate(a)) < 0.006
    df.unpersist()


def test_histograms_that_meet_in_a_task_stay_bounded():
    node = 90 * 24 * 10 * 256  # of 90 tasks
    assert B.histogram_reducers(96, node, 6) == 8 and B.histogram_reducers(480, node, 6) == 40
    assert B.histogram_reducers(3, node, 6) == 3 and B.histogram_reducers(96, 6 * 24 * 10 * 256, 6) == 6
    assert B.histogram_reducers(4, B.REDUCER_BYTES * 3, 6) == 4
