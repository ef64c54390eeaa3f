import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_risk.llm import whitening as WH
from cohort_risk.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<double>, label int"


def table(spark, vectors, parts=4):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def checked(df, vectors, components=32):
    """Rows against the definition, in exact integers and long doubles; ids may repeat."""
    kept = {i: v for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in kept.values()], dtype=object)
    n, d = x.shape
    s = x.sum(0)
    y = n * x - s  # n times the centred rows, exact
    deviation = {i: s if s < 2**63 else None for i, s in zip(kept, (y * y).sum(1), strict=True)}
    a = (y.astype(np.longdouble) / n).astype(float)
    _, sigma, w = np.linalg.svd(a)
    sigma, w = np.concatenate((sigma, np.zeros(d)))[:d], w.T
    e = sigma**2 / n
    cov = np.array([[float(sum(y[:, i] * y[:, j])) / n**3 for j in range(d)] for i in range(d)])
    assert np.abs((w * e) @ w.T - cov).max() <= 1e-9 * np.abs(cov).max()
    rank = int((sigma > 1e-9 * sigma[0]).sum())
    k = min(components, rank)
    rows = df.collect()
    assert len(rows) == n * k
    got = np.full((n, k), np.nan)
    place = {i: r for r, i in enumerate(kept)}
    for r in rows:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error == rows[0].identity_error <= 1e-4
        assert abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-9
        got[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9
    gaps = np.abs(np.diff(e))
    for c in range(k):
        own = a @ w[:, c] / math.sqrt(e[c])
        if min(gaps[max(c - 1, 0) : c + 1], default=1) > 1e-3 * e[0]:  # else the vector isn't determined
            assert min(np.abs(got[:, c] - own).max(), np.abs(got[:, c] + own).max()) < 1e-8 * max(1, np.abs(own).max())
    return rows


def test_equals_its_definition(spark):
    r = np.random.default_rng(1)
    v = (r.standard_normal((300, 12)) * 2.0 ** -np.arange(12)) @ r.standard_normal((12, 12)) + 5
    checked(WH.whiten(table(spark, v.tolist()), keep=["vec_id"]), v.tolist())


def test_only_the_first_components_and_a_common_offset(spark):
    r = np.random.default_rng(2)
    v = r.standard_normal((400, 40)) * np.linspace(3, 0.05, 40) + 1e4
    rows = checked(WH.whiten(table(spark, v.tolist()), keep=["vec_id"]), v.tolist())
    assert max(x.component for x in rows) == 32


def test_ill_conditioned_rows(spark):
    # variances from 10^12 down to that of single steps
    r = np.random.default_rng(3)
    v = np.column_stack((r.standard_normal(500) * 1e6, r.standard_normal(500) * 1e3, r.standard_normal(500), r.standard_normal(500) / 8))
    checked(WH.whiten(table(spark, v.tolist()), keep=["vec_id"]), v.tolist())


@pytest.mark.parametrize("vectors", [
    [[1, 2, 5], [2, 4, 5], [3, 7, 5], [1, 0, 5]],  # a constant dimension
    [[1, 2, 3], [2, 4, 6], [3, 6, 9], [9, 18, 27]],  # one direction
    [[float(i == j) for j in range(8)] for i in range(3)],  # more dimensions than rows
])
def test_directions_without_extent_are_left_out(spark, vectors):
    checked(WH.whiten(table(spark, vectors), keep=["vec_id"]), vectors)


def test_unusable_vectors_are_dropped_and_ties_stay(spark):
    r = np.random.default_rng(4)
    v = [*r.standard_normal((20, 3)).tolist(), None, [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 0.0], *[[1.0, 2.0, -3.0]] * 15]
    checked(WH.whiten(table(spark, v), keep=["vec_id"]), v)


def test_nothing_to_whiten(spark):
    for v in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]], [[], []]):
        got = WH.whiten(table(spark, v, 1))
        assert got.columns == ["vec_id", "embedding", "label", *WH.RESULT] and got.count() == 0


def test_short_vectors_end_in_zeros(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((30, 4)).tolist()
    short = [x[: i % 4 + 1] for i, x in enumerate(v)]
    checked(WH.whiten(table(spark, short), keep=["vec_id"]), [x + [0.0] * (4 - len(x)) for x in short])


def test_extra_and_clashing_columns_null_and_repeated_ids(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(None if i % 3 == 0 else 7, x, 1) for i, x in enumerate(r.standard_normal((30, 3)).tolist())], SCHEMA)
    got = WH.whiten(df.withColumn("component", F.lit("own")).withColumn("n", F.lit("own")).withColumn("i", F.lit("kept")))
    rows = got.collect()
    assert len(rows) == 90 and {x.n for x in rows} == {30} and {x.i for x in rows} == {"kept"} and sum(x.vec_id is None for x in rows) == 30


def test_deviations_stay_exact_when_large():
    x = np.array([[2**40, 0], [0, 2**40], [5, 7]], np.int64)
    total = [int(s) for s in x.sum(0)]
    exact = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
    assert WH.deviations(x, 3, total) == [e if e < 2**63 else None for e in exact]
    assert WH.deviations(x[:, :1] // 2**20, 3, [s // 2**20 for s in total[:1]]) == [sum((3 * int(c) - s) ** 2 for c, s in zip(row, [total[0] // 2**20], strict=True)) for row in x[:, :1] // 2**20]


def test_query(spark):
    found = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()}
    ids = sorted(found)
    assert ids == list(range(ids[0], ids[0] + len(ids)))
    df = QUERIES["op12_embedding_whitening"](spark, SF_SMALL).withColumn("vec_id", F.col("vec_id") - ids[0])
    checked(df, [found[i] for i in ids])
