"""Synthetic student generator (A3): ``spark.range(n)`` plus seeded
Catalyst random expressions, so generation is distributed and every partition
is reproducible after a lost executor (``rand(seed)`` is seeded per
partition). The distributions are the reference's; numpy's exact random
stream is not reproduced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numeric import clip
from ..operators.quality import beta_int, poisson


def _choice(values: list[str], seed: int) -> Column:
    idx = F.floor(F.rand(seed) * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx)


def _numeric(kind: str, params: tuple, seed: int) -> Column:
    if kind == "normal":
        mu, sd = params
        return F.lit(mu) + F.randn(seed) * F.lit(sd)
    if kind == "beta":
        return beta_int(params[0], params[1], seed)
    return F.rand(seed)  # a uniform draw; turned into a Poisson count afterwards


def generate_students(spark: SparkSession, n: int, seed: int = S.SEED, partitions: int | None = None) -> DataFrame:
    """n students with ids STU_0001.. and the declared 28 columns."""
    ids = spark.range(1, n + 1, numPartitions=partitions) if partitions else spark.range(1, n + 1)
    number = F.col("id").cast("string")  # zero-padded to four digits, longer numbers as they are
    cols = {
        "student_id": F.concat(F.lit("STU_"), F.when(F.col("id") < 10_000, F.lpad(number, 4, "0")).otherwise(number)),
        "name": F.concat(F.lit("Student "), F.col("id").cast("string")),
        "email": F.concat(F.lit("student"), F.col("id").cast("string"), F.lit("@university.edu")),
    }
    k = 0
    for name, values in S.GENERATOR_CHOICES.items():
        k += 1
        cols[name] = _choice(values, seed * 100 + k)
    bounds, counts = {}, {}
    for name, kind, params, bnd in S.GENERATOR_NUMERIC:
        k += 1
        cols[name] = _numeric(kind, params, seed * 100 + k)
        if kind not in ("normal", "beta"):
            counts[name] = params[0]
        if bnd is not None:
            bounds[name] = bnd
    # Draw first, clip in a second projection: a clip written around the
    # random expression itself would copy it into lazily evaluated CASE
    # branches whose generators then fall out of step.
    drawn = ids.select(F.col("id").alias("ordinal"), *[c.alias(n_) for n_, c in cols.items()])
    drawn = drawn.withColumns({c: poisson(lam, F.col(c)) for c, lam in counts.items()})
    clipped = drawn.withColumns({c: clip(F.col(c), lo, hi) for c, (lo, hi) in bounds.items()})
    types = {f.name: f.dataType for f in S.STUDENT_SCHEMA.fields}
    return clipped.select("ordinal", *[F.col(c).cast(types[c]).alias(c) for c in S.STUDENT_COLUMNS])
