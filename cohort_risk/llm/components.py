"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins on the edge table; every round's
edges are written to the shared folder, so the plan stays short and a lost
executor costs one round at most. A node that holds a third of all edges is
reduced by partial aggregation and its joins may be split. Only a count and
a checksum reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = C.split_join(both, low, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = C.written(large, "components")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = C.split_join(large, low, ["u"]).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return C.written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "components")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (two long columns); a component
    is named by its smallest node."""
    a, b = edges.columns
    now = C.written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "components"
    )
    state = _state(now)
    while state[0]:
        then, now = state, _round(now)
        state = _state(now)
        if state == then:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
