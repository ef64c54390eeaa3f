"""Named queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and the
equivalent DuckDB SQL in ``ORACLE[name]`` (checked side by side by the
driver). Each query reads the driver's whole tables through the views of
``plans.views``; there is no row cap anywhere except where a top-k is the
feature itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco
