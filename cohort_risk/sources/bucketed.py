"""Tables bucketed on the student id (storage-partitioned joins): students and the
decision log written once with the same buckets, so that whatever groups or joins them
by student moves neither again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

KEY = "student_id"


def write_bucketed(df: DataFrame, buckets: int, name: str = "bucketed", key: str = KEY) -> str:
    """``df`` as a table of ``buckets`` files by hash of ``key``, each sorted by it, under
    the shared folder; returns the table's name in the session's catalog. The rows move
    once, here."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    rows = df.repartition(buckets, F.col(key))  # a task per bucket
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, f"bucketed/{table}")).format("parquet").saveAsTable(table)
    return table


def pair(spark: SparkSession, students: DataFrame, decisions: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Students and decisions as co-bucketed tables."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tuple(spark.table(write_bucketed(df, n, name)) for df, name in ((students, "students"), (decisions, "decisions")))
