"""Dashboard statistics kept up incrementally (E1-E3, E5-E8): mergeable partial states
per source file, so that after an append only new files are read.

A refresh compares the files of the scored table (path, length, time) with those the
store has states of, aggregates the new ones to one row per file and (branch, year,
section, risk category), and writes states and file list as a new part of the store.
A read merges the states of the files that are there now: what a deleted or rewritten
file had contributed is not counted. Sums are fixed to 9 decimals per average, as in
``aggregates``, so the result is that of a full run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import pct

DIMS = ["branch", "year", "section", "risk_category"]
MEASURES = ["gpa", "attendance_rate", "risk_probability"]
_FILE = ["path", "length", "modified"]


def files_of(spark: SparkSession, source: str) -> DataFrame:
    """The data files of a table as Spark's file system has them now (listed, not opened)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source)
    return found.select("path", "length", F.col("modificationTime").cast("double").alias("modified"))


def _store(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    whole = [p for p in parts if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}/{p}/_SUCCESS"))]
    return spark.read.parquet(*[f"{store}/{name}/{p}" for p in whole]) if whole else None


def refresh(spark: SparkSession, source: str, store: str) -> int:
    """Add the states of files that the store doesn't know; returns how many files were read.
    The file list is written last: a refresh that stops half-way leaves nothing that counts."""
    now, known = files_of(spark, source), _store(spark, store, "files")
    fresh = now if known is None else now.join(known.select(*_FILE), _FILE, "left_anti")
    rows = fresh.collect()  # what an append added
    if not rows:
        return 0
    part = uuid.uuid4().hex[:12]
    scored = spark.read.option("basePath", source).parquet(*[r["path"] for r in rows])
    sums = [x for m in MEASURES for x in (F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"))]
    states = scored.groupBy(F.col("_metadata.file_path").alias("path"), *DIMS).agg(F.count("*").alias("n"), *sums)
    states.withColumn("part", F.lit(part)).write.parquet(f"{store}/states/{part}")
    spark.createDataFrame([(*r, part) for r in rows], "path string, length long, modified double, part string").write.parquet(f"{store}/files/{part}")
    return len(rows)


def states(spark: SparkSession, source: str, store: str) -> DataFrame:
    """One merged state per (branch, year, section, risk category) of the files there now."""
    known, found = _store(spark, store, "files"), _store(spark, store, "states")
    if known is None or found is None:
        raise FileNotFoundError(f"{store} has no states; refresh it first")
    valid = known.join(files_of(spark, source), _FILE).select("path", "part").distinct()
    missing = files_of(spark, source).join(known.select(*_FILE), _FILE, "left_anti")
    if not missing.isEmpty():
        raise ValueError("the table has files that the store doesn't know; refresh it")
    merged = [F.sum(c).alias(c) for c in ("n", *[x for m in MEASURES for x in (f"sum_{m}", f"n_{m}")])]
    return found.join(valid, ["path", "part"]).groupBy(*DIMS).agg(*merged)


def _average(m: str, digits: int) -> Column:
    mean = F.try_divide(F.sum(f"sum_{m}"), F.sum(f"n_{m}").cast("double"))
    return F.bround(mean.cast("decimal(38,9)"), digits).cast("double")


def _high() -> Column:
    return F.coalesce(F.sum(F.when(F.col("risk_category") == "High Risk", F.col("n"))), F.lit(0)).cast("bigint")


def kpi_overview(merged: DataFrame) -> DataFrame:
    """E1 from states."""
    n, high = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint"), _high()
    return merged.agg(n.alias("total_students"), high.alias("high_risk_count"), F.bround(pct(high, n), 6).alias("high_risk_pct"), _average("gpa", 6).alias("avg_gpa"), _average("attendance_rate", 6).alias("avg_attendance"))


def risk_stats_by(merged: DataFrame, keys: list[str]) -> DataFrame:
    """E5-E7 from states, worst group first."""
    for k in keys:
        merged = merged.filter(F.col(k).isNotNull())
    n, high = F.sum("n").cast("bigint"), _high()
    return merged.groupBy(*keys).agg(
        n.alias("total_students"), _average("gpa", 2).alias("avg_gpa"), _average("attendance_rate", 2).alias("avg_attendance"),
        _average("risk_probability", 2).alias("avg_risk_pct"), high.alias("high_risk_count"), F.bround(pct(high, n), 1).alias("high_risk_pct"),
    ).orderBy(F.desc("high_risk_pct"), *keys)


def risk_distribution(merged: DataFrame) -> DataFrame:
    """E3 from states."""
    counts = merged.groupBy("risk_category").agg(F.sum("n").cast("bigint").alias("n_students"))
    total = merged.agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(total)).withColumn("pct", F.bround(pct(F.col("n_students"), F.col("total")), 6)).drop("total")  # one row
    return shares.orderBy(F.desc("n_students"), "risk_category")
