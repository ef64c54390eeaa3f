"""File sources and sinks.

CSV uploads are read with the declared schema (no inference pass over the
data): fields are read as text and cast with ``try_cast``; a malformed value
(``gpa = abc``) quarantines its row instead of failing the job (T5).
Columns the file does not carry are added as typed NULLs and reported in
``missing`` so the absent-column defaults (T3) can tell "column absent"
from "value missing".
"""

from __future__ import annotations

import csv
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

CORRUPT = "_corrupt_record"


@dataclass
class Upload:
    rows: DataFrame  # well-formed rows, declared schema
    rejected: DataFrame  # raw text of malformed rows + the columns that failed
    present: list[str]  # columns the file carries (header order)
    missing: list[str]  # declared columns the file lacks


#: Fields that pandas reads as missing (fixed values).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]


def parse_header(line: str) -> list[str]:
    """Column names of a header line, quotes understood; a repeated name gets a number, as in pandas."""
    names: list[str] = []
    for c in next(csv.reader([line.lstrip("\ufeff")]), []):
        c, n = c.strip(), 1
        while c in names:
            c, n = f"{c.rsplit('.', 1)[0] if n > 1 else c}.{n}", n + 1
        names.append(c)
    return names


def read_headers(spark: SparkSession, path: str) -> dict[tuple[tuple[str, ...], bool], list[str]]:
    """The files of a CSV path by their own header line and by whether some line has an
    odd number of quotes, so that a quoted field may go on in the next line. One pass of
    text, split as Spark likes, reduced in every task; one row per file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.select("file", "at", F.monotonically_increasing_id().alias("i"), F.when(F.col("at") == 0, F.col("value")).alias("head"), (quotes % 2 == 1).alias("odd"))
    files: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("head", F.struct("at", "i")).alias("header"), F.bool_or("odd").alias("odd")).collect():
        files.setdefault((tuple(parse_header(r["header"])), r["odd"]), []).append(r["file"])
    return files


def _typed(c: str, kind: T.DataType):
    """Text to a declared type; whole numbers may be written 15.0."""
    if kind == T.StringType():
        return F.col(c)
    if isinstance(kind, T.IntegralType):
        d = F.col(c).try_cast("double")
        return F.coalesce(F.col(c).try_cast(kind), F.when(d == F.floor(d), d.cast("string").try_cast("decimal(38,0)").try_cast(kind)))
    return F.col(c).try_cast(kind)


def read_students_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> Upload:
    """A1: read a student CSV file or folder with the declared types, as pandas
    would: every file by its own header (files may order or lack columns
    differently), doubled quotes and line breaks inside quotes, the usual
    missing-value words, whole numbers written 15.0. Every field is read as
    text and cast with ``try_cast``; a row whose non-missing field does not cast
    (``gpa = abc``) is quarantined with the failing column names instead of
    failing the job (T5). The decision looks at all declared columns, so it
    does not depend on which columns a later query reads. Unknown columns are
    kept as text. Files without an unfinished quoted line are split by Spark; the others
    are read whole (``multi_line`` decides for all files alike)."""
    declared = {f.name: f.dataType for f in S.STUDENT_SCHEMA.fields}
    raw, cols = None, []
    for (header, odd), files in sorted(read_headers(spark, path).items()):
        text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        part = spark.read.schema(text).option("header", True).option("escape", '"').option("multiLine", odd if multi_line is None else multi_line).csv(files)
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
        cols += [c for c in header if c not in cols]
    if raw is None:
        raw = spark.createDataFrame([], T.StructType([]))
    raw = raw.select(*[F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in cols])
    typed = {c: _typed(f"`{c}`", declared.get(c, T.StringType())) for c in cols}
    checks = [F.when(F.col(c).isNotNull() & typed[c].isNull(), F.lit(c)) for c in cols if c in declared]
    bad = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
    tagged = raw.select(*[typed[c].alias(c) for c in cols], bad.alias(CORRUPT), *[F.col(f"`{c}`").alias(f"_raw_{c}") for c in cols])
    rows = tagged.filter(F.size(CORRUPT) == 0).select(*[f"`{c}`" for c in cols])
    rejected = tagged.filter(F.size(CORRUPT) > 0).select(
        F.col(CORRUPT).alias("bad_columns"), *[F.col(f"`_raw_{c}`").alias(c) for c in cols]
    )
    missing = [c for c in S.STUDENT_COLUMNS if c not in cols]
    return Upload(rows, rejected, list(cols), missing)


def complete_columns(df: DataFrame, leave: list[str] | None = None) -> DataFrame:
    """A2: add every absent declared column as a typed NULL, but those in
    ``leave``: an absent feature has a default of its own (T3) and isn't learned
    from, which a NULL column would hide."""
    add = {f.name: F.lit(None).cast(f.dataType) for f in S.STUDENT_SCHEMA.fields if f.name not in df.columns and f.name not in (leave or [])}
    return df.withColumns(add) if add else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; one file per task (no coalesce to a single writer)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_original(df: DataFrame, path: str) -> None:
    """A4: the dataset without the three model-derived columns."""
    write_csv(df.drop(*S.SCORED_COLUMNS, "p_high_risk"), path)


def write_scored(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> None:
    """A5: every column, scored. Parquet for large outputs, partitioned by
    semester by default so semester slices prune whole folders."""
    if fmt == "parquet":
        parts = partition_by if partition_by is not None else (["semester"] if "semester" in df.columns else [])
        w = df.write.mode("overwrite")
        if parts:
            w = w.partitionBy(*parts)
        w.parquet(path)
    else:
        write_csv(df, path)


def write_lookup(df: DataFrame, path: str, row_group_bytes: int = 8 << 20) -> None:
    """The scored table laid out for point lookups (D4): range-clustered and sorted by
    student_id, so an id lies in the one or two row groups whose bounds hold it, with
    Parquet Bloom filters on student_id and name, so a name opens the row groups that
    (almost surely) have it."""
    rows = df.repartitionByRange("student_id").sortWithinPartitions("student_id")
    w = rows.write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("parquet.enable.dictionary#student_id", "false")
    for c in ("student_id", "name"):
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.enable.dictionary#{c}", "false")
    w.parquet(path)


def write_decision_log(decisions: DataFrame, path: str, mode: str = "append") -> None:
    """The append-only decision log as Parquet partitioned by decision date,
    so reads of a time range prune whole folders (and a "clear all" cut-off
    becomes a partition filter)."""
    decisions.withColumn("decision_date", F.to_date("decided_at")).write.mode(mode).partitionBy("decision_date").parquet(path)


def write_approval_report(detail: DataFrame, base: str, now: dt.datetime | None = None) -> str:
    """The approval detail table under a run-dated folder; returns it."""
    stamp = (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d_%H%M%S")
    path = f"{base.rstrip('/')}/intervention_approval_report_{stamp}"
    write_csv(detail, path)
    return path


def preview(df: DataFrame, n: int = 5, order: str | None = "ordinal") -> DataFrame:
    """The first n rows (by ingest ordinal when there is one)."""
    if order and order in df.columns:
        return df.orderBy(order).limit(n)
    return df.limit(n)
