"""Change history of decisions as a stream (G5, I2): every status flip with the status
before it, whatever order the decisions arrive in.

State is kept by Spark's own stateful aggregation, one entry per (student, subject,
month) with the decisions of that month, so a batch reads and writes only the months
it touches and a key that holds a third of the log is spread over its months. The
stream emits a word on every month that a batch touches: its first and its last
decision and the flips between them. A row that arrives late makes a new word on its
month. A keyed sink keeps the last word on each month; a read joins the months of a
key, whose ends tell whether the first decision of a month is a flip. Decisions that
agree in time, ties and status are one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.fixtures import DECISION_ORDER

KEY = ["student_id", "subject"]
INLINE = 32


def decision_words(stream: DataFrame, order: list[str] = DECISION_ORDER, inline: int = INLINE) -> DataFrame:
    """The stream of words on months: ``student_id``, ``subject``, ``month``, ``first`` and
    ``last`` (status and time) and ``flips``, superseded by a later word on the same
    month. ``inline`` has no effect: all months lie apart."""
    decision = F.struct(*[F.col(c) for c in order], F.col("status"))
    months = stream.groupBy(*KEY, F.trunc("decided_at", "month").alias("month")).agg(F.sort_array(F.collect_set(decision)).alias("_d"))
    pair = F.transform("_d", lambda d: F.struct(d["status"].alias("status"), d["decided_at"].alias("decided_at")))
    months = months.select(*KEY, "month", pair.alias("_d"))
    flips = F.filter(
        F.transform("_d", lambda d, i: F.struct(
            d["status"].alias("status"), d["decided_at"].alias("decided_at"),
            F.get("_d", i - 1)["status"].alias("previous_status"), F.get("_d", i - 1)["decided_at"].alias("changed_from"),
        )), lambda d: d["previous_status"] != d["status"],
    )
    return months.select(*KEY, "month", F.get("_d", F.lit(0)).alias("first"), F.get("_d", F.size("_d") - 1).alias("last"), flips.alias("flips"))


def joined_months(words: DataFrame) -> DataFrame:
    """Every flip, from the last word on each month."""
    before = F.lag("last").over(Window.partitionBy(*KEY).orderBy("month"))
    rows = words.select(*KEY, "first", "flips", before.alias("_before"))
    first = F.struct("first.status", "first.decided_at", F.col("_before.status").alias("previous_status"), F.col("_before.decided_at").alias("changed_from"))
    own = F.when(F.col("_before.status") != F.col("first.status"), F.array(first))
    return rows.select(*KEY, F.inline(F.concat(F.coalesce(own, F.filter("flips", lambda d: F.lit(False))), "flips")))
