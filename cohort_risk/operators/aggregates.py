"""Slices and dashboard aggregates.

Every grouped statistic is a single ``groupBy().agg()`` with conditional
aggregates (``count_if``) instead of a second group-by plus an index-aligned
join: one scan, one map-side partial aggregate, one shuffle of at most
(#groups x #tasks) rows. Hot groups (one branch holding a third of all rows)
are harmless because the partial aggregate collapses them before the shuffle.
Output doubles use half-even rounding (pandas ``round``) where the dashboard
rounds, and 6 digits elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import rules as R
from ..functions.numeric import avg_round, count_if, pct

DIMENSIONS = ["branch", "year", "section"]


# ------------------------------------------------------------------ slices ----


def slice_students(df: DataFrame, branch: str | None = None, year: str | None = None, section: str | None = None) -> DataFrame:
    """Optional equality filters, AND-combined; ``None`` (or an 'All ...'
    choice) means no filter (D1). Pushed down to the scan by Catalyst."""
    for col, value in (("branch", branch), ("year", year), ("section", section)):
        if value is not None and not str(value).startswith("All "):
            df = df.filter(F.col(col) == F.lit(value))
    return df


def risk_level_slice(df: DataFrame, level: str) -> DataFrame:
    """Count and average risk of one category; average 0 when empty."""
    sel = df.filter(F.col("risk_category") == F.lit(level))
    return sel.agg(
        F.lit(level).alias("risk_category"),
        F.count(F.lit(1)).cast("bigint").alias("n_students"),
        F.coalesce(avg_round(F.col("risk_probability"), 6), F.lit(0.0)).alias("avg_risk_pct"),
    )


def filter_values(df: DataFrame) -> DataFrame:
    """Distinct values of each dimension, long form (dimension, value) (D3).
    One Expand + hash aggregate instead of three distinct scans."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in DIMENSIONS if d in df.columns])
        ).alias("kv")
    ).select("kv.dimension", "kv.value")
    return long.filter(F.col("value").isNotNull()).distinct()


# ------------------------------------------------------------------- KPIs ----


def _kpi_aggs() -> list[Column]:
    n = F.count(F.lit(1))
    high = count_if(F.col("risk_category") == "High Risk")
    return [
        n.cast("bigint").alias("total_students"),
        high.alias("high_risk_count"),
        F.bround(pct(high, n), 6).alias("high_risk_pct"),
        avg_round(F.col("gpa"), 6).alias("avg_gpa"),
        avg_round(F.col("attendance_rate"), 6).alias("avg_attendance"),
    ]


def kpi_overview(df: DataFrame) -> DataFrame:
    """Total, high-risk count and %, average GPA and attendance.
    Empty input gives NULL percentages/averages instead of an error."""
    return df.agg(*_kpi_aggs())


def kpi_slice(df: DataFrame, branch=None, year=None, section=None) -> DataFrame:
    """KPIs after a dimension slice."""
    return kpi_overview(slice_students(df, branch, year, section))


def risk_distribution(df: DataFrame) -> DataFrame:
    """Count and share per category (E3). The share uses a window over the
    (at most four) aggregated rows, not over the students."""
    counts = df.groupBy("risk_category").agg(F.count(F.lit(1)).cast("bigint").alias("n_students"))
    total = F.sum("n_students").over(Window.partitionBy())
    return counts.withColumn("pct", F.bround(pct(F.col("n_students"), total), 6)).orderBy(
        F.desc("n_students"), "risk_category"
    )


def factor_frequency(df: DataFrame) -> DataFrame:
    """How many students carry each dashboard risk factor."""
    return (
        df.select(F.explode(R.chart_factors()).alias("factor"))
        .groupBy("factor")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_students"))
        .orderBy(F.desc("n_students"), "factor")
    )


# ------------------------------------------------------ grouped statistics ----


def _group_aggs(with_attendance: bool = True) -> list[Column]:
    n = F.count(F.lit(1))
    high = count_if(F.col("risk_category") == "High Risk")
    aggs = [n.cast("bigint").alias("total_students"), avg_round(F.col("gpa"), 2).alias("avg_gpa")]
    if with_attendance:
        aggs.append(avg_round(F.col("attendance_rate"), 2).alias("avg_attendance"))
    aggs += [
        avg_round(F.col("risk_probability"), 2).alias("avg_risk_pct"),
        high.alias("high_risk_count"),
        F.bround(pct(high, n), 1).alias("high_risk_pct"),
    ]
    return aggs


def risk_stats_by(df: DataFrame, keys: list[str], with_attendance: bool = True, order: str = "high") -> DataFrame:
    """Per-group count, averages (2 dp), high-risk count and % (1 dp)
    (E5-E8). NULL keys are dropped, as pandas ``groupby`` does (T10)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    out = df.filter(cond).groupBy(*keys).agg(*_group_aggs(with_attendance))
    if order == "high":
        return out.orderBy(F.desc("high_risk_pct"), *keys)
    return out.orderBy(*keys)


def branch_risk_stats(df: DataFrame) -> DataFrame:
    return risk_stats_by(df, ["branch"], order="high")


def year_risk_stats(df: DataFrame) -> DataFrame:
    return risk_stats_by(df, ["year"], order="key")


def section_risk_stats(df: DataFrame) -> DataFrame:
    return risk_stats_by(df, ["section"], order="key")


def combined_risk_stats(df: DataFrame) -> DataFrame:
    return risk_stats_by(df, ["branch", "year", "section"], with_attendance=False, order="high")


def risk_grouping_sets(df: DataFrame) -> DataFrame:
    """E5-E8 in one scan: GROUPING SETS ((branch), (year), (section),
    (branch, year, section)). ``set_id`` = 4*g(branch) + 2*g(year) + g(section).
    A group whose own key is NULL is removed (T10)."""
    n = F.count(F.lit(1))
    high = count_if(F.col("risk_category") == "High Risk")
    g = df.groupingSets(
        [[F.col("branch")], [F.col("year")], [F.col("section")], [F.col("branch"), F.col("year"), F.col("section")]],
        "branch",
        "year",
        "section",
    ).agg(
        (F.grouping("branch") * 4 + F.grouping("year") * 2 + F.grouping("section")).cast("int").alias("set_id"),
        n.cast("bigint").alias("total_students"),
        avg_round(F.col("gpa"), 2).alias("avg_gpa"),
        avg_round(F.col("attendance_rate"), 2).alias("avg_attendance"),
        avg_round(F.col("risk_probability"), 2).alias("avg_risk_pct"),
        high.alias("high_risk_count"),
        F.bround(pct(high, n), 1).alias("high_risk_pct"),
    )
    keep = (
        ((F.col("set_id") != 3) | F.col("branch").isNotNull())
        & ((F.col("set_id") != 5) | F.col("year").isNotNull())
        & ((F.col("set_id") != 6) | F.col("section").isNotNull())
        & ((F.col("set_id") != 0) | (F.col("branch").isNotNull() & F.col("year").isNotNull() & F.col("section").isNotNull()))
    )
    return g.filter(keep)


def high_risk_by_branch(df: DataFrame) -> DataFrame:
    """High-risk students per branch: count, avg risk, avg GPA."""
    return (
        df.filter((F.col("risk_category") == "High Risk") & F.col("branch").isNotNull())
        .groupBy("branch")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("high_risk_students"),
            avg_round(F.col("risk_probability"), 2).alias("avg_risk_pct"),
            avg_round(F.col("gpa"), 2).alias("avg_gpa"),
        )
        .orderBy(F.desc("high_risk_students"), "branch")
    )


def branch_comparison(df: DataFrame) -> DataFrame:
    """Per-branch averages used for a student's comparison."""
    return (
        df.filter(F.col("branch").isNotNull())
        .groupBy("branch")
        .agg(
            avg_round(F.col("gpa"), 2).alias("avg_gpa"),
            avg_round(F.col("attendance_rate"), 2).alias("avg_attendance"),
            avg_round(F.col("risk_probability"), 2).alias("avg_risk_pct"),
            F.count("student_id").cast("bigint").alias("student_count"),
        )
    )


def factor_by_branch(df: DataFrame) -> DataFrame:
    """Branch x factor crosstab with zeros, one pass of five ``count_if``
    (E12). Branches without any factor keep a row of zeros."""
    aggs = [
        count_if(F.col(c) < F.lit(t)).alias(name.lower().replace(" ", "_")) for name, c, t in S.CHART_FACTORS
    ]
    return df.filter(F.col("branch").isNotNull()).groupBy("branch").agg(*aggs)


# ------------------------------------------------------------ distributions ----

# Fixed-width histogram bins: (column, bin width, number of bins).
HISTOGRAM_BINS = [
    ("gpa", 0.25, 16),
    ("attendance_rate", 0.05, 20),
    ("assignment_completion", 0.05, 20),
    ("quiz_scores", 5.0, 20),
]


def histograms(df: DataFrame) -> DataFrame:
    """Counts per fixed-width bin for the four distribution charts.
    Values on the top edge fall in the last bin; NULLs are skipped."""
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                F.least(F.lit(n - 1), F.floor(F.col(c) / F.lit(w))).cast("int").alias("bin"),
            )
            for c, w, n in HISTOGRAM_BINS
        ]
    )
    width = F.when(F.col("metric") == "gpa", 0.25).when(F.col("metric") == "quiz_scores", 5.0).otherwise(0.05)
    long = df.select(F.inline(parts)).filter(F.col("bin").isNotNull())
    return (
        long.groupBy("metric", "bin")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_students"))
        .withColumn("bin_start", F.bround(F.col("bin") * width, 6))
    )


BOX_COLUMNS = ["gpa", "attendance_rate", "assignment_completion", "quiz_scores"]


def box_summary(df: DataFrame) -> DataFrame:
    """Five-number summary per (risk category, metric) (E15): the metrics are
    unpivoted and all groups selected together by ``sketched_quantiles``. The
    result has one row per category and metric."""
    from .quality import sketched_quantiles

    long = df.select(
        F.coalesce(F.col("risk_category"), F.lit("Unknown")).alias("risk_category"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in BOX_COLUMNS])),
    )
    names = ["min", "q1", "median", "q3", "max"]
    res = sketched_quantiles(long, ["risk_category", "metric"], "value", [0.0, 0.25, 0.5, 0.75, 1.0])
    rows = [(*g, n, *[None if v is None else float(v) for v in qs]) for g, (n, qs) in res.items()]
    schema = "risk_category string, metric string, n bigint, " + ", ".join(f"{nm} double" for nm in names)
    return df.sparkSession.createDataFrame(rows, schema).select("risk_category", "metric", "n", *[F.bround(nm, 6).alias(nm) for nm in names])


def intervention_metrics(df: DataFrame) -> DataFrame:
    """Totals, category counts, intervention needs and category shares in one
    aggregate (E16). ``engagement_score`` counts only when present."""
    n = F.count(F.lit(1))
    hi = count_if(F.col("risk_category") == "High Risk")
    md = count_if(F.col("risk_category") == "Medium Risk")
    lo = count_if(F.col("risk_category") == "Low Risk")
    eng = count_if(F.col("engagement_score") < 0.3) if "engagement_score" in df.columns else F.lit(0).cast("bigint")
    return df.agg(
        n.cast("bigint").alias("total_students"),
        hi.alias("high_risk"),
        md.alias("medium_risk"),
        lo.alias("low_risk"),
        count_if(F.col("gpa") < 2.5).alias("tutoring"),
        count_if(F.col("attendance_rate") < 0.7).alias("attendance_support"),
        count_if(F.col("assignment_completion") < 0.6).alias("assignment_help"),
        eng.alias("engagement_boost"),
        F.bround(pct(hi, n), 6).alias("high_risk_pct"),
        F.bround(pct(md, n), 6).alias("medium_risk_pct"),
        F.bround(pct(lo, n), 6).alias("low_risk_pct"),
    )


# ------------------------------------------------------------ correlation ----


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair (i < j) over the rows complete in
    that pair (E13). One pass for the means, one for a distributed Gram matrix
    of [centred value or 0, its square, presence]: its blocks are the counts,
    sums, squares and products of every pair, so no row fans out and tasks
    ship one small matrix. A pair without variation is NULL (T7); NaN and
    infinities count as missing."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    k, inf = len(cols), F.lit(float("inf"))
    value = [F.when((F.col(c).cast("double") < inf) & (F.col(c).cast("double") > -inf), F.col(c).cast("double")) for c in cols]
    clean = df.select(*[v.alias(f"_c{i}") for i, v in enumerate(value)])
    means = clean.agg(*[F.avg(f"_c{i}").alias(f"_c{i}") for i in range(k)]).first()
    x = [F.coalesce(F.col(f"_c{i}") - F.lit(means[f"_c{i}"] or 0.0), F.lit(0.0)) for i in range(k)]
    parts = clean.select(
        *[c.alias(f"_x{i}") for i, c in enumerate(x)], *[(c * c).alias(f"_s{i}") for i, c in enumerate(x)],
        *[F.col(f"_c{i}").isNotNull().cast("double").alias(f"_m{i}") for i in range(k)],
    )
    vectors = VectorAssembler(inputCols=parts.columns, outputCol="_v").transform(parts).select("_v")
    rows = []
    if not vectors.isEmpty():
        g = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "_v")).computeGramianMatrix().toArray()
        product, total, square, count = g[:k, :k], g[:k, 2 * k :], g[k : 2 * k, 2 * k :], g[2 * k :, 2 * k :]
        for i in range(k):
            for j in range(i + 1, k):
                n = count[i, j]
                vx, vy = square[i, j] - total[i, j] ** 2 / max(n, 1), square[j, i] - total[j, i] ** 2 / max(n, 1)
                cov = product[i, j] - total[i, j] * total[j, i] / max(n, 1)
                # what is left of a constant column is rounding noise
                flat = vx <= 1e-12 * square[i, j] or vy <= 1e-12 * square[j, i]
                rows.append((cols[i], cols[j], int(n), None if flat else float(np.clip(cov / np.sqrt(vx * vy), -1, 1))))
    else:
        rows = [(cols[i], cols[j], 0, None) for i in range(k) for j in range(i + 1, k)]
    return df.sparkSession.createDataFrame(rows, "col_x string, col_y string, n bigint, corr double").select(
        "col_x", "col_y", "n", F.bround("corr", 6).alias("corr")
    )
