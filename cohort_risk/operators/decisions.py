"""Approve / decline decisions: latest decision per key, change history,
joins with students, approval KPIs and summaries (G4, G5, F1, F2, F4, F6,
E17-E20).

Decisions are an append-only log ``(student_id, subject, status, decided_at,
tie...)``; ``subject`` NULL is an overall decision. "Last write wins" becomes
an ordered ``max_by`` per key: a hash/sort aggregate with map-side partial
aggregation, so a key holding a third of the log is reduced inside each task
before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import rules as R
from ..functions.numeric import avg_round, count_if, fixed_text, pct
from ..sources.fixtures import DECISION_ORDER

KEY = ["student_id", "subject"]
DEFAULT_AS_OF = "2002-01-01 00:00:00"
#: What the approval report takes from the students.
DETAIL_COLUMNS = ["student_id", "name", "email", "branch", "year", "section", "semester", "gpa", "risk_category"]


def _order_struct(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def current_decisions(decisions: DataFrame, order: list[str] = DECISION_ORDER, cleared_at: str | None = None) -> DataFrame:
    """Latest decision per (student_id, subject) by ``order`` (G4). Ordering is
    by decision time (then ties), never by arrival. ``cleared_at`` drops
    everything decided before a "clear all" cut-off."""
    if cleared_at is not None:
        decisions = decisions.filter(F.col("decided_at") >= F.lit(cleared_at).cast(decisions.schema["decided_at"].dataType))
    payload = [c for c in decisions.columns if c not in KEY]
    latest = F.max_by(F.struct(*[F.col(c) for c in payload]), _order_struct(order)).alias("d")
    return decisions.groupBy(*KEY).agg(latest).select(*KEY, *[F.col(f"d.{c}").alias(c) for c in payload])


def decision_changes(decisions: DataFrame, order: list[str] = DECISION_ORDER, bucket: str = "month") -> DataFrame:
    """Every status flip with the previous status and its time (G5): the full
    history that the reference keeps one level deep.

    ``lag`` runs per (key, bucket), where a bucket is a calendar unit of the
    decision time: a deterministic slice of the key's decisions in decision
    order, so a key that holds a third of the log is spread over its months
    (or a finer unit). The log is exchanged once, on (key, bucket); the last
    decision of a bucket falls out of the same window, and only this small
    per-bucket table moves again, to give the first row of the next bucket its
    predecessor."""
    from pyspark.sql.window import Window

    part = [*KEY, "_bucket"]
    narrow = list(dict.fromkeys([*KEY, "status", "decided_at", *order]))
    rows = decisions.select(*narrow).withColumn("_bucket", F.date_trunc(bucket, F.col("decided_at").cast("timestamp")))
    w = Window.partitionBy(*part).orderBy(*[F.col(c) for c in order])
    inner = rows.select(
        *part,
        "status",
        "decided_at",
        F.lag("status").over(w).alias("_prev_status"),
        F.lag("decided_at").over(w).alias("_prev_at"),
        (F.row_number().over(w) == 1).alias("_first"),
        F.lead("decided_at").over(w).isNull().alias("_last"),
    )
    last = inner.filter("_last").select(*part, F.struct("status", "decided_at").alias("_end"))
    wb = Window.partitionBy(*KEY).orderBy("_bucket")
    before = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)], F.lag("_end").over(wb).alias("_before"))
    j = inner.join(before, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(part)], "left")
    out = j.select(
        *KEY,
        "status",
        "decided_at",
        F.when(F.col("_first"), F.col("_before.status")).otherwise(F.col("_prev_status")).alias("previous_status"),
        F.when(F.col("_first"), F.col("_before.decided_at")).otherwise(F.col("_prev_at")).alias("changed_from"),
    )
    return out.filter(F.col("previous_status").isNotNull() & (F.col("previous_status") != F.col("status")))


def overall(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("subject").isNull())


def _narrow(students: DataFrame, cols: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Only the columns a report needs (plus the ingest ordinal), before the
    per-student aggregate carries them through a shuffle."""
    return students.select(*cols, *([ordinal] if ordinal in students.columns else []))


def latest_students(students: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per student_id, the *last* row by ingest ordinal (T16: the
    approval page builds a dict, later rows overwrite earlier ones)."""
    cols = [c for c in students.columns if c != "student_id"]
    if ordinal not in students.columns:  # no ingest order: the largest row, whatever the partitioning
        rows = students.groupBy("student_id").agg(F.max(F.struct(*cols)).alias("s"))
        return rows.select("student_id", *[F.col(f"s.{c}").alias(c) for c in cols])
    return (
        students.groupBy("student_id")
        .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(ordinal)).alias("s"))
        .select("student_id", *[F.col(f"s.{c}").alias(c) for c in cols])
    )


def first_students(students: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per student_id, the *first* by ingest ordinal."""
    cols = [c for c in students.columns if c != "student_id"]
    return (
        students.groupBy("student_id")
        .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(ordinal)).alias("s"))
        .select("student_id", *[F.col(f"s.{c}").alias(c) for c in cols])
    )


def lookup(students: DataFrame, student_id: str | None = None, name: str | None = None, ordinal: str = "ordinal") -> DataFrame:
    """The first row (by ingest order) of one student, found by id or by
    name: the filter reaches the scan and a bounded heap keeps one row."""
    found = students.filter((F.col("student_id") == student_id) if student_id is not None else (F.col("name") == name))
    return found.orderBy(ordinal).limit(1) if ordinal in students.columns else found.limit(1)


def days_since(ts: Column, as_of: str = DEFAULT_AS_OF) -> Column:
    """Whole days elapsed: floor(seconds / 86400), not a calendar-date
    difference (T12). Both ends are wall-clock (NTZ) values, so the session
    time zone plays no part."""
    secs = F.timestamp_diff("SECOND", ts.cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))
    return F.floor(secs / F.lit(86400)).cast("bigint")


def decision_detail(decisions: DataFrame, students: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Current overall decisions joined (inner) with the students (F1):
    the detail table of the approval report, newest first. Name and risk
    category are those stored with the decision, where the log has them (a
    later re-score doesn't rewrite history). AQE picks a
    broadcast when one side turns out small at run time, else a sort-merge
    join (with skew splitting)."""
    cur = current_decisions(overall(decisions))
    cols = DETAIL_COLUMNS
    st = latest_students(_narrow(students, cols))
    j = cur.join(st, "student_id", "inner")
    na = F.lit("N/A")

    def decided(c: str, current: str) -> Column:
        return F.coalesce(F.col(c), F.col(current)) if c in cur.columns else F.col(current)

    return j.select(
        F.col("student_id"),
        decided("student_name", "name").alias("student_name"),
        F.coalesce("email", na).alias("email"),
        F.coalesce("branch", na).alias("branch"),
        F.coalesce("year", na).alias("year"),
        F.coalesce("section", na).alias("section"),
        F.coalesce("semester", na).alias("semester"),
        fixed_text(F.coalesce(F.col("gpa"), F.lit(0.0)), 2).alias("gpa"),
        F.coalesce(decided("decided_category", "risk_category"), F.lit("Unknown")).alias("risk_category"),
        F.initcap("status").alias("status"),
        F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("decision_date"),
        days_since(F.col("decided_at"), as_of).alias("days_since"),
    ).orderBy(F.desc("decision_date"), "student_id")


def decision_kpis(decisions: DataFrame) -> DataFrame:
    """Approval KPIs over every current overall decision, also those without a
    matching student (E17, T18). Rate is 0 when there is none."""
    cur = current_decisions(overall(decisions))
    n = F.count(F.lit(1))
    ap = count_if(F.col("status") == "approved")
    de = count_if(F.col("status") == "declined")
    return cur.agg(
        n.cast("bigint").alias("total_decisions"),
        ap.alias("approved"),
        de.alias("declined"),
        F.bround(F.coalesce(pct(ap, n), F.lit(0.0)), 6).alias("approval_rate"),
        F.bround(F.coalesce(pct(de, n), F.lit(0.0)), 6).alias("declined_pct"),
    )


def _with_branch(decisions: DataFrame, students: DataFrame) -> DataFrame:
    cur = current_decisions(overall(decisions))
    st = latest_students(_narrow(students, ["student_id", "branch", "gpa"]))
    return cur.join(st, "student_id", "inner")


def branch_decision_kpis(decisions: DataFrame, students: DataFrame) -> DataFrame:
    """Decisions and approval rate per branch, for all branches at once."""
    j = _with_branch(decisions, students)
    n = F.count(F.lit(1))
    ap = count_if(F.col("status") == "approved")
    return j.groupBy(F.coalesce(F.col("branch"), F.lit("Unknown")).alias("branch")).agg(
        n.cast("bigint").alias("decisions"),
        ap.alias("approved"),
        F.bround(F.coalesce(pct(ap, n), F.lit(0.0)), 6).alias("approval_rate"),
    )


def branch_decision_summary(decisions: DataFrame, students: DataFrame) -> DataFrame:
    """Per branch of the detail table: decisions, approved, average of the
    2-decimal GPA (T13) and approval rate (1 dp), best rate first (E19)."""
    j = _with_branch(decisions, students)
    n = F.count(F.lit(1))
    ap = count_if(F.col("status") == "approved")
    return (
        j.groupBy(F.coalesce(F.col("branch"), F.lit("N/A")).alias("branch"))
        .agg(
            n.cast("bigint").alias("total_decisions"),
            ap.alias("approved"),
            avg_round(F.bround(F.coalesce(F.col("gpa"), F.lit(0.0)), 2), 2).alias("avg_gpa"),
            F.bround(pct(ap, n), 1).alias("approval_rate"),
        )
        .orderBy(F.desc("approval_rate"), "branch")
    )


def branches_with_decisions(decisions: DataFrame, students: DataFrame) -> DataFrame:
    """Branches of students that have an overall decision (F4): semi join,
    then distinct; NULL branch shows as 'Unknown'."""
    cur = overall(decisions).select("student_id")
    return (
        students.join(cur, "student_id", "left_semi")
        .select(F.coalesce(F.col("branch"), F.lit("Unknown")).alias("branch"))
        .distinct()
    )


def orphan_decisions(decisions: DataFrame, students: DataFrame) -> DataFrame:
    """Decisions whose student is unknown (F6): the rows the approval detail
    silently drops, kept visible with an anti join."""
    return decisions.join(students.select("student_id"), "student_id", "left_anti")


def subject_status(students: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each (student, subject) with its risk level and current decision, or
    PENDING when undecided (F2). Left outer join on the composite key."""
    keep = ["student_id"] + (["ordinal"] if "ordinal" in students.columns else [])
    rows = R.subject_rows(students, keep)
    cur = current_decisions(decisions.filter(F.col("subject").isNotNull())).select(
        "student_id", "subject", F.col("status").alias("decision")
    )
    j = rows.join(cur, ["student_id", "subject"], "left")
    return j.select(
        *keep,
        "subject",
        "attendance",
        "performance",
        "subject_risk",
        F.coalesce(F.upper("decision"), F.lit("PENDING")).alias("status"),
        F.when(F.col("decision").isNull(), R.subject_advice(F.col("subject_risk"))).alias("advice"),
    )


def subject_status_summary(students: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per student: approved / declined / pending subject names and counts
    (E20). Pending counts only Medium/High subjects without a decision. The
    decisions are reduced to one row per student (a conditional ``max_by`` per
    subject), students to their first ingest row, and one join on the id
    brings them together; the lists are expressions in subject order."""
    cols = [c for s in S.SUBJECTS for c in (f"{s}_attendance", f"{s}_performance")]
    st = _narrow(students, ["student_id", *cols])
    st = first_students(st) if "ordinal" in st.columns else st.dropDuplicates(["student_id"])
    latest = [
        F.max_by(F.when(F.col("subject") == s, F.upper("status")), F.when(F.col("subject") == s, _order_struct(DECISION_ORDER))).alias(f"_{s}")
        for s in S.SUBJECTS
    ]
    cur = decisions.filter(F.col("subject").isin(*S.SUBJECTS)).groupBy(F.col("student_id").alias("_id")).agg(*latest)
    j = st.join(cur, F.col("student_id") == F.col("_id"), "left")

    def names(cond) -> Column:
        return F.filter(F.array(*[F.when(cond(s), F.lit(S.SUBJECT_NAMES[s])) for s in S.SUBJECTS]), lambda x: x.isNotNull())

    lists = j.select(
        "student_id",
        names(lambda s: F.col(f"_{s}") == "APPROVED").alias("approved_subjects"),
        names(lambda s: F.col(f"_{s}") == "DECLINED").alias("declined_subjects"),
        names(
            lambda s: F.col(f"_{s}").isNull() & (R.subject_level(F.col(f"{s}_attendance"), F.col(f"{s}_performance")) != "Low Risk")
        ).alias("pending_subjects"),
    )
    return lists.select(
        "student_id",
        F.size("approved_subjects").cast("bigint").alias("n_approved"),
        F.size("declined_subjects").cast("bigint").alias("n_declined"),
        F.size("pending_subjects").cast("bigint").alias("n_pending"),
        F.array_join("approved_subjects", ", ").alias("approved_subjects"),
        F.array_join("declined_subjects", ", ").alias("declined_subjects"),
        F.array_join("pending_subjects", ", ").alias("pending_subjects"),
    )
