"""Joins and groups by student on co-bucketed tables move nothing below the join."""

import re

from cohort_risk.operators import decisions as D
from cohort_risk.operators import interventions as I
from cohort_risk.plans import views as V

from .conftest import SF_SMALL


def _exchanges(df):
    """Exchange lines of the physical plan and of what stands below its joins."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.split("\n") if re.search(r"Exchange", x)]
    joins = [i for i, x in enumerate(plan.split("\n")) if "Join" in x]
    below = [x for i, x in enumerate(plan.split("\n")) if "Exchange" in x and joins and i > joins[0]]
    return lines, below


def test_plans_of_bucketed_tables_hold_no_exchange_below_the_join(spark):
    students, log = V.bucketed(spark, SF_SMALL)
    for df, above in (
        (D.decision_detail(log, students), 1),  # the final order
        (D.branch_decision_summary(log, students), 2),  # partial sums by branch, the order
        (D.branch_decision_kpis(log, students), 1), (D.subject_status_summary(students, log), 0), (D.current_decisions(log), 0),
        (I.notification_outbox(log, students), 0),
    ):
        lines, below = _exchanges(df)
        assert len(lines) <= above and not below, lines
    # the same on plain tables moves both sides
    assert len(_exchanges(D.subject_status_summary(V.scored(spark, SF_SMALL, with_ordinal=True), V.decisions(spark, SF_SMALL)))[0]) >= 2


def test_bucketed_queries_write_what_they_read(spark, monkeypatch):
    from cohort_risk.plans import catalog as C
    from cohort_risk.sources import bucketed as BK

    wrote, write = [], BK.write_bucketed
    monkeypatch.setattr(V, "_BUCKETED", {})
    monkeypatch.setattr(BK, "write_bucketed", lambda df, n, name: wrote.append((name, df.columns)) or write(df, n, name))
    assert C.q_current_decision_bucketed(spark, SF_SMALL).count() == D.current_decisions(V.decisions(spark, SF_SMALL)).count()
    assert [name for name, _ in wrote] == ["decisions"]  # no students for the log's latest rows
    got = C.q_decision_detail_bucketed(spark, SF_SMALL)
    assert wrote[1] == ("students", [*D.DETAIL_COLUMNS, "ordinal"]) and len(wrote) == 2
    plain = D.decision_detail(V.decisions(spark, SF_SMALL), V.scored(spark, SF_SMALL, with_ordinal=True))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in plain.collect()]
