"""Every SQL-expressible query equals its DuckDB oracle (sf0.001 here; the
driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import rows_of

from .conftest import SF_SMALL

NAMES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    scols, srows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(E.oracle_sql()[name])
    dcols, drows = rows_of([d[0] for d in res.description], res.fetchall())
    assert scols == dcols
    assert srows == drows


def test_every_query_has_a_callable_and_entry_runs(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["branch", "total_students", "avg_gpa", "avg_attendance", "avg_risk_pct", "high_risk_count", "high_risk_pct"]
