"""Every registered query of the subpackage against its SQL, and its contract columns."""

import pytest

import __spark_entry__ as E
from cohort_risk.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL

from .helpers import duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    res = duck(SF_SMALL).execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall())


def test_all_operators_and_the_pipeline_are_registered():
    names = E.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
