"""Every query with SQL gives the rows that DuckDB gives."""

import oracle
import pytest
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
CASES = [(name, build, sql) for m in catalog.MODULES for name, (build, sql) in m.QUERIES.items()]


@pytest.mark.parametrize(("name", "build", "sql"), CASES, ids=[c[0] for c in CASES])
def test_query(spark, name, build, sql):
    if sql:
        assert oracle.difference(spark, SF, build, sql) == ""
    else:
        assert build(spark, SF).count() >= 0


def test_names_are_unique():
    names = [c[0] for c in CASES]
    assert len(names) == len(set(names))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
