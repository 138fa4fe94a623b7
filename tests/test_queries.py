"""Every query with SQL gives the same rows as that SQL on another engine."""

import pytest
from helpers import SF, rows

from tessera.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(name, spark, duck):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(name, spark):
    assert catalogue.QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_pushdown_and_topk(spark):
    plan = catalogue.QUERIES["hybrid_kind_masked"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "CartesianProduct" not in plan
