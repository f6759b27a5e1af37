"""Every query of the library against SQL on the same tables; those that SQL cannot express have to run."""

from __future__ import annotations

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from barquill.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
