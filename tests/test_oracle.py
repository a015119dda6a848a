"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from tests.conftest import TABLES
from workload.compare import differences, open_oracle
from workload.oracle import oracle_sql
from workload.queries import queries

STATEMENTS = oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(TABLES)


def test_every_query_has_sql():
    assert set(queries()) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_equals_sql(spark, oracle, name):
    assert differences(oracle, STATEMENTS[name], queries()[name](spark, TABLES)) is None


def test_entry(spark):
    assert entry(spark).count() == 5
