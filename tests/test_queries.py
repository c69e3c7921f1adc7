"""Every registered query against its check SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from check_queries import compare, connect

import __spark_entry__ as contract
from fleetlens.plans import checks
from fleetlens.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(checks.oracle_sql())


@pytest.mark.parametrize("name", sorted(checks.oracle_sql()))
def test_query(spark, db, name):
    problem, _ = compare(spark, db, SF_DIR, name)
    assert not problem, problem


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
