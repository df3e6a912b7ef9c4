"""Every registered query against its SQL on the small tables."""

import os

import pytest

import __spark_entry__
from tidemark.plans.registry import REGISTRY

from oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, db, name):
    problem = compare(spark, db, REGISTRY[name], SF_DIR)
    assert problem is None or (problem == "empty result" and name.startswith(("j9", "x7"))), problem


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
