"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def db(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, db, folder, name):
    ok, note = compare(spark, db, folder, name)
    assert ok, note


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["threshold", "precision", "recall", "f1", "cost", "youden", "tp", "fp", "tn", "fn"]
    assert df.count() == 80


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
