"""Every registered query against its SQL counterpart, exactly."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry_module
from registry import oracle
from registry import queries as registered
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES = registered.queries()
SQL = oracle.statements()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.keys() <= entry_module.queries().keys()


def test_entry_module_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry_module.__file__.rsplit("/", 1)[0])


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert differences(con, SQL[name], QUERIES[name](spark, SF_DIR)) is None
