from __future__ import annotations

import pytest

import __spark_entry__
from quern.plans import catalog
from tests.compare import assert_same, connection


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(name, spark, small, duck):
    assert_same(catalog.QUERIES[name](spark, small), catalog.ORACLE_SQL[name], duck)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score", "matched"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_module_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
