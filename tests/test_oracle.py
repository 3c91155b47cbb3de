"""Every matrix query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import os
import subprocess
import sys

import pytest

from conftest import SF001, SF01

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as se  # noqa: E402
from oracle_check import compare, duck  # noqa: E402
from tessera.plans.catalog import ORACLE, QUERIES  # noqa: E402

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(se.queries()) and set(ORACLE) <= set(se.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF01).toPandas()
    assert compare(got, con.execute(ORACLE[name]).df()) == "OK"


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["i", "j", "v"]
    assert df.count() > 0
    assert os.path.isdir(SF001)


SAME_TYPE = {("bigint", "BIGINT"), ("int", "INTEGER"), ("string", "VARCHAR"), ("double", "DOUBLE")}


def test_column_names_and_types_match_oracle(spark, con):
    """Spark output schema equals the DuckDB oracle's, column by column (names and types)."""
    bad = {}
    for name, sql in ORACLE.items():
        st = dict(QUERIES[name](spark, SF01).dtypes)
        rel = con.sql(sql)
        dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
        if sorted(st) != sorted(dt) or any((st[c], dt[c]) not in SAME_TYPE for c in st):
            bad[name] = (st, dt)
    assert not bad, bad


def test_missing_dependencies_leave_the_matrix_queries():
    """Without a library that only other subpackages need, every query of the catalog is still registered."""
    code = ("import sys\nfor m in ('tiktoken', 'sentencepiece', 'xxhash'): sys.modules[m] = None\n"
            "import __spark_entry__ as se\nfrom tessera.plans.catalog import QUERIES\nassert set(se.queries()) == set(QUERIES)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
