"""Every query of the subpackage: registered, run over the small tables, and held against its SQL where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as se  # noqa: E402
from oracle_check import compare, duck  # noqa: E402
from tessera.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(se.queries()) and set(ORACLE) <= set(se.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, duck(SF).execute(ORACLE[name]).df()) == "OK"
