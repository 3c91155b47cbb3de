import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import get_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", 8, app="tessera-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


def to_dense(df, shape, dtype=np.int64):
    p = df.toPandas()
    m = np.zeros(shape, dtype=dtype)
    if len(p):
        m[p["i"].astype(int).values, p["j"].astype(int).values] = p["v"].values
    return m


def from_dense(spark, m, vtype="bigint", keep_zeros=False):
    rows = [(int(i), int(j), (int(m[i, j]) if vtype == "bigint" else float(m[i, j])))
            for i in range(m.shape[0]) for j in range(m.shape[1]) if keep_zeros or m[i, j] != 0]
    return spark.createDataFrame(rows, f"i BIGINT, j BIGINT, v {vtype.upper()}")
