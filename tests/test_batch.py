"""A collection of products in one plan against NumPy, one key at a time."""

import numpy as np
import pytest

from conftest import to_dense
from tessera.operators.batch import grids, matmul_batch

SHAPES = {"tiny": (1, 1, 1), "wide": (3, 40, 5), "big": (70, 90, 60), "hot": (80, 2, 90), "flat": (9, 1, 9)}


@pytest.fixture(scope="module")
def sides(spark):
    rnd = np.random.default_rng(8)
    m = {k: (rnd.integers(-9, 9, (r, x)), rnd.integers(-9, 9, (x, c))) for k, (r, x, c) in SHAPES.items()}

    def cells(side):
        rows = [(k, int(i), int(j), int(p[side][i, j])) for k, p in m.items() for i, j in zip(*np.nonzero(p[side]))]
        extra = [(None, 0, 0, 5), ("left" if side == 0 else "right", 0, 0, 5)]  # a null key, and keys that one side lacks
        return spark.createDataFrame(rows + extra, "name string, i bigint, j bigint, v bigint")
    return m, cells(0), cells(1)


@pytest.mark.parametrize("limits", [(1 << 22, 1 << 20), (500, 200)])
def test_every_key(spark, sides, limits):
    m, a, b = sides
    c = matmul_batch(a, b, "name", *limits).cache()
    assert c.columns == ["name", "i", "j", "v"]
    assert {r.name for r in c.select("name").distinct().collect()} <= set(m)
    for k, (x, y) in m.items():
        assert (to_dense(c.where(c.name == k).drop("name"), (x.shape[0], y.shape[1])) == x @ y).all(), k


def test_grids_follow_the_work(spark, sides):
    _, a, b = sides
    got = {r.name: (r.g, r.chunks) for r in grids(a.dropna(), b.dropna(), "name", 500, 200).collect()}
    assert set(got) == set(SHAPES)
    assert got["tiny"] == (1, 1) and got["flat"] == (1, 1) and got["big"][0] > 10 and got["hot"][0] > 3


def test_doubles_repeats_and_empty(spark, sides):
    rows = [(1, 0, 0, 0.5), (1, 0, 0, 0.25), (2, 0, 1, 2.0)]
    x = spark.createDataFrame(rows, "key int, i int, j int, v double")
    assert sorted(map(tuple, matmul_batch(x, x).collect())) == [(1, 0, 0, 0.5625)]
    assert matmul_batch(x.where("false"), x).collect() == []
    with pytest.raises(ValueError):
        matmul_batch(x.selectExpr("key", "i", "j", "cast(v as decimal(9,2)) v"), x)
