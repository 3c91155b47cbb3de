"""CSV matrices written by the tests: loading and products in every strategy against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import to_dense
from tessera.operators.blocks import matmul_block
from tessera.operators.products import matmul_broadcast, matmul_join
from tessera.operators.strassen import matmul_strassen
from tessera.sources.io import read_csv_matrix

SIZES = (8, 16, 32, 64)


def _matrix(n, k):
    return np.random.default_rng(1000 * n + k).integers(0, 100_000, (n, n))


@pytest.fixture(scope="module")
def csv(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    for n in SIZES:
        for k in (1, 2):
            (folder / f"{n}_{k}.csv").write_text("\n".join(",".join(f"{v / 100_000:.5f}" for v in row) for row in _matrix(n, k)) + "\n")
    return lambda n, k: read_csv_matrix(spark, f"{folder}/{n}_{k}.csv")


@pytest.mark.parametrize("n,k", [(n, k) for n in SIZES for k in (1, 2)])
def test_load_checksums(csv, n, k):
    r = csv(n, k).agg(F.count("*").alias("c"), F.sum("v").alias("s"),
                      F.sum(F.col("v") * (F.col("i") * 1000 + F.col("j"))).alias("w")).first()
    m = _matrix(n, k)
    i, j = np.indices(m.shape)
    assert (r["c"], r["s"], r["w"]) == (n * n, int(m.sum()), int((m * (i * 1000 + j)).sum()))


@pytest.mark.parametrize("n", SIZES)
def test_golden_products_all_strategies(csv, n):
    a, b, shape = csv(n, 1), csv(n, 2), (n, n)
    want = _matrix(n, 1) @ _matrix(n, 2)
    for c in (matmul_join(a, b), matmul_broadcast(a, b), matmul_strassen(a, b, 1, shape, shape),
              matmul_strassen(a, b, 2, shape, shape, leaf="block", block_size=max(2, n // 8)),
              matmul_block(a, b, max(2, n // 4), shape, shape)):
        assert (to_dense(c, shape) == want).all()


def test_golden_strassen_three_levels(csv):
    c = matmul_strassen(csv(64, 1), csv(64, 2), 3, (64, 64), (64, 64))
    assert (to_dense(c, (64, 64)) == _matrix(64, 1) @ _matrix(64, 2)).all()
