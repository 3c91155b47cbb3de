"""Random check of products: true products pass, one wrong cell is found in its row."""

import numpy as np

from conftest import SF01, from_dense
from tessera.operators import algebra, products
from tessera.operators.verify import check_product
from tessera.sources import tables
from pyspark.sql import functions as F


def outcome(df):
    return sorted((r["round"], r.n_rows, r.n_wrong) for r in df.collect())


def test_true_product_passes_and_one_wrong_cell_is_found(spark):
    sp = tables.supplier_part(spark, SF01)
    t = algebra.transpose(sp)
    c = products.matmul_join(sp, t)
    n = c.select("i").distinct().count()
    assert outcome(check_product(sp, t, c)) == [(k, n, 0) for k in range(3)]
    off = c.withColumn("v", F.col("v") + F.when((F.col("i") == 3) & (F.col("j") == 8), 1).otherwise(0))
    assert outcome(check_product(sp, t, off)) == [(k, n, 1) for k in range(3)]
    assert outcome(check_product(sp, t, c.where("NOT (i = 5 AND j = 9)"))) == [(k, n, 1) for k in range(3)]


def test_negative_and_large_values(spark):
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(-2 ** 30, 2 ** 30, (9, 7)), rnd.integers(-2 ** 30, 2 ** 30, (7, 5))
    x, y, z = from_dense(spark, a), from_dense(spark, b), from_dense(spark, a @ b)
    assert outcome(check_product(x, y, z, rounds=2, seed=4)) == [(0, 9, 0), (1, 9, 0)]
    assert all(w == 9 for _, _, w in outcome(check_product(x, y, from_dense(spark, a @ b + 1))))


def test_empty(spark):
    x = from_dense(spark, np.eye(3, dtype=np.int64))
    assert outcome(check_product(x.where("false"), x, x.where("false"))) == []
    assert outcome(check_product(x, x, x.where("false"), rounds=1)) == [(0, 3, 3)]
