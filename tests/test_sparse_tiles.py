"""Sparse tile product: equal to NumPy and to the join on any grid, skew included, with fewer shuffled rows."""

import numpy as np
import pytest

from conftest import SF01, from_dense, to_dense
from tessera.operators import algebra, products, sparse_tiles
from tessera.sources import tables


def sparse(rnd, n, m, share):
    return np.where(rnd.random((n, m)) < share, rnd.integers(-50, 50, (n, m)), 0)


@pytest.mark.parametrize("grid", [None, (1, 1), (3, 2), (4, 5)])
def test_equals_numpy_on_any_grid(spark, grid):
    rnd = np.random.default_rng(3)
    a, b = sparse(rnd, 23, 31, 0.2), sparse(rnd, 31, 17, 0.3)
    c = sparse_tiles.matmul_sparse_tiles(from_dense(spark, a), from_dense(spark, b), grid)
    assert c.dtypes == [("i", "bigint"), ("j", "bigint"), ("v", "bigint")]
    got = c.collect()
    assert len(got) == np.count_nonzero(a @ b) and (to_dense(c, (23, 17)) == a @ b).all()


def test_row_blocks_and_both_accumulators(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    a, b = sparse(rnd, 40, 30, 0.3), sparse(rnd, 30, 25, 0.3)
    tiles = [(*np.nonzero(x), x[np.nonzero(x)]) for x in (a, b)]
    for step, dense in ((1, 0), (7, 1 << 20), (100, 0), (1 << 20, 1 << 20)):
        monkeypatch.setattr(sparse_tiles, "_STEP", step)
        monkeypatch.setattr(sparse_tiles, "_DENSE", dense)
        got, seen = np.zeros((40, 25), dtype=np.int64), 0
        for i, j, v in sparse_tiles.row_products(*tiles):
            got[i, j] += v
            seen += len(v)
        assert (got == a @ b).all() and seen == np.count_nonzero(a @ b)


def test_hot_index_and_hot_row(spark):
    """An inner index, and a row, that hold a third of all cells."""
    rnd = np.random.default_rng(9)
    a, b = sparse(rnd, 60, 40, 0.02), sparse(rnd, 40, 50, 0.02)
    a[:, 7], b[7, :], a[3, :] = 5, 2, 1
    g, chunks = sparse_tiles.plan_grid(*sparse_tiles.pair_counts(from_dense(spark, a), from_dense(spark, b)), 8, pairs_per_task=400)
    assert g * g * 400 >= 60 * 50  # the hot index is split
    c = sparse_tiles.matmul_sparse_tiles(from_dense(spark, a), from_dense(spark, b), pairs_per_task=400)
    assert (to_dense(c, (60, 50)) == a @ b).all()


def test_empty_and_zero_cells(spark):
    a = from_dense(spark, np.zeros((4, 4), dtype=np.int64), keep_zeros=True)
    assert sparse_tiles.matmul_sparse_tiles(a, a).count() == 0
    assert sparse_tiles.matmul_sparse_tiles(a.where("false"), a.where("false")).count() == 0
    half = from_dense(spark, np.array([[0.5, 0], [0, 2.0]]), "double")
    assert to_dense(sparse_tiles.matmul_sparse_tiles(half, half), (2, 2), np.float64).tolist() == [[0.25, 0], [0, 4.0]]
    with pytest.raises(ValueError):
        sparse_tiles.matmul_sparse_tiles(half.selectExpr("i", "j", "CAST(v AS DECIMAL(10, 2)) AS v"), half)


def shuffled(df):
    """Rows that all exchanges of the executed plan wrote."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            if name == "ShuffleExchangeExec":
                total += p.metrics().get("shuffleRecordsWritten").get().value()
            todo += [p.children().apply(k) for k in range(p.children().size())]
    return total


def test_fewer_shuffled_rows_than_the_join(spark):
    sp = tables.supplier_part(spark, SF01)
    t = algebra.transpose(sp)
    tiles, join = sparse_tiles.matmul_sparse_tiles(sp, t), products.matmul_join(sp, t)
    assert shuffled(tiles) < shuffled(join)


def test_dense_product_refuses_before_it_allocates(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0])], "i bigint, row array<double>")
    b = from_dense(spark, np.ones((2, 2)), "double")
    with pytest.raises(ValueError):
        products.matmul_rows_broadcast(rows, b, (10 ** 6, 10 ** 6))
