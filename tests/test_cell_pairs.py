"""Pairs of packed groups: exact, and what is written grows with the cells alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import from_dense, to_dense
from test_row_blocks import nodes, sparse
from tessera.operators import cell_pairs, products, sparse_tiles, strassen, strassen_cells, verify
from tessera.operators.algebra import transpose
from tessera.operators.cell_pairs import GROUP_CELLS, NULL, pack, pair_cells, plan_groups, unpack
from tessera.operators.estimate import output_cells
from tessera.operators.layout import BUCKETS


def written(df):
    return sum(p.metrics().get("dataSize").get().value() for p in nodes(df))


def grown(product, spark):
    """Bytes shuffled for A * A^T of 8000 cells in 20 columns, over those in 2000: the pairs are a hundred times as many."""
    rnd, size = np.random.default_rng(3), []
    for inner in (2000, 20):
        cells = spark.createDataFrame([(int(i), int(k), 1) for i, k in zip(rnd.permutation(8000), rnd.integers(0, inner, 8000))], "i bigint, j bigint, v bigint")
        size.append(written(product(cells, transpose(cells))))
    return size[1] / size[0]


@pytest.mark.parametrize("product", [products.matmul_join, sparse_tiles.matmul_sparse_tiles])
def test_products_write_their_cells_alone(spark, product):
    """F6, F7, F8, F11: blocks of rows wrote a copy of B's rows for each block that meets them."""
    assert grown(lambda a, b: product(a, b, block_pairs=1), spark) < 1.5


def test_strassen_writes_its_cells_alone(spark, monkeypatch):
    """operands and the sums of all leaf products were shuffled."""
    monkeypatch.setattr(strassen, "BLOCK_PAIRS", 1)
    assert grown(lambda a, b: strassen.matmul_strassen(a, b, 2), spark) < 1.5


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("dense", [True, False])
def test_strassen_in_pairs(spark, monkeypatch, levels, dense):
    rnd = np.random.default_rng(levels)
    a, b = sparse(rnd, 37, 45, 0.2), sparse(rnd, 45, 26, 0.2)
    h = [[(-(-n // 2 ** levels) * 2 ** levels) >> (lvl + 1) for lvl in range(levels)] for n in (37, 45, 26)]
    x, y = ((m, n, v[m, n]) for v in (a, b) for m, n in [np.nonzero(v)])
    if not dense:
        monkeypatch.setattr(strassen_cells, "DENSE", 1)
        monkeypatch.setattr(cell_pairs, "DENSE", 1)
    monkeypatch.setattr(strassen_cells, "STEP", 50)
    left, right = (tuple(z[np.argsort(k, kind="stable")] for z in (o, k, v)) for o, k, v in (x, (y[1], y[0], y[2])))
    got = np.zeros((37, 26), dtype=np.int64)
    for i, j, v in strassen_cells._kernel(*h, 37, 26)(left, right):
        assert (got[i, j] == 0).all()
        got[i, j] = v
    assert (got == a @ b).all()
    c = strassen_cells.strassen_pairs(from_dense(spark, a), from_dense(spark, b), levels, *h, (37, 26), 9)
    assert (to_dense(c, (37, 26)) == a @ b).all() and c.count() == np.count_nonzero(a @ b)


@pytest.mark.parametrize("vtype", ["bigint", "double"])
def test_pairs_with_null_and_repeated_cells(spark, vtype):
    a = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (700, 1, 4), (None, 1, 5), (0, None, 5), (0, 1, None), (-3, 2, 1), (1 << 62, 2, -(1 << 40))], "i bigint, j bigint, v bigint")
    b = spark.createDataFrame([(1, 0, 10), (1, 0, 1), (1, None, 5), (None, 3, 5), (1, 2, None), (2, -(1 << 62), 7), (2, 5, 0)], "i bigint, j bigint, v bigint")
    a, b = (x.withColumn("v", F.col("v").cast(vtype)) for x in (a, b))
    want = products.matmul_join(a, b)
    for groups in ((1, 1), (3, 2)):
        c = pair_cells(a, b, groups)
        assert c.dtypes == want.dtypes and sorted(map(str, c.collect())) == sorted(map(str, want.collect()))


def test_pieces_keep_every_value():
    for o, k, v in (([NULL, 5, 1 << 62], [-9, 0, 1 << 61], [1, -1, 1 << 62]), ([3], [1 << 40], [0.5]), ([7, 7], [2, 2], [-300, 70000]), ([0, 1 << 31], [0, 1 << 33], [float("inf"), -0.0])):
        got = unpack(pack(*(np.array(x) for x in (o, k, v))))
        assert [x.tolist() for x in got] == [o, k, v]


def test_groups_keep_to_their_size():
    even = np.full(BUCKETS, 50_000)
    ga, gb = plan_groups(even, even, 200)
    assert ga == gb and np.bincount(np.arange(BUCKETS) % ga, even).max() <= GROUP_CELLS
    few = np.zeros(BUCKETS, dtype=np.int64)
    few[3] = 10
    assert plan_groups(even // 100, few, 200) == (200, 1)
    few[3] = GROUP_CELLS + 1  # one row that no task should hold
    assert plan_groups(even, few, 200) is None


def test_sums_beyond_64_bits_are_not_made_in_pairs(spark):
    a = spark.createDataFrame([(i, k, 1 << 31) for i in range(2) for k in range(4)], "i bigint, j bigint, v bigint")
    assert cell_pairs.groups_for(a, transpose(a), 4) is None
    one = a.where("i = 0 AND j = 0")
    assert cell_pairs.groups_for(one, transpose(one), 4) == (1, 1) and cell_pairs.groups_for(one.unionByName(one), transpose(one), 4) is None


def test_estimate_shuffles_cells(spark):
    """64 numbers for nearly every cell of B were shuffled."""
    rnd = np.random.default_rng(5)
    cells = spark.createDataFrame([(int(i), int(k), 1) for i, k in zip(rnd.integers(0, 3, 4000), rnd.permutation(4000))], "i bigint, j bigint, v bigint").repartition(4)
    from tessera.operators.estimate import row_sizes
    assert written(row_sizes(cells, transpose(cells))) < 4000 * 64 * 2
    assert output_cells(cells, transpose(cells)) == pytest.approx(3, rel=0.4)


def test_check_shuffles_cells_once(spark):
    """a row for every cell and round was shuffled."""
    rnd = np.random.default_rng(6)
    a = spark.createDataFrame([(int(i), int(k), 1) for i, k in zip(rnd.integers(0, 3, 4000), rnd.permutation(4000))], "i bigint, j bigint, v bigint").repartition(4)
    t, c = transpose(a), spark.createDataFrame([(0, 0, 1)], "i bigint, j bigint, v bigint")
    assert written(verify.check_product(a, t, c, rounds=9)) < 1.2 * written(verify.check_product(a, t, c, rounds=3))
