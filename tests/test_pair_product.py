"""Thin products: packed groups of tiles meet in a cartesian product, copies aren't written out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import from_dense, to_dense
from tessera.operators import blocks
from tessera.operators.blocks import (
    COPY_BYTES, PACK_BYTES, block_product, grid_for, matmul_block, matmul_blocks, pair_product, pair_product_cells, pairs_for,
)
from tessera.operators.dispatch import matmul_abt
from tessera.operators.layout import blocks_to_cells, cells_to_blocks, rows_to_blocks, transpose_blocks
from tessera.operators.products import matmul_join


def ints(shape, seed, high=50):
    return np.random.default_rng(seed).integers(-high, high, shape)


def test_a_large_thin_product_writes_no_copies(spark):
    """20,000 vectors of 64: the grid would write each side once for every group."""
    rows = spark.range(20_000).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: x.cast("bigint")).alias("row"))
    eb = rows_to_blocks(rows, 64, (20_000, 64))
    p = matmul_blocks(eb, transpose_blocks(eb), 64, (20_000, 64), (64, 20_000))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in p and "FlatMapCoGroupsInPandas" not in p and "Broadcast" not in p
    assert p.count("explode(") == p.count("posexplode(")  # only the segments of rows; no copies
    # a group is packed where it was dealt: besides the tiles', one exchange a side
    assert p.count("Exchange") <= 4


@pytest.mark.parametrize("value", ["double", "bigint"])
def test_pairs_give_the_product(spark, value):
    x, y = ints((11, 7), 1, 1 << 30 if value == "bigint" else 50), ints((7, 14), 2, 1 << 30 if value == "bigint" else 50)
    x[3:6], y[:, 9:12] = 0, 0  # tiles that do not exist
    ab = cells_to_blocks(from_dense(spark, x), 3, (11, 7))
    bb = cells_to_blocks(from_dense(spark, y), 3, (7, 14))
    for groups in ((1, 1), (2, 3), (4, 5), (9, 9)):
        got = pair_product(ab, bb, groups, value)
        assert got.groupBy("bi", "bj").count().where("count > 1").isEmpty()
        assert (to_dense(blocks_to_cells(got, 3, cast="bigint"), (11, 14)) == x @ y).all()


def test_pairs_and_grid_return_the_same_tiles(spark):
    """Cells whose row or column is null have no partner and change nothing."""
    r = np.random.default_rng(3)
    x, y = r.random((10, 8)) * 1e3, r.random((8, 12)) * 1e-3
    lost = spark.createDataFrame([(None, 0, 5.0), (0, None, 5.0)], "i BIGINT, j BIGINT, v DOUBLE")
    whole = from_dense(spark, x, "double"), from_dense(spark, y, "double")
    a, b = (m.unionByName(lost) for m in whole)
    tiles = [cells_to_blocks(a, 4, (10, 8)), cells_to_blocks(b, 4, (8, 12))]
    key = lambda df: sorted((t.bi, t.bj, t.nr, t.nc, tuple(t.blk)) for t in df.collect())
    pairs = key(pair_product(*tiles, (2, 2)))
    assert pairs == key(block_product(*(cells_to_blocks(m, 4, s) for m, s in zip(whole, ((10, 8), (8, 12)))), (2, 1)))
    shuffled = [cells_to_blocks(m.repartition(5, "v"), 4, s) for m, s in ((a, (10, 8)), (b, (8, 12)))]
    assert pairs == key(pair_product(*shuffled, (3, 1)))


def test_matmul_block_takes_pairs_when_copies_are_many(spark, monkeypatch):
    x = ints((23, 5), 4)
    a, t = from_dense(spark, x), from_dense(spark, x.T)
    monkeypatch.setattr(blocks, "COPY_BYTES", 0)
    c = matmul_block(a, t, 4, (23, 5), (5, 23))
    assert "CartesianProduct" in c._jdf.queryExecution().executedPlan().toString()
    assert (to_dense(c, (23, 23)) == x @ x.T).all()


def test_abt_takes_pairs_when_copies_are_many(spark, monkeypatch):
    x, y = ints((70, 6), 5), ints((90, 6), 6)
    monkeypatch.setattr(blocks, "COPY_BYTES", 0)
    c = matmul_abt(from_dense(spark, x), from_dense(spark, y), strategy="block")
    assert "CartesianProduct" in c._jdf.queryExecution().executedPlan().toString()
    assert dict(c.dtypes)["v"] == "bigint" and (to_dense(c, (70, 90)) == x @ y.T).all()


def test_abt_shuffles_packed_cells_once(spark, monkeypatch):
    """One exchange a side, not one for tiles and one for groups; of A * A^T, B reads what A has written."""
    x = ints((70, 6), 7)
    monkeypatch.setattr(blocks, "COPY_BYTES", 0)
    a = spark.range(420).select(F.expr("id div 6").alias("i"), (F.col("id") % 6).alias("j"), F.get(F.lit(x.ravel()), F.col("id").cast("int")).alias("v"))
    c = matmul_abt(a, a, strategy="block")
    assert c._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    got = np.zeros((70, 70), dtype=np.int64)
    for r in c.collect():
        got[r.i, r.j] = r.v
    assert (got == x @ x.T).all()
    final = c._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


@pytest.mark.parametrize("value", ["double", "bigint"])
@pytest.mark.parametrize("groups", [(1, 1), (2, 3), (9, 9)])
def test_packed_cells_give_the_join(spark, value, groups):
    """Cells in any order, twice or without index or value; sides that see different inner sizes."""
    high = 1 << 30 if value == "bigint" else 50
    x, y = ints((11, 7), 8, high), ints((7, 14), 9, high)
    x[3:6], y[:, 9:12], y[5:] = 0, 0, 0
    more = spark.createDataFrame([(None, 0, 5), (0, None, 5), (0, 0, None), (2, 1, 4), (2, 1, 4), (10, 4, -3)], "i BIGINT, j BIGINT, v BIGINT")
    a = from_dense(spark, x).unionByName(more).repartition(5, "v")
    b = from_dense(spark, y).unionByName(more.where("i is null or i < 7"))
    tiles = pair_product_cells(a, b, 3, (11, 7), (5, 14), groups, value)
    assert tiles.groupBy("bi", "bj").count().where("count > 1").isEmpty()
    key = lambda df: sorted(tuple(r) for r in df.where("i is not null and j is not null and v <> 0").select("i", "j", "v").collect())
    assert key(blocks_to_cells(tiles, 3, cast="bigint")) == key(matmul_join(a, b))


def test_packed_cells_of_doubles(spark):
    r = np.random.default_rng(10)
    x, y = r.random((10, 8)) * 1e3, r.random((8, 12)) * 1e-3
    a, b = from_dense(spark, x, "double"), from_dense(spark, y, "double")
    key = lambda df: sorted((t.bi, t.bj, t.nr, t.nc, tuple(t.blk)) for t in df.collect())
    cells = key(pair_product_cells(a.repartition(4, "v"), b, 4, (10, 8), (8, 12), (2, 2)))
    assert cells == key(pair_product(cells_to_blocks(a, 4, (10, 8)), cells_to_blocks(b, 4, (8, 12)), (2, 2)))


@pytest.mark.parametrize("n", [20_000, 100_000, 1_000_000, 10_000_000])
@pytest.mark.parametrize("b", [64, 512])
def test_groups_keep_to_their_budget(n, b):
    shapes = (n, 64), (64, n)
    grid = grid_for(-(-n // b), 1, -(-n // b), b, 200)
    gi, gj = pairs_for(*shapes, b, grid, 200)
    assert gi * gj >= 200 or (gi, gj) == (-(-n // b),) * 2
    assert -(-(-(-n // b)) // gi) * 8 * b * 64 <= PACK_BYTES + 8 * b * 64
    # what is read grows with the copies the grid would have written, or less
    assert gi + gj <= 2 * grid[0]


def test_small_or_cut_products_stay_on_the_grid():
    assert pairs_for((500, 64), (64, 500), 64, (8, 1), 200) is None
    assert pairs_for((64, 100_000), (100_000, 64), 64, (1, 200), 200) is None
    assert pairs_for((100_000, 1 << 16), (1 << 16, 100_000), 64, (40, 1), 200) is None
    assert COPY_BYTES > 8 * 2 * 500 * 64 * 8
