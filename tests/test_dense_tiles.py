"""Dense tiles of sparse cells: only the cells are sorted, not the zeros between them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import from_dense, to_dense
from tessera.operators import layout


def test_sparse_tile_is_filled_without_sorting_its_zeros(spark):
    """F4."""
    rnd = np.random.default_rng(3)
    x = np.where(rnd.random((70, 50)) < 0.02, rnd.integers(1, 9, (70, 50)), 0)
    b = layout.cells_to_blocks(from_dense(spark, x), 32, x.shape)
    assert "array_except" not in b._jdf.queryExecution().executedPlan().toString()
    assert (to_dense(layout.blocks_to_cells(b, 32), x.shape) == x).all()
    assert all(len(r.blk) == r.nr * r.nc for r in b.collect())


def test_ends_repeats_and_nulls(spark):
    rows = [(1, [(0, 5)]), (2, [(3, 5)]), (3, [(2, 7), (1, 6)]), (4, [(1, 6), (1, 4)]), (5, [(None, 9), (2, None)]), (6, [(3, 1), (2, 2), (1, 3), (0, 4)])]
    d = spark.createDataFrame(rows, "id int, e array<struct<p: int, v: bigint>>")
    got = {r.id: r.a for r in d.select("id", layout.dense_array("e", F.lit(4), "bigint").alias("a")).collect()}
    assert got == {1: [5, 0, 0, 0], 2: [0, 0, 0, 5], 3: [0, 6, 7, 0], 4: [0, 4, 6, 0, 0], 5: [9, 0, 0, None, 0], 6: [4, 3, 2, 1]}


@pytest.mark.parametrize("vtype", ["bigint", "double"])
@pytest.mark.parametrize("b", [4, 32])
def test_sparse_tiles_are_filled_as_dense_ones(spark, vtype, b, monkeypatch):
    """zeros are no objects or rows; cells without index or value come out as without ``sparse``."""
    monkeypatch.setattr(layout, "TILE_BYTES", 1 << 12)
    rnd = np.random.default_rng(4)
    x = np.where(rnd.random((70, 50)) < 0.1, rnd.integers(-9, 9, (70, 50)), 0)
    cells = from_dense(spark, x, keep_zeros=True).where("v <> 0 OR i = 3")
    odd = spark.createDataFrame([(None, 3, 5), (None, 40, 4), (7, None, 6), (None, None, 8), (None, 3, None), (69, 49, None)], "i bigint, j bigint, v bigint")
    cells = cells.where("i <> 69 OR j <> 49").unionByName(odd).withColumn("v", F.col("v").cast(vtype))
    want, got = (layout.cells_to_blocks(cells, b, x.shape, sparse=s) for s in (False, True))
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    flat = [layout.blocks_to_cells(t, b, sparse=s) for t in (want, got) for s in (False, True)]
    rows = [sorted(map(str, f.collect())) for f in flat]
    assert rows[0] == rows[1] == rows[2] == rows[3] and len({str(f.dtypes) for f in flat}) == 1
    assert "posexplode" not in flat[3]._jdf.queryExecution().executedPlan().toString()
