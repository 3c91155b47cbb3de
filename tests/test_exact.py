"""Exact values and stable types in every strategy, lossless storage, memory budgets, shared folder."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import from_dense, to_dense
from tessera import session
from tessera.operators.blocks import DEFAULT_GROUP_BYTES, check_shapes, grid_for, group_tiles, kernel_for, matmul_block
from tessera.operators.dispatch import matmul
from tessera.operators.layout import cells_to_rows, hstack_rows, rows_to_cells
from tessera.session import shared_dir
from tessera.sources import io

EXACT = ("auto", "join", "broadcast", "block", "strassen", "strassen_block")


def big(shape, seed, top=10**8):
    return np.random.default_rng(seed).integers(-top, top, shape)


@pytest.mark.parametrize("strategy", EXACT)
def test_large_integers_are_exact_in_every_strategy(spark, strategy):
    x, y = big((40, 30), 1), big((30, 20), 2)
    c = matmul(from_dense(spark, x), from_dense(spark, y), strategy, block_size=8)
    assert dict(c.dtypes)["v"] == "bigint"
    assert (to_dense(c, (40, 20)) == x @ y).all() and np.abs(x @ y).max() > 2**53


@pytest.mark.parametrize("strategy", EXACT)
def test_mixed_integer_types_give_bigint(spark, strategy):
    x, y = big((9, 7), 3, 10**5), big((7, 5), 4, 10**5)
    b = from_dense(spark, y).withColumn("v", F.col("v").cast("int"))
    for a in (from_dense(spark, x), from_dense(spark, x).withColumn("v", F.col("v").cast("int"))):
        c = matmul(a, b, strategy, block_size=4)
        assert dict(c.dtypes)["v"] == "bigint" and (to_dense(c, (9, 5)) == x @ y).all()


@pytest.mark.parametrize("strategy", [s for s in EXACT if s != "block"])
def test_decimals_stay_decimals(spark, strategy):
    rows = [(i, j, Decimal(10**11 + 7 * i + j)) for i in range(12) for j in range(12)]
    a = spark.createDataFrame(rows, "i BIGINT, j BIGINT, v DECIMAL(12,0)")
    c = matmul(a, a, strategy)
    want = matmul(a, a, "join")
    assert c.dtypes == want.dtypes and sorted(map(tuple, c.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("fill", [1.0, 0.3])
def test_sums_beyond_64_bits_come_out_whole(spark, fill):
    """auto stops being BIGINT only where a sum may not fit."""
    rnd = np.random.default_rng(8)
    x = np.where(rnd.random((3000, 8)) < fill, rnd.integers(-(10**8), 10**8, (3000, 8)), 0)
    x[:, 0] = 10**8
    e = from_dense(spark, x)
    t = e.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    want = x.T.astype(object) @ x.astype(object)
    assert want[0, 0] > 2**63
    c = matmul(t, e)
    assert dict(c.dtypes)["v"] == "decimal(38,0)"
    assert {(r.i, r.j): int(r.v) for r in c.collect()} == {(i, j): want[i, j] for i in range(8) for j in range(8) if want[i, j]}
    narrow = matmul(*(m.where("i < 8 AND j < 8") for m in (t, e)))
    assert dict(narrow.dtypes)["v"] == "bigint" and (to_dense(narrow, (8, 8)) == x[:8].T @ x[:8]).all()


def test_digits_without_room_are_decimals(spark):
    huge = from_dense(spark, np.full((2, 2), -(1 << 61)))
    assert {int(r.v) for r in matmul(huge, huge).collect()} == {1 << 123}


def test_block_refuses_what_tiles_cannot_hold(spark):
    a = spark.createDataFrame([(0, 0, Decimal(1))], "i BIGINT, j BIGINT, v DECIMAL(12,0)")
    with pytest.raises(ValueError):
        matmul(a, a, "block")
    huge = from_dense(spark, np.full((2, 2), 1 << 33))
    with pytest.raises(ValueError):
        matmul_block(huge, huge, 2)


def test_kernel_bounds():
    assert kernel_for("bigint", "int", 4, 10, 10) == "double"
    assert kernel_for("bigint", "bigint", 1, 1 << 27, 1 << 26) == "bigint"
    assert kernel_for("bigint", "bigint", 1, 1 << 32, 1 << 31) is None
    assert kernel_for("double", "float", 4, 1.0, 1.0) == "double" and kernel_for("decimal(12,0)", "bigint", 1, 1, 1) is None


def test_declared_inner_sizes_must_agree():
    with pytest.raises(ValueError):
        check_shapes((1, 3), (5, 2), exact=True)


@pytest.mark.parametrize("vectors,b", [(250_000, 64), (1_000_000, 512), (10_000_000, 64), (10_000_000, 512)])
def test_a_group_keeps_to_its_budget_with_its_output(vectors, b):
    nb, nk = -(-vectors // b), max(1, 64 // b)
    for i, k, j in ((nb, nk, nb), (nk, nb, nk), (nb, nb, nk)):
        g, c = grid_for(i, k, j, b, 200)
        assert group_tiles(i, k, j, g, c) * 8 * b * b <= max(DEFAULT_GROUP_BYTES, 4 * 8 * b * b)


def test_chunked_inner_side_is_summed_in_rounds(spark):
    x, y = big((6, 160), 5, 1000), big((160, 5), 6, 1000)
    c = matmul_block(from_dense(spark, x), from_dense(spark, y), 4, (6, 160), (160, 5), grid=(2, 40))
    assert (to_dense(c, (6, 5)) == x @ y).all()


def fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{np.random.default_rng().integers(1 << 40)}"


def test_sparse_rows_keep_their_columns(spark):
    cells = spark.createDataFrame([(0, 0, 1), (0, 5, 2), (1, 3, 3)], "i BIGINT, j BIGINT, v BIGINT")
    path = fresh(spark, "sparse")
    io.write_rows(cells, path)
    assert sorted(map(tuple, io.read_cells(spark, path, "bigint").where("v <> 0").collect())) == [(0, 0, 1), (0, 5, 2), (1, 3, 3)]
    both = cells.select(F.lit(1).alias("which"), "*").unionByName(cells.select(F.lit(2).alias("which"), "i", (F.col("j") + 4).alias("j"), "v"))
    for ncols, width in ((None, {1: 6, 2: 10}), (12, {1: 12, 2: 12})):
        path = fresh(spark, "parts")
        io.write_rows(both, path, ncols=ncols, partition_by=["which"])
        for which, shift in ((1, 0), (2, 4)):
            rows = io.read_rows(spark, f"{path}/which={which}", "bigint")
            assert {len(r.row) for r in rows.collect()} == {width[which]}
            assert sorted(map(tuple, rows_to_cells(rows).where("v <> 0").collect())) == [(0, shift, 1), (0, 5 + shift, 2), (1, 3 + shift, 3)]


def test_hstack_pads_rows_that_one_side_lacks(spark):
    left = spark.createDataFrame([(0, [1, 2])], "i BIGINT, row ARRAY<BIGINT>")
    right = spark.createDataFrame([(0, [3]), (1, [4])], "i BIGINT, row ARRAY<BIGINT>")
    assert sorted((r.i, r.row) for r in hstack_rows(left, right).collect()) == [(0, [1, 2, 3]), (1, [0, 0, 4])]
    assert sorted((r.i, r.row) for r in hstack_rows(right, left, 1, 2).collect()) == [(0, [3, 1, 2]), (1, [4, 0, 0])]


def test_unindexed_rows_of_a_partitioned_table_get_distinct_indices(spark):
    path = fresh(spark, "folders")
    m = from_dense(spark, np.arange(1, 41).reshape(8, 5))
    rows = cells_to_rows(m).withColumn("p", F.pmod("i", F.lit(3))).repartition(2, "i")
    rows.select("p", "row").write.partitionBy("p").parquet(path)
    got = io.read_unindexed_rows(spark, path).collect()
    assert sorted(r.i for r in got) == list(range(8)) and sorted(r.row for r in got) == [list(range(5 * i + 1, 5 * i + 6)) for i in range(8)]


class FakeSpark:
    """As much of a session as shared_dir reads."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": staticmethod(lambda: None), "setCheckpointDir": staticmethod(lambda d: None)})


@pytest.mark.parametrize("master,ok", [("local", True), ("local[8]", True), ("local[*]", True), ("yarn", False), ("spark://host:7077", False), ("local-cluster[3,2,3000]", False)])
def test_a_cluster_without_a_shared_folder_raises(master, ok):
    if ok:
        assert session.shared_dir(FakeSpark(master))
    else:
        with pytest.raises(RuntimeError):
            session.shared_dir(FakeSpark(master))


@pytest.mark.parametrize("n", [8, 16, 32])
def test_strategies_agree_on_matrices_read_from_csv(spark, tmp_path, n):
    cells, ref = [], []
    for k in (1, 2):
        m = np.random.default_rng(n * 10 + k).integers(0, 100_000, (n, n))
        (tmp_path / f"{k}.csv").write_text("\n".join(",".join(f"{v / 100000:.5f}" for v in row) for row in m) + "\n")
        cells.append(io.read_csv_matrix(spark, str(tmp_path / f"{k}.csv")))
        assert (to_dense(cells[-1], (n, n)) == m).all()
        ref.append(m)
    for s in EXACT:
        assert (to_dense(matmul(*cells, s, block_size=max(2, n // 4)), (n, n)) == ref[0] @ ref[1]).all(), s
