"""Rows of B sent packed to blocks of A's rows: exact, and what is shuffled grows with the cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import from_dense, to_dense
from tessera.operators import products, sparse_tiles, strassen
from tessera.operators.joins import contract
from tessera.operators.row_blocks import contract_blocks


def sparse(rnd, n, m, share):
    return np.where(rnd.random((n, m)) < share, rnd.integers(-50, 50, (n, m)), 0)


def nodes(df):
    """Shuffle exchanges of the executed plan."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            if name == "ShuffleExchangeExec":
                out.append(p)
            todo += [p.children().apply(k) for k in range(p.children().size())]
    return out


def copies(spark, n):
    """n shifted copies of a matrix of 512 rows on the diagonal, stored."""
    rnd = np.random.default_rng(1)
    one = from_dense(spark, sparse(rnd, 512, 200, 0.05))
    many = one.crossJoin(spark.range(n).withColumnRenamed("id", "n")).select((F.col("i") + 512 * F.col("n")).alias("i"), (F.col("j") + 200 * F.col("n")).alias("j"), "v")
    return spark.createDataFrame(many.toPandas())


def test_tiles_are_not_copied_more_often_as_the_matrix_grows(spark):
    """F8: with a grid, the copies of a cell grow with the number of tasks."""
    size = []
    for n in (1, 8):
        a = copies(spark, n)
        c = sparse_tiles.matmul_sparse_tiles(a, a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), pairs_per_task=1 << 16, block_pairs=0)
        size.append(sum(p.metrics().get("dataSize").get().value() for p in nodes(c)))
    assert size[1] <= 8 * 1.2 * size[0]


@pytest.mark.parametrize("parts", [1, 3])
def test_packed_rows_join_like_cells(spark, parts):
    """Groups, null and repeated coordinates, rows of several blocks."""
    rnd = np.random.default_rng(2)
    left = [(int(g), int(r), int(k), int(v)) for g, r, k, v in zip(rnd.integers(0, 2, 300), rnd.integers(0, 900, 300), rnd.integers(0, 9, 300), rnd.integers(-5, 5, 300))]
    right = [(int(g), int(k), int(c), int(v)) for g, k, c, v in zip(rnd.integers(0, 2, 99), rnd.integers(0, 9, 99), rnd.integers(0, 7, 99), rnd.integers(-5, 5, 99))]
    x = spark.createDataFrame(left + left[:9] + [(0, None, 3, 2), (0, 5, None, 2), (1, 5, 3, None)], "g bigint, r bigint, k bigint, lv bigint")
    y = spark.createDataFrame(right + right[:9] + [(0, 3, None, 2), (0, None, 5, 2), (1, 3, 5, None)], "g bigint, k bigint, c bigint, rv bigint")
    want, got = (sorted(map(str, f(x, y, ["g"], *more).collect())) for f, more in ((contract, ()), (contract_blocks, (parts,))))
    assert got == want


def test_tiles_with_null_and_repeated_cells(spark):
    a = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (700, 1, 4), (None, 1, 5), (0, None, 5), (0, 1, None)], "i bigint, j bigint, v bigint")
    b = spark.createDataFrame([(1, 0, 10), (1, 0, 1), (1, None, 5), (None, 3, 5), (1, 2, None)], "i bigint, j bigint, v bigint")
    want = sorted(map(str, products.matmul_join(a, b).collect()))
    assert len(want) == 6
    for block_pairs in (0, 1 << 26):
        assert sorted(map(str, sparse_tiles.matmul_sparse_tiles(a, b, block_pairs=block_pairs).collect())) == want


def test_chunks_and_parts(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    a, b = sparse(rnd, 600, 40, 0.1), sparse(rnd, 40, 30, 0.3)
    monkeypatch.setattr(sparse_tiles, "plan_blocks", lambda *_: (3, 4))
    assert (to_dense(sparse_tiles.matmul_sparse_tiles(from_dense(spark, a), from_dense(spark, b), block_pairs=0), (600, 30)) == a @ b).all()


def test_large_join_shuffles_no_sums(spark):
    """pairs of an output cell meet in one task."""
    rnd = np.random.default_rng(6)
    a, b = sparse(rnd, 300, 40, 0.2), sparse(rnd, 40, 30, 0.3)
    c = products.matmul_join(from_dense(spark, a), from_dense(spark, b), block_pairs=1)
    assert c.dtypes == [("i", "bigint"), ("j", "bigint"), ("v", "bigint")]
    assert (to_dense(c, (300, 30)) == a @ b).all() and c.count() == np.count_nonzero(a @ b)
    by = [str(p.outputPartitioning()) for p in nodes(c)]
    assert by and not any("r#" in x and "c#" in x for x in by)
    d = products.matmul_join(*(from_dense(spark, x).withColumn("v", F.col("v").cast("decimal(9,2)")) for x in (a, b)), block_pairs=1)
    assert {(r.i, r.j): int(r.v) for r in d.collect()} == {(r.i, r.j): r.v for r in c.collect()}


def test_sums_are_few_where_the_output_is_small(spark):
    n = sparse_tiles.block_counts(from_dense(spark, np.ones((4, 500), dtype=np.int64)), from_dense(spark, np.ones((500, 4), dtype=np.int64)))
    assert (n.pairs, n.blocks, n.heaviest, n.cells, n.longest, n.sums(8)) == (8000, 1, 8000, 2000, 4, 128)


def test_strassen_leaves_send_rows(spark, monkeypatch):
    """F5."""
    rnd = np.random.default_rng(7)
    a, b = sparse(rnd, 60, 40, 0.1), sparse(rnd, 40, 50, 0.1)
    monkeypatch.setattr(strassen, "BLOCK_PAIRS", 1)
    c = strassen.matmul_strassen(from_dense(spark, a), from_dense(spark, b), 2, (60, 40), (40, 50))
    assert "collect_list" in c._jdf.queryExecution().executedPlan().toString()
    assert (to_dense(c, (60, 50)) == a @ b).all()
