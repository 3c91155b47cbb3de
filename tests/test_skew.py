"""One inner index holding a third of all cells: split over tasks, result exact."""

import numpy as np
from pyspark.sql import functions as F

from conftest import from_dense, to_dense
from tessera.operators.joins import hot_key_table
from tessera.operators.products import matmul_join
from tessera.operators.strassen import matmul_strassen


def skewed(n=60, seed=0):
    r = np.random.default_rng(seed)
    a = (r.random((n, n)) < 0.05) * r.integers(1, 9, (n, n))
    a[:, 7] = r.integers(1, 9, n)          # column 7 of A is full
    b = (r.random((n, n)) < 0.05) * r.integers(1, 9, (n, n))
    b[7, :] = r.integers(1, 9, n)          # row 7 of B is full
    return a.astype(np.int64), b.astype(np.int64)


def test_hot_key_is_found_and_split(spark):
    x, y = skewed()
    a, b = from_dense(spark, x), from_dense(spark, y)
    left = a.select(F.col("i").alias("r"), F.col("j").alias("k"), F.col("v").alias("lv"))
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("rv"))
    hot = hot_key_table(left, right, ["k"], pairs_per_task=200, max_hot=8).collect()
    ks = {r["k"]: (r["sa"], r["sb"]) for r in hot}
    assert 7 in ks
    sa, sb = ks[7]
    assert sa * sb >= 60 * 60 // 200


def test_split_join_is_exact(spark):
    x, y = skewed()
    a, b = from_dense(spark, x), from_dense(spark, y)
    for ppt in (1, 50, 1 << 24):
        c = matmul_join(a, b, hot_split=True, pairs_per_task=ppt, max_hot=3)
        assert (to_dense(c, (60, 60)) == x @ y).all()
    assert (to_dense(matmul_join(a, b, hot_split=False), (60, 60)) == x @ y).all()


def test_split_in_strassen_leaf(spark):
    x, y = skewed(32, 1)
    a, b = from_dense(spark, x), from_dense(spark, y)
    c = matmul_strassen(a, b, 1, (32, 32), (32, 32), hot_split=True, pairs_per_task=5)
    assert (to_dense(c, (32, 32)) == x @ y).all()


AQE_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_aqe_splits_hot_key_in_join_product(spark):
    x, y = skewed(64, 3)
    a, b = from_dense(spark, x).repartition(8), from_dense(spark, y).repartition(8)

    def run():
        c = matmul_join(a, b)
        return to_dense(c, (64, 64)), c._jdf.queryExecution().executedPlan().toString()
    got, final = _with_conf(spark, AQE_CONF, run)
    assert (got == x @ y).all()
    assert "SortMergeJoin(skew=true)" in final


def test_aqe_splits_hot_leaf_join(spark):
    """With the default plan, AQE sees the hot inner index and splits the leaf join."""
    x, y = skewed(64, 2)
    a, b = from_dense(spark, x), from_dense(spark, y)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        c = matmul_strassen(a.repartition(8), b.repartition(8), 1, (64, 64), (64, 64))
        got = to_dense(c, (64, 64))
        final = c._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert (got == x @ y).all()
    assert "SortMergeJoin(skew=true)" in final


def rnd(shape, seed, density=1.0):
    r = np.random.default_rng(seed)
    return (r.integers(-9, 10, shape) * (r.random(shape) < density)).astype(np.int64)


def test_broadcast_product_reads_a_once_and_shuffles_partial_sums_alone(spark):
    """A hot row is spread like any other cells: no exchange below the join, one scan of A."""
    from tessera.operators.products import matmul_broadcast
    from tessera.session import shared_dir
    x, y = rnd((30, 40), 7, density=0.2), rnd((40, 6), 8)
    x[3, :] = np.arange(1, 41)
    path = f"{shared_dir(spark)}/broadcast-{np.random.default_rng().integers(1 << 40)}"
    from_dense(spark, x).write.parquet(path)
    a, b = spark.read.parquet(path), from_dense(spark, y)
    c = matmul_broadcast(a, b)
    plan = c._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("BroadcastHashJoin"):]
    assert "Exchange hashpartitioning" not in below and plan.count("FileScan parquet") == 1
    assert (to_dense(c, (30, 6)) == x @ y).all()


def test_rows_broadcast_is_one_narrow_pass(spark):
    import pytest
    from tessera.operators.layout import cells_to_rows, rows_to_cells
    from tessera.operators.products import matmul_rows_broadcast
    for dtype, name in ((np.int64, "bigint"), (float, "double")):
        x, y = rnd((30, 12), 9), rnd((12, 5), 10)
        rows = cells_to_rows(from_dense(spark, x.astype(dtype), name), 12)
        c = matmul_rows_broadcast(rows, from_dense(spark, y.astype(dtype), name), (12, 5))
        assert dict(c.dtypes)["row"] == f"array<{name}>"
        assert (to_dense(rows_to_cells(c), (30, 5)) == x @ y).all()
    with pytest.raises(ValueError):
        matmul_rows_broadcast(rows, from_dense(spark, y), (12, 5), max_cells=3)
