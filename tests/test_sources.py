"""Generators, Parquet row tables, size sweep, local rows."""

import numpy as np
from pyspark.sql import functions as F

from conftest import to_dense
from tessera.operators.layout import cells_to_rows, rows_to_cells
from tessera.session import shared_dir
from tessera.sources import generate, io


def test_generators_are_partition_independent(spark):
    a = generate.uniform(spark, 20, 30, seed=5, partitions=1).toPandas().sort_values(["i", "j"])
    b = generate.uniform(spark, 20, 30, seed=5, partitions=7).toPandas().sort_values(["i", "j"])
    assert (a["v"].values == b["v"].values).all()
    assert ((a["v"] >= 0) & (a["v"] < 1)).all()
    assert a["v"].std() > 0.2


def test_binary_and_zero(spark):
    bn = generate.binary(spark, 16, 16, seed=1).toPandas()
    assert set(bn["v"].unique()) == {0, 1}
    z = generate.binary(spark, 8, 8, seed=1, k=1).toPandas()
    assert (z["v"] == 0).all() and len(z) == 64


def test_formula_matches_python(spark):
    f = to_dense(generate.formula(spark, 5, 4, seed=7), (5, 4))
    ref = np.array([[(48271 * i + 16807 * j + 7) % 100003 for j in range(4)] for i in range(5)])
    assert (f == ref).all()


def test_rows_roundtrip_with_index(spark):
    base = shared_dir(spark)
    path = f"{base}/test-rows-{np.random.default_rng().integers(1 << 40)}"
    m = generate.formula(spark, 33, 17, seed=3)
    io.write_rows(m, path, ncols=17)
    back = io.read_cells(spark, path, "bigint")
    assert (to_dense(back, (33, 17)) == to_dense(m, (33, 17))).all()
    # filters on i reach the Parquet scan
    plan = io.read_rows(spark, path, "bigint").where(F.col("i") < 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(i), LessThan(i,5)]" in plan


def test_unindexed_row_table(spark):
    """A table stored as bare rows (no index) over several files keeps its row order."""
    base = shared_dir(spark)
    path = f"{base}/test-bare-{np.random.default_rng().integers(1 << 40)}"
    m = generate.formula(spark, 40, 6, seed=2)
    rows = cells_to_rows(m).repartitionByRange(4, "i").sortWithinPartitions("i").select("row")
    rows.write.parquet(path)
    assert len([f for f in __import__("os").listdir(path) if f.endswith(".parquet")]) > 1
    back = rows_to_cells(io.read_unindexed_rows(spark, path))
    assert (to_dense(back, (40, 6)) == to_dense(m, (40, 6))).all()


def test_sweep_writer_and_partition_pruning(spark):
    base = shared_dir(spark)
    path = f"{base}/test-sweep-{np.random.default_rng().integers(1 << 40)}"
    io.write_sweep(spark, path, [8, 16], seed=1, kind="formula")
    x = io.read_sweep(spark, path, 16, 2, "bigint")
    assert x.count() == 256
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(n" in plan
    ref = generate.formula(spark, 16, 16, seed=1 * 1000 + 16 * 10 + 2)
    assert (to_dense(x, (16, 16)) == to_dense(ref, (16, 16))).all()


def test_rows_from_local(spark):
    r = io.rows_from_local(spark, [[1.0, 2.0], [3.0, 4.0]])
    c = to_dense(rows_to_cells(r), (2, 2), dtype=float)
    assert (c == np.array([[1.0, 2.0], [3.0, 4.0]])).all()


def test_row_generators_equal_cell_generators(spark):
    for kind in ("uniform", "binary", "formula"):
        r = rows_to_cells(generate.rows(spark, 7, 5, kind, seed=4))
        c = getattr(generate, kind)(spark, 7, 5, seed=4)
        assert r.exceptAll(c).count() == 0 and c.exceptAll(r).count() == 0


def test_bucketed_factors_join_without_shuffle(spark):
    from tessera.operators.products import matmul_join
    from tessera.sources.io import save_bucketed
    base = shared_dir(spark)
    tag = np.random.default_rng().integers(1 << 40)
    a = generate.formula(spark, 30, 20, seed=1)
    b = generate.formula(spark, 20, 25, seed=2)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ta = save_bucketed(a, f"tess_a_{tag}", f"{base}/bucket-a-{tag}", "j", 8)
        tb = save_bucketed(b, f"tess_b_{tag}", f"{base}/bucket-b-{tag}", "i", 8)
        c = matmul_join(ta, tb)
        p = c._jdf.queryExecution().executedPlan().toString()
        join_part = p[p.index("SortMergeJoin"):]
        assert "Exchange" not in join_part
        assert (to_dense(c, (30, 25)) == to_dense(a, (30, 20)) @ to_dense(b, (20, 25))).all()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_category_index_is_a_dense_rank(spark):
    from tessera.sources.tables import category_index
    vals = ["v%03d" % (k * 7 % 101) for k in range(300)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "c STRING")
    want = {v: n for n, v in enumerate(sorted({v for v in vals if v is not None}))}
    for parts in (1, 3, 16):
        d, small = category_index(df, "c", partitions=parts, small_limit=10)
        assert not small
        assert {r["c"]: r["j"] for r in d.collect()} == want
    d, small = category_index(df, "c")
    assert small and {r["c"]: r["j"] for r in d.collect()} == want


def test_csv_reader_line_endings_and_whitespace(spark):
    """CRLF line ends, a trailing newline and spaces around commas read the same as clean text."""
    from tessera.sources.io import read_csv_matrix
    base = shared_dir(spark)
    d = f"{base}/test-csv-{np.random.default_rng().integers(1 << 40)}"
    import os
    os.makedirs(d)
    with open(f"{d}/m.csv", "w", newline="") as f:
        f.write("0.12345, 0.50000,0.00001\r\n0.99999,0.10000 ,0.20000\r\n\r\n")
    got = to_dense(read_csv_matrix(spark, f"{d}/m.csv"), (2, 3))
    assert (got == np.array([[12345, 50000, 1], [99999, 10000, 20000]])).all()
