"""Physical plan checks: broadcasts where promised, pruning, no driver collects in operators."""

import os
import re

from conftest import SF01
from tessera.functions.coefficients import combine_terms, left_terms, right_terms
from tessera.plans.catalog import QUERIES

PKG = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tessera")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coefficient_tables_are_strassen():
    """sum_m W*U*V is the 2x2 matrix-multiplication tensor, and each table has 12 rows."""
    u, v, w = left_terms(), right_terms(), combine_terms()
    assert len(u) == len(v) == len(w) == 12
    for cq in range(4):
        for aq in range(4):
            for bq in range(4):
                t = sum(su * sv * sw for (qa, ma, su) in u for (qb, mb, sv) in v
                        for (mw, qc, sw) in w if qa == aq and qb == bq and qc == cq and ma == mb == mw)
                ci, cj = divmod(cq, 2)
                ai, ak = divmod(aq, 2)
                bk, bj = divmod(bq, 2)
                assert t == (1 if (ai == ci and bj == cj and ak == bk) else 0)


def test_strassen_broadcasts_coefficients(spark):
    p = plan(QUERIES["matmul_strassen_l1"](spark, SF01))
    assert p.count("BroadcastHashJoin") >= 3
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_scan_prunes_columns(spark):
    p = plan(QUERIES["matmul_join"](spark, SF01))
    for m in re.finditer(r"ReadSchema: (struct<[^>]*>)", p):
        assert "l_comment" not in m.group(1) and "l_shipdate" not in m.group(1)


def test_partial_aggregation_before_shuffle(spark):
    p = plan(QUERIES["matmul_join"](spark, SF01))
    assert "partial_sum" in p


def test_dense_product_takes_block_path(spark):
    """E * E^T is dense with real work: dispatch picks NumPy block panels, not cell pairs."""
    p = plan(QUERIES["matmul_abt"](spark, SF01))
    assert "FlatMapCoGroupsInPandas" in p


def test_no_driver_collect_in_operators():
    """Matrix operators never pull data to the driver (only bounded shape/size checks).

    layout.py: ``shape_of`` / ``dims_of`` / ``stats_of`` read one aggregate row per matrix;
    io.py: ``write_rows`` reads one width;
    joins.py: ``broadcast_if_small`` counts at most max_rows + 1 rows;
    tables.py: ``category_index`` counts at most small_limit + 1 values;
    panels.py: ``panels_of`` reads a count and one row a panel, at most 32;
    sparse_tiles.py: ``pair_counts`` reads one aggregate row;
    estimate.py: ``output_cells`` reads one aggregate row.
    """
    allowed = {"layout.py": ["first()", ".collect()"], "io.py": ["first()"], "joins.py": ["count()"], "tables.py": ["count()"],
               "panels.py": ["count()", ".collect()"], "sparse_tiles.py": ["first()"], "estimate.py": ["first()"]}
    for sub in ("functions", "operators", "sources"):
        root = os.path.join(PKG, sub)
        for f in os.listdir(root):
            if not f.endswith(".py"):
                continue
            src = open(os.path.join(root, f)).read()
            if ".collect()" in src:
                assert ".collect()" in allowed.get(f, []), f
            assert "toPandas()" not in src, f
            assert "localCheckpoint" not in src, f
            for tok in ("first()", "count()"):
                if tok in src.replace("F.count(", ""):
                    assert tok in allowed.get(f, []), (f, tok)


def test_broadcast_only_below_the_checked_size(spark):
    """Above the bound B is not broadcast: the product falls back to the shuffle join."""
    import numpy as np
    from conftest import from_dense, to_dense
    from tessera.operators.joins import broadcast_if_small
    from tessera.operators.products import matmul_broadcast
    x = np.arange(1, 17, dtype=np.int64).reshape(4, 4)
    a, b = from_dense(spark, x), from_dense(spark, x)
    assert broadcast_if_small(b, 16)[1] and not broadcast_if_small(b, 15)[1]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = matmul_broadcast(a, b, max_cells=16)
        big = matmul_broadcast(a, b, max_cells=15)
        assert "BroadcastHashJoin" in plan(small)
        assert "SortMergeJoin" in plan(big) and "BroadcastHashJoin" not in plan(big)
        for c in (small, big):
            assert (to_dense(c, (4, 4)) == x @ x).all()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
