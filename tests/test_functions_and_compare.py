"""Index expressions, and the strategy comparison job."""

from pyspark.sql import functions as F

from tessera.functions.expressions import (
    child_path, halve, padded_size, path_m, path_parent, pow2, product_label, quadrant,
    quadrant_label,
)
from tessera.plans.compare import compare_strategies, generated_inputs, side_by_side, sweep_sizes


def test_path_codes_are_bijective_base_7(spark):
    df = spark.createDataFrame([(p,) for p in (8, 14, 15, 56)], "path BIGINT")
    got = df.select("path", path_m("path").alias("m"), path_parent("path").alias("parent")).collect()
    assert [(r["path"], r["m"], r["parent"]) for r in got] == [(8, 1, 1), (14, 7, 1), (15, 1, 2), (56, 7, 7)]
    # every level-2 id decodes back to itself
    lv2 = spark.range(1, 8).select(F.col("id").alias("p1")).select(
        F.explode(F.sequence(F.lit(1), F.lit(7))).alias("m"), "p1").select(
        child_path("p1", "m").alias("path"), "p1", "m")
    rows = lv2.select("path", (path_parent("path") == F.col("p1")).alias("a"),
                      (path_m("path") == F.col("m")).alias("b")).collect()
    assert len({r["path"] for r in rows}) == 49 and all(r["a"] and r["b"] for r in rows)
    assert min(r["path"] for r in rows) == 8 and max(r["path"] for r in rows) == 56


def test_quadrants_labels_halves_powers(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (4, 1), (7, 7)], "i BIGINT, j BIGINT")
    q = df.select(quadrant("i", "j", 4, 4).alias("q")).collect()
    assert [r["q"] for r in q] == [0, 1, 2, 3]
    lab = df.select(quadrant_label("B", quadrant("i", "j", 4, 4)).alias("l"),
                    product_label("A", quadrant("i", "j", 4, 4), F.lit(6)).alias("p")).collect()
    assert [r["l"] for r in lab] == ["B11", "B12", "B21", "B22"]
    assert lab[3]["p"] == "A22, M6"
    h = spark.range(0, 6).select(halve("id").alias("h"), pow2("id").alias("p")).collect()
    assert [r["h"] for r in h] == [0, 0, 1, 1, 2, 2] and [r["p"] for r in h] == [1, 2, 4, 8, 16, 32]
    assert padded_size(500, 3) == 504 and padded_size(64, 3) == 64 and padded_size(5, 2) == 8
    assert sweep_sizes(spark, 3, 6) == [8, 16, 32, 64]


def test_compare_job(spark):
    t = compare_strategies(spark, generated_inputs(spark, [16]), ["join", "block", "strassen", "mllib_block"],
                           block_size=8)
    rows = t.collect()
    assert {r["strategy"] for r in rows} == {"join", "block", "strassen", "mllib_block"}
    assert all(r["seconds"] > 0 for r in rows)
    wide = side_by_side(t).collect()
    assert len(wide) == 1 and wide[0]["strassen_l2"] is not None
