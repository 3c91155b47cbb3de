"""Sums of doubles: the same bits under every partitioning, next to the exact sum, IEEE rules for the rest."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, from_dense, to_dense
from tessera.operators import algebra
from tessera.operators.layout import rows_to_cells
from tessera.operators.repeatable import add_repeatable, matmul_repeatable, repeatable_sum
from tessera.sources import tables


def sums(spark, groups, parts=3):
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
    return {r.g: r.s for r in repeatable_sum(df, ["g"], "x", "s").collect()}


def wide(seed, n=400):
    rnd = random.Random(seed)
    return [rnd.choice([-1, 1]) * rnd.random() * 2.0 ** rnd.randint(-200, 200) for _ in range(n)]


def test_next_to_the_exact_sum_in_any_order(spark):
    groups = {f"w{k}": wide(k) for k in range(20)} | {f"n{k}": [random.Random(k).gauss(0, 1) for _ in range(300)] for k in range(10)}
    got = [sums(spark, groups, p) for p in (1, 4, 7, 16)]
    assert all({g: v.hex() for g, v in x.items()} == {g: v.hex() for g, v in got[0].items()} for x in got)
    for g, xs in groups.items():
        exact = math.fsum(xs)
        assert abs(got[0][g] - exact) <= math.ulp(exact), g


def test_edges(spark):
    inf, nan, tiny, top = math.inf, math.nan, 5e-324, 1.7976931348623157e308
    groups = {"one": [0.1], "cancel": [1e300, 1.0, -1e300], "tiny": [tiny, tiny, tiny], "top": [top], "near_top": [top, -top / 2], "over": [top, top],
              "over_back": [top, top, -top], "inf": [1.0, inf], "both": [inf, -inf], "nan": [nan, 1.0], "null": [None, None],
              "some": [None, 2.5], "zero": [0.0, -0.0], "power": [2.0 ** 32, 2.0 ** 64 - 2048, 2.0 ** -32], "less": [2.0 ** 32 - 2.0 ** -20],
              "subnormal": [2.2250738585072014e-308, -tiny]}
    got = sums(spark, groups)
    want = {"one": 0.1, "cancel": 1.0, "tiny": 3 * tiny, "top": top, "near_top": top / 2, "over": inf, "over_back": top, "inf": inf, "null": None,
            "some": 2.5, "zero": 0.0, "power": math.fsum(groups["power"]), "less": groups["less"][0], "subnormal": math.fsum(groups["subnormal"])}
    assert {g: got[g] for g in want} == want
    assert math.isnan(got["both"]) and math.isnan(got["nan"])


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 2.0, 7.0), (1, 0.5, 7.0)], "k int, l0 double, bins double")
    assert repeatable_sum(df.withColumnRenamed("k", "g"), ["g"], "l0", "odd").collect() == [(1, 2.5)]
    assert repeatable_sum(df.where("false").withColumnRenamed("k", "g"), ["g"], "l0").collect() == []
    with pytest.raises(ValueError):
        repeatable_sum(df, ["k"], "l0")


def test_sum_of_matrices(spark):
    rnd = np.random.default_rng(3)
    x, y = rnd.normal(size=(6, 5)), rnd.normal(size=(6, 5))
    got = to_dense(add_repeatable(from_dense(spark, x, "double"), from_dense(spark, y, "double")), (6, 5), float)
    assert (np.abs(got - (x + y)) <= np.spacing(np.abs(x + y))).all()
    assert add_repeatable(from_dense(spark, x, "double"), from_dense(spark, -x, "double")).count() == 0


def test_product_has_the_same_bits_under_every_partitioning(spark):
    e = rows_to_cells(tables.table(spark, SF001, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("row")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (1, 4, 7, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            c = matmul_repeatable(algebra.transpose(e.repartition(n, "j")), e.repartition(n))
            seen.append({(r.i, r.j): r.v.hex() for r in c.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(s == seen[0] for s in seen)
    cols = {}
    for r in e.collect():
        cols.setdefault(r.j, {})[r.i] = r.v
    for (i, j), v in list(seen[0].items())[::97]:
        exact = math.fsum(cols[i][k] * cols[j][k] for k in cols[i].keys() & cols[j].keys())
        assert abs(float.fromhex(v) - exact) <= math.ulp(exact)
