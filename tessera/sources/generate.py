"""Seeded, partition-independent matrix generators.

Values depend only on (i, j, seed), never on partitioning or task order, so
a regenerated or recomputed partition is identical (safe under executor
loss). ``F.rand(seed)`` is avoided for that reason.

Generators over a size use ``spark.range`` (distributed from the start);
the ``*_like`` forms fill the index grid of an existing matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the integer formula generator (a multiplicative congruential
# mix; any values would do, these are the ones the oracle SQL repeats).
FORMULA_A = 48271
FORMULA_B = 16807
FORMULA_MOD = 100003


def _grid(spark: SparkSession, nrows: int, ncols: int, partitions: int | None) -> DataFrame:
    r = spark.range(0, nrows * ncols, numPartitions=partitions) if partitions else spark.range(0, nrows * ncols)
    return r.select((F.col("id") / ncols).cast("bigint").alias("i"),
                    F.pmod(F.col("id"), F.lit(ncols)).cast("bigint").alias("j"))


def _ij(i, j):
    return (F.col("i") if i is None else i), (F.col("j") if j is None else j)


def uniform_value(seed: int, i: Column | None = None, j: Column | None = None) -> Column:
    """Double in [0, 1): the first 52 bits of md5('i,j,seed'), which any SQL engine can repeat."""
    i, j = _ij(i, j)
    h = F.md5(F.concat_ws(",", i.cast("bigint").cast("string"), j.cast("bigint").cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") * F.lit(2.0 ** -52)


def binary_value(seed: int, k: int = 2, i: Column | None = None, j: Column | None = None) -> Column:
    """Integer in [0, k): k=2 gives 0/1 matrices, k=1 the all-zero matrix."""
    i, j = _ij(i, j)
    return F.pmod(F.xxhash64(i.cast("bigint"), j.cast("bigint"), F.lit(seed).cast("bigint")),
                  F.lit(k)).cast("bigint")


def formula_value(seed: int, modulus: int = FORMULA_MOD, i: Column | None = None,
                  j: Column | None = None) -> Column:
    """(48271*i + 16807*j + seed) mod modulus; reproducible in any SQL engine."""
    i, j = _ij(i, j)
    return F.pmod(i.cast("bigint") * FORMULA_A + j.cast("bigint") * FORMULA_B + F.lit(seed),
                  F.lit(modulus)).cast("bigint")


def uniform(spark: SparkSession, nrows: int, ncols: int, seed: int = 0,
            partitions: int | None = None) -> DataFrame:
    return _grid(spark, nrows, ncols, partitions).select("i", "j", uniform_value(seed).alias("v"))


def binary(spark: SparkSession, nrows: int, ncols: int, seed: int = 0, k: int = 2,
           partitions: int | None = None) -> DataFrame:
    return _grid(spark, nrows, ncols, partitions).select("i", "j", binary_value(seed, k).alias("v"))


def formula(spark: SparkSession, nrows: int, ncols: int, seed: int = 0,
            modulus: int = FORMULA_MOD, partitions: int | None = None) -> DataFrame:
    return _grid(spark, nrows, ncols, partitions).select("i", "j", formula_value(seed, modulus).alias("v"))


def rows(spark: SparkSession, nrows: int, ncols: int, kind: str = "uniform", seed: int = 0,
         partitions: int | None = None, **kw) -> DataFrame:
    """The same matrices in ROWS form: one record per row, built by the row's task.

    Equal, cell for cell, to the CELLS generators with the same arguments.
    """
    fn = {"uniform": uniform_value, "binary": binary_value, "formula": formula_value}[kind]
    r = spark.range(0, nrows, numPartitions=partitions) if partitions else spark.range(0, nrows)
    row = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(ncols - 1).cast("bigint")),
                      lambda j: fn(seed, i=F.col("id"), j=j, **kw))
    return r.select(F.col("id").alias("i"), row.alias("row"))


def like(cells: DataFrame, value: Column) -> DataFrame:
    """A generated matrix on the index grid of ``cells``."""
    return cells.select("i", "j", value.alias("v"))


def identity_like(cells: DataFrame) -> DataFrame:
    """Identity on the row indices of ``cells``."""
    return cells.select("i").distinct().select("i", F.col("i").alias("j"),
                                               F.lit(1).cast("bigint").alias("v"))
