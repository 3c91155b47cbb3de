"""Element-wise algebra on CELLS: add, subtract, transpose, tagged union, diff.

Sparse canonical form: results never carry explicit zero cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_zeros(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("v") != 0)


def canonical(cells: DataFrame) -> DataFrame:
    """Canonical CELLS: one row per (i, j) (duplicates summed), no zero cells.

    Every operator here returns canonical cells; the layout conversions
    (cells -> rows / tiles) expect them, so foreign input with repeated
    coordinates should pass through this first.
    """
    return drop_zeros(cells.groupBy("i", "j").agg(F.sum("v").alias("v")))


def _signed_sum(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    u = None
    for df, sgn in parts:
        x = df.select("i", "j", (F.col("v") * sgn if sgn != 1 else F.col("v")).alias("v"))
        u = x if u is None else u.unionByName(x)
    # Partial (map-side) aggregation combines co-located cells before the shuffle.
    return drop_zeros(u.groupBy("i", "j").agg(F.sum("v").alias("v")))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """A + B: bag union, then one sum per cell."""
    return _signed_sum([(a, 1), (b, 1)])


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """A - B."""
    return _signed_sum([(a, 1), (b, -1)])


def transpose(a: DataFrame) -> DataFrame:
    """A^T: swap the indices (a projection, no shuffle)."""
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def union_tagged(left: DataFrame, right: DataFrame, col: str = "side",
                 tags: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Bag union of two frames with a tag column saying where each row came from."""
    return (left.withColumn(col, F.lit(tags[0]))
                .unionByName(right.withColumn(col, F.lit(tags[1])), allowMissingColumns=True))


def matrix_diff(x: DataFrame, y: DataFrame, tol: float = 0.0) -> DataFrame:
    """Compare two matrices cell by cell (absent cell = 0).

    One row: ``cells`` (cells present in either), ``differing`` (|x - y| > tol)
    and ``max_abs_diff``. A full outer join on (i, j); both sides are
    shuffled by the cell key, which has no hot values.
    """
    j = x.alias("x").join(y.alias("y"), ["i", "j"], "full_outer")
    d = F.abs(F.coalesce(F.col("x.v"), F.lit(0)) - F.coalesce(F.col("y.v"), F.lit(0)))
    return j.agg(F.count(F.lit(1)).alias("cells"),
                 F.count(F.when(d > tol, 1)).alias("differing"),
                 F.coalesce(F.max(d), F.lit(0)).alias("max_abs_diff"))
