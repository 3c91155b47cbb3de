"""Rows of B sent, packed, once to every block of A's rows that needs them.

``contract`` (see ``joins``) shuffles a row of every pair whose output cell is not added up within
its map task, and a grid of tiles copies every cell as often as the grid is wide. Here A's rows
form blocks of ``BLOCK_ROWS`` neighbours. A block that has cells of an inner index k gets B's row k
once, as packed arrays, whatever the number of its rows that meet k. All pairs of an output cell
then lie in one task, so no sums are shuffled. What is shuffled is A's cells and, for each cell of
B, as many packed copies as blocks need it: at most the cells of A's column, fewer where
neighbouring rows meet the same k, and no more as the matrices grow by further rows alike.

B's rows are cut into ``parts`` by a hash of the output column, so that neither a heavy block nor a
long row of B goes to one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import default_tasks

BLOCK_ROWS = 256


def row_block(r: str):
    return F.expr(f"{r} div {BLOCK_ROWS}")


def packed_left(left: DataFrame, group: list[str]) -> DataFrame:
    """group + [r, k, lv] -> group + [rb, k, le]: a block's cells of one inner index."""
    x = left.withColumn("rb", row_block("r")).repartition(default_tasks(left.sparkSession), *group, "k")
    return x.groupBy(*group, "rb", "k").agg(F.collect_list(F.struct("r", "lv")).alias("le"))


def packed_right(right: DataFrame, group: list[str], parts: int) -> DataFrame:
    """group + [k, c, rv] -> group + [k, cs, re]: a part of one row."""
    x = (right.withColumn("cs", F.pmod(F.xxhash64("c"), F.lit(parts)).cast("int"))
              .repartition(default_tasks(right.sparkSession), *group, "k"))
    return x.groupBy(*group, "k", "cs").agg(F.collect_list(F.struct("c", "rv")).alias("re"))


def contract_blocks(left: DataFrame, right: DataFrame, group: list[str], parts: int = 1) -> DataFrame:
    """What ``joins.contract`` returns: sum_k left(g, r, k, lv) * right(g, k, c, rv) -> (g..., r, c, v)."""
    both = packed_left(left, group).join(packed_right(right, group, parts), group + ["k"])
    sent = both.repartition(default_tasks(left.sparkSession), *group, "rb", "cs").select(*group, "rb", "cs", F.explode("le").alias("x"), "re")
    pairs = sent.select(*group, "rb", "cs", "x", F.explode("re").alias("y"))
    sums = pairs.groupBy(*group, "rb", "cs", F.col("x.r").alias("r"), F.col("y.c").alias("c")).agg(F.sum(F.col("x.lv") * F.col("y.rv")).alias("v"))
    return sums.select(*group, "r", "c", "v")
