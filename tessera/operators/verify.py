"""Check of a product without a second product: does C = A * B hold, by random vectors.

A round draws a vector x over the columns of B, takes A(Bx) and Cx modulo a prime, and compares
them row by row: three products of a matrix and a vector, each a join on the vector's index and a
sum, instead of one of two matrices. If a row of C is wrong, a round misses it with a probability
of about 1 / ``PRIME``; rounds are independent, so ``rounds`` of them miss it with that to their
power (a row whose error is a multiple of the prime in every cell is missed by all).

Integer CELLS alone. The vectors come from a hash of (index, round, seed), so a lost task draws
the same numbers again. Repeated cells of one coordinate add up; empty matrices agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647


def _vector(index: str, round_: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(index), round_, F.lit(seed)), F.lit(PRIME))


def _reduced(total: Column) -> Column:
    return F.pmod(total, F.lit(PRIME))


def check_product(a: DataFrame, b: DataFrame, c: DataFrame, rounds: int = 3, seed: int = 0) -> DataFrame:
    """round, n_rows (rows of A * B or C that hold a cell), n_wrong (rows where the two differ)."""
    a, b, c = (m.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), _reduced(F.col("v").cast("bigint")).alias("v")) for m in (a, b, c))
    # Rounds are columns, and A and B are shuffled as cells: a row a round and cell, or sums of few cells, would be several times as much.
    # Terms are below the prime, so 2^32 of them add up in 64 bits.
    times = [_reduced(F.col("v") * _vector("j", F.lit(r), seed)) for r in range(rounds)]
    bx = b.repartition("i").groupBy("i").agg(*(_reduced(F.sum(t)).alias(f"y{r}") for r, t in enumerate(times))).withColumnRenamed("i", "j")
    abx = a.repartition("j").join(bx, "j").select("i", *(_reduced(F.col("v") * F.col(f"y{r}")).alias(f"t{r}") for r in range(rounds)))
    cx = c.select("i", *((F.lit(PRIME) - t).alias(f"t{r}") for r, t in enumerate(times)))
    wrong = F.array(*(F.struct(F.lit(r).alias("round"), (_reduced(F.sum(f"t{r}")) != 0).alias("wrong")) for r in range(rounds)))
    rows = abx.unionByName(cx).groupBy("i").agg(wrong.alias("x")).select(F.explode("x").alias("x")).select("x.round", "x.wrong")
    return rows.groupBy("round").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("wrong"), 1)).alias("n_wrong"))
