"""Sums of doubles that are bitwise the same whatever the partitioning, order of rows or retries.

``sum`` of doubles rounds at every step, so its last bits follow the order in which tasks finish.
Here each value is cut without error into whole numbers: with ``k = floor(log2|v| / 20)``, v is
``(l0 + l1 / 2^20 + l2 / 2^40 + l3 / 2^60) * 2^(20 k)`` for integers l0 to l3 of at most 21 bits. Rows
of the same k add up as 64-bit integers, which do not round, and combine before the shuffle like
any sum; 2^41 values of a group may share a k, and Spark reports the overflow beyond. A group has
at most 107 different k, so what is left per group is small and bounded. An Arrow task carries the
digits of its groups from the lowest up (of the negated bins where the sum is negative, so that no
digit is) and adds them as doubles: within one unit in the last place of the exact sum, and the
exact sum itself where a double holds it.

Infinities and NaN follow IEEE rules in any order (inf - inf is NaN). Null values count as absent; a
group of nulls alone sums to null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.operators.algebra import drop_zeros

#: Bits of a digit, and groups whose digits are held at once.
BITS, GROUPS = 20, 4096
_LIMBS = ("l0", "l1", "l2", "l3")


def _limbs(v: Column) -> list[Column]:
    """k and the limbs of a finite double; zeros have k = 0 and no limbs."""
    k = F.when(v == 0, 0).otherwise(F.floor(F.log2(F.abs(v)) / BITS)).cast("int")
    half = F.pow(F.lit(2.0), -k * (BITS // 2))  # 2^(20 k) itself may be no double
    rest, out = v * half * half, []
    for name in _LIMBS:
        limb = rest.cast("bigint")
        out.append(limb.alias(name))
        rest = (rest - limb.cast("double")) * float(1 << BITS)
    return [k.alias("k"), *out]


def _carry(digits: np.ndarray) -> np.ndarray:
    """Digits in place to 0 .. 2^20 - 1, column by column; returns what is carried out of the last one."""
    carry = np.zeros(len(digits), dtype=np.int64)
    for d in range(digits.shape[1]):
        total = digits[:, d] + carry
        digits[:, d] = total & ((1 << BITS) - 1)
        carry = total >> BITS
    return carry


def fold(group: np.ndarray, k: np.ndarray, limbs: np.ndarray, n: int) -> np.ndarray:
    """The sums of n groups as doubles, from bins: the group's number, k and a row of limbs of each."""
    if not len(k):
        return np.zeros(n)
    low = int(k.min()) - len(_LIMBS) + 1
    width = int(k.max()) - low + 5  # a limb of 64 bits carries into three digits more
    digits = np.zeros((n, width), dtype=np.int64)
    for m in range(len(_LIMBS)):
        at = k - m - low
        np.add.at(digits, (group, at), limbs[:, m] & ((1 << BITS) - 1))
        np.add.at(digits, (group, at + 1), limbs[:, m] >> BITS)
    negated = -digits
    less = _carry(digits) < 0
    _carry(negated)
    digits[less] = negated[less]
    top = width - 1 - np.argmax(digits[:, ::-1] != 0, axis=1)  # of each group, so that the others don't matter
    total = np.zeros(n)
    for d in range(width):
        total += np.ldexp(digits[:, d].astype(np.float64), np.minimum(d - top, 0) * BITS)
    with np.errstate(over="ignore"):
        return np.ldexp(np.where(less, -total, total), (top + low) * BITS)


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys..., bins, odd) to (keys..., sum)."""
    for b in (whole.slice(at, GROUPS) for whole in batches for at in range(0, whole.num_rows, GROUPS)):
        bins, odd = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
        flat = bins.flatten()
        size = np.diff(bins.offsets.to_numpy())
        group = np.repeat(np.arange(b.num_rows), size)
        k = flat.field("k").to_numpy().astype(np.int64)
        limbs = np.column_stack([flat.field(c).to_numpy() for c in _LIMBS])
        total = np.where(odd.is_valid().to_numpy(zero_copy_only=False), odd.fill_null(0.0).to_numpy(), fold(group, k, limbs, b.num_rows))
        none = (size == 0) & odd.is_null().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(total, mask=none)], names=[*b.schema.names[:-2], "sum"])


def repeatable_sum(df: DataFrame, keys: list[str], value: str, name: str = "v") -> DataFrame:
    """keys and the sum of the double column ``value`` of each group: the same bits in every run."""
    if clash := {"k", "bins", "odd", "x", "sum", *_LIMBS} & {*keys}:
        raise ValueError(f"key columns {sorted(clash)} need other names")
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    flat = df.select(*keys, F.when(finite, v).alias("x"), F.when(~finite, v).alias("odd"))
    cut = flat.select(*keys, "odd", *_limbs(F.col("x")))
    # sums of infinities and NaN do not depend on the order
    per = cut.groupBy(*keys, "k").agg(*[F.sum(c).alias(c) for c in _LIMBS], F.sum("odd").alias("odd"))
    bins = per.groupBy(*keys).agg(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", *_LIMBS))).alias("bins"), F.sum("odd").alias("odd"))
    spec = StructType([*bins.schema.fields[:-2], StructField("sum", DoubleType())])
    return bins.mapInArrow(_fold_batches, spec).withColumnRenamed("sum", name)


def add_repeatable(*parts: DataFrame) -> DataFrame:
    """Sum of CELLS matrices of doubles (repeated cells of one coordinate included), bitwise repeatable; zeros are dropped."""
    u = None
    for p in parts:
        p = p.select("i", "j", F.col("v").cast("double").alias("v"))
        u = p if u is None else u.unionByName(p)
    return drop_zeros(repeatable_sum(u, ["i", "j"], "v"))


def matmul_repeatable(a: DataFrame, b: DataFrame) -> DataFrame:
    """C = A * B on CELLS of doubles, bitwise repeatable; zeros are dropped.

    Each product is rounded once, to a double, and the products of a cell then add up without
    error. The join shuffles on the inner index, where AQE splits a hot one; products are cut and
    added up in the task that makes them before the shuffle by output cell.
    """
    left = a.select(F.col("i").alias("r"), F.col("j").alias("x"), F.col("v").cast("double").alias("lv"))
    right = b.select(F.col("i").alias("x"), F.col("j").alias("c"), F.col("v").cast("double").alias("rv"))
    pairs = left.join(right, "x").select(F.col("r").alias("i"), F.col("c").alias("j"), (F.col("lv") * F.col("rv")).alias("p"))
    return drop_zeros(repeatable_sum(pairs, ["i", "j"], "p"))
