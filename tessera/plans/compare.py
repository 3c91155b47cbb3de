"""Strategy comparison job: every product strategy on the same inputs, timed.

Each (inputs, strategy) pair is one Spark job writing to the ``noop`` sink,
so the clock covers the whole computation and nothing is collected. The
timings form a DataFrame ``(label, n, strategy, levels, seconds)``;
``side_by_side`` pivots it to one row per input and one column per strategy.

MLlib's ``BlockMatrix.multiply`` is included as a comparator only (it is
RDD-based and needs a classic session).
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expressions import pow2
from tessera.operators.algebra import transpose
from tessera.operators.blocks import matmul_block
from tessera.operators.layout import shape_of
from tessera.operators.products import matmul_broadcast, matmul_join
from tessera.operators.strassen import matmul_strassen
from tessera.sources import generate, tables

TIMING_SCHEMA = "label STRING, n BIGINT, strategy STRING, levels INT, seconds DOUBLE"


def _mllib_block(a: DataFrame, b: DataFrame, bs: int, sa, sb) -> None:
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry
    ma = CoordinateMatrix(a.rdd.map(lambda r: MatrixEntry(r["i"], r["j"], float(r["v"]))), *sa)
    mb = CoordinateMatrix(b.rdd.map(lambda r: MatrixEntry(r["i"], r["j"], float(r["v"]))), *sb)
    ma.toBlockMatrix(bs, bs).multiply(mb.toBlockMatrix(bs, bs)).blocks.count()


def strategies(block_size: int) -> dict:
    return {
        ("join", 0): lambda a, b, sa, sb: matmul_join(a, b),
        ("broadcast", 0): lambda a, b, sa, sb: matmul_broadcast(a, b),
        ("block", 0): lambda a, b, sa, sb: matmul_block(a, b, block_size, sa, sb),
        ("strassen", 1): lambda a, b, sa, sb: matmul_strassen(a, b, 1, sa, sb),
        ("strassen", 2): lambda a, b, sa, sb: matmul_strassen(a, b, 2, sa, sb),
        ("strassen_block", 1): lambda a, b, sa, sb: matmul_strassen(a, b, 1, sa, sb, leaf="block",
                                                                    block_size=block_size),
        ("mllib_block", 0): None,
    }


def table_inputs(spark: SparkSession, sf_dir: str) -> list:
    """Products over the bundled tables: (label, A, B, shape A, shape B)."""
    e = tables.embedding_matrix(spark, sf_dir)
    sp = tables.supplier_part(spark, sf_dir)
    ue = tables.user_event(spark, sf_dir)
    se, ss, su = shape_of(e), shape_of(sp), shape_of(ue)
    t = lambda s: (s[1], s[0])
    return [("E*E^T", e, transpose(e), se, t(se)), ("E^T*E", transpose(e), e, t(se), se),
            ("SP*SP^T", sp, transpose(sp), ss, t(ss)), ("UE^T*UE", transpose(ue), ue, t(su), su)]


def generated_inputs(spark: SparkSession, sizes: list[int], seed: int = 0) -> list:
    """Square uniform matrices; every strategy gets the same two per size."""
    return [(f"uniform{n}", generate.uniform(spark, n, n, seed * 2 + 1),
             generate.uniform(spark, n, n, seed * 2 + 2), (n, n), (n, n)) for n in sizes]


def sweep_sizes(spark: SparkSession, lo: int, hi: int) -> list[int]:
    """[2**lo, ..., 2**hi] (hi - lo + 1 values, read back from a tiny range)."""
    return [r["n"] for r in spark.range(lo, hi + 1).select(pow2("id").alias("n")).orderBy("n").collect()]


def compare_strategies(spark: SparkSession, inputs: list, names: list[str] | None = None,
                       block_size: int = 256) -> DataFrame:
    rows = []
    for label, a, b, sa, sb in inputs:
        for (name, levels), f in strategies(block_size).items():
            if names and name not in names:
                continue
            t0 = time.time()
            if f is None:
                _mllib_block(a, b, block_size, sa, sb)
            else:
                f(a, b, sa, sb).write.format("noop").mode("overwrite").save()
            rows.append((label, int(sa[0]), name, levels, time.time() - t0))
    return spark.createDataFrame(rows, TIMING_SCHEMA)


def side_by_side(timings: DataFrame) -> DataFrame:
    name = F.concat("strategy", F.when(F.col("levels") > 0, F.concat(F.lit("_l"), F.col("levels")))
                    .otherwise(F.lit("")))
    return (timings.withColumn("s", name).groupBy("label", "n").pivot("s")
                   .agg(F.round(F.min("seconds"), 3)).orderBy("label", "n"))


def main() -> None:
    from tessera.session import get_session
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--sizes", type=int, nargs="*", default=[])
    ap.add_argument("--pow2", type=int, nargs=2, metavar=("LO", "HI"), default=None,
                    help="add sizes 2**LO .. 2**HI (the reference swept 3 .. 12)")
    ap.add_argument("--strategies", nargs="*", default=None)
    ap.add_argument("--block-size", type=int, default=256)
    ap.add_argument("--master", default=None)
    args = ap.parse_args()
    spark = get_session(args.master)
    spark.sparkContext.setLogLevel("ERROR")
    sizes = list(args.sizes)
    if args.pow2:
        sizes += sweep_sizes(spark, *args.pow2)
    inputs = table_inputs(spark, args.sf_dir) + generated_inputs(spark, sizes)
    t = compare_strategies(spark, inputs, args.strategies, args.block_size)
    for r in side_by_side(t).collect():
        print(json.dumps(r.asDict()))


if __name__ == "__main__":
    main()
