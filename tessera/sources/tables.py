"""Matrices derived from the bundled tables (whole tables, no row subsets).

* ``embedding_matrix`` E: embeddings, i = vec_id, j = position,
  v = floor(x * 10000) as BIGINT
* ``supplier_part`` SP: lineitem, i = l_suppkey, j = l_partkey,
  v = sum(l_quantity) as BIGINT
* ``user_event`` UE: events, i = user_id, j = rank of event_type among the
  distinct types, v = count(*)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.layout import rows_to_cells

EMBED_SCALE = 10000
MAX_CATEGORIES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embedding_rows(spark: SparkSession, sf_dir: str, scale: int = EMBED_SCALE) -> DataFrame:
    """ROWS form of E: (i, row ARRAY<BIGINT>), v = floor(x * scale)."""
    e = table(spark, sf_dir, "embeddings")
    row = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return e.select(F.col("vec_id").cast("bigint").alias("i"), row.alias("row"))


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E as CELLS (every cell kept, zeros included: it is a dense source)."""
    return rows_to_cells(embedding_rows(spark, sf_dir))


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP as CELLS: total quantity per (supplier, part)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").cast("bigint").alias("i"),
                       F.col("l_partkey").cast("bigint").alias("j"))
              .agg(F.sum("l_quantity").cast("bigint").alias("v")))


def category_index(values: DataFrame, col: str, partitions: int | None = None,
                   small_limit: int = MAX_CATEGORIES) -> tuple[DataFrame, bool]:
    """Dictionary (value, j): j = 0-based rank of the value among the distinct values.

    Returns the dictionary and whether it is small. One bounded count
    (stopping after ``small_limit + 1`` values) decides the way:

    * at most ``small_limit`` values: one window over that proven-small set;
    * more: distributed -- the distinct values are range-partitioned and
      sorted, numbered inside each partition, and each partition's offset is
      the count of values in the partitions before it (one row per
      partition). No task sees all values; every step is deterministic, so a
      recomputed partition gets the same numbers.
    """
    d = values.select(col).where(F.col(col).isNotNull()).distinct()
    if d.limit(small_limit + 1).count() <= small_limit:
        return d.withColumn("j", (F.row_number().over(Window.orderBy(col)) - 1).cast("bigint")), True
    spark = values.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    d = (d.repartitionByRange(n, col).sortWithinPartitions(col)
          .select(col, F.spark_partition_id().alias("pid"),
                  F.monotonically_increasing_id().alias("mid")))
    # monotonically_increasing_id = (partition id << 33) + position in partition
    d = d.select(col, "pid", (F.col("mid") - F.shiftleft(F.col("pid").cast("bigint"), 33)).alias("pos"))
    counts = d.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    offs = counts.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("off"))
    return (d.join(F.broadcast(offs), "pid")
             .select(col, (F.col("off") + F.col("pos")).cast("bigint").alias("j"))), False


def user_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UE as CELLS: events per (user, event type)."""
    ev = table(spark, sf_dir, "events")
    # Aggregate first (partial, map-side), then attach the column index: the
    # join key has few distinct values, so the dictionary side is broadcast
    # when category_index has proven it small; otherwise AQE's skew handling
    # takes over.
    per = ev.groupBy(F.col("user_id").cast("bigint").alias("i"), "event_type").agg(
        F.count(F.lit(1)).alias("v"))
    dic, small = category_index(ev, "event_type")
    return per.join(F.broadcast(dic) if small else dic, "event_type").select("i", "j", "v")
