"""Parquet row tables, the size-sweep writer, and the CSV matrix reader.

Stored row tables keep an explicit ``i`` column: Parquet does not keep row
order across files, so an index is part of the data, not of the read order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.joins import broadcast_if_small
from tessera.operators.layout import dense_array, rows_to_cells
from tessera.sources import generate

ROWS_SCHEMA = "i BIGINT, row ARRAY<{t}>"
MAX_FILES = 1_000_000
#: Columns of a record of a sparse row table.
SEGMENT = 1 << 16


def write_rows(cells: DataFrame, path: str, ncols: int | None = None, mode: str = "overwrite",
               partition_by: list[str] | None = None) -> None:
    """CELLS -> dense ROWS -> Parquet, clustered by ``i`` so range filters on i prune row groups.

    Absent cells of a stored row are zeros, so positions are kept. ``ncols`` is
    the width of every row; without it each matrix is as wide as its last cell.
    """
    extra = partition_by or []
    vtype = dict(cells.dtypes)["v"]
    rows = cells.groupBy(*extra, "i").agg(F.collect_list(F.struct(F.col("j").alias("p"), F.col("v"))).alias("__cells"))
    if ncols is not None:
        rows = rows.withColumn("__width", F.lit(ncols).cast("bigint"))
    elif extra:
        widths, _ = broadcast_if_small(cells.groupBy(*extra).agg((F.max("j") + 1).alias("__width")), MAX_FILES)
        rows = rows.join(widths, extra)
    else:
        rows = rows.withColumn("__width", F.lit(cells.agg(F.max("j") + 1).first()[0] or 0).cast("bigint"))
    rows = rows.select(*extra, "i", dense_array("__cells", F.col("__width"), vtype).alias("row"))
    w = rows.repartitionByRange("i").sortWithinPartitions("i").write.mode(mode)
    if extra:
        w = w.partitionBy(*extra)
    w.parquet(path)


def read_rows(spark: SparkSession, path: str, value_type: str = "double") -> DataFrame:
    """Parquet ROWS table with an explicit i (pushes filters on i into the scan)."""
    return spark.read.schema(ROWS_SCHEMA.format(t=value_type)).parquet(path)


def read_cells(spark: SparkSession, path: str, value_type: str = "double") -> DataFrame:
    return rows_to_cells(read_rows(spark, path, value_type))


def write_sparse_rows(cells: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """CELLS -> sparse ROWS (i, seg, js, vs) -> Parquet, clustered by ``i``: the size follows the cells, not the shape.

    A row is stored in segments of ``SEGMENT`` columns, so one with very many cells is many records.
    Cells of one coordinate are kept as they are.
    """
    keys = [*(partition_by or []), "i"]
    cells = cells.withColumn("seg", F.floor(F.col("j") / SEGMENT).cast("bigint"))
    rows = cells.groupBy(*keys, "seg").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("cells"))
    rows = rows.select(*keys, "seg", F.col("cells.j").cast("array<bigint>").alias("js"), F.col("cells.v").alias("vs"))
    w = rows.repartitionByRange("i", "seg").sortWithinPartitions("i", "seg").write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_sparse_cells(spark: SparkSession, path: str, value_type: str = "double") -> DataFrame:
    """CELLS of a sparse ROWS table; filters on i prune row groups."""
    rows = spark.read.schema(f"i BIGINT, seg BIGINT, js ARRAY<BIGINT>, vs ARRAY<{value_type}>").parquet(path)
    return rows.select("i", F.explode(F.arrays_zip("js", "vs")).alias("c")).select("i", F.col("c.js").alias("j"), F.col("c.vs").alias("v"))


def read_unindexed_rows(spark: SparkSession, path: str, row: str = "row") -> DataFrame:
    """A row table written without an index (one record per row, in file order).

    i = (rows in earlier files) + position inside the file; files come by
    folder, then in part number order. The per-file counts are one row per
    file, at most ``MAX_FILES``; their running sum is the offset.
    """
    raw = spark.read.parquet(path).select(
        row, F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("ri"))
    counts, small = broadcast_if_small(raw.groupBy("f").agg(F.count(F.lit(1)).alias("n")), MAX_FILES)
    if not small:
        raise ValueError(f"{path} has more than {MAX_FILES} files; write it with an index")
    # Spark numbers files part-00000, part-00001, ...; the width grows past
    # 99999, so order by the number first and by name only to break ties.
    folder = F.regexp_extract("f", r"^(.*/)[^/]*$", 1)
    num = F.regexp_extract("f", r"part-(\d+)[^/]*$", 1)
    order = [folder, F.when(num == "", None).otherwise(num.cast("bigint")), F.col("f")]
    offs = counts.select("f", (F.sum("n").over(Window.orderBy(*order)) - F.col("n")).alias("off"))
    return raw.join(F.broadcast(offs), "f").select((F.col("off") + F.col("ri")).cast("bigint").alias("i"),
                                                   F.col(row).alias("row"))


def write_sweep(spark: SparkSession, path: str, sizes: list[int], seed: int = 0,
                kind: str = "uniform") -> None:
    """Two n x n matrices per size, one job, partitioned by (n, which)."""
    gen = {"uniform": generate.uniform, "binary": generate.binary, "formula": generate.formula}[kind]
    parts = None
    for n in sizes:
        for which in (1, 2):
            x = gen(spark, n, n, seed=seed * 1000 + n * 10 + which).select(
                F.lit(n).alias("n"), F.lit(which).alias("which"), "*")
            parts = x if parts is None else parts.unionByName(x)
    write_rows(parts, path, partition_by=["n", "which"])


def read_sweep(spark: SparkSession, path: str, n: int, which: int,
               value_type: str = "double") -> DataFrame:
    """One matrix of a sweep; the (n, which) filter prunes partitions."""
    rows = (spark.read.schema(f"i BIGINT, row ARRAY<{value_type}>, n INT, which INT").parquet(path)
            .where((F.col("n") == n) & (F.col("which") == which)))
    return rows_to_cells(rows.select("i", "row"))


BLOCKS_SCHEMA = "bi BIGINT, bj BIGINT, nr INT, nc INT, blk ARRAY<{t}>"


def write_blocks(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """BLOCKS -> Parquet, range-partitioned and sorted by (bi, bj).

    Tiling a dense matrix once and storing the tiles lets every later block
    product skip the cells -> tiles conversion; filters on bi / bj prune row
    groups.
    """
    (blocks.repartitionByRange("bi", "bj").sortWithinPartitions("bi", "bj")
           .write.mode(mode).parquet(path))


def read_blocks(spark: SparkSession, path: str, value_type: str = "double") -> DataFrame:
    return spark.read.schema(BLOCKS_SCHEMA.format(t=value_type)).parquet(path)


def save_bucketed(cells: DataFrame, table: str, path: str, by: str, buckets: int,
                  mode: str = "overwrite") -> DataFrame:
    """Store CELLS bucketed (and sorted) by ``by`` as a catalog table at ``path``.

    Two tables bucketed on their join indices with the same bucket count
    join without a shuffle: a left factor bucketed by ``j`` and a right
    factor bucketed by ``i`` meet bucket to bucket. Worth it for a matrix
    multiplied again and again. ``path`` should be in shared storage.
    """
    (cells.write.mode(mode).bucketBy(buckets, by).sortBy(by)
          .option("path", path).saveAsTable(table))
    return cells.sparkSession.table(table)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """f (file), i (0-based line number in its file), line: text files in byte ranges, each by its own task.

    A range's lines are numbered in the task that reads them. One row a range (its count of lines)
    gives the running offsets within a file, so no task reads a whole file. Both passes come from
    one listing and plan, so their ranges are the same ones. A line ends with a newline, or a
    carriage return and a newline; white space at a line's end and the blank lines at a file's end
    are left out. An empty file has no lines.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", r"\s+$", "").alias("line"), F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("mid"))
    ranges = raw.groupBy("f", "at").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"), F.max(F.when(F.col("line") != "", F.col("mid"))).alias("last"))
    off = F.sum("n").over(Window.partitionBy("f").orderBy("at")) - F.col("n")
    ranges = ranges.select("f", "at", "last", (off - F.col("first")).alias("shift"))
    end = F.max(F.col("shift") + F.col("last")).over(Window.partitionBy("f"))
    ranges, _ = broadcast_if_small(ranges.select("f", "at", "shift", end.alias("end")), MAX_FILES)
    lines = raw.join(ranges, ["f", "at"]).withColumn("i", F.col("mid") + F.col("shift"))
    return lines.where("i <= end").select("f", "i", "line")


def read_csv_matrix(spark: SparkSession, path: str, scale: int | None = 100000) -> DataFrame:
    """Headerless comma-separated matrix file(s) -> CELLS, rows numbered within each file.

    Files of any size: they are read in byte ranges (``read_lines``).
    ``scale`` turns fixed-point decimals into exact integers:
    v = round(x * scale) as BIGINT; ``None`` keeps doubles.
    """
    return read_csv_files(spark, path, scale).select("i", "j", "v")


def read_csv_files(spark: SparkSession, path: str, scale: int | None = 100000) -> DataFrame:
    """As ``read_csv_matrix``, with the file of each cell as ``f``: one matrix a file."""
    cells = read_lines(spark, path).select("f", "i", F.posexplode(F.split(F.trim("line"), r"\s*,\s*")).alias("j", "x"))
    x = F.col("x").cast("double")
    v = F.round(x * scale).cast("bigint") if scale else x
    return cells.select("f", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), v.alias("v"))


def rows_from_local(spark: SparkSession, rows: list[list[float]], value_type: str = "double") -> DataFrame:
    """Small local rows -> ROWS (for tests and tiny inputs only)."""
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)],
                                 ROWS_SCHEMA.format(t=value_type))
