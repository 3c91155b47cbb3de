"""Sparse tile product: CELLS dealt into compressed sparse tiles, multiplied row by row in Arrow tasks.

``matmul_join`` makes a joined row of every pair A(i, k), B(k, j). Here cells are packed into
tiles before they are shuffled, and a task multiplies two sets of tiles by Gustavson's rule: for
each row of A, the rows of B that its entries name are scaled and added up. Nothing but packed
tiles, and one row an output cell, is shuffled.

Grid. Output rows are dealt into ``g`` row groups (i mod g), output columns into ``g`` column
groups (j mod g), inner indices into ``chunks`` (k mod chunks). Dealing in turn spreads dense
corners and neighbouring heavy rows evenly. A's tile (i mod g, k mod chunks) is copied to the g
column groups, B's tile to the g row groups. One task holds one tile of each.

That is the layout of small products, and where a grid is given (``plan_grid`` takes one from exact
counts). Its copies grow with the grid, so from ``BLOCK_PAIRS`` pairs on groups of rows and of columns are
packed and multiplied in pairs (see ``cell_pairs``). Where a row is too long for that, tiles are dealt by blocks of
A's rows (see ``row_blocks``): a block's tile of A meets the rows of B that it names, each sent once. ``plan_blocks``
takes the parts of the columns, and chunks of the inner side, from exact counts per block: no task
multiplies many more than ``pairs_per_task`` pairs or holds many more than ``TILE_CELLS`` cells of A.

Sums are 64-bit integers for integer cells and doubles for floating ones. A task adds up an output
cell's products in the order of the inner index, so a retried task gives the same numbers. With one
chunk, no sum is left to do; else one grouped sum adds the chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import default_tasks
from tessera.operators.cell_pairs import groups_for, pair_cells
from tessera.operators.row_blocks import packed_left, packed_right, row_block

PAIRS_PER_TASK = 1 << 22
TILE_CELLS = 1 << 20
#: Joined pairs from which rows of B are sent to blocks of A's rows.
BLOCK_PAIRS = 1 << 26
#: Cells of one row of B that are packed together, about.
ROW_CELLS = 1 << 16
#: Pairs that a kernel expands at once, and cells of a dense accumulator.
_STEP, _DENSE = 1 << 20, 1 << 21
#: A null row or column inside tiles.
_NULL = -(1 << 63)


def pair_counts(a: DataFrame, b: DataFrame) -> tuple[int, int, int, int]:
    """Cells of A and of B, joined pairs in all, and pairs of the heaviest inner index: one aggregate row."""
    na = a.groupBy(F.col("j").alias("k")).agg(F.count(F.lit(1)).alias("na"))
    nb = b.groupBy(F.col("i").alias("k")).agg(F.count(F.lit(1)).alias("nb"))
    both = na.join(nb, "k", "full").select(F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    pairs = F.col("na") * F.col("nb")
    r = both.agg(F.sum("na"), F.sum("nb"), F.sum(pairs), F.max(pairs)).first()
    return tuple(int(x or 0) for x in r)


def plan_grid(na: int, nb: int, pairs: int, heaviest: int, tasks: int, pairs_per_task: int = PAIRS_PER_TASK, tile_cells: int = TILE_CELLS) -> tuple[int, int]:
    """(g, chunks): g x g x chunks tasks of at most about ``pairs_per_task`` pairs and ``tile_cells`` cells of a side.

    g alone makes no partial sums, so it is raised first for parallelism; chunks only follow from the limits.
    """
    useful = min(tasks, max(1, pairs // (1 << 16)))  # small products aren't worth more tasks
    g = max(1, math.ceil(math.sqrt(heaviest / pairs_per_task)), math.isqrt(useful))
    chunks = max(1, math.ceil(pairs / (g * g * pairs_per_task)), math.ceil(max(na, nb) / (g * tile_cells)))
    return g, chunks


@dataclass
class BlockCounts:
    """Joined pairs in all, blocks of A's rows, the heaviest block's pairs and cells, the longest row of B, A's rows and B's columns."""

    pairs: int
    blocks: int
    heaviest: int
    cells: int
    longest: int
    rows: int
    columns: int
    left: int  # cells of A
    sent: int  # cells of B, those that several blocks need counted for each

    def sums(self, tasks: int) -> int:
        """Sums that a join by the inner index shuffles at most: one a pair, or one an output cell and task."""
        return min(self.pairs, tasks * self.rows * self.columns)


def block_counts(a: DataFrame, b: DataFrame) -> BlockCounts:
    """Exact counts by blocks of A's rows: one aggregate row."""
    # shuffled by the inner index alone, which is what both groupings and the join need; in B = A^T Spark reuses A's shuffle
    x, y = (m.select(F.col(o).cast("bigint").alias("o"), F.col(k).cast("bigint").alias("k")).repartition("k") for m, o, k in ((a, "i", "j"), (b, "j", "i")))
    na = x.groupBy(row_block("o").alias("rb"), "k").agg(F.count(F.lit(1)).alias("na"), F.max("o").alias("last"))
    nb = y.groupBy("k").agg(F.count(F.lit(1)).alias("nb"), F.max("o").alias("width"))
    per = na.join(nb, "k", "right").groupBy("rb").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"), F.sum("na").alias("cells"), F.max("nb").alias("longest"), F.sum("nb").alias("sent"),
                                                      F.max("last").alias("last"), F.max("width").alias("width"))
    r = per.agg(F.sum("pairs"), F.count("rb"), F.max("pairs"), F.max("cells"), F.max("longest"), F.max("last") + 1, F.max("width") + 1, F.sum("cells"), F.sum("sent")).first()
    return BlockCounts(*(int(x or 0) for x in r))


def plan_blocks(n: BlockCounts, tasks: int, pairs_per_task: int = PAIRS_PER_TASK, tile_cells: int = TILE_CELLS) -> tuple[int, int]:
    """(parts, chunks): a block's columns in parts, its inner side in chunks."""
    useful = min(tasks, max(1, n.pairs // (1 << 16)))  # small products aren't worth more tasks
    parts = max(1, math.ceil(n.heaviest / pairs_per_task), math.ceil(n.longest / ROW_CELLS), useful // max(1, n.blocks))
    return min(parts, max(1, n.longest)), max(1, math.ceil(n.cells / tile_cells))


def cells_to_tiles(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """CELLS to sparse tiles: r, c (i mod rows, j mod cols) and the cells' i, j, v in row order. Zeros are left out."""
    entry = F.struct("i", "j", "v")
    g = cells.where("v <> 0").groupBy(F.pmod(F.col("i"), F.lit(rows)).cast("int").alias("r"), F.pmod(F.col("j"), F.lit(cols)).cast("int").alias("c"))
    packed = g.agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return packed.select("r", "c", F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.v").alias("v"))


def tiles_to_cells(tiles: DataFrame) -> DataFrame:
    return tiles.select(F.explode(F.arrays_zip("i", "j", "v")).alias("x")).select("x.i", "x.j", "x.v")


def compress(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of sorted row numbers, and where each starts (one more at the end)."""
    edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.empty(0, dtype=np.int64)
    return row[edge], np.append(edge, len(row))


def row_products(a: tuple, b: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells (i, j, v) of the product of two tiles (i, j, v in row order), in row blocks; each cell once."""
    (ai, ak, av), (bk, bj, bv) = a, b
    b_rows, b_start = compress(bk)
    if not len(ai) or not len(b_rows):
        return
    columns, col = np.unique(bj, return_inverse=True)
    at = np.minimum(np.searchsorted(b_rows, ak), len(b_rows) - 1)
    met = b_rows[at] == ak
    ai, av, at = ai[met], av[met], at[met]
    width = np.diff(b_start)[at]
    rows, start = compress(ai)
    work = np.concatenate(([0], np.cumsum(width)))[start]  # pairs before each row
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + _STEP, side="right")) - 1)
        x, y = start[lo], start[hi]
        w = width[x:y]
        pick = np.repeat(b_start[at[x:y]], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(start[lo:hi + 1])), w)
        key, val = row * len(columns) + col[pick], np.repeat(av[x:y], w) * bv[pick]
        if (hi - lo) * len(columns) <= _DENSE:
            total = np.zeros((hi - lo) * len(columns), dtype=val.dtype)
            np.add.at(total, key, val)
            cell = np.flatnonzero(total)
            total = total[cell]
        else:
            order = np.argsort(key, kind="stable")
            key, val = key[order], val[order]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            cell, total = key[cut], np.add.reduceat(val, cut)
            cell, total = cell[total != 0], total[total != 0]
        yield rows[lo + cell // len(columns)], columns[cell % len(columns)], total
        lo = hi


def _unpack(table: pa.Table, dtype) -> tuple[np.ndarray, ...]:
    """i, j, v of a task's tiles, in row order."""
    i, j, v = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(n).chunks] or [np.empty(0)]) for n in ("i", "j", "v"))
    i, j = i.astype(np.int64), j.astype(np.int64)
    order = np.lexsort((j, i))
    return i[order], j[order], v.astype(dtype)[order]


def _concat(columns) -> np.ndarray:
    return np.concatenate([*columns] or [np.empty(0)])


def _unpack_rows(table: pa.Table, entries: str, index: str, value: str, dtype, k_first: bool) -> tuple[np.ndarray, ...]:
    """i, j, v of the packed rows of a task's tile, in row order."""
    k, i, v = [], [], []
    for batch in table.to_batches():
        lists = batch.column(entries)
        flat = lists.flatten()
        k.append(np.repeat(batch.column("k").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())))
        i.append(flat.field(index).to_numpy(zero_copy_only=False))
        v.append(flat.field(value).to_numpy(zero_copy_only=False))
    k, i, v = _concat(k).astype(np.int64), _concat(i).astype(np.int64), _concat(v).astype(dtype)
    i, j = (k, i) if k_first else (i, k)
    order = np.lexsort((j, i))
    return i[order], j[order], v[order]


def matmul_sparse_tiles(a: DataFrame, b: DataFrame, grid: tuple[int, int] | None = None, pairs_per_task: int = PAIRS_PER_TASK,
                        counts: BlockCounts | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """C = A * B on integer or floating CELLS by sparse tiles; zero cells are dropped.

    Integer sums must stay below 2**63, as BIGINT cells in any strategy. Decimals aren't tiled:
    use ``matmul_join``. Repeated cells of one coordinate add up, and null rows of A and null columns
    of B are rows and columns of C, as in the join.
    """
    kinds = {dict(x.dtypes)["v"] for x in (a, b)}
    if any(k.startswith("decimal") for k in kinds):
        raise ValueError("decimal cells have no exact tile type; use matmul_join")
    floating = bool(kinds & {"double", "float"})
    dtype, out = (np.float64, "double") if floating else (np.int64, "bigint")
    a, b = (x.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast(out).alias("v")) for x in (a, b))

    a0, b0 = a, b
    a, b = (x.where(f"{k} IS NOT NULL").withColumn(n, F.coalesce(n, F.lit(_NULL))) for x, k, n in ((a, "j", "i"), (b, "i", "j")))

    def product(x: tuple, y: tuple) -> pa.Table:
        kind = pa.float64() if floating else pa.int64()
        parts = list(row_products(x, y)) if len(x[0]) and len(y[0]) else []
        i, j, v = (np.concatenate(p) for p in zip(*parts)) if parts else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=dtype))
        return pa.table([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v, kind)], names=["i", "j", "v"])

    if not grid:
        counts, tasks = counts or block_counts(a, b), default_tasks(a.sparkSession)
        if counts.pairs < block_pairs:  # an index's pairs are at most all
            grid = plan_grid(counts.left, counts.sent, counts.pairs, counts.pairs, tasks, pairs_per_task)
        elif groups := groups_for(a0, b0, tasks):
            return pair_cells(a0, b0, groups)
    if grid:
        g, chunks = grid
        every = F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
        left = cells_to_tiles(a, g, chunks).select(F.col("r").alias("gi"), every.alias("gj"), F.col("c").alias("kc"), "i", "j", "v")
        right = cells_to_tiles(b, chunks, g).select(every.alias("gi"), F.col("c").alias("gj"), F.col("r").alias("kc"), "i", "j", "v")
        keys = ["gi", "gj", "kc"]

        def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
            return product(_unpack(x, dtype), _unpack(y, dtype))
    else:
        parts, chunks = plan_blocks(counts, tasks, pairs_per_task)
        rows = packed_left(a.where("v <> 0").select(F.col("i").alias("r"), F.col("j").alias("k"), F.col("v").alias("lv")), [])
        kc = F.pmod(F.col("k"), F.lit(chunks)).cast("int").alias("kc")
        left = rows.select("rb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cs"), kc, "k", "le")
        right = (rows.select("rb", "k").join(packed_right(b.where("v <> 0").select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("rv")), [], parts), "k")
                     .select(F.col("rb").alias("rb"), "cs", kc, F.col("k").alias("k"), "re"))
        keys = ["rb", "cs", "kc"]

        def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
            return product(_unpack_rows(x, "le", "r", "lv", dtype, False), _unpack_rows(y, "re", "c", "rv", dtype, True))

    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, f"i bigint, j bigint, v {out}")
    if chunks > 1:
        cells = cells.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return cells.where("v <> 0").select(*(F.nullif(F.col(n), F.lit(_NULL)).alias(n) for n in ("i", "j")), "v")
