"""Strassen's product as one lazy DataFrame plan.

Down, once per level: every cell (or block) of a side learns its quadrant
q, is joined to the broadcast coefficient table (U for A, V for B) -- one
row per product m that uses the quadrant -- and the signed copies are
summed per (child path, local index). Path ids are ``parent*7 + m``, so all
7**L sub-products of a level live in one DataFrame and run as tasks of the
same stages.

Leaf: one contraction per path (join on path and the inner index), either
on cells (exact, sparse) or on dense blocks (NumPy on executors).

Up, once per level: each product is joined to W on m and the signed copies
are summed per (parent path, global index in the parent).

Shapes need not be square or even: sizes are padded virtually to a multiple
of 2**levels (absent cells are zeros and are never materialised) and the
result is cropped back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.coefficients import coefficient_frames
from tessera.functions.expressions import (
    child_path, local_index, padded_size, path_m, path_parent, product_label,
    quadrant, quadrant_label, quadrant_offset,
)
from tessera.operators.blocks import (
    block_product, blocks_to_cells, cells_to_blocks, default_tasks, grid_for, sum_blocks,
)
from tessera.operators.joins import DEFAULT_MAX_HOT_KEYS, DEFAULT_PAIRS_PER_TASK, contract
from tessera.operators.layout import shape_of
from tessera.operators.products import BLOCK_PAIRS
from tessera.operators.row_blocks import contract_blocks
from tessera.operators.sparse_tiles import block_counts, plan_blocks
from tessera.operators.strassen_cells import strassen_pairs
from tessera.session import shared_dir


def with_root_path(cells: DataFrame) -> DataFrame:
    return cells.select(F.lit(0).cast("bigint").alias("path"), "i", "j", "v")


def split_quadrants(x: DataFrame, hr: int, hc: int, side: str) -> DataFrame:
    """Quadrant of every cell: q, its label, local indices and the quadrant's offsets."""
    q = quadrant("i", "j", hr, hc)
    return x.select(
        "*", q.alias("q"),
        quadrant_label(side, q).alias("quadrant"),
        local_index("i", hr).alias("li"), local_index("j", hc).alias("lj"),
        quadrant_offset(q, hr, "row").alias("row_index"),
        quadrant_offset(q, hc, "col").alias("col_index"))


def replicate(x: DataFrame, coeff: DataFrame, hr: int, hc: int, side: str) -> DataFrame:
    """One row per (cell, product using its quadrant), with the product's sign.

    Columns: path (child), m, q, sgn, i, j (local), v, tag struct
    (m_index, row_index, col_index, matrix_name) as in 'A11, M1'.
    """
    s = split_quadrants(x, hr, hc, side)
    j = s.join(F.broadcast(coeff), "q")
    tag = F.struct(F.col("m").alias("m_index"), F.col("row_index"), F.col("col_index"),
                   product_label(side, F.col("q"), F.col("m")).alias("matrix_name"))
    return j.select(child_path("path", "m").alias("path"), "m", "q", "sgn",
                    F.col("li").alias("i"), F.col("lj").alias("j"), "v", tag.alias("tag"))


def divide(x: DataFrame, coeff: DataFrame, hr: int, hc: int,
           cluster_by: str | None = None, partitions: int | None = None) -> DataFrame:
    """Operands of the next level: sum of signed quadrants per (child path, i, j).

    ``cluster_by`` ('i' or 'j') hash-partitions the sum by (path, that index)
    instead of (path, i, j): the aggregate accepts it, and the leaf join on
    (path, inner index) then needs no shuffle of its own. A map-side combine
    is not lost by this, since the quadrants summed into one operand cell
    come from different input rows.
    """
    q = quadrant("i", "j", hr, hc)
    s = x.select("path", q.alias("q"), local_index("i", hr).alias("i"),
                 local_index("j", hc).alias("j"), "v")
    j = s.join(F.broadcast(coeff), "q").select(
        child_path("path", "m").alias("path"), "i", "j", (F.col("sgn") * F.col("v")).alias("v"))
    if cluster_by:
        # An explicit count on both sides (so they stay co-partitioned), not
        # AQE's coalescing by input bytes: the leaf join expands every row.
        spark = x.sparkSession
        n = partitions or max(default_tasks(spark), spark.sparkContext.defaultParallelism)
        j = j.repartition(n, "path", cluster_by)
    r = j.groupBy("path", "i", "j").agg(F.sum("v").alias("v"))
    return r.where(F.col("v") != 0)


def leaf_product(left: DataFrame, right: DataFrame, hot_split: bool = False,
                 pairs_per_task: int = DEFAULT_PAIRS_PER_TASK,
                 max_hot: int = DEFAULT_MAX_HOT_KEYS, parts: int = 0) -> DataFrame:
    """Per path: L * R on cells, with ``parts`` by rows sent packed to blocks of rows (see ``row_blocks``)."""
    lft = left.select("path", F.col("i").alias("r"), F.col("j").alias("k"), F.col("v").alias("lv"))
    rgt = right.select("path", F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("rv"))
    p = contract_blocks(lft, rgt, ["path"], parts) if parts else contract(lft, rgt, ["path"], hot_split, pairs_per_task, max_hot)
    return p.select("path", F.col("r").alias("i"), F.col("c").alias("j"), "v").where(F.col("v") != 0)


def combine(p: DataFrame, w: DataFrame, hr: int, hc: int, by_quadrant: bool = False) -> DataFrame:
    """Parent results from the seven child products: C_q = sum_m W[m,q] * M_m.

    With ``by_quadrant`` the result keeps (path, q, i, j) local to the quadrant.
    """
    x = p.select(path_parent("path").alias("parent"), path_m("path").alias("m"), "i", "j", "v")
    j = x.join(F.broadcast(w), "m")
    if by_quadrant:
        keys = [F.col("parent").alias("path"), "q", "i", "j"]
    else:
        keys = [F.col("parent").alias("path"),
                (F.col("i") + quadrant_offset("q", hr, "row")).alias("i"),
                (F.col("j") + quadrant_offset("q", hc, "col")).alias("j")]
    r = j.groupBy(*keys).agg(F.sum(F.col("sgn") * F.col("v")).alias("v"))
    return r.where(F.col("v") != 0)


def _cut(df: DataFrame, enabled: bool) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local one)."""
    if not enabled:
        return df
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def matmul_strassen(a: DataFrame, b: DataFrame, levels: int = 1,
                    shape_a: tuple[int, int] | None = None, shape_b: tuple[int, int] | None = None,
                    leaf: str = "join", block_size: int | None = None,
                    hot_split: bool = False, pairs_per_task: int = DEFAULT_PAIRS_PER_TASK,
                    checkpoint_levels: bool = False, co_partition: bool = False) -> DataFrame:
    """C = A * B by ``levels`` levels of Strassen recursion.

    ``leaf='join'``: cell products at the leaves (exact for integer types).
    ``leaf='block'``: dense ``block_size`` tiles; quadrants are whole blocks
    and leaves are NumPy products (float64).

    Skew at the leaves: by default the leaf join shuffles on (path, inner
    index) itself, so AQE's skew-join handling (on in ``get_session``) can
    split a hot inner index at run time. ``hot_split=True`` adds the
    explicit split of ``joins.contract``, at the cost of one more pass over
    the operands. From as many sums on as make ``matmul_join`` multiply pairs
    of packed groups, all levels do so in the tasks of such pairs (see ``strassen_cells``);
    where that has no groups, or with ``checkpoint_levels``, the leaves send packed
    rows to blocks of rows. ``co_partition=True`` is for inputs known to be dense
    (every inner index has the same count, so none can be hot): the last
    divide is then partitioned by the join key and the leaf join needs no
    shuffle of its own -- two exchanges fewer, but no run-time skew split.
    """
    shape_a = shape_a or shape_of(a)
    shape_b = shape_b or shape_of(b)
    if leaf == "block":
        return _strassen_blocks(a, b, levels, shape_a, shape_b, block_size or 256, checkpoint_levels)
    r, k = shape_a[0], max(shape_a[1], shape_b[0])
    c = shape_b[1]
    rr, kk, cc = padded_size(r, levels), padded_size(k, levels), padded_size(c, levels)
    counts, tasks = None, default_tasks(a.sparkSession)
    if not hot_split and not co_partition:
        counts = block_counts(a, b)
        if counts.sums(tasks) >= BLOCK_PAIRS and levels and not checkpoint_levels:
            halves = ([n >> (lvl + 1) for lvl in range(levels)] for n in (rr, kk, cc))
            if (whole := strassen_pairs(a, b, levels, *halves, (r, c), tasks)) is not None:
                return whole
    u, v, w = coefficient_frames(a.sparkSession)
    left, right = with_root_path(a), with_root_path(b)
    for lvl in range(levels):
        hr, hk, hc = rr >> (lvl + 1), kk >> (lvl + 1), cc >> (lvl + 1)
        last = co_partition and lvl == levels - 1 and not hot_split and not checkpoint_levels
        left = _cut(divide(left, u, hr, hk, "j" if last else None), checkpoint_levels)
        right = _cut(divide(right, v, hk, hc, "i" if last else None), checkpoint_levels)
    parts = plan_blocks(counts, tasks, pairs_per_task)[0] if counts and counts.sums(tasks) >= BLOCK_PAIRS else 0
    p = leaf_product(left, right, hot_split, pairs_per_task, parts=parts)
    for lvl in reversed(range(levels)):
        p = _cut(combine(p, w, rr >> (lvl + 1), cc >> (lvl + 1)), checkpoint_levels)
    return p.where((F.col("i") < r) & (F.col("j") < c)).select("i", "j", "v")


def _strassen_blocks(a: DataFrame, b: DataFrame, levels: int, shape_a, shape_b,
                     bs: int, checkpoint_levels: bool) -> DataFrame:
    ab = cells_to_blocks(a, bs, shape_a, pad=True)
    bb = cells_to_blocks(b, bs, shape_b, pad=True)
    p = strassen_blocks(ab, bb, levels, bs, shape_a, shape_b, checkpoint_levels)
    r, c = shape_a[0], shape_b[1]
    ta, tb = dict(a.dtypes)["v"], dict(b.dtypes)["v"]
    cast = "bigint" if ta in ("bigint", "int") and tb == ta else None
    cells = blocks_to_cells(p, bs, cast=cast)
    return cells.where((F.col("i") < r) & (F.col("j") < c))


def strassen_blocks(ab: DataFrame, bb: DataFrame, levels: int, bs: int,
                    shape_a: tuple[int, int], shape_b: tuple[int, int],
                    checkpoint_levels: bool = False) -> DataFrame:
    """Strassen on the BLOCKS layout: full ``bs x bs`` tiles in, tiles of C out.

    Quadrants are whole tiles (the tile grid is padded virtually to a
    multiple of 2**levels); leaves are grid block products. Tiles outside
    the true shape may be present in the result and hold zeros.
    """
    spark = ab.sparkSession
    r, k, c = shape_a[0], max(shape_a[1], shape_b[0]), shape_b[1]
    nbr, nbk, nbc = -(-r // bs), -(-k // bs), -(-c // bs)
    pr, pk, pc = padded_size(nbr, levels), padded_size(nbk, levels), padded_size(nbc, levels)
    u, v, w = coefficient_frames(spark)

    def down(x, coeff, hr, hc):
        q = quadrant("bi", "bj", hr, hc)
        s = x.select("path", q.alias("q"), local_index("bi", hr).alias("bi"),
                     local_index("bj", hc).alias("bj"), "nr", "nc",
                     F.col("blk").cast("array<double>").alias("blk"))
        j = s.join(F.broadcast(coeff), "q").select(
            child_path("path", "m").alias("path"), "bi", "bj", "nr", "nc", "blk", "sgn", "q")
        return sum_blocks(j, ["path", "bi", "bj"], sign="sgn", order="q")

    def up(p, hr, hc):
        x = p.select(path_parent("path").alias("parent"), path_m("path").alias("m"),
                     "bi", "bj", "nr", "nc", "blk")
        j = x.join(F.broadcast(w), "m").select(
            F.col("parent").alias("path"),
            (F.col("bi") + quadrant_offset("q", hr, "row")).alias("bi"),
            (F.col("bj") + quadrant_offset("q", hc, "col")).alias("bj"),
            "nr", "nc", "blk", "sgn", "m")
        return sum_blocks(j, ["path", "bi", "bj"], sign="sgn", order="m")

    root = F.lit(0).cast("bigint").alias("path")
    left = ab.select(root, "bi", "bj", "nr", "nc", "blk")
    right = bb.select(root, "bi", "bj", "nr", "nc", "blk")
    for lvl in range(levels):
        hr, hk, hc = pr >> (lvl + 1), pk >> (lvl + 1), pc >> (lvl + 1)
        left = _cut(down(left, u, hr, hk), checkpoint_levels)
        right = _cut(down(right, v, hk, hc), checkpoint_levels)
    lr, lk, lc = pr >> levels, pk >> levels, pc >> levels
    tasks = max(1, default_tasks(spark) // (7 ** levels))
    p = block_product(left, right, grid_for(lr, lk, lc, bs, tasks), group=["path"])
    for lvl in reversed(range(levels)):
        p = _cut(up(p, pr >> (lvl + 1), pc >> (lvl + 1)), checkpoint_levels)
    return p.drop("path")
