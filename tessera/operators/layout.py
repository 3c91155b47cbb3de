"""Conversions between the three layouts, and matrix dimensions.

CELLS  (i BIGINT, j BIGINT, v T)
ROWS   (i BIGINT, row ARRAY<T>)
BLOCKS (bi BIGINT, bj BIGINT, nr INT, nc INT, blk ARRAY<T>), row-major ``blk``

Grouping conversions (cells -> rows, cells -> blocks) gather one row or one
block per group, so a group never holds more than ``ncols`` or ``b*b``
values whatever the size of the matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of row or column indices whose sizes a plan may ask for.
BUCKETS = 4096


def rows_to_cells(rows: DataFrame, i: str = "i", row: str = "row") -> DataFrame:
    """ROWS -> CELLS: one cell per array element; j is the array position."""
    return (rows.select(F.col(i).cast("bigint").alias("i"), F.posexplode(row).alias("j", "v"))
                .select("i", F.col("j").cast("bigint").alias("j"), "v"))


def matrix_dims(cells: DataFrame) -> DataFrame:
    """One row (nrows, ncols, nnz); trailing all-zero rows/columns are not seen."""
    return cells.agg((F.max("i") + 1).cast("bigint").alias("nrows"),
                     (F.max("j") + 1).cast("bigint").alias("ncols"),
                     F.count(F.lit(1)).alias("nnz"))


def dims_of(*matrices: DataFrame) -> list[tuple[int, int, int]]:
    """(nrows, ncols, nnz) of several matrices in one job (one aggregate row each)."""
    u = None
    for n, m in enumerate(matrices):
        x = m.select(F.lit(n).alias("_m"), "i", "j")
        u = x if u is None else u.unionByName(x)
    got = {r["_m"]: r for r in u.groupBy("_m").agg(
        (F.max("i") + 1).alias("nrows"), (F.max("j") + 1).alias("ncols"),
        F.count(F.lit(1)).alias("nnz")).collect()}
    return [(int(got[n]["nrows"]), int(got[n]["ncols"]), int(got[n]["nnz"])) if n in got else (0, 0, 0)
            for n in range(len(matrices))]


def stats_of(*matrices: DataFrame) -> list[tuple[int, int, int, int | float]]:
    """(nrows, ncols, nnz, largest absolute value) of several matrices in one job."""
    u = None
    for n, m in enumerate(matrices):
        x = m.select(F.lit(n).alias("_m"), "i", "j", F.col("v").alias(f"v{n}"))
        u = x if u is None else u.unionByName(x, allowMissingColumns=True)
    aggs = [f(f"v{n}").alias(f"{nm}{n}") for n in range(len(matrices)) for nm, f in (("hi", F.max), ("lo", F.min))]
    got = {r["_m"]: r for r in u.groupBy("_m").agg(
        (F.max("i") + 1).alias("nrows"), (F.max("j") + 1).alias("ncols"),
        F.count(F.lit(1)).alias("nnz"), *aggs).collect()}
    return [(int(r["nrows"]), int(r["ncols"]), int(r["nnz"]), max(abs(r[f"hi{n}"] or 0), abs(r[f"lo{n}"] or 0)))
            if (r := got.get(n)) else (0, 0, 0, 0) for n in range(len(matrices))]


def fits_bigint(a: DataFrame, b: DataFrame) -> bool:
    """Whether no sum of A * B, nor of some of its terms, can leave 64 bits: by the largest row of A and column of B (Cauchy-Schwarz)."""
    bound = 1.0
    for x, key in ((a, "i"), (b, "j")):
        cells = x.groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))  # repeated cells add up
        bound *= float(cells.groupBy(key).agg(F.sum(F.col("v") * F.col("v")).alias("s")).agg(F.max("s")).first()[0] or 0)
    return bound ** 0.5 * (1 + 1e-6) < 2.0 ** 63


def bucket_sizes(*matrices: tuple[DataFrame, Column]) -> list[tuple[np.ndarray, float]]:
    """Cells of several matrices in each bucket of an index, and the largest sum of absolute values of a bucket: 4,096 rows a matrix at most, in one job."""
    u = None
    for n, (m, index) in enumerate(matrices):
        x = m.select(F.lit(n).alias("_m"), F.pmod(F.xxhash64(index), F.lit(BUCKETS)).cast("int").alias("p"), F.col("v").cast("double").alias("v"))
        u = x if u is None else u.unionByName(x)
    out = [[np.zeros(BUCKETS, dtype=np.int64), 0.0] for _ in matrices]
    for r in u.groupBy("_m", "p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("v")).alias("s")).collect():
        out[r["_m"]][0][r["p"]] = r["n"]
        out[r["_m"]][1] = max(out[r["_m"]][1], r["s"] or 0.0)
    return [tuple(x) for x in out]


def shape_of(cells: DataFrame) -> tuple[int, int]:
    """(nrows, ncols) as Python ints: a one-row aggregate, for plan-time sizes."""
    r = matrix_dims(cells).first()
    return int(r["nrows"] or 0), int(r["ncols"] or 0)


def dense_array(entries: str, n, vtype: str) -> F.Column:
    """Dense array of length ``n`` from array<struct<p, v>> with distinct positions.

    A full array is only sorted by position. Otherwise each entry, in order of
    position, gets the zeros since the entry before it in front, and the last
    one the rest behind: O(n), and only the entries are sorted. All JVM.
    """
    e = F.sort_array(F.col(entries))
    zeros = lambda m: F.array_repeat(F.lit(0).cast(vtype), F.coalesce(m, F.lit(0)).cast("int"))
    at = F.transform(e, lambda x: F.coalesce(x["p"].cast("bigint"), F.lit(-1)))
    before = F.concat(F.array(F.lit(-1).cast("bigint")), F.slice(at, 1, F.size(e) - 1))  # e itself must not occur in a lambda: it would be sorted for every entry
    runs = F.zip_with(e, before, lambda x, p: F.concat(zeros(x["p"] - p - 1), F.array(x["v"])))
    rest = zeros(n - 1 - F.coalesce(e[F.size(e) - 1]["p"], F.lit(-1)))
    return F.when(F.size(e) == n, F.transform(e, lambda x: x["v"])).otherwise(F.concat(F.flatten(runs), rest))


def cells_to_rows(cells: DataFrame, ncols: int | None = None) -> DataFrame:
    """CELLS -> ROWS.

    With ``ncols`` the row is dense (absent cells are 0); without it the row
    holds the present values in column order (right for dense input).
    """
    g = cells.groupBy("i").agg(F.collect_list(F.struct(F.col("j").alias("p"), F.col("v"))).alias("e"))
    if ncols is None:
        return g.select("i", F.transform(F.sort_array("e"), lambda x: x["v"]).alias("row"))
    return g.select("i", dense_array("e", F.lit(ncols), dict(cells.dtypes)["v"]).alias("row"))


#: Bytes of tiles in one Arrow batch.
TILE_BYTES = 8 << 20
_TILE_TYPES = {"bigint": np.int64, "double": np.float64}


def _tiles(b: int, nrows: int, ncols: int, dtype):
    """Cells (t, i, j, v) in order of the tile's number t -> tiles; a tile may go on in the next batch."""
    across, kind = -(-ncols // b), pa.from_numpy_dtype(dtype)
    most = max(1, TILE_BYTES // (8 * b * b))

    def made(t, i, j, v, null):
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        for lo in range(0, len(starts), most):
            s = starts[lo:lo + most]
            x = slice(s[0], starts[lo + most] if lo + most < len(starts) else len(t))
            bi, bj = t[s] // across, t[s] % across
            nr, nc = np.minimum(b, nrows - bi * b), np.minimum(b, ncols - bj * b)
            ends = np.r_[0, np.cumsum(nr * nc)]
            tile = np.repeat(np.arange(len(s)), np.diff(np.r_[s, x.stop]))
            at = ends[tile] + (i[x] - bi[tile] * b) * nc[tile] + j[x] - bj[tile] * b
            flat = np.zeros(ends[-1], dtype=dtype)
            flat[at] = v[x]
            none = None
            if null[x].any():
                none = np.zeros(ends[-1], dtype=bool)
                none[at] = null[x]
            blk = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, kind, mask=none))
            yield pa.RecordBatch.from_arrays([pa.array(bi), pa.array(bj), pa.array(nr.astype(np.int32)), pa.array(nc.astype(np.int32)), blk], names=["bi", "bj", "nr", "nc", "blk"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                v = batch.column(3)
                held.append([batch.column(n).to_numpy() for n in range(3)] + [v.fill_null(0).to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False)])
                size += batch.num_rows
            if size >= max(1 << 16, b * b):
                x = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(x[0], x[0][-1]))  # the last tile may go on
                if cut:
                    yield from made(*(c[:cut] for c in x))
                held, size = [[c[cut:] for c in x]], len(x[0]) - cut
        if held:
            yield from made(*(np.concatenate(c) for c in zip(*held)))

    return run


def _filled_blocks(cells: DataFrame, b: int, shape: tuple[int, int]) -> DataFrame:
    nrows, ncols = shape
    vtype = dict(cells.dtypes)["v"]
    outside = F.col("i").isNull() | F.col("j").isNull()
    t = F.expr(f"(i div {b}) * {-(-ncols // b)} + j div {b}")
    x = cells.where(~outside).select(t.alias("t"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "v")
    x = x.repartition("t").sortWithinPartitions("t")
    tiles = x.mapInArrow(_tiles(b, nrows, ncols, _TILE_TYPES[vtype]), f"bi bigint, bj bigint, nr int, nc int, blk array<{vtype}>")
    return tiles.unionByName(cells_to_blocks(cells.where(outside), b, shape))


def cells_to_blocks(cells: DataFrame, b: int, shape: tuple[int, int], pad: bool = False, sparse: bool = False) -> DataFrame:
    """CELLS -> BLOCKS of ``b x b`` (edge blocks smaller unless ``pad``).

    ``shape`` is the (nrows, ncols) of the matrix; it fixes the edge block
    sizes. Blocks with no cell at all are not emitted (sparse-friendly).

    ``sparse`` is for distinct BIGINT or DOUBLE cells, few in a tile: they are dealt and sorted by the
    number of their tile, and NumPy fills tiles a few megabytes at a time, where ``dense_array`` makes
    every zero an object of its own. Cells without row or column index, which have no tile, are gathered as without it.
    """
    nrows, ncols = shape
    vtype = dict(cells.dtypes)["v"]
    if sparse and not pad and vtype in _TILE_TYPES and nrows and ncols:
        return _filled_blocks(cells, b, shape)
    bi = F.expr(f"i div {b}")
    bj = F.expr(f"j div {b}")
    if pad:
        nr, nc = F.lit(b), F.lit(b)
    else:
        nr = F.least(F.lit(b), F.lit(nrows) - bi * b).cast("int")
        nc = F.least(F.lit(b), F.lit(ncols) - bj * b).cast("int")
    keyed = cells.select(bi.alias("bi"), bj.alias("bj"), nr.cast("int").alias("nr"),
                         nc.cast("int").alias("nc"),
                         ((F.col("i") - bi * b) * nc + (F.col("j") - bj * b)).cast("int").alias("p"),
                         "v")
    g = keyed.groupBy("bi", "bj", "nr", "nc").agg(F.collect_list(F.struct("p", "v")).alias("e"))
    blk = dense_array("e", F.col("nr") * F.col("nc"), vtype)
    return g.select("bi", "bj", "nr", "nc", blk.alias("blk"))


def rows_to_blocks(rows: DataFrame, b: int, shape: tuple[int, int], pad: bool = False) -> DataFrame:
    """ROWS (dense rows of length ncols) -> BLOCKS.

    Each row is cut into column segments of ``b`` (array slices, no per-cell
    rows); the ``b`` segments of a block are then gathered and concatenated
    in row order. A group holds at most ``b`` segments.
    """
    nrows, ncols = shape
    nbj = -(-ncols // b)
    vtype = dict(rows.dtypes)["row"][len("array<"):-1]
    segs = rows.select(
        "i", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(nbj - 1)),
                                      lambda c: F.slice("row", c * b + 1, b))).alias("bj", "seg"))
    bi = F.floor(F.col("i") / b).cast("bigint")
    keyed = segs.select(bi.alias("bi"), F.col("bj").cast("bigint").alias("bj"),
                        (F.col("i") - bi * b).cast("int").alias("li"), "seg")
    g = keyed.groupBy("bi", "bj").agg(F.sort_array(F.collect_list(F.struct("li", "seg"))).alias("e"))
    nr = F.least(F.lit(b), F.lit(nrows) - F.col("bi") * b).cast("int")
    nc = F.least(F.lit(b), F.lit(ncols) - F.col("bj") * b).cast("int")
    if pad:
        zero_seg = F.array_repeat(F.lit(0).cast(vtype), b)
        padded_segs = F.transform("e", lambda x: F.concat(
            x["seg"], F.array_repeat(F.lit(0).cast(vtype), F.lit(b) - F.size(x["seg"]))))
        m = F.map_from_arrays(F.transform("e", lambda x: x["li"]), padded_segs)
        blk = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(b - 1)),
                                    lambda r: F.coalesce(F.element_at(m, r), zero_seg)))
        return g.select("bi", "bj", F.lit(b).alias("nr"), F.lit(b).alias("nc"), blk.alias("blk"))
    return g.select("bi", "bj", nr.alias("nr"), nc.alias("nc"),
                    F.flatten(F.transform("e", lambda x: x["seg"])).alias("blk"))


def transpose_blocks(blocks: DataFrame) -> DataFrame:
    """BLOCKS of A -> BLOCKS of A^T: swap block indices, transpose each tile (JVM)."""
    t = F.transform(F.sequence(F.lit(0), F.col("nr") * F.col("nc") - 1),
                    lambda p: F.col("blk")[F.pmod(p, F.col("nr")) * F.col("nc") + F.floor(p / F.col("nr"))])
    # Transpose in its own projection: in one select with the swapped
    # aliases, names inside the lambda could resolve to those aliases.
    x = blocks.select("bi", "bj", "nr", "nc", t.alias("tblk"))
    return x.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"),
                    F.col("nc").alias("nr"), F.col("nr").alias("nc"), F.col("tblk").alias("blk"))


def _tile_cells(b: int):
    """bi, bj, nc, blk -> the cells other than 0."""
    def run(batches):
        for whole in batches:
            step = max(1, TILE_BYTES // (8 * b * b))
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                lists = batch.column(3).fill_null([])
                flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                found = np.flatnonzero(flat.fill_null(0).to_numpy(zero_copy_only=False))
                starts = np.cumsum(sizes) - sizes
                tile = np.searchsorted(starts + sizes, found, side="right")
                p = found - starts[tile]
                none = [batch.column(n).is_null().to_numpy(zero_copy_only=False)[tile] for n in range(3)]
                bi, bj, nc = (batch.column(n).fill_null(1).to_numpy()[tile] for n in range(3))
                i = pa.array(bi.astype(np.int64) * b + p // nc, mask=none[0] | none[2])
                j = pa.array(bj.astype(np.int64) * b + p % nc, mask=none[1] | none[2])
                yield pa.RecordBatch.from_arrays([i, j, flat.take(pa.array(found))], names=["i", "j", "v"])

    return run


def blocks_to_cells(blocks: DataFrame, b: int, keep_zeros: bool = False,
                    cast: str | None = None, sparse: bool = False) -> DataFrame:
    """BLOCKS -> CELLS. ``b`` is the nominal block size (offset of block bi is bi*b).

    ``cast='bigint'`` rounds values computed in double back to integers.
    ``sparse`` is for tiles that are mostly zeros: NumPy finds the others, and no row is made of a zero.
    """
    vtype = dict(blocks.dtypes)["blk"][len("array<"):-1]
    if sparse and not keep_zeros and cast is None and vtype in _TILE_TYPES:
        return blocks.select("bi", "bj", "nc", "blk").mapInArrow(_tile_cells(b), f"i bigint, j bigint, v {vtype}")
    x = blocks.select("bi", "bj", "nc", F.posexplode("blk").alias("p", "v"))
    v = F.col("v")
    if cast in ("bigint", "long", "int"):
        v = F.round(v).cast("bigint")
    elif cast:
        v = v.cast(cast)
    out = x.select((F.col("bi") * b + F.floor(F.col("p") / F.col("nc"))).cast("bigint").alias("i"),
                   (F.col("bj") * b + F.pmod(F.col("p"), F.col("nc"))).cast("bigint").alias("j"),
                   v.alias("v"))
    return out if keep_zeros else out.where(F.col("v") != 0)


def submatrix(cells: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Rows [r0, r1) x columns [c0, c1), re-indexed from 0.

    A plain filter on i and j: on a Parquet row table clustered by i it
    reaches the scan and prunes row groups.
    """
    return (cells.where((F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1))
                 .select((F.col("i") - r0).alias("i"), (F.col("j") - c0).alias("j"), "v"))


def slice_rows(rows: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """ROWS form of ``submatrix``: filter on i, ``slice`` of each row array."""
    return (rows.where((F.col("i") >= r0) & (F.col("i") < r1))
                .select((F.col("i") - r0).alias("i"), F.slice("row", c0 + 1, c1 - c0).alias("row")))


def assemble(quadrants: dict[int, DataFrame], hr: int, hc: int) -> DataFrame:
    """One matrix from its quadrants {q: CELLS} (q = 2*row half + column half).

    Each quadrant is shifted by its offset and the four are unioned: no
    shuffle, no join.
    """
    out = None
    for q, x in sorted(quadrants.items()):
        y = x.select((F.col("i") + (q // 2) * hr).alias("i"), (F.col("j") + (q % 2) * hc).alias("j"), "v")
        out = y if out is None else out.unionByName(y)
    return out


def hstack_rows(left: DataFrame, right: DataFrame, left_cols: int | None = None,
                right_cols: int | None = None) -> DataFrame:
    """[L | R] on dense ROWS: join on the row index (unique per side), concatenate rows.

    A row that only one side has is zeros on the other, as wide as that side
    (given, or the widest row found).
    """
    def width(rows: DataFrame, given: int | None) -> int:
        return given if given is not None else int(rows.agg(F.max(F.size("row"))).first()[0] or 0)

    def padded(col: str, n: int, vtype: str) -> F.Column:
        return F.coalesce(col, F.array_repeat(F.lit(0).cast(vtype), n))

    vtype = dict(left.dtypes)["row"][len("array<"):-1]
    return left.join(right.withColumnRenamed("row", "row_r"), "i", "full_outer").select(
        "i", F.concat(padded("row", width(left, left_cols), vtype),
                      padded("row_r", width(right, right_cols), vtype)).alias("row"))
