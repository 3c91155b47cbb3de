"""Dense block products.

Block product C[bi,bj] = sum_bk A[bi,bk] * B[bk,bj] as a 3-D grid:

* output block rows are dealt into ``G`` row groups (gi = bi mod G), output
  block columns into ``G`` column groups (gj = bj mod G), and the inner
  block index into ``K`` chunks (kc = bk mod K);
* every A block (bi, bk) is sent to the G cells (gi, *, kc), every B block
  (bk, bj) to the G cells (*, gj, kc);
* one cogrouped pandas task per (gi, gj, kc) multiplies its blocks with
  NumPy and sums over its bk, so it emits one partial block per (bi, bj);
* when K > 1 the K partials of an output block are summed (fan-in <= K).

G and K are chosen from the block counts so that there are enough tasks and
a task's input stays under a memory budget. Inputs are copied G times, which
is the price of a balanced, skew-free product; no group ever holds a whole
matrix, a whole block row or a whole block column unless the budget allows.

Where the inner side is thin (K = 1) and the copies are large, they are not
written out: block rows of A and block columns of B are packed into groups, one
partition each, and every pair of groups is one task of a cartesian product,
which reads both groups from where they were written once (``pair_product``).
From CELLS the groups are packed without a shuffle for the tiles before
(``pair_product_cells``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.layout import blocks_to_cells, cells_to_blocks, stats_of

DEFAULT_GROUP_BYTES = 256 << 20
#: Copied inputs that a grid may write out; a packed group of tiles; a batch of result tiles.
COPY_BYTES, PACK_BYTES, BATCH_BYTES = 64 << 20, 16 << 20, 8 << 20

_BLOCK_FIELDS = "bi BIGINT, bj BIGINT, nr INT, nc INT, blk ARRAY<{t}>"
_DTYPES = {"double": "float64", "bigint": "int64"}


def grid_for(nbi: int, nbk: int, nbj: int, b: int, tasks: int,
             group_bytes: int = DEFAULT_GROUP_BYTES) -> tuple[int, int]:
    """(G, K) for the grid product.

    A group holds x = ceil(nb/G) block rows (and columns) by y = ceil(nbk/K)
    inner blocks as input and, however small the inner side is, x by x output
    tiles, which exist twice while they are returned. Both count against the
    budget. Shuffle volume is 2*n*n*G for the copied inputs plus n*n*K for the
    partial results, so G is kept small first; for parallelism G is raised
    before K, as it makes no partials and no summing round.
    """
    nbi, nbk, nbj = max(nbi, 1), max(nbk, 1), max(nbj, 1)
    gmax = max(nbi, nbj)
    cap = max(group_bytes / (8.0 * b * b), 1.0)            # tiles
    x = max(1, int(math.sqrt(cap / 4)))                    # half of it for the output
    x = min(gmax, x)
    y = max(1, int((cap - 2 * min(x, nbi) * min(x, nbj)) // max(1, min(x, nbi) + min(x, nbj))))
    g = -(-gmax // x)
    k = -(-nbk // min(y, nbk))
    while g * g * k < tasks and (g < gmax or k < nbk):
        if g < gmax:
            g += 1
        else:
            k = min(nbk, k * 2)
    return g, k


def group_tiles(nbi: int, nbk: int, nbj: int, g: int, k: int) -> int:
    """Tiles that the largest group of a (G, K) grid holds: inputs, and outputs twice."""
    xi, xj, y = -(-nbi // g), -(-nbj // g), -(-nbk // k)
    return (xi + xj) * y + 2 * xi * xj


def sum_blocks(df: DataFrame, keys: list[str], sign: str | None = None,
               order: str | None = None) -> DataFrame:
    """Element-wise sum of the blocks sharing ``keys`` (optionally times ``sign``).

    Callers only use this where a key has a bounded number of blocks
    (Strassen operands <= 2, results <= 4, K partials <= 16 per round), so
    collecting them per key is bounded too. The fold runs in the JVM, in the
    order of the ``order`` column (distinct within a key), so a recomputed
    task adds the same numbers in the same order.
    """
    blk = F.col("blk") if sign is None else F.transform("blk", lambda x: x * F.col(sign))
    ordk = F.col(order) if order else F.lit(0)
    g = df.groupBy(*keys).agg(F.first("nr").alias("nr"), F.first("nc").alias("nc"),
                              F.collect_list(F.struct(ordk.alias("o"), blk.alias("b"))).alias("e"))
    bl = F.transform(F.array_sort("e", lambda x, y: F.when(x["o"] < y["o"], -1)
                                  .when(x["o"] > y["o"], 1).otherwise(0)), lambda x: x["b"])
    folded = F.aggregate(F.slice(bl, 2, 1 << 30), bl[0],
                         lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))
    return g.select(*keys, "nr", "nc", folded.alias("blk"))


def _panel(group: list[str], dtype: str):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = group + ["bi", "bj", "nr", "nc", "blk", "kc"]
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object if c == "blk" else "int64") for c in cols})
        gvals = [a[c].iloc[0] for c in group + ["kc"]]
        # Fixed accumulation order (by inner block index), whatever order the
        # shuffle delivered the rows in: a retried task gives identical sums.
        a = a.sort_values(["bk", "bi"], kind="stable")
        b = b.sort_values(["bk", "bj"], kind="stable")
        by_k: dict = {}
        for bk, bj, nr, nc, blk in zip(b["bk"], b["bj"], b["nr"], b["nc"], b["blk"]):
            by_k.setdefault(bk, []).append((bj, np.asarray(blk, dtype=dtype).reshape(nr, nc)))
        acc: dict = {}
        for bi, bk, nr, nc, blk in zip(a["bi"], a["bk"], a["nr"], a["nc"], a["blk"]):
            rhs = by_k.get(bk)
            if not rhs:
                continue
            x = np.asarray(blk, dtype=dtype).reshape(nr, nc)
            for bj, y in rhs:
                p = x @ y
                key = (bi, bj)
                if key in acc:
                    acc[key] += p
                else:
                    acc[key] = p
        rows = {c: [] for c in cols}
        for (bi, bj), p in acc.items():
            for c, val in zip(group + ["kc"], gvals):
                rows[c].append(val)
            rows["bi"].append(bi)
            rows["bj"].append(bj)
            rows["nr"].append(p.shape[0])
            rows["nc"].append(p.shape[1])
            rows["blk"].append(p.ravel())
        out = pd.DataFrame({c: rows[c] for c in cols if c != "blk"})
        out["blk"] = pd.Series(rows["blk"], dtype=object)
        return out
    return run


def block_product(a: DataFrame, b: DataFrame, grid: tuple[int, int],
                  group: list[str] | None = None, value: str = "double") -> DataFrame:
    """BLOCKS x BLOCKS -> BLOCKS of ``value``, optionally per extra key columns ``group``.

    ``value='bigint'`` multiplies 64-bit integer tiles; the caller has checked
    that no sum can reach 2**63.

    ``a`` has group + (bi, bj, nr, nc, blk) with bj the inner block index;
    ``b`` the same with bi the inner index.
    """
    group = group or []
    g, k = grid
    av = a.select(*group, "bi", F.col("bj").alias("bk"), "nr", "nc",
                  F.col("blk").cast(f"array<{value}>").alias("blk"))
    bv = b.select(*group, F.col("bi").alias("bk"), "bj", "nr", "nc",
                  F.col("blk").cast(f"array<{value}>").alias("blk"))
    av = (av.withColumn("gi", F.pmod("bi", F.lit(g)).cast("int"))
            .withColumn("kc", F.pmod("bk", F.lit(k)).cast("int"))
            .withColumn("gj", F.explode(F.sequence(F.lit(0), F.lit(g - 1)))))
    bv = (bv.withColumn("gj", F.pmod("bj", F.lit(g)).cast("int"))
            .withColumn("kc", F.pmod("bk", F.lit(k)).cast("int"))
            .withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(g - 1)))))
    keys = group + ["gi", "gj", "kc"]
    gschema = ", ".join(f"{c} BIGINT" for c in group)
    schema = (gschema + ", " if gschema else "") + _BLOCK_FIELDS.format(t=value.upper()) + ", kc INT"
    part = (av.groupBy(*keys).cogroup(bv.groupBy(*keys))
              .applyInPandas(_panel(group, _DTYPES[value]), schema))
    if k == 1:
        return part.select(*group, "bi", "bj", "nr", "nc", "blk")
    return tree_sum_blocks(part, group + ["bi", "bj"], "kc", k)


def pairs_for(shape_a: tuple[int, int], shape_b: tuple[int, int], b: int, grid: tuple[int, int],
              tasks: int) -> tuple[int, int] | None:
    """Groups of block rows of A and of block columns of B for ``pair_product``; None: the grid does.

    Each pair of groups is one task, so no output is held and only the inputs
    bound a group: there are as many as give enough tasks, or more to keep a
    group to ``PACK_BYTES``. The grid stays where it writes few copies, cuts
    the inner side (K > 1), or where pairs would read more than it copies.
    """
    g, k = grid
    left, right = (8 * max(r, 1) * max(c, 1) for r, c in (shape_a, shape_b))
    if k > 1 or g * (left + right) < COPY_BYTES or 8 * b * max(shape_a[1], shape_b[0]) > PACK_BYTES:
        return None
    nbi, nbj = max(1, -(-shape_a[0] // b)), max(1, -(-shape_b[1] // b))
    gj = min(nbj, max(math.isqrt(max(tasks, 1) - 1) + 1, -(-right // PACK_BYTES)))
    gi = min(nbi, max(-(-tasks // gj), -(-left // PACK_BYTES)))
    gj = max(gj, min(nbj, -(-tasks // gi)))
    return (gi, gj) if left * gj + right * gi <= g * (left + right) else None


def _cell_groups(shape_a: tuple[int, int], shape_b: tuple[int, int], b: int, tasks: int) -> tuple[int, int] | None:
    """Groups for ``pair_product_cells``: as many on both sides where A and B^T have one shape."""
    nbi, nbk, nbj = -(-shape_a[0] // b), -(-shape_a[1] // b), -(-shape_b[1] // b)
    groups = pairs_for(shape_a, shape_b, b, grid_for(nbi, nbk, nbj, b, tasks), tasks)
    return (max(groups),) * 2 if groups and shape_a == shape_b[::-1] else groups


def _packed(lists: pa.ListArray, at: int, outer: str, inner: str, dtype: str) -> dict:
    """Tiles of one packed group: outer block index -> inner block index -> tile, both in order."""
    t = lists[at].values
    col = dict(zip((f.name for f in t.type), t.flatten()))
    ends, flat = col["blk"].offsets.to_numpy(), col["blk"].values.to_numpy(zero_copy_only=False)
    ints = {c: col[c].to_numpy() for c in ("bi", "bj", "nr", "nc")}
    out: dict = {}
    for n in np.lexsort((ints[inner], ints[outer])):
        tile = np.asarray(flat[ends[n]:ends[n + 1]], dtype=dtype).reshape(ints["nr"][n], ints["nc"][n])
        out.setdefault(int(ints[outer][n]), {})[int(ints[inner][n])] = tile
    return out


def _tile_batch(tiles: list) -> pa.RecordBatch:
    ends = np.cumsum([0] + [p.size for _, _, p in tiles]).astype(np.int32)
    blk = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p.ravel() for _, _, p in tiles])))
    return pa.RecordBatch.from_arrays(
        [pa.array([bi for bi, _, _ in tiles], pa.int64()), pa.array([bj for _, bj, _ in tiles], pa.int64()),
         pa.array([p.shape[0] for _, _, p in tiles], pa.int32()), pa.array([p.shape[1] for _, _, p in tiles], pa.int32()), blk],
        names=["bi", "bj", "nr", "nc", "blk"])


def _group_pairs(left_of, right_of):
    """``left_of`` and ``right_of`` unpack a group: (lists, row) -> outer -> inner block index -> tile."""
    def run(batches):
        for batch, at in ((whole, n) for whole in batches for n in range(whole.num_rows)):
            left, right = left_of(batch.column(0), at), right_of(batch.column(1), at)
            ready, size = [], 0
            for (bi, xs), (bj, ys) in ((x, y) for x in left.items() for y in right.items()):
                p = None
                for bk in xs:  # in order: a retried task gives identical sums
                    if bk in ys:
                        q = xs[bk] @ ys[bk]
                        p = q if p is None else p + q
                if p is None:
                    continue
                ready.append((bi, bj, p))
                size += p.nbytes
                if size >= BATCH_BYTES:
                    yield _tile_batch(ready)
                    ready, size = [], 0
            if ready:
                yield _tile_batch(ready)
    return run


def pair_product(a: DataFrame, b: DataFrame, groups: tuple[int, int], value: str = "double") -> DataFrame:
    """BLOCKS x BLOCKS -> BLOCKS of ``value`` by a cartesian product of packed groups of tiles.

    Block rows of A are dealt into ``groups[0]`` partitions, block columns of B
    into ``groups[1]``, each written once and packed into one record; a task
    reads one of either, so copies go over the network but never to disk. A
    group holds all of its rows' (columns') inner side, so no partials arise.
    """
    def packs(x: DataFrame, key: str, n: int, name: str) -> DataFrame:
        x = x.where(F.col("bi").isNotNull() & F.col("bj").isNotNull())
        tile = F.struct("bi", "bj", "nr", "nc", F.col("blk").cast(f"array<{value}>").alias("blk"))
        x = x.select(F.pmod(key, F.lit(n)).cast("int").alias("g"), tile.alias("t")).repartitionById(n, "g")
        return x.groupBy("g").agg(F.collect_list("t").alias(name)).select(name)

    pairs = packs(a, "bi", groups[0], "a").hint("shuffle_replicate_nl").crossJoin(packs(b, "bj", groups[1], "b"))
    dtype = _DTYPES[value]
    return pairs.mapInArrow(_group_pairs(lambda x, at: _packed(x, at, "bi", "bj", dtype), lambda x, at: _packed(x, at, "bj", "bi", dtype)),
                            _BLOCK_FIELDS.format(t=value.upper()))


def _pieces(b: int, width: int, groups: int):
    """Cells (o, k, v) -> pieces of tiles: a batch's cells of one tile in order.

    A piece has the steps from one position in the tile to the next instead of
    positions: where cells are dense all are 1, which a compressed shuffle
    hardly notices.
    """
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            o, k = (batch.column(c).to_numpy() for c in (0, 1))
            bo, bk = o // b, k // b
            at = (o - bo * b) * width + (k - bk * b)
            order = np.lexsort((at, bk, bo))
            bo, bk, at = bo[order], bk[order], at[order]
            starts = np.flatnonzero(np.r_[True, (np.diff(bo) != 0) | (np.diff(bk) != 0)])
            steps = np.diff(at, prepend=0)
            steps[starts] = at[starts]
            ends = pa.array(np.r_[starts, len(at)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array((bo[starts] % groups).astype(np.int32)), pa.array(bo[starts]), pa.array(bk[starts]),
                 pa.ListArray.from_arrays(ends, pa.array(steps.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(batch.column(2).to_numpy()[order]))],
                names=["g", "bo", "bk", "step", "v"])
    return run


def _assembled(lists: pa.ListArray, row: int, b: int, outer: int, inner: int, dtype: str) -> dict:
    """Tiles of one group of pieces, as of ``_packed``; cells that occur twice are added, as in the join."""
    t = lists[row].values
    col = dict(zip((f.name for f in t.type), t.flatten()))
    ends, steps, flat = col["step"].offsets.to_numpy(), col["step"].values.to_numpy(), col["v"].values.to_numpy()
    first, width = col["v"].offsets.to_numpy(), min(b, inner)
    found: dict = {}
    for n, key in enumerate(zip(col["bo"].to_pylist(), col["bk"].to_pylist())):
        found.setdefault(key, []).append(n)
    out: dict = {}
    for (bo, bk), pieces in sorted(found.items()):
        at = np.concatenate([np.cumsum(steps[ends[n]:ends[n + 1]], dtype=np.int64) for n in pieces])
        v = np.concatenate([flat[first[n]:first[n + 1]] for n in pieces]).astype(dtype)
        tile = np.zeros(b * width, dtype=dtype)
        if np.bincount(at).max() > 1:
            order = np.lexsort((v, at))  # a retried task adds in the same order
            np.add.at(tile, at[order], v[order])
        else:
            tile[at] = v
        out.setdefault(bo, {})[bk] = tile.reshape(b, width)[:outer - bo * b, :inner - bk * b]
    return out


def pair_product_cells(a: DataFrame, b: DataFrame, block_size: int, shape_a: tuple[int, int],
                       shape_b: tuple[int, int], groups: tuple[int, int], value: str = "double") -> DataFrame:
    """CELLS x CELLS -> BLOCKS, as ``pair_product`` of their tiles, each cell written once.

    Tasks that read cells pack them into pieces of tiles, which one shuffle
    deals into the groups; the tasks of the cartesian product put the tiles
    together. B is packed as its transpose, so that in A * A^T with as many
    groups on both sides Spark reuses A's shuffle for B. Cells without index
    or value take no part, as in the join.
    """
    inner, dtype = max(shape_a[1], shape_b[0]), _DTYPES[value]
    rows, cols = shape_a[0], shape_b[1]

    def packs(x: DataFrame, outer: str, k: str, n: int, name: str) -> DataFrame:
        kind = "bigint" if dict(x.dtypes)["v"] in INTEGERS else value
        x = x.select(F.col(outer).cast("bigint").alias("o"), F.col(k).cast("bigint").alias("k"), F.col("v").cast(kind).alias("v"))
        x = x.where(F.col("o").isNotNull() & F.col("k").isNotNull() & F.col("v").isNotNull())
        x = x.mapInArrow(_pieces(block_size, min(block_size, inner), n), f"g INT, bo BIGINT, bk BIGINT, step ARRAY<INT>, v ARRAY<{kind}>")
        x = x.select("g", F.struct("bo", "bk", "step", "v").alias("t")).repartitionById(n, "g")
        return x.groupBy("g").agg(F.collect_list("t").alias(name)).select(name)

    def left_of(lists, at):
        return _assembled(lists, at, block_size, rows, inner, dtype)

    def right_of(lists, at):
        return {bj: {bk: np.ascontiguousarray(x.T) for bk, x in xs.items()}
                for bj, xs in _assembled(lists, at, block_size, cols, inner, dtype).items()}

    pairs = packs(a, "i", "j", groups[0], "a").hint("shuffle_replicate_nl").crossJoin(packs(b, "j", "i", groups[1], "b"))
    return pairs.mapInArrow(_group_pairs(left_of, right_of), _BLOCK_FIELDS.format(t=value.upper()))


def tree_sum_blocks(df: DataFrame, keys: list[str], level: str, n: int, fan_in: int = 16) -> DataFrame:
    """Sum the ``n`` partial blocks per key, at most ``fan_in`` at a time.

    ``level`` numbers the partials 0..n-1; each round groups them by
    ``level div fan_in``, so no group ever gathers more than ``fan_in``
    blocks, however large n is.
    """
    while n > fan_in:
        df = (df.withColumn("_o", F.col(level))
                .withColumn(level, F.floor(F.col(level) / fan_in).cast("int")))
        df = sum_blocks(df, keys + [level], order="_o")
        n = -(-n // fan_in)
    return sum_blocks(df, keys, order=level)


def default_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def matmul_blocks(a: DataFrame, b: DataFrame, block_size: int, shape_a: tuple[int, int],
                  shape_b: tuple[int, int], grid: tuple[int, int] | None = None,
                  value: str = "double") -> DataFrame:
    """C = A * B on the BLOCKS layout (both sides tiled with the same ``block_size``)."""
    check_shapes(shape_a, shape_b)
    nbi = -(-shape_a[0] // block_size)
    nbk = -(-shape_a[1] // block_size)
    nbj = -(-shape_b[1] // block_size)
    if grid is None:
        tasks = default_tasks(a.sparkSession)
        grid = grid_for(nbi, nbk, nbj, block_size, tasks)
        if groups := pairs_for(shape_a, shape_b, block_size, grid, tasks):
            return pair_product(a, b, groups, value)
    return block_product(a, b, grid, value=value)


INTEGERS = ("bigint", "int", "smallint", "tinyint")


def check_shapes(shape_a: tuple[int, int], shape_b: tuple[int, int], exact: bool = False) -> None:
    """Refuse sides whose inner sizes can't be those of one product.

    Sizes measured from cells miss trailing zero rows and columns, so only
    ``exact`` (declared) sizes must be equal.
    """
    if exact and shape_a[1] != shape_b[0]:
        raise ValueError(f"inner sizes differ: {shape_a} by {shape_b}")


def kernel_for(type_a: str, type_b: str, inner: int, max_a, max_b, growth: int = 1) -> str | None:
    """Tile type in which a product is exact: 'double', 'bigint', or None if only cells are.

    Floating inputs take doubles. Integer sums are bounded by
    inner * max|A| * max|B| (times ``growth`` for intermediate sums): below
    2**53 doubles hold them exactly, below 2**63 integers do. Decimals stay cells.
    """
    if type_a in ("double", "float") and type_b in ("double", "float"):
        return "double"
    if type_a not in INTEGERS or type_b not in INTEGERS:
        return None
    bound = int(inner) * int(max_a) * int(max_b) * growth
    return "double" if bound < 1 << 53 else "bigint" if bound < 1 << 63 else None


def matmul_block(a: DataFrame, b: DataFrame, block_size: int,
                 shape_a: tuple[int, int] | None = None, shape_b: tuple[int, int] | None = None,
                 grid: tuple[int, int] | None = None, cast: str | None = "auto",
                 value: str | None = None) -> DataFrame:
    """C = A * B through dense ``block_size`` tiles multiplied by NumPy on executors.

    Integer inputs are measured (unless the caller names the tile type by
    ``value``): tiles are doubles or 64-bit integers, whichever is exact, and
    the result is BIGINT. Inputs that no tile type holds exactly are refused.
    """
    ta, tb = dict(a.dtypes)["v"], dict(b.dtypes)["v"]
    if value is None and ta in ("double", "float") and tb in ("double", "float"):
        value = "double"
    if value is None or shape_a is None or shape_b is None:
        sa, sb = stats_of(a, b)
        shape_a, shape_b = shape_a or sa[:2], shape_b or sb[:2]
        value = value or kernel_for(ta, tb, max(sa[1], sb[0]), sa[3], sb[3])
        if value is None:
            raise ValueError(f"no tile type holds {ta} x {tb} exactly here; use strategy 'join'")
    if groups := grid is None and _cell_groups(shape_a, shape_b, block_size, default_tasks(a.sparkSession)):
        c = pair_product_cells(a, b, block_size, shape_a, shape_b, groups, value)
    else:
        ab = cells_to_blocks(a, block_size, shape_a)
        bb = cells_to_blocks(b, block_size, shape_b)
        c = matmul_blocks(ab, bb, block_size, shape_a, shape_b, grid, value)
    if cast == "auto":
        cast = "bigint" if ta in INTEGERS and tb in INTEGERS else None
    return blocks_to_cells(c, block_size, cast=cast)
