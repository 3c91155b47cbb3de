"""Products of a whole collection of matrix pairs in one plan: C_key = A_key * B_key for every key.

CELLS carry a key column next to i, j, v. Every key gets a grid of its own, from its exact counts:
a small product is one task's group, a large one is dealt into g x g x chunks groups like in
``sparse_tiles``, so sizes may differ by any factor and no group holds more than about
``pairs_per_task`` pairs or ``tile_cells`` cells of a side. The grids are one row a key; they are
broadcast where a count proves them few, else joined. All keys' groups are tasks of the same
stages: no job a key, nothing on the driver but that count.

Integer sums must stay below 2**63; floating cells give doubles; decimals aren't tiled. Null keys
have no product, nor has a key that one side lacks. Repeated cells of one coordinate add up. Zero
cells are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import broadcast_if_small
from tessera.operators.sparse_tiles import PAIRS_PER_TASK, TILE_CELLS, row_products

MAX_KEYS = 1_000_000


def grids(a: DataFrame, b: DataFrame, key: str, pairs_per_task: int = PAIRS_PER_TASK, tile_cells: int = TILE_CELLS) -> DataFrame:
    """key, g, chunks, pairs of each key that both sides hold, from exact counts per inner index."""
    na = a.groupBy(key, F.col("j").alias("x")).agg(F.count(F.lit(1)).alias("na"))
    nb = b.groupBy(key, F.col("i").alias("x")).agg(F.count(F.lit(1)).alias("nb"))
    both = na.join(nb, [key, "x"], "full").select(key, F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    pairs = F.col("na") * F.col("nb")
    per = both.groupBy(key).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum(pairs).alias("pairs"), F.max(pairs).alias("heaviest"))
    # g makes no partial sums, so it is raised for work as well as for a heavy inner index
    g = F.greatest(F.ceil(F.sqrt(F.col("heaviest") / pairs_per_task)), F.ceil(F.sqrt(F.col("pairs") / pairs_per_task)), F.lit(1))
    per = per.where("pairs > 0").withColumn("g", g.cast("int"))
    chunks = F.greatest(F.ceil(F.greatest("na", "nb") / (F.col("g") * F.lit(tile_cells))), F.lit(1))
    return per.select(key, "g", chunks.cast("int").alias("chunks"), "pairs")


def matmul_batch(a: DataFrame, b: DataFrame, key: str = "key", pairs_per_task: int = PAIRS_PER_TASK, tile_cells: int = TILE_CELLS) -> DataFrame:
    """key, i, j, v: the cells of every key's product, in one job."""
    kinds = {dict(x.dtypes)["v"] for x in (a, b)}
    if any(k.startswith("decimal") for k in kinds):
        raise ValueError("decimal cells have no exact tile type; use matmul_join on one key at a time")
    floating = bool(kinds & {"double", "float"})
    dtype, out = (np.float64, "double") if floating else (np.int64, "bigint")
    kind, kept = dict(a.dtypes)[key], a.schema[key].dataType
    a, b = (x.select(F.col(key).cast(kept).alias("key"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast(out).alias("v"))
             .where("key IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL AND v <> 0") for x in (a, b))
    plan, _ = broadcast_if_small(grids(a, b, "key", pairs_per_task, tile_cells), MAX_KEYS)
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    deal = lambda c, n: F.pmod(F.col(c), F.col(n)).cast("int")
    tile = ["key", "gi", "gj", "kc"]

    def packed(cells: DataFrame, gi, gj, kc) -> DataFrame:
        """Tiles, packed before they are copied to the other axis of the grid."""
        t = cells.join(plan, "key").select("key", "g", gi.alias("own"), kc.alias("kc"), "i", "j", "v")
        t = t.groupBy("key", "g", "own", "kc").agg(F.sort_array(F.collect_list(F.struct("i", "j", "v"))).alias("e"))
        return t.select("key", *gj, "kc", F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.v").alias("v"))

    left = packed(a, deal("i", "g"), [F.col("own").alias("gi"), every.alias("gj")], deal("j", "chunks"))
    right = packed(b, deal("j", "g"), [every.alias("gi"), F.col("own").alias("gj")], deal("i", "chunks"))

    def unpack(t: pa.Table) -> tuple[np.ndarray, ...]:
        i, j, v = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column(n).chunks]) for n in ("i", "j", "v"))
        order = np.lexsort((j, i))
        return i[order], j[order], v.astype(dtype)[order]

    def multiply(group: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        parts = list(row_products(unpack(x), unpack(y))) if x.num_rows and y.num_rows else []
        i, j, v = (np.concatenate(p) for p in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, dtype))
        keys = pa.array([group[0].as_py()], group[0].type).take(pa.array(np.zeros(len(i), dtype=np.int64)))
        return pa.table([keys, pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v, pa.float64() if floating else pa.int64())], names=["key", "i", "j", "v"])

    cells = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(multiply, f"key {kind}, i bigint, j bigint, v {out}")
    # keys of several chunks have a partial sum a chunk
    cells = cells.groupBy("key", "i", "j").agg(F.sum("v").alias("v"))
    return cells.where("v <> 0").withColumnRenamed("key", key)
