"""The registered queries: one DataFrame plan per operator, each over whole tables.

Matrices (see ``tessera.sources.tables``):
  E  embeddings as vec_id x position, v = floor(x * 10000)
  SP lineitem as supplier x part, v = total quantity
  UE events as user x event type, v = count
  F  a formula-generated matrix on E's index grid (seed 7)

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is the
DuckDB SQL computing the same rows. Sizes that depend on the data (the
halves used by a quadrant split) are computed from the data on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.coefficients import coefficient_frames
from tessera.functions.expressions import padded_size, path_m, path_parent
from tessera.operators import algebra, blocks, dispatch, layout, panels, products, sparse_tiles, strassen
from tessera.operators.dispatch import matmul
from tessera.operators.layout import shape_of
from tessera.operators.batch import matmul_batch
from tessera.operators.estimate import error_bound, output_cells
from tessera.operators.repeatable import add_repeatable, matmul_repeatable
from tessera.operators.verify import check_product
from tessera.plans import oracle as sq
from tessera.session import shared_dir
from tessera.sources import generate, io, tables

SEED = 7


def _e(spark, sf):
    return tables.embedding_matrix(spark, sf)


def _f(e):
    return generate.like(e, generate.formula_value(SEED))


def _half(n: int, levels: int, lvl: int) -> int:
    return padded_size(n, levels) >> lvl


def _text(arr) -> F.Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


# ----------------------------------------------------------------- layouts
def q_rows_to_cells(spark, sf):
    return _e(spark, sf)


def q_cells_to_rows(spark, sf):
    r = layout.cells_to_rows(_e(spark, sf))
    return r.select("i", _text("row").alias("row_text"), F.size("row").cast("bigint").alias("n"))


def q_cells_to_rows_dense(spark, sf):
    ue = tables.user_event(spark, sf)
    _, ncols = shape_of(ue)
    r = layout.cells_to_rows(ue, ncols=ncols)
    return r.select("i", _text("row").alias("row_text"))


def q_cells_to_blocks(spark, sf):
    e = _e(spark, sf)
    b = layout.cells_to_blocks(e, 16, shape_of(e))
    return b.select("bi", "bj", "nr", "nc", _text("blk").alias("blk_text"))


def q_blocks_roundtrip(spark, sf):
    sp = tables.supplier_part(spark, sf)
    b = layout.cells_to_blocks(sp, 64, shape_of(sp), sparse=True)
    return layout.blocks_to_cells(b, 64, sparse=True)


def q_matrix_dims(spark, sf):
    parts = [("E", _e(spark, sf)), ("SP", tables.supplier_part(spark, sf)),
             ("UE", tables.user_event(spark, sf))]
    out = None
    for name, m in parts:
        d = layout.matrix_dims(m).select(F.lit(name).alias("matrix"), "*")
        out = d if out is None else out.unionByName(d)
    return out


def q_slice_assemble(spark, sf):
    e = _e(spark, sf)
    r, c = shape_of(e)
    hr, hc = _half(r, 1, 1), _half(c, 1, 1)
    quads = {2 * a + b: layout.submatrix(e, a * hr, (a + 1) * hr if a == 0 else r,
                                         b * hc, (b + 1) * hc if b == 0 else c)
             for a in (0, 1) for b in (0, 1)}
    return layout.assemble(quads, hr, hc)


def q_rows_slice_hstack(spark, sf):
    rows = tables.embedding_rows(spark, sf)
    r, c = shape_of(_e(spark, sf))
    hc = _half(c, 1, 1)
    x = layout.hstack_rows(layout.slice_rows(rows, 0, r, 0, hc), layout.slice_rows(rows, 0, r, hc, c))
    return x.select("i", _text("row").alias("row_text"))


# ----------------------------------------------------------------- algebra
def q_matrix_add(spark, sf):
    e = _e(spark, sf)
    return algebra.add(e, _f(e))


def q_matrix_subtract(spark, sf):
    e = _e(spark, sf)
    return algebra.subtract(e, _f(e))


def q_transpose(spark, sf):
    return algebra.transpose(tables.supplier_part(spark, sf))


def q_matrix_diff(spark, sf):
    e = _e(spark, sf)
    return algebra.matrix_diff(e, _f(e))


# -------------------------------------------------------------- Strassen steps
def _et_e(spark, sf):
    e = _e(spark, sf)
    r, c = shape_of(e)
    return algebra.transpose(e), e, (c, r), (r, c)


def q_block_split(spark, sf):
    e = _e(spark, sf)
    r, c = shape_of(e)
    return strassen.split_quadrants(e, _half(r, 1, 1), _half(c, 1, 1), "A")


def q_strassen_replicate(spark, sf):
    e = _e(spark, sf)
    r, c = shape_of(e)
    u, _, _ = coefficient_frames(spark)
    x = strassen.replicate(strassen.with_root_path(e), u, _half(r, 1, 1), _half(c, 1, 1), "A")
    return x.select("path", "m", "q", "sgn", "i", "j", "v", "tag.*")


def q_union_tagged(spark, sf):
    et, e, sa, sb = _et_e(spark, sf)
    u, v, _ = coefficient_frames(spark)
    hr, hk, hc = _half(sa[0], 1, 1), _half(sa[1], 1, 1), _half(sb[1], 1, 1)
    left = strassen.replicate(strassen.with_root_path(et), u, hr, hk, "A")
    right = strassen.replicate(strassen.with_root_path(e), v, hk, hc, "B")
    return (algebra.union_tagged(left, right)
            .select("side", "path", "sgn", "i", "j", "v", F.col("tag.matrix_name").alias("matrix_name")))


def _operands(spark, sf, levels):
    et, e, sa, sb = _et_e(spark, sf)
    u, v, _ = coefficient_frames(spark)
    left, right = strassen.with_root_path(et), strassen.with_root_path(e)
    for lvl in range(1, levels + 1):
        hr, hk, hc = _half(sa[0], levels, lvl), _half(sa[1], levels, lvl), _half(sb[1], levels, lvl)
        left = strassen.divide(left, u, hr, hk)
        right = strassen.divide(right, v, hk, hc)
    return left, right, sa, sb


def q_strassen_operands_left(spark, sf):
    return _operands(spark, sf, 1)[0]


def q_strassen_operands_right(spark, sf):
    return _operands(spark, sf, 1)[1]


def q_path_codes(spark, sf):
    left = _operands(spark, sf, 2)[0]
    return (left.groupBy("path").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("total"))
                .select("path", path_m("path").alias("m"), path_parent("path").alias("parent"),
                        "cells", "total"))


def q_strassen_products(spark, sf):
    left, right, _, _ = _operands(spark, sf, 1)
    return strassen.leaf_product(left, right)


def q_strassen_combine(spark, sf):
    left, right, sa, sb = _operands(spark, sf, 1)
    _, _, w = coefficient_frames(spark)
    p = strassen.leaf_product(left, right)
    return strassen.combine(p, w, _half(sa[0], 1, 1), _half(sb[1], 1, 1), by_quadrant=True)


# ----------------------------------------------------------------- products
def q_matmul_join(spark, sf):
    sp = tables.supplier_part(spark, sf)
    return products.matmul_join(sp, algebra.transpose(sp))


def q_matmul_abt(spark, sf):
    e = _e(spark, sf)
    return dispatch.matmul_abt(e, e)


def q_matmul_broadcast(spark, sf):
    ue = tables.user_event(spark, sf)
    return products.matmul_broadcast(algebra.transpose(ue), ue)


def q_matmul_block(spark, sf):
    """E * E^T straight from the row table: rows -> tiles, tiles transposed, NumPy panels."""
    rows = tables.embedding_rows(spark, sf)
    r, c = shape_of(_e(spark, sf))
    eb = layout.rows_to_blocks(rows, 64, (r, c))
    prod = blocks.matmul_blocks(eb, layout.transpose_blocks(eb), 64, (r, c), (c, r))
    return layout.blocks_to_cells(prod, 64, cast="bigint")


def _strassen_et_e(levels, **kw):
    def run(spark, sf):
        et, e, sa, sb = _et_e(spark, sf)
        # E is dense by construction (every embedding element is a cell).
        return strassen.matmul_strassen(et, e, levels, sa, sb, co_partition=True, **kw)
    return run


def q_matmul_strassen_checkpointed(spark, sf):
    """Two levels with the lineage cut after every level (reliable checkpoints in the shared folder)."""
    et, e, sa, sb = _et_e(spark, sf)
    shared_dir(spark)
    return strassen.matmul_strassen(et, e, 2, sa, sb, checkpoint_levels=True)


def q_blocks_parquet_roundtrip(spark, sf):
    """E tiled from its row table, stored as Parquet tiles, read back as cells."""
    rows = tables.embedding_rows(spark, sf)
    r, c = shape_of(_e(spark, sf))
    path = f"{shared_dir(spark)}/tessera-tiles-{uuid.uuid4().hex}"
    io.write_blocks(layout.rows_to_blocks(rows, 32, (r, c)), path)
    return layout.blocks_to_cells(io.read_blocks(spark, path, "bigint"), 32)


def q_matmul_strassen_rect(spark, sf):
    ue = tables.user_event(spark, sf)
    r, c = shape_of(ue)
    return strassen.matmul_strassen(algebra.transpose(ue), ue, 2, (c, r), (r, c))


def q_matmul_strassen_sparse(spark, sf):
    sp = tables.supplier_part(spark, sf)
    r, c = shape_of(sp)
    return strassen.matmul_strassen(sp, algebra.transpose(sp), 2, (r, c), (c, r))


def q_matmul_identity(spark, sf):
    e = _e(spark, sf)
    return products.matmul_join(e, generate.identity_like(algebra.transpose(e)))


def q_matmul_auto(spark, sf):
    sp = tables.supplier_part(spark, sf)
    return matmul(sp, algebra.transpose(sp), strategy="auto")


def q_matmul_sparse_tiles(spark, sf):
    """SP * SP^T by compressed sparse tiles: only packed tiles and one row an output cell are shuffled."""
    sp = tables.supplier_part(spark, sf)
    return sparse_tiles.matmul_sparse_tiles(sp, algebra.transpose(sp))


def q_matmul_panels(spark, sf):
    """SP * SP^T in column panels of SP^T, each at most a quarter of its cells, though all of it would fit."""
    sp = tables.supplier_part(spark, sf)
    return panels.matmul_panels(sp, algebra.transpose(sp), max_cells=sp.count() // 4 + 1)


def q_matmul_batch(spark, sf):
    """Supplier x part of every shipping year times its transpose, all years in one job."""
    li = tables.table(spark, sf, "lineitem")
    cells = (li.groupBy(F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
               .agg(F.sum("l_quantity").cast("bigint").alias("v")))
    return matmul_batch(cells, cells.select("year", F.col("j").alias("i"), F.col("i").alias("j"), "v"), "year")


def _nation_supplier(spark, sf):
    return tables.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("bigint").alias("i"), F.col("s_suppkey").cast("bigint").alias("j"),
                                                      F.lit(1).cast("bigint").alias("v"))


def q_output_size(spark, sf):
    """Cells of SP * SP^T and of nation x supplier * SP, and n_off: 1 where the sketch is off by more than three standard errors."""
    sp, ns = tables.supplier_part(spark, sf), _nation_supplier(spark, sf)
    out = None
    for name, a, b in (("SP*SPt", sp, algebra.transpose(sp)), ("NS*SP", ns, sp)):
        made = matmul(a, b, strategy="sparse_tiles").agg(F.count(F.lit(1)).alias("n_cells"))
        off = F.abs(F.col("n_cells") - F.lit(output_cells(a, b))) > 3 * error_bound() * F.col("n_cells")
        made = made.select(F.lit(name).alias("product"), "n_cells", off.cast("bigint").alias("n_off"))
        out = made if out is None else out.unionByName(made)
    return out


def q_sum_repeatable(spark, sf):
    """Revenue by supplier x part, doubles added without rounding; six decimals are compared."""
    li = tables.table(spark, sf, "lineitem")
    cells = li.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return add_repeatable(cells).select("i", "j", F.round("v", 6).alias("v"))


def q_matmul_repeatable(spark, sf):
    """E^T * E of the embeddings as doubles, the same bits in every run; six decimals are compared."""
    rows = tables.table(spark, sf, "embeddings").select(F.col("vec_id").cast("bigint").alias("i"), F.col("embedding").cast("array<double>").alias("row"))
    e = layout.rows_to_cells(rows)
    return matmul_repeatable(algebra.transpose(e), e).select("i", "j", F.round("v", 6).alias("v"))


def q_product_check(spark, sf):
    """SP * SP^T, by sparse tiles, checked against random vectors: no second product."""
    sp = tables.supplier_part(spark, sf)
    t = algebra.transpose(sp)
    return check_product(sp, t, sparse_tiles.matmul_sparse_tiles(sp, t))


# ---------------------------------------------------------------- generators
def q_generate_formula(spark, sf):
    return _f(_e(spark, sf))


def q_generate_binary(spark, sf):
    return generate.like(_e(spark, sf), generate.formula_value(SEED, 2))


def q_generate_uniform(spark, sf):
    return generate.like(_e(spark, sf), generate.uniform_value(SEED))


def q_parquet_roundtrip(spark, sf):
    """E stored as dense rows, SP and UE as sparse ones, every non-zero cell read back."""
    path = f"{shared_dir(spark)}/tessera-roundtrip-{uuid.uuid4().hex}"
    io.write_rows(_e(spark, sf), f"{path}/dense")
    back = io.read_cells(spark, f"{path}/dense", "bigint").where("v <> 0").select(F.lit(1).alias("which"), "*")
    parts = None
    for which, m in ((2, tables.supplier_part(spark, sf)), (3, tables.user_event(spark, sf))):
        m = m.select(F.lit(which).alias("which"), "*")
        parts = m if parts is None else parts.unionByName(m)
    io.write_sparse_rows(parts, f"{path}/sparse", partition_by=["which"])
    for which in (2, 3):
        m = io.read_sparse_cells(spark, f"{path}/sparse/which={which}", "bigint").where("v <> 0").select(F.lit(which).alias("which"), "*")
        back = back.unionByName(m)
    return back


def q_csv_roundtrip(spark, sf):
    """E stored as CSV, a file a range of rows with the row's id in front; each row is placed by its file's first id and its line number (ids have no gaps)."""
    rows = tables.embedding_rows(spark, sf).repartitionByRange("i").sortWithinPartitions("i")
    path = f"{shared_dir(spark)}/tessera-csv-{uuid.uuid4().hex}"
    rows.select(F.concat(F.col("i").cast("string"), F.lit(","), _text("row"))).write.text(path)
    cells = io.read_csv_files(spark, path, scale=1)
    first = cells.where("i = 0 AND j = 0").select("f", F.col("v").alias("first"))
    return cells.join(first, "f").where("j > 0").select((F.col("first") + F.col("i")).alias("i"), (F.col("j") - 1).alias("j"), "v")


def q_matmul_rows_broadcast(spark, sf):
    """E, as stored rows, times a formula matrix with a row for each of E's columns and 5 columns."""
    c = int(tables.table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0)
    b = generate.formula(spark, c, 5, SEED)
    return layout.rows_to_cells(products.matmul_rows_broadcast(tables.embedding_rows(spark, sf), b, (c, 5))).where("v <> 0")


def q_matmul_auto_exact(spark, sf):
    """E at a scale whose sums pass 2**53: the default entry stays exact."""
    e = layout.rows_to_cells(tables.embedding_rows(spark, sf, 100_000_000))
    return dispatch.matmul(algebra.transpose(e), e)


def q_matmul_block_chunked(spark, sf):
    """E^T * E with the inner side in 20 chunks, so partial tiles are summed in rounds."""
    et, e, st, se = _et_e(spark, sf)
    return blocks.matmul_block(et, e, 16, st, se, grid=(2, 20))


QUERIES = {
    "rows_to_cells": q_rows_to_cells,
    "cells_to_rows": q_cells_to_rows,
    "cells_to_rows_dense": q_cells_to_rows_dense,
    "cells_to_blocks": q_cells_to_blocks,
    "blocks_roundtrip": q_blocks_roundtrip,
    "matrix_dims": q_matrix_dims,
    "slice_assemble": q_slice_assemble,
    "rows_slice_hstack": q_rows_slice_hstack,
    "block_split": q_block_split,
    "strassen_replicate": q_strassen_replicate,
    "union_tagged": q_union_tagged,
    "strassen_operands_left": q_strassen_operands_left,
    "strassen_operands_right": q_strassen_operands_right,
    "path_codes": q_path_codes,
    "strassen_products": q_strassen_products,
    "strassen_combine": q_strassen_combine,
    "matrix_add": q_matrix_add,
    "matrix_subtract": q_matrix_subtract,
    "transpose": q_transpose,
    "matrix_diff": q_matrix_diff,
    "matmul_join": q_matmul_join,
    "matmul_abt": q_matmul_abt,
    "matmul_broadcast": q_matmul_broadcast,
    "matmul_block": q_matmul_block,
    "matmul_strassen_l1": _strassen_et_e(1),
    "matmul_strassen_l2": _strassen_et_e(2),
    "matmul_strassen_l3": _strassen_et_e(3),
    "matmul_strassen_checkpointed": q_matmul_strassen_checkpointed,
    "matmul_strassen_rect": q_matmul_strassen_rect,
    "matmul_strassen_sparse": q_matmul_strassen_sparse,
    "matmul_strassen_block": _strassen_et_e(1, leaf="block", block_size=16),
    "matmul_identity": q_matmul_identity,
    "matmul_auto": q_matmul_auto,
    "generate_formula": q_generate_formula,
    "generate_binary": q_generate_binary,
    "generate_uniform": q_generate_uniform,
    "matmul_sparse_tiles": q_matmul_sparse_tiles,
    "matmul_panels": q_matmul_panels,
    "product_check": q_product_check,
    "matmul_batch": q_matmul_batch,
    "output_size": q_output_size,
    "sum_repeatable": q_sum_repeatable,
    "matmul_repeatable": q_matmul_repeatable,
    "parquet_roundtrip": q_parquet_roundtrip,
    "csv_roundtrip": q_csv_roundtrip,
    "matmul_auto_exact": q_matmul_auto_exact,
    "matmul_rows_broadcast": q_matmul_rows_broadcast,
    "matmul_block_chunked": q_matmul_block_chunked,
    "blocks_parquet_roundtrip": q_blocks_parquet_roundtrip,
}


# ------------------------------------------------------------------- oracle
def _n(src: str, col: str) -> str:
    return f"(SELECT max({col}) + 1 FROM ({src}))"


def _h(n_sql: str, levels: int, lvl: int) -> str:
    f = 1 << levels
    return f"(({n_sql} + {f - 1}) // {f} * {f} // {1 << lvl})"


def _text_sql(order: str) -> str:
    return f"string_agg(CAST(v AS VARCHAR), ',' ORDER BY {order})"


def _oracle() -> dict[str, str]:
    E, SP, UE = sq.E, sq.SP, sq.UE
    ET = sq.t(E)
    FM = sq.formula(E, SEED)
    ne, me = _n(E, "i"), _n(E, "j")
    o: dict[str, str] = {}
    o["rows_to_cells"] = E
    o["cells_to_rows"] = f"SELECT i, {_text_sql('j')} AS row_text, count(*) AS n FROM ({E}) GROUP BY i"
    o["cells_to_rows_dense"] = (
        f"SELECT u.i AS i, string_agg(CAST(coalesce(x.v, 0) AS VARCHAR), ',' ORDER BY t.j) AS row_text "
        f"FROM (SELECT DISTINCT i FROM ({UE})) u CROSS JOIN "
        f"(SELECT CAST(range AS BIGINT) AS j FROM range(0, {_n(UE, 'j')})) t "
        f"LEFT JOIN ({UE}) x ON x.i = u.i AND x.j = t.j GROUP BY u.i")
    o["cells_to_blocks"] = (
        f"SELECT bi, bj, CAST(least(16, {ne} - bi * 16) AS INTEGER) AS nr, "
        f"CAST(least(16, {me} - bj * 16) AS INTEGER) AS nc, {_text_sql('i, j')} AS blk_text "
        f"FROM (SELECT i // 16 AS bi, j // 16 AS bj, i, j, v FROM ({E})) GROUP BY bi, bj")
    o["blocks_roundtrip"] = sq.nonzero(SP)
    o["matrix_dims"] = " UNION ALL ".join(
        f"SELECT '{nm}' AS matrix, CAST(max(i) + 1 AS BIGINT) AS nrows, CAST(max(j) + 1 AS BIGINT) AS ncols, "
        f"count(*) AS nnz FROM ({src})" for nm, src in (("E", E), ("SP", SP), ("UE", UE)))
    o["slice_assemble"] = E
    o["rows_slice_hstack"] = f"SELECT i, {_text_sql('j')} AS row_text FROM ({E}) GROUP BY i"
    o["block_split"] = sq.quadrants(E, _h(ne, 1, 1), _h(me, 1, 1), "A")
    o["strassen_replicate"] = sq.replicate(sq.with_path(E), "A", _h(ne, 1, 1), _h(me, 1, 1))
    hr, hk, hc = _h(me, 1, 1), _h(ne, 1, 1), _h(me, 1, 1)
    rep = ("SELECT '{s}' AS side, path, sgn, i, j, v, matrix_name FROM ({x})")
    o["union_tagged"] = (rep.format(s="A", x=sq.replicate(sq.with_path(ET), "A", hr, hk)) + " UNION ALL "
                         + rep.format(s="B", x=sq.replicate(sq.with_path(E), "B", hk, hc)))
    left1 = sq.divide(sq.with_path(ET), "A", hr, hk)
    right1 = sq.divide(sq.with_path(E), "B", hk, hc)
    o["strassen_operands_left"] = left1
    o["strassen_operands_right"] = right1
    l2 = sq.divide(sq.divide(sq.with_path(ET), "A", _h(me, 2, 1), _h(ne, 2, 1)), "A", _h(me, 2, 2), _h(ne, 2, 2))
    o["path_codes"] = (f"SELECT path, CAST((path - 1) % 7 + 1 AS INTEGER) AS m, CAST((path - 1) // 7 AS BIGINT) AS parent, "
                       f"count(*) AS cells, CAST(sum(v) AS BIGINT) AS total FROM ({l2}) GROUP BY path")
    prods = sq.leaf(left1, right1)
    o["strassen_products"] = prods
    o["strassen_combine"] = sq.combine(prods, hr, hc, by_quadrant=True)
    o["matrix_add"] = sq.signed_sum([(E, 1), (FM, 1)])
    o["matrix_subtract"] = sq.signed_sum([(E, 1), (FM, -1)])
    o["transpose"] = sq.t(SP)
    o["matrix_diff"] = (
        f"SELECT count(*) AS cells, count(CASE WHEN abs(coalesce(x.v, 0) - coalesce(y.v, 0)) > 0 THEN 1 END) AS differing, "
        f"coalesce(max(abs(coalesce(x.v, 0) - coalesce(y.v, 0))), 0) AS max_abs_diff "
        f"FROM ({E}) x FULL OUTER JOIN ({FM}) y ON x.i = y.i AND x.j = y.j")
    o["matmul_join"] = sq.product(SP, sq.t(SP))
    o["matmul_abt"] = sq.product(E, ET)
    o["matmul_broadcast"] = sq.product(sq.t(UE), UE)
    o["matmul_block"] = sq.product(E, ET)
    for lv in (1, 2, 3):
        o[f"matmul_strassen_l{lv}"] = sq.product(ET, E)
    o["matmul_strassen_checkpointed"] = sq.product(ET, E)
    o["blocks_parquet_roundtrip"] = sq.nonzero(E)
    o["matmul_strassen_rect"] = sq.product(sq.t(UE), UE)
    o["matmul_strassen_sparse"] = sq.product(SP, sq.t(SP))
    o["matmul_strassen_block"] = sq.product(ET, E)
    o["matmul_identity"] = sq.nonzero(E)
    o["matmul_auto"] = sq.product(SP, sq.t(SP))
    o["matmul_sparse_tiles"] = sq.product(SP, sq.t(SP))
    o["matmul_panels"] = sq.product(SP, sq.t(SP))
    o["product_check"] = (f"SELECT CAST(range AS INTEGER) AS round, (SELECT count(DISTINCT i) FROM ({sq.product(SP, sq.t(SP))})) AS n_rows, "
                          "CAST(0 AS BIGINT) AS n_wrong FROM range(0, 3)")
    by_year = ("SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS i, l_partkey AS j, CAST(sum(l_quantity) AS BIGINT) AS v "
               "FROM lineitem GROUP BY 1, 2, 3")
    o["matmul_batch"] = (f"SELECT a.year AS year, a.i AS i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v "
                         f"FROM ({by_year}) a JOIN ({by_year}) b ON a.year = b.year AND a.j = b.j GROUP BY 1, 2, 3 HAVING sum(a.v * b.v) <> 0")
    ns = "SELECT CAST(s_nationkey AS BIGINT) AS i, CAST(s_suppkey AS BIGINT) AS j, CAST(1 AS BIGINT) AS v FROM supplier"
    o["output_size"] = " UNION ALL ".join(f"SELECT '{name}' AS product, count(*) AS n_cells, CAST(0 AS BIGINT) AS n_off FROM ({c})"
                                          for name, c in (("SP*SPt", sq.product(SP, sq.t(SP))), ("NS*SP", sq.product(ns, SP))))
    o["sum_repeatable"] = ("SELECT l_suppkey AS i, l_partkey AS j, round(fsum(l_extendedprice * (1 - l_discount)), 6) AS v FROM lineitem "
                           "GROUP BY 1, 2 HAVING fsum(l_extendedprice * (1 - l_discount)) <> 0")
    ed = ("SELECT CAST(vec_id AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(x AS DOUBLE) AS v "
          "FROM (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(embedding) AS x FROM embeddings)")
    o["matmul_repeatable"] = (f"SELECT a.j AS i, b.j AS j, round(fsum(a.v * b.v), 6) AS v FROM ({ed}) a JOIN ({ed}) b ON a.i = b.i "
                              "GROUP BY 1, 2 HAVING fsum(a.v * b.v) <> 0")
    o["csv_roundtrip"] = E
    o["generate_uniform"] = (f"SELECT i, j, CAST(('0x' || substr(md5(concat_ws(',', i, j, {SEED})), 1, 13)) AS BIGINT) * pow(2.0, -52) AS v "
                             f"FROM ({E})")
    o["generate_formula"] = FM
    o["generate_binary"] = sq.formula(E, SEED, 2)
    o["parquet_roundtrip"] = " UNION ALL ".join(
        f"SELECT {w} AS which, i, j, v FROM ({src}) WHERE v <> 0" for w, src in ((1, E), (2, SP), (3, UE)))
    five = (f"SELECT e.j AS i, t.j AS j FROM (SELECT DISTINCT j FROM ({E})) e CROSS JOIN "
            "(SELECT CAST(range AS BIGINT) AS j FROM range(0, 5)) t")
    o["matmul_rows_broadcast"] = sq.product(E, sq.formula(five, SEED))
    big = E.replace("* 10000)", "* 100000000)")
    o["matmul_auto_exact"] = sq.product(sq.t(big), big)
    o["matmul_block_chunked"] = sq.product(ET, E)
    return o


ORACLE = _oracle()
