"""tessera: matrix algebra on Spark DataFrames.

Matrices are DataFrames in one of three layouts, all keyed by explicit
indices (never by row or arrival order):

* CELLS  ``(i BIGINT, j BIGINT, v T)``         -- the canonical, sparse form
* ROWS   ``(i BIGINT, row ARRAY<T>)``          -- the stored row table
* BLOCKS ``(bi, bj BIGINT, nr, nc INT, blk ARRAY<T>)`` -- dense row-major tiles

Operators return lazy DataFrames and pass no matrix through the driver. Some run small jobs while
they build a plan: sizes, value ranges and bounded counts, one aggregate row each.
"""

from tessera.session import get_session, shared_dir
from tessera.operators.layout import (
    rows_to_cells, cells_to_rows, cells_to_blocks, blocks_to_cells, matrix_dims,
)
from tessera.operators.algebra import (
    add, subtract, transpose, matrix_diff, union_tagged, drop_zeros, canonical,
)
from tessera.operators.products import matmul_join, matmul_broadcast
from tessera.operators.blocks import matmul_block
from tessera.operators.strassen import matmul_strassen
from tessera.operators.dispatch import matmul, matmul_abt

__all__ = [
    "get_session", "shared_dir",
    "rows_to_cells", "cells_to_rows", "cells_to_blocks", "blocks_to_cells", "matrix_dims",
    "add", "subtract", "transpose", "matrix_diff", "union_tagged", "drop_zeros", "canonical",
    "matmul_join", "matmul_abt", "matmul_broadcast", "matmul_block", "matmul_strassen",
    "matmul",
]
