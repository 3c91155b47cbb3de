"""Strassen's seven products as three small coefficient tables.

Quadrants are numbered ``q = 2*(row half) + (column half)``:
0 = X11, 1 = X12, 2 = X21, 3 = X22.

* ``U(q, m, sgn)`` -- left operand of product m is  sum_q sgn * A_q
* ``V(q, m, sgn)`` -- right operand of product m is sum_q sgn * B_q
* ``W(m, q, sgn)`` -- result quadrant C_q is        sum_m sgn * M_m

Each table has 12 rows, so broadcasting them is always safe.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Strassen (1969), the seven products and the four result
# quadrants, in natural order. These must stay exactly as written.
# ---------------------------------------------------------------------------
STRASSEN_PRODUCTS = [
    (1, "A11 + A22", "B11 + B22"),
    (2, "A21 + A22", "B11"),
    (3, "A11", "B12 - B22"),
    (4, "A22", "B21 - B11"),
    (5, "A11 + A12", "B22"),
    (6, "A21 - A11", "B11 + B12"),
    (7, "A12 - A22", "B21 + B22"),
]
STRASSEN_COMBINE = [
    ("C11", "M1 + M4 - M5 + M7"),
    ("C12", "M3 + M5"),
    ("C21", "M2 + M4"),
    ("C22", "M1 - M2 + M3 + M6"),
]
# ---------------------------------------------------------------------------

_TERM = re.compile(r"([+-]?)\s*([ABCM])(\d+)")


def _terms(expr: str) -> list[tuple[int, str]]:
    """'A21 - A11' -> [(+1, '21'), (-1, '11')]."""
    return [(-1 if s == "-" else 1, idx) for s, _, idx in _TERM.findall(expr)]


def _q(idx: str) -> int:
    r, c = int(idx[0]) - 1, int(idx[1]) - 1
    return 2 * r + c


def left_terms() -> list[tuple[int, int, int]]:
    """Rows (q, m, sgn) of U."""
    return [(_q(idx), m, s) for m, left, _ in STRASSEN_PRODUCTS for s, idx in _terms(left)]


def right_terms() -> list[tuple[int, int, int]]:
    """Rows (q, m, sgn) of V."""
    return [(_q(idx), m, s) for m, _, right in STRASSEN_PRODUCTS for s, idx in _terms(right)]


def combine_terms() -> list[tuple[int, int, int]]:
    """Rows (m, q, sgn) of W."""
    return [(int(idx), _q(c[1:]), s) for c, expr in STRASSEN_COMBINE for s, idx in _terms(expr)]


def sign_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U, V, W as 7 x 4 arrays: the sign of quadrant q in product m, 0 where it has none."""
    out = tuple(np.zeros((7, 4), dtype=np.int64) for _ in range(3))
    for t, terms in zip(out, (left_terms(), right_terms(), [(q, m, s) for m, q, s in combine_terms()])):
        for q, m, s in terms:
            t[m - 1, q] = s
    return out


def coefficient_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U, V, W as DataFrames (12 rows each)."""
    u = spark.createDataFrame(left_terms(), "q INT, m INT, sgn INT")
    v = spark.createDataFrame(right_terms(), "q INT, m INT, sgn INT")
    w = spark.createDataFrame(combine_terms(), "m INT, q INT, sgn INT")
    return u, v, w
