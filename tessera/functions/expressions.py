"""Index arithmetic for quadrant splitting and the Strassen recursion path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quadrant(i, j, hr: int, hc: int) -> Column:
    """q = 2*(i >= hr) + (j >= hc), for indices below 2*hr / 2*hc."""
    return ((_c(i) >= hr).cast("int") * 2 + (_c(j) >= hc).cast("int")).cast("int")


def local_index(x, h: int) -> Column:
    """Index inside its half: x - h when x >= h."""
    x = _c(x)
    return F.when(x >= h, x - h).otherwise(x)


def quadrant_offset(q, h: int, axis: str) -> Column:
    """Global offset of quadrant q along 'row' or 'col'."""
    q = _c(q)
    half = F.floor(q / 2) if axis == "row" else F.pmod(q, F.lit(2))
    return (half * F.lit(h)).cast("bigint")


def quadrant_label(side, q) -> Column:
    """'A' and 2 -> 'A21'. ``side`` is a literal name or a Column."""
    q = _c(q)
    s = F.lit(side) if isinstance(side, str) else side
    return F.concat(s, (F.floor(q / 2) + 1).cast("string"), (F.pmod(q, F.lit(2)) + 1).cast("string"))


def product_label(side, q, m) -> Column:
    """'A11, M1'."""
    return F.concat(quadrant_label(side, q), F.lit(", M"), _c(m).cast("string"))


def child_path(path, m) -> Column:
    """Recursion path of product m below ``path``: path*7 + m (bijective base 7)."""
    return (_c(path) * 7 + _c(m)).cast("bigint")


def path_m(path) -> Column:
    """Product number (1..7) of a non-root path."""
    return (F.pmod(_c(path) - 1, F.lit(7)) + 1).cast("int")


def path_parent(path) -> Column:
    """Parent of a non-root path."""
    return F.floor((_c(path) - 1) / 7).cast("bigint")


def halve(x) -> Column:
    return F.floor(_c(x) / 2).cast("bigint")


def pow2(k) -> Column:
    """2**k as BIGINT, for a column k (the SQL ``shiftleft`` takes a column shift)."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _c(k).cast("int"))


def padded_size(n: int, levels: int) -> int:
    """Smallest multiple of 2**levels that is >= n (virtual zero padding)."""
    f = 1 << levels
    return -(-n // f) * f


def signed_array(arr, sgn) -> Column:
    """sgn * arr, element-wise."""
    s = _c(sgn)
    return F.transform(_c(arr), lambda x: x * s)
