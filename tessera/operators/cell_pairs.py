"""Product of large sparse CELLS by pairs of packed groups: each cell is written once, no copies and no sums are.

Rows of A, and columns of B, are dealt into groups by a hash. Tasks that read cells pack them into
pieces, one array of bytes for each group, which one shuffle brings together. Every pair of groups
is then one task of a cartesian product (``shuffle_replicate_nl``), which reads both groups from
where they were written. It holds all pairs of its output cells, so no sums are shuffled either.
What is written grows with the cells of A and B alone, whatever the pairs or the output; what is read
grows with the cells times the groups of the other side. B is packed as its transpose, so that in
A * A^T with as many groups on both sides Spark reuses A's shuffle for B.

In a piece cells are in order of the inner index, which is held as steps; rows and values are held in
as few bytes as the piece's largest needs.

``plan_groups`` takes the groups from exact counts of 4,096 buckets of rows. A row so long that its group
would be too large for a task, or sums that may leave 64 bits, are left to the callers' other ways.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import INTEGERS
from tessera.operators.layout import BUCKETS, bucket_sizes

#: Cells of a group, of a piece, and pairs of groups at most.
GROUP_CELLS, PIECE_CELLS, MAX_TASKS = 3 << 20, 1 << 20, 1 << 17
#: Pairs that a kernel expands at once, and cells of a dense accumulator.
STEP, DENSE = 1 << 20, 1 << 21
#: A null row or column inside a group.
NULL = -(1 << 63)

_CODES = ("u1", "u2", "u4", "i8", "f8")


def _largest(sizes: np.ndarray, groups: int) -> int:
    return int(np.bincount(np.arange(BUCKETS) % groups, sizes, groups).max())


def _fewest(sizes: np.ndarray, most: int) -> int | None:
    """The fewest groups of at most ``most`` cells."""
    n = max(1, -(-int(sizes.sum()) // most))
    while n <= BUCKETS and _largest(sizes, n) > most:
        n += max(1, n // 16)
    return n if n <= BUCKETS else None


def plan_groups(a: np.ndarray, b: np.ndarray, tasks: int, most_a: int = GROUP_CELLS, most_b: int = GROUP_CELLS) -> tuple[int, int] | None:
    """Groups of A's rows and of B's columns from the cells in each bucket; None if one is too large for a task."""
    ga, gb = _fewest(a, most_a), _fewest(b, most_b)
    if ga is None or gb is None:
        return None
    left, right, rows, columns = int(a.sum()), int(b.sum()), np.count_nonzero(a), np.count_nonzero(b)
    while ga * gb < tasks and (ga < rows or gb < columns):  # by what adds the fewest reads
        if gb >= columns or (ga < rows and (right, ga) <= (left, gb)):
            ga += 1
        else:
            gb += 1
    if left == right and most_a == most_b:
        ga = gb = max(ga, gb)
    return (ga, gb) if ga * gb <= MAX_TASKS else None


def kind_of(a: DataFrame, b: DataFrame) -> str | None:
    """'bigint' or 'double', in which sums are made, as in the join; None for decimals."""
    kinds = {dict(x.dtypes)["v"] for x in (a, b)}
    return "bigint" if kinds <= set(INTEGERS) else "double" if kinds <= {*INTEGERS, "double", "float"} else None


def groups_for(a: DataFrame, b: DataFrame, tasks: int, row: Column | None = None, column: Column | None = None, **most) -> tuple[int, int] | None:
    """``plan_groups`` of CELLS (``row``, ``column``: what is dealt instead of A's i and B's j); None also where sums may leave 64 bits."""
    if (kind := kind_of(a, b)) is None:
        return None
    (na, total_a), (nb, total_b) = bucket_sizes((a, F.col("i") if row is None else row), (b, F.col("j") if column is None else column))
    if kind == "bigint" and total_a * total_b * (1 + 1e-6) >= 2.0 ** 63:
        return None
    return plan_groups(na, nb, tasks, **most)


# ------------------------------------------------------------------- packing
def _narrow(x: np.ndarray) -> tuple[int, int, bytes]:
    """Code, base, and the differences from the base in as few bytes as they need."""
    if x.dtype.kind == "f":
        return 4, 0, x.tobytes()
    lo, hi = int(x.min()), int(x.max())
    code = next((n for n, top in enumerate((1 << 8, 1 << 16, 1 << 32)) if hi - lo < top), 3)
    return (code, lo, (x - lo).astype(_CODES[code]).tobytes()) if code < 3 else (3, 0, x.tobytes())


def pack(o: np.ndarray, k: np.ndarray, v: np.ndarray) -> bytes:
    """Cells in order of k."""
    parts = [_narrow(o), _narrow(np.diff(k)) if len(k) > 1 else (0, 0, b""), _narrow(v)]
    head = np.array([len(k), int(k[0]), *(n for p in parts for n in p[:2])], dtype="i8")
    return head.tobytes() + b"".join(p[2] for p in parts)


def unpack(buffer, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    head = np.frombuffer(buffer, "i8", 8, at).tolist()
    n, first, at, out = head[0], head[1], at + 64, []
    for (code, base), size in zip(((head[2], head[3]), (head[4], head[5]), (head[6], head[7])), (n, n - 1, n)):
        x = np.frombuffer(buffer, _CODES[code], size, at)
        at += x.nbytes
        out.append(x if code == 4 else x.astype("i4") + np.int32(base) if code < 2 and abs(base) < 1 << 30 else x.astype("i8") + base)
    k = np.empty(n, dtype="i8")
    k[0] = first
    np.cumsum(out[1], out=k[1:])
    k[1:] += first
    return _short(out[0]), _short(k), _short(out[2])


def _short(x: np.ndarray) -> np.ndarray:
    """Integers of 32 bits where they fit."""
    return x.astype("i4") if x.dtype == np.int64 and -(1 << 31) <= x.min() and x.max() < 1 << 31 else x


def _pieces(batches):
    """g, o, k, v -> g, piece."""
    held, size = [], 0

    def flush():
        g, o, k, v = (np.concatenate([h[n] for h in held]) for n in range(4))
        order = np.lexsort((o, k, g))
        g, o, k, v = g[order], o[order], k[order], v[order]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        ends = np.r_[starts[1:], len(g)]
        return pa.RecordBatch.from_arrays([pa.array(g[starts]), pa.array([pack(o[x:y], k[x:y], v[x:y]) for x, y in zip(starts, ends)], pa.binary())], names=["g", "e"])

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(n).to_numpy(zero_copy_only=False) for n in range(4)])
            size += batch.num_rows
        if size >= PIECE_CELLS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _packed(x: DataFrame, outer: str, inner: str, by: Column, groups: int, kind: str, name: str) -> DataFrame:
    """One record a group, with its pieces. Cells without inner index or value add nothing."""
    dealt = F.pmod(F.pmod(F.xxhash64(by), F.lit(BUCKETS)), F.lit(groups)).cast("int")
    x = x.where(F.col(inner).isNotNull() & (F.col("v").isNotNull() if kind == "double" else F.col("v") != 0))  # 0 times infinity isn't 0
    x = x.select(dealt.alias("g"), F.coalesce(F.col(outer).cast("bigint"), F.lit(NULL)).alias("o"), F.col(inner).cast("bigint").alias("k"), F.col("v").cast(kind).alias("v"))
    return x.mapInArrow(_pieces, "g int, e binary").repartitionById(groups, "g").groupBy("g").agg(F.collect_list("e").alias(name)).select(name)


def _cells(lists: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """o, k, v of a group in order of k; cells that occur twice are in the same order in every run."""
    pieces = lists[row].values
    _, ends, data = pieces.buffers()
    ends = np.frombuffer(ends, "i4")[pieces.offset:pieces.offset + len(pieces)]
    o, k, v = (np.concatenate(x) for x in zip(*(unpack(data, int(at)) for at in ends)))
    if v.dtype.kind == "f":
        first = np.argsort(v, kind="stable")
        o, k, v = o[first], k[first], v[first]
    order = ordered(k)
    return o[order], k[order], v[order]


def ordered(x: np.ndarray) -> np.ndarray:
    """Stable order of integers, by their 16-bit halves where they lie close enough together."""
    if not len(x):
        return np.empty(0, dtype=np.int64)
    lo, hi = int(x.min()), int(x.max())
    if hi - lo >= 1 << 32:
        return np.argsort(x, kind="stable")
    y = np.subtract(x, lo, dtype=np.int64).astype(np.uint32)
    order = np.argsort(y.astype(np.uint16), kind="stable")
    return order if hi - lo < 1 << 16 else order[np.argsort((y >> 16).astype(np.uint16)[order], kind="stable")]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted integers, and where each starts (one more at the end)."""
    edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, dtype=np.int64)
    return x[edge], np.append(edge, len(x))


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and each value's place among them."""
    order = ordered(x)
    values, start = distinct(x[order])
    place = np.empty(len(x), dtype=np.int32)
    place[order] = np.repeat(np.arange(len(values), dtype=np.int32), np.diff(start))
    return values.astype(np.int64), place


def expand(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... as many as width[0], then start[1] ..."""
    return np.arange(int(width.sum())) + np.repeat(start - np.cumsum(width) + width, width)


# ------------------------------------------------------------------- product
def products(a: tuple, b: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells (i, j, v) of a product of two groups (o, k, v in order of k), some rows at a time; each cell once."""
    (ai, ak, av), (bj, bk, bv) = a, b
    del a, b
    wide = np.int64 if av.dtype.kind == bv.dtype.kind == "i" else np.float64
    inner, start = distinct(bk)
    columns, col = ranked(bj)
    del bj, bk
    at = np.minimum(np.searchsorted(inner, ak), len(inner) - 1).astype(np.int32)
    met = np.flatnonzero(inner[at] == ak)
    del ak
    if not len(met):
        return
    met = met[ordered(ai[met])]  # by row, then inner index
    ai, av, at = ai[met], av[met], at[met]
    del met
    width, begin = np.diff(start).astype(np.int32)[at], start.astype(np.int32)[at]
    del at
    rows, edge = distinct(ai)
    rows, work = rows.astype(np.int64), np.r_[0, np.cumsum(width, dtype=np.int64)][edge]  # pairs before each row
    del ai
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + STEP, side="right")) - 1)
        x, y = edge[lo], edge[hi]
        w = width[x:y]
        pick = expand(begin[x:y], w.astype(np.int64))
        row = np.repeat(np.arange(hi - lo), work[lo + 1:hi + 1] - work[lo:hi])
        key, val = row * len(columns) + col[pick], np.repeat(av[x:y].astype(wide), w) * bv[pick]
        cell, total = summed(key, val, (hi - lo) * len(columns))
        yield rows[lo + cell // len(columns)], columns[cell % len(columns)], total
        lo = hi


def summed(key: np.ndarray, val: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys below ``size`` whose values don't add up to 0, in order, and their sums."""
    if size <= DENSE or size <= 4 * len(key):
        total = np.zeros(size, dtype=val.dtype)
        np.add.at(total, key, val)
        cell = np.flatnonzero(total)
        return cell, total[cell]
    order = np.argsort(key, kind="stable")
    key, val = key[order], val[order]
    cell, start = distinct(key)
    total = np.add.reduceat(val, start[:-1])
    return cell[total != 0], total[total != 0]


def pair_cells(a: DataFrame, b: DataFrame, groups: tuple[int, int], kernel: Callable = products, row: Column | None = None, column: Column | None = None) -> DataFrame:
    """CELLS of ``kernel`` over all pairs of groups: C = A * B by default. Null rows of A and null columns of B are such in C, as in the join."""
    kind = kind_of(a, b)
    left = _packed(a, "i", "j", F.col("i") if row is None else row, groups[0], kind, "a")
    right = _packed(b, "j", "i", F.col("j") if column is None else column, groups[1], kind, "b")

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                for i, j, v in kernel(_cells(batch.column(0), n), _cells(batch.column(1), n)):
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v)], names=["i", "j", "v"])

    c = left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, f"i bigint, j bigint, v {kind}")
    return c.select(*(F.nullif(F.col(n), F.lit(NULL)).alias(n) for n in ("i", "j")), "v")
