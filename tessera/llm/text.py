"""Helpers shared by the text operators: words, shingle hashes, Arrow batches, folders.

Words are the runs ``[^\\x20\\x09-\\x0D]+``; on UTF-8 bytes that is exactly what
``bytes.split()`` yields, and ``bytes.lower()`` lower-cases A-Z alone.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_dir

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
SHINGLE_WORDS = 5
MAX_BATCH_BYTES = 16 << 20
BATCH_BYTES = 4 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, so that order and low bits of a hash are uniform."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed=seed) for i in range(256)], dtype=np.uint64)


_BYTE = _table(1)
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
#: Texts are hashed in blocks of about this many bytes, cut at white space.
HASH_BLOCK = 1 << 20


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULT, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _hash_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, dtype=np.uint8)
    up, down = _power_tables(len(b) + 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[b], [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * down[:len(b)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64)), start, end


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of UTF-8 bytes, in order: a 64-bit hash (a polynomial over byte codes, read off prefix sums), start and end."""
    if len(raw) <= HASH_BLOCK:
        return _hash_block(raw)
    parts, at = [], 0
    while at < len(raw):
        cut = at + HASH_BLOCK
        while cut < len(raw) and not _BLANK[raw[cut]]:
            cut += 1
        h, start, end = _hash_block(raw[at:cut])
        parts.append((h, start + at, end + at))
        at = cut
    return tuple(np.concatenate(x) for x in zip(*parts))


def word_hashes(raw: bytes) -> np.ndarray:
    return word_spans(raw)[0]


def shingle_hashes(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash per n-word shingle in text order; fewer words make one shingle of all; none make none."""
    k = min(n, len(words))
    if k == 0:
        return np.empty(0, dtype=np.uint64)
    count = len(words) - k + 1
    acc = np.full(count, k, dtype=np.uint64)
    for d in range(k):
        acc = acc * np.uint64(_MULT) + words[d:d + count]
    return mix64(acc)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def shingle_set(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z in lower case."""
    return distinct(shingle_hashes(word_hashes(lower_bytes(text)), n))


def lower_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def small_slices(batch: pa.RecordBatch, limit: int = MAX_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch, each a few rows, so that Python objects of few rows are alive at once."""
    if batch.num_rows == 0:
        return
    step = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
    give_back()


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """From now on whole documents move in small batches: at most ``limit`` bytes (or one row) to a Python worker at once, and 512 rows from Parquet."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
