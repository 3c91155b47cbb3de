"""Substring dedup by content-defined chunks.

A text's UTF-8 bytes are cut where a gear rolling hash of the last 16 bytes has its
top ``MASK_BITS`` bits zero (moved on to the next character start), at least
``MIN_CHUNK`` and at most about ``MAX_CHUNK`` bytes apart. Cuts depend on what stands
before them alone, so an insertion changes the chunks around it and no others.
Chunks are told apart by 128-bit digest. Of equal chunks the one with the least
(id, row hash, place) stays; the others are repeats, in whatever document. A run of
successive repeats of at least ``min_run`` bytes is removed; shorter ones stay, so
that chance repeats of a few words leave a text alone.

One shuffle by digest finds the repeats. Each task first keeps only the least of
equal chunks that it sees (for a bounded number of chunks at a time), so a chunk
that a third of all documents hold sends a row a task; what it found to repeat is
spread by document.

A row is known by its id and text: repeated rows are one document, each row treated
alike. Null texts are kept as null and hold no chunk. Null ids come before others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import materialize, small_slices

MASK_BITS, MIN_CHUNK, MAX_CHUNK = 5, 16, 512
MIN_RUN = 100
#: Chunks that a task compares before it sends them.
HELD = 400_000
_GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed=9) & 0xFFFF for i in range(256)], dtype=np.uint16)
_TOP = np.uint16((0xFFFF << (16 - MASK_BITS)) & 0xFFFF)


def cuts_of(raw: bytes) -> list[int]:
    """Ends of the chunks of a text, the last one its length."""
    if not raw:
        return []
    b = np.frombuffer(raw, dtype=np.uint8)
    h = _GEAR[b]
    for k in (1, 2, 4, 8):  # after each step a sum over twice as many bytes, older ones shifted further
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint16(k)
        h = h + shifted
    out, last = [], 0
    size = len(raw)
    for p in (np.flatnonzero((h & _TOP) == 0) + 1).tolist() + [size]:
        while p - last > MAX_CHUNK:
            last = _char_start(raw, last + MAX_CHUNK, size)
            out.append(last)
        if p - last >= MIN_CHUNK:
            p = _char_start(raw, p, size)
            if p > last:
                out.append(p)
                last = p
    if not out or out[-1] < size:
        out.append(size)
    return out


def _char_start(raw: bytes, p: int, size: int) -> int:
    while p < size and raw[p] & 0xC0 == 0x80:
        p += 1
    return p


def _raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _chunks(rows: DataFrame) -> DataFrame:
    """(hi, lo, doc, key, place, repeat) of chunks: the least of equal ones in a task, and those it found to repeat."""
    limit = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        repeats: list[tuple] = []

        def flush():
            digests = np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 2) if held else np.empty((0, 2), dtype=np.int64)
            rows = [*held.values(), *repeats]
            none = len(repeats)
            cols = list(zip(*rows)) or [[], [], []]
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((digests[:, 0], np.zeros(none, dtype=np.int64)))), pa.array(np.concatenate((digests[:, 1], np.zeros(none, dtype=np.int64)))),
                 *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))), pa.array([False] * len(held) + [True] * none, pa.bool_())],
                names=["hi", "lo", "doc", "key", "place", "repeat"])
            held.clear()
            repeats.clear()
            return out

        for whole in batches:
            for b in small_slices(whole, 2 << 20):
                for doc, key, text in zip(*(c.to_pylist() for c in b.columns)):
                    raw, at = _raw(text), 0
                    for place, end in enumerate(cuts_of(raw)):
                        digest = xxhash.xxh3_128_digest(raw[at:end])
                        at = end
                        mine = (doc, key, place)
                        if (other := held.setdefault(digest, mine)) is not mine and other != mine:
                            if mine < other:
                                held[digest], mine = mine, other
                            repeats.append(mine)
                if len(held) + len(repeats) > limit:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "hi bigint, lo bigint, doc bigint, key bigint, place int, repeat boolean")


def _repeats(chunks: DataFrame) -> DataFrame:
    """(key, place) of every chunk that isn't the least of its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # digest of the row before, and its place
        for b in batches:
            if not b.num_rows:
                continue
            hi, lo, doc, key, place = (b.column(i).to_numpy() for i in range(5))
            known = b.column(5).to_numpy(zero_copy_only=False)
            eq = lambda c, i: np.concatenate(([last is not None and last[i] == c[0]], c[1:] == c[:-1]))
            same = eq(hi, 0) & eq(lo, 1)
            twice = same & eq(doc, 2) & eq(key, 3) & eq(place, 4)  # of a repeated row
            last = (hi[-1], lo[-1], doc[-1], key[-1], place[-1])
            # a row after the least one of its kind, unless it is that one again
            use = known | (same & ~twice)
            yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(place[use])], names=["key", "place"])

    spread = F.when(F.col("repeat"), F.xxhash64("key")).otherwise(F.xxhash64("hi", "lo"))
    rows = chunks.withColumn("to", spread).repartition("to").drop("to").sortWithinPartitions("repeat", "hi", "lo", "doc", "key", "place")
    return rows.mapInArrow(run, "key bigint, place int")


def remove(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_run: int = MIN_RUN, stats: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, the text without removed runs; with ``stats`` also n_bytes, n_chunks, n_repeats and n_removed."""
    doc = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63)))
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(doc.alias("doc"), key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    found = _repeats(_chunks(rows)).groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places"))
    found = materialize(found, "repeats")

    names = [f"k{i}" for i in range(len(docs.columns))]
    keyed = docs.toDF(*names).withColumn("key", F.xxhash64(F.col(names[docs.columns.index(id_col)]), F.col(names[docs.columns.index(text_col)]).cast("string")))
    joined = keyed.join(found, "key", "left").select(*names, "places")
    at = docs.columns.index(text_col)
    spec = ", ".join(f"{k} {'string' if i == at else f.dataType.simpleString()}" for i, (k, f) in enumerate(zip(names, docs.schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_slices(whole):
                out = [[] for _ in range(5)]
                for text, places in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                    for col, x in zip(out, _without(text, places or (), min_run)):
                        col.append(x)
                cols = [*b.columns[:len(names)]]
                cols[at] = pa.array(out[0], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, pa.int64()) for c in out[1:])], names=[*names, "s0", "s1", "s2", "s3"])

    done = joined.mapInArrow(run, f"{spec}, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    out = [F.col(k).cast(f.dataType).alias(f.name) for k, f in zip(names, docs.schema) if not (stats and f.name in ("n_bytes", "n_chunks", "n_repeats", "n_removed"))]
    return done.select(*out, *([F.col(f"s{i}").alias(x) for i, x in enumerate(("n_bytes", "n_chunks", "n_repeats", "n_removed"))] if stats else []))


def _without(text: str | None, places, min_run: int) -> tuple:
    """The text without long runs of repeats; its bytes, chunks, repeats and removed bytes."""
    raw = _raw(text)
    cuts = cuts_of(raw)
    if not places:
        return text, len(raw), len(cuts), 0, 0
    repeat, kept, removed = set(places), [], 0
    start, run = 0, 0  # where the running stretch began, and whether it is one of repeats
    edges = [0, *cuts]
    for i in range(len(cuts) + 1):
        now = i < len(cuts) and i in repeat
        if i == len(cuts) or now != run:
            stretch = raw[start:edges[i]]
            if run and len(stretch) >= min_run:
                removed += len(stretch)
            else:
                kept.append(stretch)
            start, run = edges[i], now
    return b"".join(kept).decode("utf-8", "surrogatepass"), len(raw), len(cuts), len(repeat), removed
