"""Benchmark decontamination: which test items does a document contain?

A document contains an item when it holds at least ``threshold`` of the item's
distinct shingles (five words, A-Z in lower case; an item or document with fewer
words is one shingle). The search is a containment search on MinHash sketches:

* Items are partitioned by size (powers of two of their shingle count). An item of
  n shingles is sketched by its k = n - ceil(threshold * n) + 1 smallest hashes. A
  document that lacks all k of them lacks too many shingles to contain the item, so
  no item is missed, however long the document is.
* For each size partition the document's sketch is its own hashes up to the largest
  hash in the partition's sketches, the head of its sorted hashes. Documents with
  too few shingles for a partition skip it.
* A sketch hash in common makes a candidate; candidates are verified by counting
  the item's shingles in the document as strings.

Documents are read in one narrow pass; nothing of theirs is shuffled. The items'
index is broadcast in blocks of at most ``block_bytes`` of item text, found by a
count before; more items mean more blocks, each a pass over the documents.

Null or empty texts contain nothing and are contained in nothing. Repeated
documents and items are each reported. Ties can't arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.text import SHINGLE_WORDS, distinct, lower_bytes, shingle_hashes, shingle_set, small_slices, word_hashes

THRESHOLD = 80  # per cent
BLOCK_BYTES = 32 << 20


def shingle_strings(raw: bytes, n: int = SHINGLE_WORDS) -> set[bytes]:
    w = raw.split()
    return {b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


class ItemIndex:
    """Sketches of a block of items by size partition, and their shingles for the verification."""

    def __init__(self, items: list[tuple], threshold: int = THRESHOLD):
        self.ids, self.shingles, self.threshold = [], [], threshold
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            hashes = shingle_set(text)
            if n := len(hashes):
                by_size.setdefault(n.bit_length(), []).append((len(self.ids), hashes[:n - self.needed(n) + 1]))
                self.ids.append(item_id)
                self.shingles.append(shingle_strings(lower_bytes(text)))
        # of each partition: shingles a document must have, the sketches' largest hash, hashes and whose they are
        self.parts = []
        for sketches in by_size.values():
            hashes = np.concatenate([s for _, s in sketches])
            owner = np.repeat([i for i, _ in sketches], [len(s) for _, s in sketches])
            order = np.argsort(hashes, kind="stable")
            least = min(self.needed(len(self.shingles[i])) for i, _ in sketches)
            self.parts.append((least, hashes[order[-1]], hashes[order], owner[order]))

    def needed(self, n: int) -> int:
        """Shingles of an item of n that a document must hold."""
        return -(-self.threshold * n // 100)

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        """Items that share a sketch hash with a document's sorted distinct hashes."""
        found = []
        for least, top, hashes, owner in self.parts:
            if len(doc) < least:
                continue
            sketch = doc[:np.searchsorted(doc, top, "right")]
            lo, hi = np.searchsorted(hashes, sketch, "left"), np.searchsorted(hashes, sketch, "right")
            found += [owner[a:b] for a, b in zip(lo[hi > lo], hi[hi > lo])]
        return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)

    def search(self, text: str | None) -> list[tuple]:
        """(item, its shingles, those in the text) for each item that the text contains."""
        raw, out = lower_bytes(text), []
        own = None
        for i in self.candidates(distinct(shingle_hashes(word_hashes(raw)))) if raw else ():
            own = shingle_strings(raw) if own is None else own
            item = self.shingles[i]
            if (shared := len(item & own)) >= self.needed(len(item)):
                out.append((self.ids[i], len(item), shared))
        return out


def annotate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
             leaks_col: str = "leaks", threshold: int = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns and rows of ``docs`` and ``leaks_col``: structs of item_id, n_shingles, n_shared, an empty array if none."""
    spark = docs.sparkSession
    src = items.select(F.col(f"`{item_id_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    size = src.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = T.ArrayType(T.StructType([T.StructField("item_id", src.schema["item_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())]))
    out = docs.drop(leaks_col).withColumn(leaks_col, F.array().cast(kind))
    arrow, at = to_arrow_type(kind), len(out.columns) - 1
    pos = out.columns.index(text_col)
    for k in range(blocks):
        rows = src.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        index = spark.sparkContext.broadcast([(r.item_id, r.text) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            found = ItemIndex(index.value, threshold)
            for whole in batches:
                for b in small_slices(whole):
                    texts = b.column(pos).to_pylist()
                    new = [old + [dict(zip(("item_id", "n_shingles", "n_shared"), x)) for x in found.search(t)] for old, t in zip(b.column(at).to_pylist(), texts)]
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, arrow)], names=b.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """A row for each document and item it contains: id_col, item_id, n_shingles, n_shared, containment."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hits = annotate(narrow, items, **more).select("id", F.explode("leaks").alias("x"))
    return hits.select(F.col("id").alias(id_col), "x.item_id", "x.n_shingles", "x.n_shared", (F.col("x.n_shared") / F.col("x.n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, **more) -> DataFrame:
    """The documents that contain no item."""
    name = "leaks" + "_" * max(map(len, docs.columns))  # longer than any column
    return annotate(docs, items, leaks_col=name, **more).where(F.size(name) == 0).drop(name)
