"""Exact removal of repeated byte strings by a distributed difference-cover search.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else,
in the same document or another, is removed. Equal strings are found among all
suffixes, told apart by their first ``LENGTH`` bytes, without sorting those that a
shorter look proves unique or equal:

* Cover. Each start belongs to the sample position at the least hash of ``k`` bytes
  inside its string (the leftmost of equals). As in a difference cover, two equal
  strings reach a sample at the same offset, so they meet at samples of one name.
  The starts of one sample form a run, a few dozen starts long.
* Sort and name. Runs are shuffled and sorted by (sample name, run content). Runs of
  equal content are equal at every start; a name with one run holds no repeat. What
  is left, names with runs that differ, is cut out and goes on.
* Recursion. A name of more than ``LOCAL`` such runs is sampled anew with longer
  strings (``ROUNDS``), which splits what the round before could not tell, down to
  single starts.
* Merge. All starts of the other names, which one task holds, are named by a
  difference cover of period 3 over letters of 25 bytes: the suffix at letter 1 by its
  triples (letters 1-3, 4-6, 7), their names named again, the suffix at letter 0 by
  (letter, name of the suffix at letter 1). Sorted by these, equal strings are
  adjacent, and adjacent names are compared.

Names are 64-bit hashes, not ranks, so naming needs no shuffle of its own; strings
are taken as equal when all their names (128 bits) agree. Equal runs collapse in the
task that sees them, before each shuffle, so a passage that a third of all documents
hold sends a few rows a task. No group is held whole.

A row is known by its id and text; rows that repeat both count as different places.
Null texts are empty. Bytes kept need not be whole characters: they are returned as
binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import _BYTE, _MULT, _power_tables, materialize, mix64, small_slices

LENGTH = 200
ROUNDS = (64, 150, 185)
#: Letters of the last round's names, as byte offsets: letter 0, then triples 1-3, 4-6 and 7.
TRIPLES = (0, 25, 100, 175, 200)
_POSITION = np.uint64((1 << 20) - 1)
#: Starts of a text that are sampled at a time, and rows that a task collapses before it sends them.
SEGMENT, HELD = 1 << 19, 1 << 18
#: Runs of a name, and starts, that are merged at a time in the task that holds them; names of more runs recurse.
LOCAL, STARTS = 4096, 300_000
MAX_BROADCAST = 1 << 21
COLUMNS = ("key", "ctx", "doc", "a", "e", "n", "content", "done")
SCHEMA = "key bigint, ctx bigint, doc bigint, a bigint, e bigint, n int, content binary, done boolean"


class Hashed:
    """A byte string with prefix sums, from which the hash of any stretch is read."""

    def __init__(self, raw: bytes):
        b = np.frombuffer(raw, dtype=np.uint8)
        self.up, down = _power_tables(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[b] * down[:len(b)], out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))


def runs(raw: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sample name, content name, first start, end of starts) of the runs of a text's starts under samples of k bytes."""
    out = []
    for lo in range(0, len(raw) - LENGTH + 1, SEGMENT):
        out.append(_segment(raw[lo:lo + SEGMENT + LENGTH - 1], k, lo))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int64),) * 2


def _segment(raw: bytes, k: int, lo: int):
    text = Hashed(raw)
    n, w = len(raw), LENGTH - k + 1
    at = np.arange(n - k + 1)
    name = text.stretch(at, at + k)
    # ties between equal names go to the leftmost: the position stands in the low bits
    order = (name & ~_POSITION) | at.astype(np.uint64)
    m = n - LENGTH + 1
    blocks = np.concatenate((order, np.full(-len(order) % w, ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:m], ahead[w - 1:w - 1 + m])
    a = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    e = np.concatenate((a[1:], [m]))
    sample = (least[a] & _POSITION).astype(np.int64)
    # the sample's place in the run is part of its name: equal strings sample at equal offsets
    ctx = mix64(text.stretch(a, e - 1 + LENGTH) + (sample - a).astype(np.uint64))
    return name[sample].view(np.int64), ctx.view(np.int64), a + lo, e + lo


def names_at(text: Hashed, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each start: the name of letter 0, and of the suffix at letter 1, named by the names of its triples."""
    letter, *triples = (text.stretch(at + x, at + y) for x, y in zip(TRIPLES, TRIPLES[1:]))
    suffix = np.zeros(len(at), dtype=np.uint64)
    for t in triples:
        suffix = mix64(suffix * np.uint64(_MULT) + t)
    return letter.view(np.int64), suffix.view(np.int64)


def _merged(content: list[bytes], doc: np.ndarray, a: np.ndarray, n: np.ndarray):
    """Sort all starts of some runs by name and compare adjacent ones; (doc, a, e) of those that repeat, in adjoining stretches."""
    size = np.array([len(x) for x in content])
    width, begin = size - LENGTH + 1, np.cumsum(size) - size
    step = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    letter, suffix = names_at(Hashed(b"".join(content)), np.repeat(begin, width) + step)
    order = np.lexsort((suffix, letter))
    letter, suffix = letter[order], suffix[order]
    first = np.flatnonzero(np.concatenate(([True], (letter[1:] != letter[:-1]) | (suffix[1:] != suffix[:-1]))))
    own = np.repeat(n, width)[order]
    total = np.add.reduceat(own, first)
    again = (np.repeat(total, np.diff(np.append(first, len(letter)))) >= 2) & (own == 1)
    start = (np.repeat(a, width) + step)[order][again]
    return _joined(np.repeat(doc, width)[order][again], start, start + 1)


def _collapsed(key, ctx, doc, a, e, n, content) -> pa.RecordBatch:
    """Rows for the next shuffle: one of each class, and as done those that a class of two or more settles."""
    order = np.lexsort((ctx, key))
    key, ctx, doc, a, e, n = (x[order] for x in (key, ctx, doc, a, e, n))
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]))))
    total = np.add.reduceat(n, first)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    settled = np.flatnonzero((total[of] >= 2) & (n == 1))
    d, x, y = _joined(doc[settled], a[settled], e[settled])
    zeros = np.zeros(len(d), dtype=np.int64)
    cat = lambda p, q, t: pa.array(np.concatenate((p, q)), t)
    data = [content[i] for i in order[first]] if content is not None else [None] * len(first)
    return pa.RecordBatch.from_arrays(
        [cat(key[first], zeros, pa.int64()), cat(ctx[first], zeros, pa.int64()), cat(doc[first], d, pa.int64()), cat(a[first], x, pa.int64()),
         cat(e[first], y, pa.int64()), cat(np.minimum(total, 2), zeros, pa.int32()), pa.array(data + [None] * len(d), pa.binary()),
         pa.array([False] * len(first) + [True] * len(d), pa.bool_())], names=list(COLUMNS))


def _joined(doc, a, e):
    """Adjoining runs of a document put together."""
    order = np.lexsort((a, doc))
    doc, a, e = doc[order], a[order], e[order]
    if not len(doc):
        return doc, a, e
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (a[1:] != e[:-1]))))
    return doc[first], a[first], np.append(e[first[1:] - 1], e[-1])


class Sender:
    """Gathers rows of a task and gives them out collapsed."""

    def __init__(self, limit: int):
        self.limit = limit
        self.parts, self.content, self.size, self.bytes = [], [], 0, 0

    def add(self, key, ctx, doc: int, a, e, n: int, content: list[bytes] | None):
        self.parts.append((key, ctx, np.full(len(key), doc, dtype=np.int64), a, e, np.full(len(key), n, dtype=np.int64)))
        self.content.extend(content if content is not None else [])
        self.size += len(key)
        self.bytes += sum(map(len, content)) if content is not None else 0

    def add_each(self, key, ctx, doc: int, a, e, n, content: list[bytes]):
        self.add(key, ctx, doc, a, e, 1, content)
        self.parts[-1] = (*self.parts[-1][:5], n)

    def full(self) -> bool:
        return self.size > self.limit or self.bytes > 32 << 20

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            cols = [np.concatenate(c) for c in zip(*self.parts)]
            whole = _collapsed(*cols, self.content if len(self.content) == self.size else None)
            for at in range(0, whole.num_rows, 1 << 15):
                yield whole.slice(at, 1 << 15)
        self.__init__(self.limit)


def _raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def first_round(docs: DataFrame) -> DataFrame:
    limit = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(limit)
        for whole in batches:
            for b in small_slices(whole, 4 << 20):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if len(raw := _raw(text)) >= LENGTH:
                        key, ctx, a, e = runs(raw, ROUNDS[0])
                        out.add(key, ctx, doc, a, e, 1, None)
                if out.full():
                    yield from out.flush()
        yield from out.flush()

    return docs.mapInArrow(run, SCHEMA)


def _cut(out: Sender, raw: bytes, doc: int, a: int, n: int, k: int) -> None:
    """Send the starts of a stretch as runs under samples of k bytes, or one by one if k is 0."""
    if k:
        key, ctx, x, y = runs(raw, k)
        out.add(key, ctx, doc, x + a, y + a, n, [raw[i:j + LENGTH - 1] for i, j in zip(x.tolist(), y.tolist())])
    else:
        key, ctx = names_at(Hashed(raw), np.arange(len(raw) - LENGTH + 1))
        x = np.arange(len(key)) + a
        out.add(key, ctx, doc, x, x + 1, n, None)


def _parts(go: np.ndarray, of_name: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of whole names, a bounded number of starts together."""
    if len(go):
        part = np.cumsum(size[go] - LENGTH + 1) // STARTS
        first = np.flatnonzero(np.diff(of_name[go], prepend=-1))
        part = np.repeat(part[first], np.diff(np.append(first, len(go))))
        yield from np.split(go, np.flatnonzero(np.diff(part)) + 1)


def compare(rows: DataFrame, next_k: int | None) -> DataFrame:
    """Sort runs by name and content and compare adjacent ones. next_k: None returns what differs as it is; 0 or more cuts it anew."""
    limit, local = HELD, LOCAL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, more = Sender(limit), None, False  # more: the held name has had another run before

        def settle(cols, content, before: bool, after: bool):
            """cols of whole classes; before, after: the first or last name goes on outside them."""
            key, ctx, doc, a, e, n = cols
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]))))
            total = np.add.reduceat(n, first)
            name = np.flatnonzero(np.concatenate(([True], key[first][1:] != key[first][:-1])))
            of_name = np.repeat(np.arange(len(name)), np.diff(np.append(name, len(first))))
            several = np.diff(np.append(name, len(first))) > 1
            several &= np.logical_or.reduceat(total < 2, name)
            several[0] |= before
            several[-1] |= after
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            done = np.flatnonzero((total[of] >= 2) & (n == 1))
            d, x, y = _joined(doc[done], a[done], e[done])
            go = np.flatnonzero(several[of_name])
            if next_k is not None:
                wide = np.diff(np.append(name, len(first))) > local
                wide[0] |= before
                wide[-1] |= after
                far = wide[of_name[go]]
                for c in go[far]:
                    i = first[c]
                    _cut(out, content[i], int(doc[i]), int(a[i]), int(min(total[c], 2)), next_k)
                for part in _parts(go[~far], of_name, np.array([len(content[i]) for i in first])):
                    i = first[part]
                    more = _merged([content[j] for j in i], doc[i], a[i], np.minimum(total[part], 2))
                    d, x, y = (np.concatenate(z) for z in zip((d, x, y), more))
                go = go[:0]
            i = first[go]
            cat = lambda p, q, t: pa.array(np.concatenate((p, q)), t)
            zeros, none = np.zeros(len(d), dtype=np.int64), [None] * (len(i) + len(d))
            yield pa.RecordBatch.from_arrays(
                [cat(key[i], zeros, pa.int64()), cat(ctx[i], zeros, pa.int64()), cat(doc[i], d, pa.int64()), cat(a[i], x, pa.int64()), cat(e[i], y, pa.int64()),
                 cat(np.minimum(total[go], 2), zeros, pa.int32()), pa.array(none, pa.binary()), pa.array([False] * len(i) + [True] * len(d), pa.bool_())], names=list(COLUMNS))

        for b in batches:
            done = b.column(7).to_numpy(zero_copy_only=False)
            if done.any():
                yield b.filter(pa.array(done))
                b = b.filter(pa.array(~done))
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(6)]
            content = b.column(6).to_pylist()
            if held is not None:
                cols, content = [np.concatenate(c) for c in zip(held[0], cols)], held[1] + content
            key, ctx = cols[0], cols[1]
            cut = int(np.searchsorted(key, key[-1]))  # the last name may go on
            if len(key) - cut > limit:  # a name of many runs: all but its last run can be settled
                cut = max(cut, int(np.flatnonzero(ctx != ctx[-1])[-1]) + 1 if (ctx[cut:] != ctx[-1]).any() else cut)
            after = 0 < cut and key[cut - 1] == key[-1]
            if cut:
                yield from settle([c[:cut] for c in cols], content[:cut], more, after)
                more = bool(after)
            held = ([c[cut:] for c in cols], content[cut:])
            if out.full():
                yield from out.flush()
        if held is not None and len(held[0][0]):
            yield from settle(*held, more, False)
        yield from out.flush()

    to = F.when(F.col("done"), F.xxhash64("doc", "a")).otherwise(F.col("key"))
    sorted_rows = rows.withColumn("to", to).repartition("to").drop("to").sortWithinPartitions("done", "key", "ctx")
    return sorted_rows.mapInArrow(run, SCHEMA)


def _small(df: DataFrame, entries: int) -> DataFrame:
    return F.broadcast(df) if entries <= MAX_BROADCAST else df


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, a, e): starts a to e - 1 of repeated strings, from (doc, text) rows."""
    first = materialize(compare(first_round(docs), None), "runs")
    open_runs = first.where("NOT done")
    asked = open_runs.groupBy("doc").agg(F.collect_list(F.struct("key", "ctx", "a", "e", "n")).alias("asked"))
    texts = docs.join(_small(asked, open_runs.count()), "doc").select("doc", "text", "asked")
    limit = HELD

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(limit)
        for whole in batches:
            for b in small_slices(whole, 4 << 20):
                for doc, text, asked in zip(*(c.to_pylist() for c in b.columns)):
                    raw = _raw(text)
                    col = lambda c: np.array([x[c] for x in asked], dtype=np.int64)  # noqa: B023, E731
                    out.add_each(col("key"), col("ctx"), doc, col("a"), col("e"), col("n"), [raw[x["a"]:x["e"] + LENGTH - 1] for x in asked])
                if out.full():
                    yield from out.flush()
        yield from out.flush()

    rows = texts.mapInArrow(cut_out, SCHEMA)
    for k in (*ROUNDS[1:], 0):
        rows = compare(rows, k)
    found = compare(rows, None).where("done")
    return first.where("done").select("doc", "a", "e").unionByName(found.select("doc", "a", "e"))


def remove(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept (binary) of every row."""
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = repeated(src.select("doc", "text")).groupBy("doc").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
    found = materialize(found, "spans")
    joined = src.join(found, "doc", "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_slices(whole, 4 << 20):
                rows = [_without(_raw(t), s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
                                                 names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = joined.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", id_col)


def _without(raw: bytes, spans) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs and what is left."""
    kept, end, removed, runs_ = [], 0, 0, 0
    for a, e in sorted((s["a"], s["e"] + LENGTH - 1) for s in spans or ()):
        if a > end or not runs_:
            kept.append(raw[end:a])
            runs_ += 1
            removed += e - a
            end = e
        elif e > end:
            removed += e - end
            end = e
    kept.append(raw[end:])
    return len(raw), removed, runs_, b"".join(kept)
