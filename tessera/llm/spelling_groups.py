"""Spelling variant grouping with PartEnum signatures.

Words are counted over all texts; two words are near if one inserted, deleted or replaced code
point tells them apart. A word's form is its near word of largest count, where that is at least
``RATIO`` times its own; its root is where its forms end.

Signatures. A word is the binary vector of its letter multiset: one dimension for each letter
and each occurrence of it. An insertion or deletion flips one dimension, a replacement two, so
near words are within Hamming distance two. PartEnum partitions the dimensions by letter into
``PARTS`` = 3 and enumerates what is left when any two parts are taken out: one part of near
words agrees at least. Letters say nothing about order, and anagrams abound, so a signature is
joined with the word outside a window: the word is cut into windows, three or more, of four
letters or so (at most 16 of them), and the edit lies in one. Words of n letters are cut as n, and as n - 1 to meet
the words one shorter. The equi-join on (n, window, outside, part, the part's letters) is thus
exact: every near pair shares a key, and groups hold words that differ in a few letters alone,
so their size is bounded by the alphabet and not by the corpus.

Verification. Groups are sorted into tasks by key and read as a stream; pairs inside are compared
letter by letter, and a pair counts in the first window and part that it shares, so no pair is
emitted twice and none is shuffled: each word sends on its number of near words and the best
of them, combined by word. The rows don't depend on order or partitioning.

Form links are followed by pointer doubling, as counts grow tenfold a link a few rounds.

Nulls: null and empty texts hold no word; a null id is written as an empty one in the checksum
that decides on deletions. Repeated rows count as often as they come. Ties go to the smallest
word in code-point order. Texts without words, and empty tables, give an empty result. Other
columns of the input are not read. Words are of U+0041..U+00FF letters, so they travel as
Latin-1 bytes, whose order is code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import materialize, small_slices

MIN_LETTERS, MIN_COUNT, RATIO, NOISE = 7, 2, 10, 31
PARTS = 3
WINDOW, MAX_WINDOWS = 4, 16
_RUN = re.compile("[a-z\u00C0-\u00FF]{%d,}" % MIN_LETTERS)  # shorter runs give no word
_FLUSH = 200_000
#: Words up to this length are compared in a matrix; pairs with a longer one, one by one.
_WIDE = 64
_PAIRS = 1 << 18


def count_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word (Latin-1 bytes) and n of words of at least ``MIN_LETTERS`` that occur ``MIN_COUNT`` times or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": pa.array([w.encode("latin-1") for w in seen], pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for whole in batches:
            for b in small_slices(whole, 2 << 20):
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if not text:
                        continue
                    prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for w, k in Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                        h = zlib.crc32(w.encode(), prefix)
                        if h % NOISE == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < MIN_LETTERS:
                                continue
                        seen[w] += k
                    if len(seen) > _FLUSH:
                        yield flush()
        if seen:
            yield flush()

    src = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def windows(n: int) -> list[int]:
    """Where a word of n letters is cut into windows: their ends, from 0 to n."""
    k = min(MAX_WINDOWS, max(3, -(-n // WINDOW)))
    return [n * i // k for i in range(k + 1)]


def part_of(letter: int) -> int:
    return letter % PARTS


def signatures(word: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(key, role, window, part) of a word; role 1 if it is taken as the longer of a pair."""
    letters = sorted(word)
    kept = [bytes([c for c in letters if part_of(c) == p]) for p in range(PARTS)]
    size = len(word)
    for role in (0, 1):
        n = size - role
        ends = windows(n)
        for w in range(len(ends) - 1):
            outside = b"%d %d %b\x00%b\x00" % (n, w, word[:ends[w]], word[size - (n - ends[w + 1]):])
            for p in range(PARTS):
                yield xxhash.xxh3_64_intdigest(b"%b%d%b" % (outside, p, kept[p])) - (1 << 63), role, w, p


def one_edit(a: bytes, b: bytes) -> tuple[int, int] | None:
    """Lengths of the common head and tail of two near words (a no longer than b), else None."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    tail = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), len(a))
    if len(a) == len(b):
        return (head, tail) if a != b and head + tail == len(a) - 1 else None
    return (head, tail) if len(b) == len(a) + 1 and head + tail >= len(a) else None


def _pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers x < y of all pairs inside groups, a bounded number at a time."""
    reps = np.repeat(size, size) - 1 - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))  # partners behind each row
    rows = np.repeat(start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    total = np.cumsum(reps)
    at = 0
    while at < len(rows):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + _PAIRS, side="right")))
        r = reps[at:to]
        x = np.repeat(rows[at:to], r)
        yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(r) - r, r)
        at = to


def _near(words: pa.Array, role: np.ndarray, window: np.ndarray, part: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (row numbers) among rows sorted by key, each in its first shared window and part alone."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    start, size = edge[:-1], np.diff(edge)
    start, size = start[size > 1], size[size > 1]
    if not len(size):
        return
    offset = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] else np.empty(0, dtype=np.uint8)
    length = np.diff(offset)
    used = np.zeros(len(words), dtype=bool)
    used[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = True
    wide = int(min(_WIDE, length[used].max()))
    col = np.arange(wide)
    # left- and right-aligned letters, 0 beyond a word
    left = np.where(col < length[:, None], data[np.minimum(offset[:-1, None] + col, max(0, len(data) - 1))], 0).astype(np.uint8)
    right = np.where(col < length[:, None], data[np.maximum(offset[1:, None] - 1 - col, 0)], 0).astype(np.uint8)
    for x, y in _pairs(start, size):
        ok = (role[x] + role[y] < 2) & (window[x] == window[y]) & (part[x] == part[y]) & (length[x] - role[x] == length[y] - role[y])
        x, y = x[ok], y[ok]
        swap = length[x] > length[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        short, long = length[x], length[y]
        head, tail = _common(left, x, y, short), _common(right, x, y, short)
        near = np.where(short == long, head + tail == short - 1, head + tail >= short)
        added = np.zeros(len(x), dtype=np.int64)
        removed = np.full(len(x), -1)
        for k in np.flatnonzero(long > wide):
            a, b = words[int(x[k])].as_py(), words[int(y[k])].as_py()
            both = one_edit(a, b)
            near[k] = both is not None
            if both:
                head[k], tail[k] = both
        x, y, short, long, head, tail, added, removed = (v[near] for v in (x, y, short, long, head, tail, added, removed))
        if not len(x):
            continue
        added = data[offset[y] + head].astype(np.int64) % PARTS
        same = short == long
        removed[same] = data[offset[x[same]] + head[same]].astype(np.int64) % PARTS
        first = np.zeros(len(x), dtype=np.int64)  # the least part that neither letter is in
        for p in (1, 2):
            first = np.where((added == first) | (removed == first), p, first)
        # the first window that ends behind the edit
        edit = np.maximum(short - tail, 1)
        want = np.empty(len(x), dtype=np.int64)
        for n in np.unique(short):
            at = short == n
            want[at] = np.searchsorted(np.array(windows(int(n))[1:]), edit[at])
        once = (first == part[x]) & (want == window[x])
        yield x[once], y[once]


def _common(m: np.ndarray, x: np.ndarray, y: np.ndarray, short: np.ndarray) -> np.ndarray:
    differ = m[x] != m[y]
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1]), short)


def _best(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    """word, n_near, form_n, form of the words of a batch of whole groups, a row a group."""
    words, n = rows.column(1), rows.column(2).to_numpy()
    meta = rows.column(3).to_numpy().astype(np.int64)
    found = [f for f in _near(words, meta & 1, meta >> 3, meta >> 1 & 3, rows.column(0).to_numpy()) if len(f[0])]
    if not found:
        return None
    x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    own, other = np.concatenate([x, y]), np.concatenate([y, x])
    rank = np.empty(len(words), dtype=np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], own))  # the largest count first, then the smallest word
    own, other = own[order], other[order]
    cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    count, pick = np.diff(np.append(cut, len(own))), other[cut]
    return pa.RecordBatch.from_arrays([words.take(pa.array(own[cut])), pa.array(count), pa.array(n[pick]), words.take(pa.array(pick))], names=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, and form, form_n of the near word of largest count (null without one), a row for each of ``words`` (word, n)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                b = whole.slice(at, 8192)
                key, of, meta = [], [], []
                for i, w in enumerate(b.column(0).to_pylist()):
                    for k, role, window, p in signatures(w):
                        key.append(k)
                        of.append(i)
                        meta.append(window << 3 | p << 1 | role)
                of = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), b.column(0).take(of), b.column(1).take(of), pa.array(meta, pa.int32())], names=["key", "word", "n", "meta"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the key that the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or held and held[-1].column(0)[-1].as_py() != key[0]:
                done = pa.concat_batches([*held, b.slice(0, cut)]) if held else b.slice(0, cut)
                held = []
                if done.num_rows and (out := _best(done)):
                    yield out
            held.append(b.slice(cut))
        if held and (out := _best(pa.concat_batches(held))):
            yield out

    # a small table that grows twentyfold: as many tasks sign it as will read the keys
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = words.repartition(parts).mapInArrow(sign, "key bigint, word binary, n bigint, meta int")
    near = signed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "word binary, n_near bigint, form_n bigint, form binary")
    rows = near.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("m"), "form").alias("best"))
    rows = rows.unionByName(words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(rows.schema["best"].dataType).alias("best")))
    both = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return both.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the links word -> form end. Links lead to larger counts, so they never turn back."""
    steps = materialize(forms.select("word", F.col("form").alias("to")), "forms")
    while True:
        on = steps.select(F.col("word").alias("at"), F.col("to").alias("on"))
        after = materialize(steps.join(on, F.col("to") == F.col("at"), "left").select("word", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")), "forms")
        if after.where("moved").isEmpty():
            return after.select("word", F.col("to").alias("root"))
        steps = after.select("word", "to")


def group(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word; form and form_n are null where no near word has ``ratio`` times its count."""
    words = materialize(count_words(docs, text_col, id_col), "words")
    near = near_words(words)
    takes = F.col("form_n") >= ratio * F.col("n")
    near = materialize(near.select("word", "n", "n_near", F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")), "near")
    formed = near.where("form IS NOT NULL")
    out = formed.join(roots(formed), "word").unionByName(near.where("form IS NULL").withColumn("root", F.col("word")))
    said = lambda c: F.decode(F.col(c), "ISO-8859-1").alias(c)
    return out.select(said("word"), said("form"), said("root"), "n", "n_near", "form_n")
