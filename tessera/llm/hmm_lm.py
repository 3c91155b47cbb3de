"""A hidden Markov language model trained by Baum-Welch, with exact text likelihoods.

Tokens are words (A-Z in lower case) and one end token a text. Training texts give
every word's count. The ``SYMBOLS`` most frequent words are symbols of their own; the
other words fall into ``CLASSES`` classes by their last two bytes, a class is one
symbol, and a word's share within its class is (c + 0.1) / (class count + 0.1 *
(class words + 1)), which leaves an unseen word of the class the same 0.1.

Training. Each iteration runs scaled forward and backward recursions over all
training texts and adds expected counts up across partitions; long texts are cut
into sequences of ``SEQUENCE`` tokens for this, so that many run in lockstep.

Scoring. The scaled forward recursion runs over whole texts: the result is the
exact log10 probability of all tokens and the end.

Counts of words live in a table; those of the ``HEAD`` most frequent words (a fixed
number) are broadcast, the rest meets the rare tokens of each text in a join, which
spreads evenly because no rare word is frequent.

Words are told apart by 64-bit hash. Null texts are empty: one end token. Rows with
a null id belong to the training texts of no fold and are scored as held out. All
rows come back, repeated ones too. Without training texts base_score and score are
null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import lower_bytes, materialize, small_slices, word_spans

SYMBOLS, CLASSES, HEAD = 8192, 256, 1 << 18
STATES, ITERATIONS, SEQUENCE = 8, 4, 1024
#: Tokens that run in lockstep, about.
TOKENS = 1 << 16
_PRIOR = 200.0


def held_out(id_col: str = "doc_id", folds: int = 10) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(folds)) == 0, F.lit(True))


def classes_of(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int32)
    if not len(start):
        return np.empty(0, dtype=np.int32)
    last, before = b[end - 1], np.where(end - start > 1, b[np.maximum(end - 2, 0)], 0)
    return (last * 31 + before * 7) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """(word, class, n) summed over all texts; each task adds up a few million tokens at a time before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h, c = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h)
            h, c = h[order], c[order]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            at = edge[:-1]
            return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(c[at].astype(np.int32)), pa.array(np.diff(edge))], names=["word", "class", "n"])

        for whole in batches:
            for b in small_slices(whole):
                for text in b.column(0).to_pylist():
                    raw = lower_bytes(text)
                    h, start, end = word_spans(raw)
                    held.append((h, classes_of(raw, start, end)))
                    size += len(h)
                if size > 1 << 21:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return texts.mapInArrow(run, "word bigint, class int, n bigint").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Sorted hashes and counts of the head words, the symbol of each (or -1), class totals, and the corpus totals."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    class_counts: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    def log_base(self, c):
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def unigram(self) -> np.ndarray:
        """Counts of symbols, classes and the end."""
        out = np.zeros(SYMBOLS + CLASSES + 1)
        use = self.symbols >= 0
        out[self.symbols[use]] = self.counts[use]
        out[SYMBOLS:-1] = self.class_counts
        return out


def vocabulary(words: DataFrame, n_texts: int) -> Vocabulary:
    by_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n"))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least, seen = None, 0
    for r in by_count.limit(HEAD).collect():  # distinct counts: at most as many as head words
        if seen + r.k > HEAD:
            break
        seen, least = seen + r.k, r.n
    head = words.where(F.col("n") >= (least if least is not None else (1 << 62))).toArrow()
    h, c, n = (head.column(x).to_numpy() for x in ("word", "class", "n"))
    order = np.argsort(h.view(np.uint64))
    h, c, n = h.view(np.uint64)[order], c[order], n[order]
    symbols = np.full(len(h), -1, dtype=np.int32)
    best = np.lexsort((h, -n))[:SYMBOLS]
    symbols[best] = np.arange(len(best))
    counts, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        counts[r["class"]], kinds[r["class"]] = r.n, r.k
    counts -= np.bincount(c[best], weights=n[best], minlength=CLASSES)
    kinds -= np.bincount(c[best], minlength=CLASSES)
    return Vocabulary(h, n, symbols, counts, kinds, int(total) + n_texts, int(distinct) + (n_texts > 0))


def encode(texts: DataFrame, vocab) -> DataFrame:
    """From (id, text, held_out) rows: symbols as int16 bytes, sums over head tokens, and the rare tokens with their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        log_base, share = v.log_base(v.counts), np.log10(v.counts + 0.1)
        class_log = np.log10(v.class_counts + 0.1 * (v.class_words + 1))
        for whole in batches:
            for b in small_slices(whole, 4 << 20):
                out = [[] for _ in range(6)]
                for text in b.column(1).to_pylist():
                    raw = lower_bytes(text)
                    h, start, end = word_spans(raw)
                    kind = classes_of(raw, start, end)
                    at = np.minimum(np.searchsorted(v.words, h), max(0, len(v.words) - 1))
                    known = v.words[at] == h if len(v.words) else np.zeros(len(h), dtype=bool)
                    symbol = np.where(known, v.symbols[at], -1) if len(v.words) else np.full(len(h), -1)
                    in_class = symbol < 0
                    symbol = np.where(in_class, SYMBOLS + kind, symbol).astype(np.int16)
                    shares = float((share[at[known & in_class]]).sum()) - float(class_log[kind[in_class]].sum()) if v.total else 0.0
                    for col, x in zip(out, (symbol.tobytes(), len(h) + 1, int(known.sum()), float(log_base[at[known]].sum()) if known.any() else 0.0, shares,
                                            h[~known].view(np.int64))):
                        col.append(x)
                cols = [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["id", "held_out", "symbols", "n_tokens", "n_head", "base", "shares", "rare"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, held_out boolean, symbols binary, n_tokens bigint, n_head bigint, base double, shares double, rare array<bigint>")


@dataclass
class Hmm:
    """Start (K), transition (K x K) and emission (symbols x K) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def forward(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Natural-log likelihood of each sequence; all run in lockstep, the longest first."""
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        sizes = np.array([len(seqs[i]) for i in order])
        grid = np.zeros((sizes[0], len(order)), dtype=np.int32)
        for col, i in enumerate(order):
            grid[:len(seqs[i]), col] = seqs[i]
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        scale, ones = np.ones(grid.shape), np.ones(len(self.start))
        a = self.start * self.emit[grid[0]]
        for t in range(sizes[0]):
            m = alive[t]
            if t:
                a = a[:m] @ self.move
                a *= self.emit.take(grid[t, :m], axis=0)
            c = np.dot(a, ones, out=scale[t, :m])
            a /= c[:, None]
        out = np.log(scale, out=scale).sum(axis=0)
        back = np.empty(len(order))
        back[order] = out
        return back

    def expected(self, seqs: list[np.ndarray], counts: "Hmm") -> float:
        """Add the expected counts of sequences to ``counts``; their log likelihood."""
        seqs = sorted(seqs, key=lambda s: -len(s))
        sizes = np.array([len(s) for s in seqs])
        steps, width, k = sizes[0], len(seqs), len(self.start)
        grid = np.zeros((steps, width), dtype=np.int32)
        for col, s in enumerate(seqs):
            grid[:len(s), col] = s
        alive = np.searchsorted(-sizes, -np.arange(steps), "left")
        alpha, scale, emitted = np.zeros((steps, width, k)), np.ones((steps, width)), self.emit.take(grid, axis=0)
        ones = np.ones(k)
        for t in range(steps):
            m = alive[t]
            a, c = alpha[t, :m], scale[t, :m]
            if t:
                np.matmul(alpha[t - 1, :m], self.move, out=a)
                a *= emitted[t, :m]
            else:
                np.multiply(self.start, emitted[0], out=a)
            np.dot(a, ones, out=c)
            a /= c[:, None]
        emitted /= scale[:, :, None]
        beta, later = np.ones((steps, width, k)), np.zeros((steps, width, k))
        back = np.ascontiguousarray(self.move.T)
        for t in range(steps - 1, 0, -1):
            m = alive[t]
            w = later[t, :m]
            np.multiply(emitted[t, :m], beta[t, :m], out=w)
            np.matmul(w, back, out=beta[t - 1, :m])
        # the steps' sums are left to one product; sequences that ended add zeros
        counts.move += (alpha[:-1].reshape(-1, k).T @ later[1:].reshape(-1, k)) * self.move
        alpha *= beta
        counts.start += alpha[0].sum(axis=0)
        seen = grid.ravel()  # behind its end a sequence adds zeros
        for j in range(k):
            counts.emit[:, j] += np.bincount(seen, weights=alpha[:, :, j].ravel(), minlength=len(self.emit))
        return float(np.log(scale).sum())

    def zeros(self) -> "Hmm":
        return Hmm(np.zeros_like(self.start), np.zeros_like(self.move), np.zeros_like(self.emit))


def initial(unigram: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
    """Emissions scattered about the unigram model, states that tend to stay."""
    rng = np.random.default_rng(seed)
    base = (unigram + 0.1) / (unigram + 0.1).sum()
    emit = base[:, None] * np.exp(rng.normal(0, 1.0, (len(unigram), states)))
    return Hmm(np.full(states, 1 / states), np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1)), emit / emit.sum(axis=0))


def maximise(counts: Hmm, unigram: np.ndarray) -> Hmm:
    base = (unigram + 0.1) / (unigram + 0.1).sum()
    emit = counts.emit + _PRIOR * base[:, None]
    return Hmm((counts.start + 1) / (counts.start + 1).sum(), (counts.move + 1) / (counts.move + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _lockstep(seqs: list[np.ndarray], tokens: int = TOKENS) -> Iterator[list[int]]:
    """Indices of sequences of like length in groups, a bounded number of tokens a group (or one sequence)."""
    group, longest = [], 0
    for i in sorted(range(len(seqs)), key=lambda i: len(seqs[i])):
        longest = max(longest, len(seqs[i]))
        if group and longest * (len(group) + 1) > tokens:
            yield group
            group, longest = [], len(seqs[i])
        group.append(i)
    if group:
        yield group


END = SYMBOLS + CLASSES


def _with_end(raw: bytes) -> np.ndarray:
    return np.append(np.frombuffer(raw, dtype=np.int16), np.int16(END))


def iterate(train: DataFrame, model: Hmm, unigram: np.ndarray) -> tuple[Hmm, float]:
    """One Baum-Welch iteration over encoded training rows; the new model and the old one's log likelihood."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts, total = own.zeros(), 0.0
        for whole in batches:
            for b in small_slices(whole, 2 << 20):
                seqs = [s[i:i + SEQUENCE] for s in map(_with_end, b.column(0).to_pylist()) for i in range(0, len(s), SEQUENCE)]
                for at in _lockstep(seqs):
                    total += own.expected([seqs[i] for i in at], counts)
        flat = np.concatenate([[total], counts.start, counts.move.ravel(), counts.emit.ravel()])
        cell = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell])], names=["cell", "x"])

    rows = train.select("symbols").mapInArrow(run, "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    k, flat = len(model.start), np.zeros(1 + len(model.start) + model.move.size + model.emit.size)  # as large as the model
    flat[rows.column("cell").to_numpy()] = rows.column("x").to_numpy()
    counts = Hmm(flat[1:1 + k], flat[1 + k:1 + k + k * k].reshape(k, k), flat[1 + k + k * k:].reshape(-1, k))
    return maximise(counts, unigram), float(flat[0])


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", folds: int = 10, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), held_out(id_col, folds).alias("held_out"))
    train = texts.where("NOT held_out")
    n_texts = train.count()
    words = materialize(count_words(train.select("text")), "words")
    vocab = vocabulary(words, n_texts)
    rows = materialize(encode(texts, spark.sparkContext.broadcast(vocab)).withColumn("row", F.monotonically_increasing_id()), "encoded")

    unigram = vocab.unigram()
    unigram[END] = n_texts
    model = initial(unigram, states)
    for _ in range(iterations if n_texts else 0):
        model, _ = iterate(rows.where("NOT held_out"), model, unigram)

    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for b in small_slices(whole, 2 << 20):
                seqs = [_with_end(x) for x in b.column(1).to_pylist()]
                out = np.empty(len(seqs))
                for at in _lockstep(seqs):
                    out[at] = own.forward([seqs[i] for i in at])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out / math.log(10))], names=["row", "hmm"])

    likelihood = rows.select("row", "symbols").mapInArrow(run, "row bigint, hmm double")
    # rare tokens: their counts, joined; a token that training lacks counts 0
    rare = rows.select("row", F.explode("rare").alias("word")).join(words.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    add = rare.groupBy("row").agg(F.sum((F.col("n") > 0).cast("bigint")).alias("n_rare"), F.sum(F.log10(F.col("n") + 0.1)).alias("logs"), F.count(F.lit(1)).alias("n_all"))
    out = rows.select("row", "id", "held_out", "n_tokens", "n_head", "base", "shares").join(likelihood, "row").join(add, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per_token = math.log10(vocab.total + 0.1 * (vocab.distinct + 1)) if n_texts else 0.0
    end = float(vocab.log_base(n_texts)) if n_texts else 0.0
    known = F.lit(n_texts > 0)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_head") + zero("n_rare") + F.lit(int(n_texts > 0))).cast("bigint").alias("n_known"),
        F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        F.when(known, F.col("base") + zero("logs") - zero("n_all") * per_token + end).alias("base_score"),
        F.when(known, F.col("hmm") + F.col("shares") + zero("logs")).alias("score"))

