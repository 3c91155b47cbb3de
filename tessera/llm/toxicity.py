"""Toxicity scores that see through obfuscated spelling: a noisy channel, then a word model.

Character model. Trigrams of letters (a-z, the Latin-1 letters, and a boundary) are
counted over all training texts; the table has a fixed size, whatever the corpus.

Channel. A token that may be read in another way (with a doubled letter, a mimic or a
mark, or three or more single characters with blanks between) becomes a lattice: each written character may stand for itself, for letters that it mimics,
or, if it repeats or separates, for nothing, each at a cost. Viterbi search finds
the cheapest reading of the whole token under the character model, however long it is.
Other tokens have one reading, themselves.

Word model. Features are the restored word and its first four to six letters. From
labelled rows, at most ``max_labels`` (spread by hash, one id for each group of near
copies; rows that repeat that id count each), each feature gets the share of toxic rows among those that hold it; it
counts if that share is at least ``MIN_SHARE`` per cent, unless chance alone would give
more than ``MAX_CHANCE`` of the features found so, among those held by as many rows,
and if at least ``LEAST`` rows hold it. A text's score is a noisy or: 1 - (1 - base) * product of (1 - share), a word
taking part once, by its best feature.

Labels, language, source and id are never inputs of a score. Null and empty texts
score the base rate of rows without any feature. All rows come back, repeated ones
too. Without labelled rows every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import lower_bytes, materialize, mix64, shingle_hashes, small_slices, word_hashes

MAX_LABELS = 40_000
MIN_SHARE = 97  # per cent
MAX_CHANCE, LEAST, SURE = 0.01, 5, 32
PREFIXES = (4, 5, 6)
#: Letters that a written character may mimic: fixed values.
MIMICS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
          "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¥": "y", "#": "h", "*": "aeiou", "?": ""}
MARKS = ".-_*~'’·,/\\:;=^`\"+ ​‌‍­"
_PLAIN = ".,;:!?\"'()[]{}<>|…„“”‚‘’«»¿¡-_"
_ENDS = re.compile(r"^[%&#*$]{2,}|[%&#*$]{2,}$")
_STRIP = ".,;:!?\"'()[]{}%*$&#<>|…„“”‚‘’«»¿¡-_"
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
K = len(_LETTERS) + 1
_CODES = np.zeros(256, dtype=np.int32)
for _c, _i in CODE.items():
    _CODES[ord(_c)] = _i
#: Costs of the channel, in nats.
COST_MIMIC, COST_REPEAT, COST_MARK, COST_KEEP = 0.6, 0.2, 0.2, 6.0
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_OTHER = re.compile("[" + re.escape("".join(MIMICS) + MARKS) + "]")
_CACHE = 200_000


def trigram_counts(texts: list[str]) -> np.ndarray:
    joined = "  ".join(texts).lower().encode("latin-1", "replace")
    c = _CODES[np.frombuffer(b"  " + joined + b"  ", dtype=np.uint8)]
    return np.bincount((c[:-2] * K + c[1:-1]) * K + c[2:], minlength=K ** 3)


def _spelt(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, letter = chain
        out.append(letter)
    return "".join(out[::-1])


class CharModel:
    """-log P(letter | two before), add-one smoothed with a back-off to bigrams."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(K, K, K).astype(np.float64)
        bi = tri.sum(axis=0)
        p1 = (bi.sum(axis=0) + 1) / (bi.sum() + K)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
        self.cost = -np.log(p3)

    def restore(self, written: str) -> str:
        """The cheapest reading of a written token."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # readings are chains (rest, last letter) that share their heads
        before = ""
        for ch in written:
            options: list[tuple[str, float]] = []
            if ch in CODE:
                options.append((ch, 0.0))
                if ch == before:
                    options.append(("", COST_REPEAT))
            else:
                options += [(x, COST_MIMIC) for x in MIMICS.get(ch, "")]
                if ch == before and options:
                    options.append(("", COST_REPEAT))
                if ch in MARKS:
                    options.append(("", COST_MARK))
                options.append((" ", COST_KEEP if ch != " " else 1.0))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, said) in best.items():
                for out, extra in options:
                    if out:
                        c = CODE.get(out, 0)
                        state, total, text = (b, c), cost + extra + self.cost[a, b, c], (said, out)
                    else:
                        state, total, text = (a, b), cost + extra, said
                    if state not in after or total < after[state][0]:
                        after[state] = (total, text)
            best, before = after, ch
        return min((cost + self.cost[a, b, 0], _spelt(said)) for (a, b), (cost, said) in best.items())[1].strip()


def looks_disguised(core: str) -> bool:
    """A doubled letter, a mimic or a mark: the channel may read it in another way."""
    return bool(_DOUBLE.search(core) or not core.isalpha() and _OTHER.search(core))


class Reader:
    """Distinct restored words of a text; remembers a bounded number of tokens."""

    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def read(self, token: str) -> tuple[str, ...]:
        wide = _ENDS.sub("", token.strip(_PLAIN))
        core = token.strip(_STRIP)
        if not core:
            return ()
        if not looks_disguised(wide):
            return (core,)
        return tuple({core, *self.pieces(wide), *(self.pieces(core) if core != wide else ())})

    def pieces(self, written: str) -> set[str]:
        """Words of the cheapest reading."""
        return set(self.model.restore(written).split())

    def word(self, token: str) -> tuple[str, ...]:
        if (got := self.known.get(token)) is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            got = self.known[token] = self.read(token)
        return got

    def spaced(self, low: str) -> set[str]:
        """Words spelt in single characters with blanks between, one or many."""
        return {w for m in _SPACED.finditer(low) for w in self.pieces(" ".join(m[0].split()))}

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        return {w for t in set(low.split()) for w in self.word(t)} | self.spaced(low)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    counts: np.ndarray
    shares: dict[str, float]
    base: float

    def scorer(self):
        reader, known = Reader(CharModel(self.counts)), {}
        # a look-up for each kind of feature: whole words, then prefixes of each length
        whole = {f: s for f, s in self.shares.items() if not f.endswith("~")}
        heads = [(n, {f[:-1]: s for f, s in self.shares.items() if f.endswith("~") and len(f) == n + 1}) for n in PREFIXES]
        heads = [(n, h) for n, h in heads if h]

        def share(word: str) -> float:
            return max([whole.get(word, 0.0), *(h.get(word[:n], 0.0) for n, h in heads)])

        def score(text: str | None) -> float:
            low, hits = (text or "").lower(), {}
            for t in set(low.split()):
                core = t.strip(_PLAIN)
                if core.isalpha() and not _DOUBLE.search(core):
                    if core in whole:
                        hits[core] = share(core)
                        continue
                    for n, h in heads:
                        if core[:n] in h:
                            hits[core] = share(core)
                            break
                elif core:
                    if (got := known.get(t)) is None:
                        if len(known) >= _CACHE:
                            known.clear()
                        got = known[t] = {w: s for w in reader.read(t) if (s := share(w))}
                    hits.update(got)
            hits.update((w, s) for w in reader.spaced(low) if (s := share(w)))
            return 1.0 - (1.0 - self.base) * math.prod(1.0 - s for s in hits.values())

        return score


def least_hashes(text: str) -> list[int]:
    """The smallest shingle hash of a text under three hash functions."""
    h = shingle_hashes(word_hashes(lower_bytes(text)))
    return [int(mix64(h + np.uint64(k)).min()) >> 1 if len(h) else 0 for k in range(3)]


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(folds)) == 0


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", folds: int = 5,
        max_labels: int = MAX_LABELS) -> Model:
    """Learn from rows whose crc32(id) mod ``folds`` isn't 0 (null ids never): characters of all, labels of at most ``max_labels``."""
    spark = docs.sparkSession
    train = docs.where(~held_out(id_col, folds)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K ** 3, dtype=np.int64)
        for whole in batches:
            for b in small_slices(whole, 2 << 20):
                total += trigram_counts([t for t in b.column(0).to_pylist() if t])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    sums = train.select("text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(K ** 3, dtype=np.int64)  # the table's size is fixed
    counts[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()

    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("id", folds))
    n = known.count()
    if n > max_labels:  # about max_labels of them, spread by hash
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * max_labels / n))
    marks = spark.sparkContext.broadcast({r.id: r.y for r in known.groupBy("id").agg(F.max("y").alias("y")).collect()})
    table = spark.sparkContext.broadcast(counts)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_slices(whole):
                use = pa.array([i in marks.value for i in b.column(0).to_pylist()], pa.bool_())
                ids, least = b.column(0).filter(use), [least_hashes(t or "") for t in b.column(1).filter(use).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array([marks.value[i] for i in ids.to_pylist()], pa.int32()),
                                                  *(pa.array([x[k] for x in least], pa.int64()) for k in range(3))], names=["id", "y", "a", "b", "c"])

    # one id for each group of near copies: those that share a smallest shingle hash, of three; texts stay where they are
    id_type = train.schema["id"].dataType.simpleString()
    rows = train.mapInArrow(pick, f"id {id_type}, y int, a bigint, b bigint, c bigint")
    for key, rest in (("a", ["b", "c"]), ("b", ["c"]), ("c", [])):
        rows = rows.groupBy(key).agg(F.max(F.struct("y", "id", *rest)).alias("r")).select("r.*")
    chosen = spark.sparkContext.broadcast({r.id for r in rows.select("id").collect()})  # no more than labels

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen, toxic, docs_n = Reader(CharModel(table.value)), Counter(), Counter(), [0, 0]

        def flush():
            out = pa.RecordBatch.from_pydict({"f": list(seen), "n": list(seen.values()), "t": [toxic[f] for f in seen]})
            seen.clear()
            toxic.clear()
            return out

        for whole in batches:
            for b in small_slices(whole, 2 << 20):
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if i not in chosen.value:
                        continue
                    y = marks.value[i]
                    own = {f for w in reader.words(text) for f in features(w)}
                    seen.update(own)
                    docs_n[y] += 1
                    if y:
                        toxic.update(own)
                if len(seen) > 300_000:
                    yield flush()
        seen[""], toxic[""] = sum(docs_n), docs_n[1]
        yield flush()

    by = train.mapInArrow(tally, "f string, n bigint, t bigint").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    by = materialize(by, "features")
    size = by.where("f = ''").first()
    if size is None or not size.n or not size.t:
        return Model(counts, {}, 0.0)
    base = min(0.5, size.t / size.n)
    toxic = F.expr(f"100 * t >= {MIN_SHARE} * n")
    # for each number of rows: features with it, and toxic ones among them against what chance would give
    seen = by.where("f <> ''").groupBy(F.least("n", F.lit(SURE)).alias("n")).agg(F.count(F.lit(1)).alias("all"), F.count(F.when(toxic, 1)).alias("toxic")).collect()
    trusted = [r.n for r in seen if r.toxic and r.n >= LEAST and (r.n == SURE or r.all * base ** math.ceil(r.n * MIN_SHARE / 100) <= MAX_CHANCE * r.toxic)]
    keep = by.where(toxic & (F.col("f") != "") & F.least("n", F.lit(SURE)).isin(trusted)).collect()  # of at most max_labels rows
    return Model(counts, {r.f: (r.t + 0.1) / (r.n + 1.0) for r in keep}, 0.5 * size.t / size.n)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and ``score_col``, in one narrow pass."""
    kept = [c for c in docs.columns if c != score_col]
    names = [f"k{i}" for i in range(len(kept))]
    src = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(kept, names)], F.col(f"`{text_col}`").cast("string").alias("text_in"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spec = "".join(f"{k} {f.dataType.simpleString()}, " for k, f in zip(names, src.schema)) + "s double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = shared.value.scorer()
        for whole in batches:
            for b in small_slices(whole):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(map(fn, b.column(b.num_columns - 1).to_pylist()), pa.float64())], names=[*names, "s"])

    return src.mapInArrow(run, spec).toDF(*kept, score_col)
