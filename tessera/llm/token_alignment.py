"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A is byte-level BPE (a ``tokenizers`` file), B a piece model with byte fallback (a
``sentencepiece`` file). Both encode a blank and the text. A text is aligned if the joined
bytes of A's tokens, and of B's, are those of blank and text; else, or if it is null or empty,
it has no tokens.

Matrices, all in compressed sparse rows built here (row starts, column numbers, values):

* tokens x bytes, a one for each byte that a token covers, for A and for B. The row products of
  A * Bt (Gustavson: rows of Bt scaled and added up, for each entry of a row of A) are the
  overlap links, their values the shared bytes.
* groups are the runs between byte offsets where tokens of both end. A-ids x groups and groups x
  B-ids hold how often an id stands in a group; the row products of these give, for each A-id,
  the B-ids that it shares groups with and the number of links between them.

Segments. Neither tokenizer has a token that crosses from a character that isn't white space to
a blank, so both end a token there, and such segments are aligned on their own, each distinct one
once in a batch and its result remembered (a bounded number). Segments of letters that the two
libraries for A split alike go through the faster one (``tiktoken`` with the ranks of A's file);
others go through A's own library.

Corpus-wide counts. A narrow pass writes each document's numbers and its links, as (pair,
number) in bytes, to the shared folder. A pair's count is the number of documents that
hold it: combined in tasks, then by Spark. A pair that documents hold so often that it makes
more than 1 / ``HOT`` of all entries is hot; there can be no more than ``HOT`` hot pairs, so they
are broadcast and looked up where the links are. The links left are sent to the tasks that hold
their pair's count, in blocks; a task reads its counts first and then the blocks as a stream. So
no pair is a hot key, and nothing that grows with the corpus is broadcast.

Nulls: null and empty texts count zero and have an empty ``groups_sha256``. Rows keep their
columns named in ``keep``; repeated rows and rows of one id count as a document each. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import encode_text
from tessera.llm.text import materialize, small_slices

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HOT = 1 << 16
#: Ids of B take the low bits of a pair.
SHIFT = 24
_SEGMENT = re.compile(r"\s+(?:\S+[^\S ]\s*)*\S*")
#: Characters that both libraries for A take for the same kind: ASCII but for odd controls, and Latin letters.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-ſ]*")
_REMEMBER, _REMEMBER_CHARS = 100_000, 48
_CHUNK = 1 << 16
#: Products of a row block, at most, unless a single row has more.
_BLOCK = 1 << 20


def byte_level() -> dict[str, int]:
    """The printable character of each byte in a byte-level vocabulary, turned around: printable Latin-1 as is, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers, with the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        of = byte_level()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes([of[c] for c in token])
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes)}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))

    def encode_a(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text):
            return encode_text(self.fast, text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode_b(self, text: str) -> list[int]:
        """Of a text that starts with the blank that the model adds itself."""
        return self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.b.piece_to_id("▁")]

    def whole(self, a: list[int], b: list[int], raw: bytes) -> bool:
        return b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    """One per worker process."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def _starts(of: np.ndarray, n: int) -> np.ndarray:
    """Row starts of a matrix of ``n`` rows whose entries have the sorted row numbers ``of``."""
    return np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))


def row_products(a_start, a_col, a_val, b_start, b_col, b_val, first: int, last: int):
    """Rows first..last of A * B by Gustavson's rule: (row, column, value) sorted, one entry a cell.

    For each entry (r, k) of A the row k of B, times the entry, is added to row r.
    """
    lo, hi = a_start[first], a_start[last]
    k, val = a_col[lo:hi], a_val[lo:hi]
    row = np.repeat(np.arange(first, last), np.diff(a_start[first:last + 1]))
    width = b_start[k + 1] - b_start[k]
    at = np.repeat(b_start[k], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    row, col, val = np.repeat(row, width), b_col[at], np.repeat(val, width) * b_val[at]
    return _added(row, col, val)


def _added(row, col, val):
    key = row << SHIFT | col
    order = np.argsort(key, kind="stable")
    key, val = key[order], val[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    return key[cut] >> SHIFT, key[cut] & ((1 << SHIFT) - 1), np.add.reduceat(val, cut) if len(cut) else val


def _entries(row: np.ndarray, col: np.ndarray, n: int):
    """A matrix of counts from occurrences (row, col): row starts, columns, values."""
    row, col, val = _added(row, col, np.ones(len(row), dtype=np.int64))
    return _starts(row, n), col, val


def overlaps(a_len: np.ndarray, b_len: np.ndarray):
    """Token x token overlap links of one byte axis: row products of A's tokens x bytes with B's, transposed. (a, b, shared bytes)."""
    size = int(a_len.sum())
    ones = np.ones(size, dtype=np.int64)
    a_start = np.concatenate(([0], np.cumsum(a_len)))
    # Bt has a row for each byte, with the one token that covers it
    return row_products(a_start, np.arange(size), ones, np.arange(size + 1), np.repeat(np.arange(len(b_len)), b_len), ones, 0, len(a_len))


class Links:
    """Alignment of one token sequence by A and one by B that cover the same bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray):
        self.a, self.b = a, b
        self.a_end, self.b_end = np.cumsum(a_len), np.cumsum(b_len)
        self.cuts = np.intersect1d(self.a_end, self.b_end, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(self.cuts, self.a_end), np.searchsorted(self.cuts, self.b_end)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (A id << SHIFT | B id) and the number of their links, in blocks of A ids, each pair once."""
        ids, row = np.unique(self.a, return_inverse=True)
        n = len(self.cuts)
        a = _entries(row.astype(np.int64), self.a_group, len(ids))
        b = _entries(self.b_group, self.b, n)
        work = np.concatenate(([0], np.cumsum(np.add.reduceat(np.diff(b[0])[a[1]], a[0][:-1])))) if len(ids) else np.zeros(1, dtype=np.int64)
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(work, work[at] + _BLOCK, side="right")) - 1)
            r, c, v = row_products(*a, *b, at, to)
            yield ids[r] << SHIFT | c, v
            at = to


class Aligner:
    """Aligns texts segment by segment."""

    def __init__(self, pair: Pair):
        self.pair, self.known = pair, {}

    def learn(self, segments: list[str]) -> None:
        """Align segments that aren't known yet; an unaligned one is known as None."""
        if len(self.known) > _REMEMBER:
            self.known.clear()
        plain, chunk = [], 0
        for s in segments:
            if s in self.known:
                continue
            self.known[s] = None
            if len(s) <= _REMEMBER_CHARS and s[-1] > " " and _PLAIN.fullmatch(s):
                plain.append(s)
                chunk += len(s)
                if chunk > _CHUNK:
                    self.together(plain)
                    plain, chunk = [], 0
            else:
                self.alone(s)
        if plain:
            self.together(plain)

    def alone(self, s: str) -> None:
        a, b = self.pair.encode_a(s), self.pair.encode_b(s)
        if self.pair.whole(a, b, s.encode("utf-8", "surrogatepass")):
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            self.put([s], a, b, np.array([0, len(a)]), np.array([0, len(b)]), np.array([len(s.encode())]))

    def together(self, parts: list[str]) -> None:
        """Encode many segments as one text: each starts with a blank and ends without white space, so no token crosses."""
        text = "".join(parts)
        a, b, raw = self.pair.encode_a(text), self.pair.encode_b(text), text.encode()
        if not self.pair.whole(a, b, raw):
            for s in parts:
                self.alone(s)
            return
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        size = np.array([len(s.encode()) for s in parts], dtype=np.int64)
        ends = np.cumsum(size)
        self.put(parts, a, b, np.append(0, np.searchsorted(np.cumsum(self.pair.a_len[a]), ends) + 1), np.append(0, np.searchsorted(np.cumsum(self.pair.b_len[b]), ends) + 1), size)

    def put(self, parts: list[str], a, b, a_at, b_at, size) -> None:
        """Results of segments whose tokens stand in a row: groups as text, counts, and links as pairs with their numbers."""
        links = Links(a, b, self.pair.a_len[a], self.pair.b_len[b])
        n_over = len(overlaps(self.pair.a_len[a], self.pair.b_len[b])[0]) if len(parts) == 1 else None
        said_a, said_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        na, nb = np.bincount(links.a_group, minlength=len(links.cuts)), np.bincount(links.b_group, minlength=len(links.cuts))
        groups, i, j = [], 0, 0
        for x, y in zip(na.tolist(), nb.tolist()):
            groups.append((said_a[i] if x == 1 else ",".join(said_a[i:i + x])) + "|" + (said_b[j] if y == 1 else ",".join(said_b[j:j + y])))
            i, j = i + x, j + y
        n_links = np.concatenate(([0], np.cumsum(na * nb)))
        ends = np.concatenate(([0], np.searchsorted(links.cuts, np.cumsum(size)) + 1))
        if n_over is None:  # one axis for all: count links by the segment of their A token
            of = np.searchsorted(a_at, overlaps(self.pair.a_len[a], self.pair.b_len[b])[0], side="right") - 1
            overs = np.bincount(of, minlength=len(parts)).tolist()
        else:
            overs = [n_over]
        each = self.split(links, a_at, b_at, ends, len(parts)) if len(parts) > 1 else [tuple(np.concatenate(v).tobytes() for v in zip(*links.blocks()))]
        for k, s in enumerate(parts):
            g0, g1 = int(ends[k]), int(ends[k + 1])
            self.known[s] = (";".join(groups[g0:g1]), int(a_at[k + 1] - a_at[k]), int(b_at[k + 1] - b_at[k]), g1 - g0, int(n_links[g1] - n_links[g0]), overs[k], *each[k])

    @staticmethod
    def split(links: Links, a_at, b_at, ends, n: int):
        """Pairs and their numbers, in bytes, of each of many short segments: row products of group incidence, an A token a row, then added up by segment and pair."""
        a_start, groups = np.arange(len(links.a) + 1), len(links.cuts)
        b_start = _starts(links.b_group, groups)
        ones_a, ones_b = np.ones(len(links.a), dtype=np.int64), np.ones(len(links.b), dtype=np.int64)
        row, col, val = row_products(a_start, links.a_group, ones_a, b_start, links.b, ones_b, 0, len(links.a))
        seg = np.searchsorted(a_at, row, side="right") - 1
        pair = links.a[row] << SHIFT | col
        order = np.lexsort((pair, seg))
        seg, pair, val = seg[order], pair[order], val[order]
        cut = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (pair[1:] != pair[:-1]))))
        seg, pair, val = seg[cut], pair[cut], np.add.reduceat(val, cut)
        at = np.searchsorted(seg, np.arange(n + 1))
        at, pair, val = (8 * at).tolist(), pair.tobytes(), val.tobytes()
        return [(pair[x:y], val[x:y]) for x, y in zip(at, at[1:])]

    def align(self, segments: list[str]):
        """(n_a, n_b, n_groups, n_links, n_overlaps, digest, pairs, counts) of a text of known segments; None if one isn't aligned."""
        got = [self.known[s] for s in segments]
        if not got or None in got:
            return None
        groups, *sums, pairs, vals = zip(*got)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        pair, val = np.frombuffer(b"".join(pairs), dtype=np.int64), np.frombuffer(b"".join(vals), dtype=np.int64)
        order = np.argsort(pair, kind="stable")
        pair, val = pair[order], val[order]
        cut = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        return (*map(sum, sums), digest, pair[cut].astype("<i8").tobytes(), np.add.reduceat(val, cut).astype("<i4").tobytes())


def segments_of(text: str) -> list[str]:
    """Cut blank + text where a blank follows a character that isn't white space."""
    return _SEGMENT.findall(" " + text)


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row's numbers and links: row, k0.. (the columns ``keep``), n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, pairs, counts.

    ``pairs`` are A id * 2^24 + B id as little-endian 64-bit integers, each once, ``counts`` their links (32 bits).
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    src = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    spec = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in src.schema[:-1]) + "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups_sha256 string, pairs binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(pair_of(a_path, b_path))
        for whole in batches:
            for b in small_slices(whole, 1 << 20):
                texts = [segments_of(t) if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
                aligner.learn(list(dict.fromkeys(s for t in texts for s in t)))
                rows = [aligner.align(t) or (0, 0, 0, 0, 0, "", None, None) for t in texts]
                kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                                                 names=[*b.schema.names[:-1], "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "pairs", "counts"])
                for s in [s for t in texts for s in t if len(s) > _REMEMBER_CHARS]:
                    aligner.known.pop(s, None)

    return src.mapInArrow(run, spec)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best (no B id has a larger count with its A id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

        for b in batches:
            for raw in b.column(0):
                if raw.is_valid:
                    held.append(np.frombuffer(raw.as_buffer(), dtype="<i8"))
                    size += len(held[-1])
                    if size > 1 << 22:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    # the pairs of one document differ, so it counts each once
    counts = aligned.where("pairs IS NOT NULL").select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("a", F.shiftright("pair", SHIFT).cast("int")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # one row an A id: at most the vocabulary
    return materialize(counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")


def link_sums(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best, count_sum: links whose pair is its A id's best, and the sum of the counts of all links' pairs."""
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    hot = counts.where(F.col("n") * HOT > F.lit(total)).orderBy("pair").toArrow()  # fewer than HOT rows
    spark = aligned.sparkSession
    shared = spark.sparkContext.broadcast([hot.column(c).to_numpy() for c in ("pair", "n", "best")])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for whole in batches:
            for b in small_slices(whole, 4 << 20):
                raw = b.column(1).to_pylist()
                row = np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in raw])
                pair, links = np.frombuffer(b"".join(raw), dtype="<i8"), np.frombuffer(b"".join(b.column(2).to_pylist()), dtype="<i4").astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
                known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), dtype=bool)
                yield _sums(row[known], links[known], n[at[known]], best[at[known]])
                yield _blocks(1, pair[~known], [row[~known], links[~known]], parts)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, n, best = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            yield _blocks(0, pair, [n, best.astype(np.int64)], parts)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, pairs = None, [], None
        for b in batches:
            for to, links_here, pair, x, y in zip(*(b.column(c).to_pylist() for c in ("to", "links", "pair", "x", "y"))):
                pair, x, y = (np.frombuffer(v, dtype="<i8") for v in (pair, x, y))
                if to != now:
                    now, held, pairs = to, [], None
                if not links_here:
                    held.append((pair, x, y))
                    continue
                if pairs is None:  # all counts of a task come before its links
                    pairs, n, best = (np.concatenate(v) for v in zip(*held))
                    order = np.argsort(pairs)
                    pairs, n, best, held = pairs[order], n[order], best[order] == 1, []
                at = np.searchsorted(pairs, pair)
                yield _sums(x, y, n[at], best[at])

    kind = "to int, links int, pair binary, x binary, y binary, row bigint, n_best bigint, count_sum bigint"
    links = materialize(aligned.where("pairs IS NOT NULL").select("row", "pairs", "counts").mapInArrow(split, kind), "links")
    rest = counts.where(F.col("n") * HOT <= F.lit(total)).select("pair", "n", "best").mapInArrow(hold, kind)
    sent = rest.unionByName(links.where("to >= 0")).select("to", "links", "pair", "x", "y").repartition(parts, "to").sortWithinPartitions("to", "links")
    cold = sent.mapInArrow(look_up, kind).select("row", "n_best", "count_sum")
    both = links.where("to IS NULL").select("row", "n_best", "count_sum").unionByName(cold)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


_KINDS = {"to": pa.int32(), "links": pa.int32(), "pair": pa.binary(), "x": pa.binary(), "y": pa.binary(), "row": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64()}


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in _KINDS.items()], names=list(_KINDS))


def _sums(row: np.ndarray, links: np.ndarray, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """row, n_best, count_sum of the rows that some links belong to."""
    rows, of = np.unique(row, return_inverse=True)
    n_best, total = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    np.add.at(n_best, of, np.where(best, links, 0))
    np.add.at(total, of, links * n)
    return _rows(len(rows), row=rows, n_best=n_best, count_sum=total)


def _blocks(links: int, pair: np.ndarray, values: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Pairs with two values each, packed into one row for each task that gets some of them."""
    to = _spread(pair, parts)
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [v[order].astype("<i8") for v in (pair, *values)]
    cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.empty(0, dtype=np.int64)
    ends = np.append(cut[1:], len(to))
    packed = [[v[x:y].tobytes() for x, y in zip(cut.tolist(), ends.tolist())] for v in columns]
    return _rows(len(cut), to=to[cut], links=[links] * len(cut), pair=packed[0], x=packed[1], y=packed[2])


def _spread(pair: np.ndarray, parts: int) -> np.ndarray:
    """A task for each pair, by a multiplicative hash."""
    h = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, then n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum and groups_sha256, a row for each of ``docs``."""
    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    aligned = materialize(align(docs, a_path, b_path, text_col, keep), "aligned")
    sums = link_sums(aligned, pair_counts(aligned))
    zero = F.lit(0).cast("long")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
    rows = aligned.join(sums, "row", "left")
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *numbers, F.coalesce("n_best", zero).alias("n_best"),
                       F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
