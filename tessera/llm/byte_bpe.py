"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` adds token ids, ``decode`` turns ids back into raw bytes. Both are one
narrow Arrow pass: no shuffle, nothing kept between rows but the encoder, which
each Python worker loads once.

Long texts are cut first, at places where the splitting pattern is bound to start
a new match: a white-space character after a character that is not white space.
No alternative of the pattern crosses from the latter to the former, and the
pattern looks ahead only from inside white space, so the ids of the parts,
concatenated, are the ids of the whole. A part therefore ends with a full match;
a single match longer than a part stays whole.

Nulls and empty texts give an empty list of ids; null ids decode to null.
Columns of the input with the names of the added ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import small_slices

RANKS = "byte_bpe_50k.tiktoken"
PART_CHARS = 1 << 14
#: White-space runs and other single matches beyond this go through the piece encoder one by one.
LONG_MATCH = 1 << 12
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \t\n\r])")
_LONG_RUN = re.compile(r"\s{%d}|\S{%d}" % (LONG_MATCH, LONG_MATCH))
_encoders: dict = {}


def load_encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoder of a rank file (base64 token, blank, rank on each line), one per process."""
    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}
        _encoders[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def safe_parts(text: str, part_chars: int = PART_CHARS) -> Iterator[str]:
    """Cut a text into parts of about ``part_chars`` at safe boundaries."""
    start, n = 0, len(text)
    while n - start > part_chars:
        cut = _BOUNDARY.search(text, start + part_chars)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(enc: tiktoken.Encoding, text: str, pattern: str = public_tokenizers.PATTERN,
                part_chars: int = PART_CHARS) -> list[int]:
    """Ids of a whole text, as ``enc.encode_ordinary`` gives them."""
    ids: list[int] = []
    for part in safe_parts(text, part_chars) if len(text) > part_chars else [text]:
        if len(part) > LONG_MATCH and _LONG_RUN.search(part):
            # The encoder's own splitter may exceed its backtracking limit in very long runs.
            for m in regex.finditer(pattern, part):
                ids += enc._encode_single_piece(m.group())
        else:
            ids += enc.encode_ordinary(part)
    return ids


def encode(df: DataFrame, rank_path: str, text_col: str = "text", ids_col: str = "token_ids",
           keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``ids_col``, an array of ids."""
    keep = [c for c in (df.columns if keep is None else keep) if c != ids_col]
    src = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                    F.col(f"`{text_col}`").cast("string").alias("text_in"))
    spec = ", ".join(f"k{i} {src.schema[i].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(rank_path)
        for whole in batches:
            for b in small_slices(whole, 4 << 20):
                ids = [encode_text(enc, t) if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))],
                                                 names=[*b.schema.names[:-1], "ids"])

    out = src.mapInArrow(run, (spec + ", " if spec else "") + "ids array<int>")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(ids_col))


def decode(df: DataFrame, rank_path: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """Replace ``ids_col`` by ``bytes_col``, the raw bytes (they need not be whole UTF-8 when ids were cut)."""
    return _with_decoded(df, rank_path, ids_col, bytes_col, digests=False)


def digests(df: DataFrame, rank_path: str, ids_col: str = "token_ids") -> DataFrame:
    """Decode, and digest ids and bytes where they are: n_tokens, ids_sha256, decoded_sha256 for ``ids_col``."""
    return _with_decoded(df, rank_path, ids_col, "", digests=True)


def _with_decoded(df: DataFrame, rank_path: str, ids_col: str, bytes_col: str, digests: bool) -> DataFrame:
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else [bytes_col]
    keep = [c for c in df.columns if c != ids_col and c not in added]
    src = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{ids_col}`").alias("ids"))
    spec = "".join(f"k{i} {src.schema[i].dataType.simpleString()}, " for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(rank_path)
        decimal = [str(i) for i in range(enc.n_vocab)] if digests else []
        for whole in batches:
            for b in small_slices(whole, 4 << 20):
                rows = b.column(b.num_columns - 1).to_pylist()
                texts = [None if r is None else enc.decode_bytes(r) for r in rows]
                if digests:
                    more = [pa.array([None if r is None else len(r) for r in rows], pa.int64()),
                            pa.array([None if r is None else _sha(" ".join([decimal[i] for i in r]).encode()) for r in rows], pa.string()),
                            pa.array([None if t is None else _sha(t) for t in texts], pa.string())]
                else:
                    more = [pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], *[f"a{i}" for i in range(len(more))]])

    kinds = ["a0 bigint, a1 string, a2 string"] if digests else ["a0 binary"]
    out = src.mapInArrow(run, spec + kinds[0])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"a{i}").alias(c) for i, c in enumerate(added)])


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def round_trip(docs: DataFrame, rank_path: str, text_col: str = "text") -> Column:
    """True where decoding the ids of a text gives its UTF-8 bytes: a check for any table."""
    return F.col("decoded_sha256") == F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
