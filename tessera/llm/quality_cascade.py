"""Quality rules as a short-circuit cascade.

Each rule rejects a text or lets it pass; a text is kept when none rejects it, so
the verdict doesn't depend on the order of the rules, only the cost does. The
order is found by measurement: ``measure`` runs every rule on a sample of about
``sample_rows`` texts, on the executors, and sums seconds and rejections per rule;
``order_rules`` puts first what rejects most per second. ``apply`` then runs the
rules in that order and stops at a text's first rejection.

Every rule sees a ``Text``, which computes words, lines and letters when first
asked, so that rules share them and a rejected text never pays for the rest.

Nulls count as empty texts: no words, rejected by the base rule. All rows come
back, repeated ones too; columns of the input other than id and text are left out.
"""

from __future__ import annotations

import string
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import small_slices

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000
_CAPITALS, _SMALL = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_NO_LETTERS = bytes(i for i in range(128) if chr(i) not in string.ascii_letters + BLANKS)


class Text:
    """A text with the counts that rules look at, each computed once, on demand."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a 3-word window found twice or more, the first find included."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        total, covered = 0, 0  # covered: the first word not counted yet
        for i, x in enumerate(windows):
            if seen[x] > 1:
                total += i + 3 - max(i, covered)
                covered = i + 3
        return total

    @cached_property
    def n_letter_words(self) -> int:
        """Words that hold an ASCII letter or a character beyond ASCII."""
        return len(self.raw.translate(None, _NO_LETTERS).split())

    @cached_property
    def n_capitals(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _CAPITALS))

    @cached_property
    def n_distinct_near(self) -> int:
        """Distinct words of each run of 1,000 words, added up: a share of all words that means the same at every length."""
        return sum(len(set(self.words[at:at + 1000])) for at in range(0, self.n_words, 1000))

    @cached_property
    def n_small_letters(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SMALL))


@dataclass(frozen=True)
class Rule:
    """``rejects`` tells whether a text fails the rule."""

    name: str
    rejects: Callable[[Text], bool]


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


#: Limits in common use for web text: symbols and letters per word, repeated lines and word windows, shouting.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 3 * t.n_words <= t.word_chars <= 10 * t.n_words),
    Rule("repeated_lines", lambda t: 5 * t.n_dup_lines > 2 * len(t.lines)),
    Rule("repeated_windows", lambda t: 5 * t.n_repeat_words > 2 * t.n_words),
    Rule("exclamations", lambda t: 4 * t.raw.count(b"!") > t.n_words),
    Rule("ellipses", lambda t: 10 * sum(x.endswith((b"...", "…".encode())) for x in map(bytes.strip, t.lines)) > 3 * len(t.lines)),
    Rule("bullets", lambda t: 10 * sum(x.lstrip().startswith((b"- ", b"* ", "•".encode())) for x in t.lines) > 9 * len(t.lines)),
    Rule("digits", lambda t: 4 * sum(map(t.text.count, "0123456789")) > t.word_chars),
    Rule("few_distinct_words", lambda t: 5 * t.n_distinct_near < t.n_words),
    Rule("capitals", lambda t: t.n_capitals > t.n_small_letters),
    Rule("words_with_letters", lambda t: 10 * t.n_letter_words < 8 * t.n_words),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
            sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, int]]:
    """Seconds and rejections of each rule over a random sample of about ``sample_rows`` rows, run where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for i, rule in enumerate(rules):
                    t = Text(text)
                    t.raw, t.words  # every rule pays alike for what the base has computed
                    began = time.perf_counter()
                    hits[i] += rule.rejects(t)
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "s": spent, "hits": hits})

    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).sample(share, seed=7)
    rows = sample.mapInArrow(run, "rule bigint, s double, hits bigint").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("hits").alias("hits")).collect()
    got = {r["rule"]: (r["s"], r["hits"]) for r in rows}
    return {rule.name: got.get(i, (0.0, 0)) for i, rule in enumerate(rules)}


def order_rules(stats: dict[str, tuple[float, int]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Most rejections per second first; rules that reject nothing of the sample last, the cheap before the dear."""
    def rank(rule: Rule):
        s, hits = stats[rule.name]
        return (-hits / max(s, 1e-9), s, rule.name)
    return tuple(sorted(rules, key=rank))


SCHEMA = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
_SPARK = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"


def apply(docs: DataFrame, rules: tuple[Rule, ...] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, the base counts, ``base_failed`` and ``kept`` of every row. rules: in the order to run; measured if None."""
    if rules is None:
        rules = order_rules(measure(docs, RULES, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_slices(whole):
                out = []
                for text in b.column(1).to_pylist():
                    t = Text(text)
                    failed = base_failed(t)
                    kept = not failed and not any(rule.rejects(t) for rule in rules)
                    out.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
                cols = [pa.array(c, f.type) for c, f in zip(zip(*out), list(SCHEMA)[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=SCHEMA.names)

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema[0].dataType.simpleString()}, {_SPARK}").withColumnRenamed("id", id_col)
