import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import hmm_lm
from tessera.llm.queries import QUERIES
from tessera.llm.text import table

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute_base(rows):
    def toks(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]

    held = {d: d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = Counter(w for d, t in rows if not held[d] for w in toks(t))
    n, v = sum(c.values()), len(c)
    return sorted(((d, held[d], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for d, t in rows for w in [toks(t)]), key=str)


def check(got, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    want = brute_base(rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(math.isclose(x[5], y[5], rel_tol=1e-9) for x, y in zip(got, want))


@pytest.mark.parametrize("head", [hmm_lm.HEAD, 300])
def test_base_matches_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(hmm_lm, "HEAD", head)
    docs = table(spark, SF, "documents")
    check(hmm_lm.score(docs, iterations=1).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, " \n"), (5, "A B"), (5, "A B"), (None, "a zz"), (6, "word " * 20000), (7, "é" * 100000)]
    rows += [(i, f"a b w{i}") for i in range(10, 40)]
    df = spark.createDataFrame([(d, t, 1.0, "n") for d, t in rows], "doc_id long, text string, score double, row string")
    out = hmm_lm.score(df).collect()
    check(out, rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert hmm_lm.score(df.where("false")).count() == 0
    assert [(r.score, r.base_score, r.train_tokens) for r in hmm_lm.score(df.where("doc_id IS NULL")).collect()] == [(None, None, 0)]


def tiny(rng, k=3, s=5):
    p = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape) + 0.1)
    return hmm_lm.Hmm(p(k), p(k, k), np.ascontiguousarray(p(k, s).T))


def by_paths(m, seq):
    return sum(m.start[p[0]] * m.emit[seq[0], p[0]] * math.prod(m.move[a, b] * m.emit[o, b] for a, b, o in zip(p, p[1:], seq[1:]))
               for p in itertools.product(range(len(m.start)), repeat=len(seq)))


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    m = tiny(rng)
    seqs = [rng.integers(0, 5, n) for n in (4, 1, 6, 3, 6)]
    assert np.allclose(m.forward(seqs), [math.log(by_paths(m, s)) for s in seqs])


def test_expected_counts_are_sums_over_paths():
    rng = np.random.default_rng(2)
    m = tiny(rng)
    seqs = [rng.integers(0, 5, n) for n in (4, 2, 5)]
    counts = m.zeros()
    total = m.expected(seqs, counts)
    want = m.zeros()
    for s in seqs:
        whole = by_paths(m, s)
        for p in itertools.product(range(3), repeat=len(s)):
            w = m.start[p[0]] * m.emit[s[0], p[0]] * math.prod(m.move[a, b] * m.emit[o, b] for a, b, o in zip(p, p[1:], s[1:])) / whole
            want.start[p[0]] += w
            for a, b in zip(p, p[1:]):
                want.move[a, b] += w
            for o, a in zip(s, p):
                want.emit[o, a] += w
    assert np.allclose(counts.start, want.start) and np.allclose(counts.move, want.move) and np.allclose(counts.emit, want.emit)
    assert math.isclose(total, m.forward(seqs).sum())


def test_held_out_texts_score_above_unigrams(spark):
    out = [r for r in QUERIES["op6_hmm_lm"](spark, SF01).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.95
    assert sum(r.score > r.base_score for r in out) > 0.9 * len(out)


def test_training_raises_the_likelihood(spark):
    from pyspark.sql import functions as F

    texts = table(spark, SF, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("held_out"))
    vocab = hmm_lm.vocabulary(hmm_lm.count_words(texts.select("text")), 200)
    rows = hmm_lm.encode(texts, spark.sparkContext.broadcast(vocab)).cache()
    uni = vocab.unigram()
    model, seen = hmm_lm.initial(uni), []
    for _ in range(4):
        model, ll = hmm_lm.iterate(rows, model, uni)
        seen.append(ll)
    assert seen == sorted(seen)


def test_expected_counts_of_uneven_sequences_against_one_at_a_time():
    """In lockstep, sequences that ended add nothing."""
    rnd = np.random.default_rng(5)
    model = hmm_lm.initial(rnd.random(hmm_lm.END + 1) * 50)
    seqs = [rnd.integers(0, hmm_lm.END + 1, n).astype(np.int16) for n in (1, 7, 3, 40, 40, 2)]
    together, apart = model.zeros(), model.zeros()
    total = model.expected(seqs, together)
    one = [model.expected([s], apart) for s in seqs]
    assert np.isclose(total, sum(one)) and np.allclose(model.forward(seqs), one)
    for x, y in ((together.start, apart.start), (together.move, apart.move), (together.emit, apart.emit)):
        assert np.allclose(x, y)
    assert np.isclose(together.emit.sum(), sum(map(len, seqs)))
