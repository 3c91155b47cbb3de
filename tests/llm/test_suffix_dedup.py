import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup
from tessera.llm.queries import QUERIES
from tessera.llm.text import table

SF, N = "/root/testdata/sf0.001", suffix_dedup.LENGTH


def brute(rows):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i:i + N] for _, r in raws for i in range(len(r) - N + 1))
    out = []
    for d, r in raws:
        gone = np.zeros(len(r) + 2, dtype=bool)
        for i in range(len(r) - N + 1):
            if seen[r[i:i + N]] > 1:
                gone[i + 1:i + 1 + N] = True
        kept = bytes(x for x, g in zip(r, gone[1:]) if not g)
        out.append((d, len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove(df).collect()), key=str)


def test_documents_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, QUERIES["op4_suffix_dedup"](spark, SF).collect()), key=str) == want and sum(x[2] for x in want) > 0


def family():
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefghij klmn é\n") for _ in range(n))
    base, passage = text(3000), text(700)
    rows = []
    for i in range(60):  # passages in other surroundings, cut at all places, and near copies
        x = rnd.randrange(0, 500)
        rows.append(text(rnd.randrange(400)) + passage[x:x + rnd.choice([150, 180, 199, 200, 201, 230, 260, 400])] + text(rnd.randrange(400)))
    for i in range(30):
        b = list(base)
        for _ in range(rnd.randrange(12)):
            b[rnd.randrange(len(b))] = "#"
        rows.append("".join(b))
    return list(enumerate(rows))


@pytest.mark.parametrize("held,limit", [(suffix_dedup.HELD, suffix_dedup.MAX_BROADCAST), (20, -1)])
def test_families_match_brute_force(spark, monkeypatch, held, limit):
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "LOCAL", suffix_dedup.LOCAL if held > 20 else 3)
    monkeypatch.setattr(suffix_dedup, "MAX_BROADCAST", limit)
    rows = family()
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_odd_rows(spark):
    rnd = random.Random(12)
    words = " ".join(str(rnd.random()) for _ in range(20000))
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, "ab" * 5000), (7, words), (8, "same " * 60), (8, "same " * 60), (None, "x" + words[:250]), (9, "short")]
    df = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, doc int, a string")
    assert got(df) == brute(rows)
    assert got(df.where("false")) == []


def test_segments_give_the_same_samples(monkeypatch):
    raw = "".join(t for _, t in family()).encode()
    for k in suffix_dedup.ROUNDS:
        whole = suffix_dedup.runs(raw, k)
        monkeypatch.setattr(suffix_dedup, "SEGMENT", 777)
        parts = suffix_dedup.runs(raw, k)
        monkeypatch.undo()
        assert parts[2][0] == 0 and (parts[2][1:] == parts[3][:-1]).all() and parts[3][-1] == whole[3][-1]
        assert set(whole[2].tolist()) <= set(parts[2].tolist())
        at = np.searchsorted(whole[2], parts[2], "right") - 1
        assert (whole[0][at] == parts[0]).all()


def test_equal_windows_sample_at_equal_offsets():
    rnd = random.Random(13)
    raw = bytes(rnd.choice(b"ab") for _ in range(3000))
    for k in suffix_dedup.ROUNDS:
        key, ctx, a, e = suffix_dedup.runs(raw, k)
        key2, ctx2, a2, e2 = suffix_dedup.runs(raw[701:], k)
        assert a[0] == 0 and (a[1:] == e[:-1]).all() and e[-1] == len(raw) - N + 1
        inner = {(x, y): k1 for x, y, k1 in zip(a.tolist(), e.tolist(), key.tolist()) if x > 701}
        later = {(x + 701, y + 701): k1 for x, y, k1 in zip(a2.tolist(), e2.tolist(), key2.tolist()) if x > 0}
        assert inner.items() & later.items() == {i for i in inner.items() if i[0] in later} and len(inner.items() & later.items()) > 5
