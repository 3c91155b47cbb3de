import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import cdc_dedup
from tessera.llm.queries import QUERIES
from tessera.llm.text import table

SF = "/root/testdata/sf0.001"


def brute_cuts(raw):
    out, last = [], 0

    def char(p):
        while p < len(raw) and raw[p] & 0xC0 == 0x80:
            p += 1
        return p

    for p in range(1, len(raw) + 1):
        h = sum(int(cdc_dedup._GEAR[raw[p - 1 - j]]) << j for j in range(min(16, p))) & 0xFFFF
        if h >> (16 - cdc_dedup.MASK_BITS) == 0 or p == len(raw):
            while p - last > cdc_dedup.MAX_CHUNK:
                last = char(last + cdc_dedup.MAX_CHUNK)
                out.append(last)
            if p - last >= cdc_dedup.MIN_CHUNK and char(p) > last:
                last = char(p)
                out.append(last)
    if raw and (not out or out[-1] < len(raw)):
        out.append(len(raw))
    return out


def brute(rows, min_run=cdc_dedup.MIN_RUN):
    """Rows of non-null distinct ids."""
    least, texts = {}, []
    for d, t in rows:
        raw = (t or "").encode()
        cuts = brute_cuts(raw)
        parts = [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        texts.append((d, t, parts))
        for i, x in enumerate(parts):
            least[x] = min(least.get(x, (d, i)), (d, i))
    out = []
    for d, t, parts in texts:
        again = [least[x] != (d, i) for i, x in enumerate(parts)]
        kept, i = [], 0
        while i < len(parts):
            j = i
            while j < len(parts) and again[j] == again[i]:
                j += 1
            if not again[i] or sum(map(len, parts[i:j])) < min_run:
                kept += parts[i:j]
            i = j
        out.append((d, None if t is None else b"".join(kept).decode()))
    return sorted(out)


@pytest.mark.parametrize("held", [cdc_dedup.HELD, 50])
def test_documents_match_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(cdc_dedup, "HELD", held)
    docs = table(spark, SF, "documents").repartition(4)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted((r.doc_id, r.text) for r in cdc_dedup.remove(docs).collect())
    assert got == want and any(g != (r.doc_id, r.text) for g, r in zip(got, docs.orderBy("doc_id").collect()))


def test_cuts_match_brute_force():
    rnd = random.Random(3)
    for n in (0, 1, 15, 16, 17, 700, 3000):
        raw = "".join(rnd.choice("ab é😀\n") for _ in range(n)).encode()
        assert cdc_dedup.cuts_of(raw) == brute_cuts(raw)
    assert cdc_dedup.cuts_of(b"a" * 5000) == brute_cuts(b"a" * 5000)


def test_insertions_shift_no_distant_cuts():
    rnd = random.Random(4)
    raw = bytes(rnd.choice(b"abcdefgh ") for _ in range(4000))
    a, b = cdc_dedup.cuts_of(raw), cdc_dedup.cuts_of(raw[:1000] + b"inserted" + raw[1000:])
    assert set(a) - {x for x in a if 900 <= x <= 1300} <= {x if x < 1000 else x - 8 for x in b}


def test_passages_and_odd_rows(spark):
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage = words(60)
    rows = [(i, f"{words(30)} {passage} {words(30)}") for i in range(8)] + [(20, None), (21, ""), (22, "x"), (23, "a" * 50000), (24, words(20000)), (25, passage), (26, "a few words")]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, key string, n_removed int")
    out = cdc_dedup.remove(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == brute(rows)
    stats = {r.doc_id: r for r in cdc_dedup.remove(df.drop("n_removed"), stats=True).collect()}
    assert all(stats[i].n_removed > 150 for i in range(1, 8)) and stats[0].n_removed == stats[24].n_removed == 0
    assert cdc_dedup.remove(df.where("false")).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = "the same text of some length, " + " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.text) for r in cdc_dedup.remove(df).collect()), key=str)
    assert out == sorted([(1, ""), (1, ""), (2, ""), (None, text)], key=str)


def test_query(spark):
    out = QUERIES["op9_cdc_dedup"](spark, SF)
    assert out.columns == ["doc_id", "n_bytes", "n_chunks", "n_repeats", "n_removed", "kept_sha256"]
    assert out.count() == 200 and out.where("n_removed > n_bytes").count() == 0 and out.agg(F.sum("n_removed")).first()[0] > 0
