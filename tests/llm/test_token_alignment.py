import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tessera.llm import token_alignment as ta
from tessera.llm.queries import QUERIES
from tessera.llm.text import table

SF = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(p) for p in (ta.A_FILE, ta.B_FILE))


def loaded():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts):
    """Rows by the definition, each text encoded whole by the two libraries."""
    a, b = loaded()
    # the printable alphabet of byte-level BPE
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    out, held = [], Counter()
    for t in texts:
        ta_, tb = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ba, bb = [bytes(byte[c] for c in a.id_to_token(i)) for i in ta_], [piece(b.id_to_piece(i)) for i in tb]
        raw = (" " + (t or "")).encode()
        if not t or b"".join(ba) != raw or b"".join(bb) != raw:
            out.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, i, j, links, over = [], 0, 0, Counter(), 0
        for cut in sorted(set(ea) & set(eb)):
            x, y = i, j
            while i < len(ea) and ea[i] <= cut:
                i += 1
            while j < len(eb) and eb[j] <= cut:
                j += 1
            groups.append(",".join(map(str, ta_[x:i])) + "|" + ",".join(map(str, tb[y:j])))
            links.update((p, q) for p in ta_[x:i] for q in tb[y:j])
            over += sum(ea[m] - len(ba[m]) < eb[k] and eb[k] - len(bb[k]) < ea[m] for m in range(x, i) for k in range(y, j))
        held.update(links.keys())
        out.append((len(ea), len(eb), len(groups), sum(links.values()), over, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    return [(0,) * 7 + ("",) if r is None else (*r[:5], sum(n for k, n in r[5].items() if held[k] == top[k[0]]), sum(n * held[k] for k, n in r[5].items()), r[6]) for r in out]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256"]


def rows_of(df, ident="doc_id"):
    return sorted(((str(r[ident]), *(r[c] for c in COLUMNS)) for r in df.collect()))


def test_alignment_matches_brute_force_on_the_tables(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(docs, brute([r.text for r in docs])))
    assert rows_of(QUERIES["op13_token_alignment"](spark, SF)) == want


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", "a\nb", "a\n b", "a\n  b \n", "\t", "x\u0000y", "café naïve", "日本語 の text", "\U0001F600\U0001F468‍\U0001F469",
       "a▁b", "　wide", "ﬁne", "é", "a b", "a\u0085b c", "a  b", "­ x", "<|endoftext|> <s> <unk> </s> <0x41>", "x" * 5000, "ab" * 3000, " " * 3000 + "z", "1234567890" * 50,
       "it's we'll 'S", "a​b", "مرحبا שלום", "word " * 2000, "힣가", "\U000E0001", "a" * 50 + " " + "b" * 50, "same text", "same text"]


def test_odd_texts(spark):
    rows = [(None if i == 4 else i, t, "k", 5, 7) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int, row int").select("doc_id", "text", F.col("pairs").alias("k0"), "row")
    want = sorted((str(r[0]), *x) for r, x in zip(rows, brute(ODD)))
    got = ta.report(df)
    assert rows_of(got) == want and got.columns[:3] == ["doc_id", "k0", "row"]
    assert rows_of(ta.report(df.repartition(5))) == want


def test_random_mixtures():
    rnd = random.Random(8)
    pair, (a, b) = ta.pair_of(A, B), loaded()
    bits = ["word", "Étang", " ", "  ", "\n", "\t", "!", "...", "12", "é", "ſ", "ö", "日", " ", " ", "'s", "-", "\r\n", "¿", "²", "x" * 60]
    for _ in range(1500):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25)))
        segments = ta.segments_of(t)
        assert "".join(segments) == " " + t
        assert [i for s in segments for i in pair.encode_a(s)] == a.encode(" " + t, add_special_tokens=False).ids
        assert [i for s in segments for i in pair.encode_b(s)] == b.encode(t)


def test_plain_characters_are_split_alike():
    """The faster library for A gives the same ids wherever the slower one is left out."""
    pair = ta.pair_of(A, B)
    for c in map(chr, range(0x180)):
        for t in (f" a{c}b {c}1{c} {c}{c}", f" {c}", f" 1{c}{c}a"):
            if ta._PLAIN.fullmatch(t):
                assert pair.encode_a(t) == pair.a.encode(t, add_special_tokens=False).ids


def dense(m, rows, cols):
    start, col, val = m
    out = np.zeros((rows, cols), dtype=np.int64)
    for r in range(rows):
        for k in range(start[r], start[r + 1]):
            out[r, col[k]] += val[k]
    return out


def test_row_products_equal_dense_products():
    rnd = np.random.default_rng(4)
    for _ in range(30):
        n, m, k = rnd.integers(1, 12, 3)
        a, b = rnd.integers(0, 3, (n, m)), rnd.integers(0, 3, (m, k))
        sparse = lambda x: (np.concatenate(([0], np.cumsum((x > 0).sum(axis=1)))), np.nonzero(x)[1], x[np.nonzero(x)])
        got = np.zeros((n, k), dtype=np.int64)
        for lo in range(0, n, 5):  # in row blocks
            r, c, v = ta.row_products(*sparse(a), *sparse(b), lo, min(n, lo + 5))
            got[r, c] += v
        assert (got == a @ b).all()


def test_shared_bytes_of_overlaps():
    a, b = np.array([2, 3, 1]), np.array([1, 4, 1])
    want = {(0, 0): 1, (0, 1): 1, (1, 1): 3, (2, 2): 1}
    assert {(x, y): v for x, y, v in zip(*map(list, ta.overlaps(a, b)))} == want


def test_empty_table(spark):
    assert ta.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert rows_of(ta.report(spark.createDataFrame([(1, None)], "doc_id long, text string"))) == [("1", *(0,) * 7, "")]
