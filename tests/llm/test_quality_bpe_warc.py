import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, quality_cascade, warc
from tessera.llm.queries import QUERIES
from tessera.llm.text import table

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path(byte_bpe.RANKS)
ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b c a b c"), (4, "a b c a b c"), (None, "x"), (5, "ab　cd\x85e f\x1cg\n\nab\nab\n"),
       (6, "word " * 3000), (7, "loooong" * 20000), (8, " " * 60000 + "x"), (9, "é😀 ñ\n# a | b"), (10, "it's we'll 12 34,5 !!")]


def odd(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in ODD], "doc_id bigint, text string, n_words string, kept int")


def brute_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(zip(w, w[1:], w[2:]))
    rep = {i + d for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for d in range(3)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def test_quality_matches_brute_force(spark):
    for df in (table(spark, SF, "documents"), odd(spark)):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                      for r in quality_cascade.apply(df).collect())
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            b = brute_base(r.text)
            want[(r.doc_id, *b, not b[-1] and not any(x.rejects(quality_cascade.Text(r.text)) for x in quality_cascade.RULES))] += 1
        assert got == want


def test_quality_order_does_not_change_the_verdict(spark):
    docs = table(spark, SF, "documents")
    a = quality_cascade.apply(docs, quality_cascade.RULES).select("doc_id", "kept")
    b = quality_cascade.apply(docs, quality_cascade.RULES[::-1]).select("doc_id", "kept")
    assert a.exceptAll(b).count() == 0


def test_quality_orders_by_rejections_per_second(spark):
    rules = quality_cascade.RULES[:3]
    names = [r.name for r in quality_cascade.order_rules({rules[0].name: (1.0, 5), rules[1].name: (0.1, 5), rules[2].name: (0.01, 0)}, rules)]
    assert names == [rules[1].name, rules[0].name, rules[2].name]
    assert set(quality_cascade.measure(table(spark, SF, "documents"), sample_rows=50)) == {r.name for r in quality_cascade.RULES}


def test_quality_finds_labelled_junk(spark):
    got = QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) == 0 and n.get((1, False), 0) <= 0.02 * n[1, True]


def test_quality_empty_table(spark):
    assert quality_cascade.apply(odd(spark).where("false")).count() == 0


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.load_encoding(RANKS)


def test_bpe_digests_match_the_library(spark, enc):
    for df in (table(spark, SF, "documents"), odd(spark)):
        out = byte_bpe.digests(byte_bpe.encode(df, RANKS, keep=["doc_id"]), RANKS)
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = enc.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert got == want


def test_bpe_safe_parts_give_the_same_ids(enc):
    rnd = random.Random(1)
    bits = ["a", "b", "é", " ", "  ", "\n", "\t", "　", "'s", "'", "1", "22", "!", "日本", "\x1c", "\x85", "\r\n", "😀"]
    for _ in range(2000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))
        assert "".join(byte_bpe.safe_parts(text, 3)) == text
        assert byte_bpe.encode_text(enc, text, part_chars=3) == enc.encode_ordinary(text)


def test_bpe_decodes_raw_bytes_of_cut_ids(spark):
    df = spark.createDataFrame([(1, "日本語 text")], "doc_id long, text string")
    ids = byte_bpe.encode(df, RANKS).withColumn("token_ids", F.slice("token_ids", 1, 1))
    got = byte_bpe.decode(ids, RANKS).first()
    assert "日本語".encode().startswith(bytes(got.decoded)) and got.text == "日本語 text"
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "token_ids array<int>"), RANKS).first().decoded is None
    assert byte_bpe.encode(odd(spark).where("false"), RANKS).count() == 0


def brute_warc(rows):
    first = {}
    for i, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    return sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                   "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, h in rows)


ODD_PAGES = [(1, "u", "same"), (2, "u\r\nX: y", "same"), (9, None, None), (4, "", ""), (5, "é", "é" * 300000), (6, "z", "same"), (7, "v", "\x1f� WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("split", [997, 8 << 20])
def test_warc_round_trip(spark, split):
    odd_pages = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string").withColumn("id", F.lit("x")).withColumn("payload", F.lit(1))
    for df in (table(spark, SF, "pages"), odd_pages):
        out = warc.round_trip(df, split_bytes=split, with_payload=True).collect()
        rows = [(r.page_id, r.html) for r in df.collect()]
        assert sorted((int(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in out) == brute_warc(rows)
        whole = dict(rows)
        assert all(bytes(r.payload) == ((whole[int(r.record_id)] or "").encode() if r.record_type == "response" else b"") for r in out)


def test_warc_query_and_large_min(spark):
    got = sorted(map(tuple, QUERIES["op8_warc"](spark, SF).collect()))
    assert got == brute_warc([(r.page_id, r.html) for r in table(spark, SF, "pages").collect()])
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string")
    types = {r.record_id: r.record_type for r in warc.round_trip(pages, min_revisit_bytes=5).collect()}
    assert set(types.values()) == {"response"}


def test_warc_repeated_and_null_ids_have_one_response(spark):
    pages = spark.createDataFrame([(1, "u", "p"), (1, "u", "p"), (None, "u", "p")], "page_id long, url string, html string")
    out = sorted((r.record_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert out == [("1", "response", None), ("1", "revisit", "1"), ("null", "revisit", "1")]
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_reader_skips_damage(tmp_path):
    members = [warc.gzip_member(warc.make_record(str(i), "u", b"payload %d" % i * 50, None)) for i in range(4)]
    members[1] = members[1][:40] + b"\x00" * 30 + members[1][70:]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"junk" + b"".join(members))
    size = path.stat().st_size
    for step in (13, 100, size):
        with open(path, "rb") as f:
            got = [r["record_id"] for s in range(0, size, step) for _, r in warc.read_range(f, s, min(size, s + step))]
        assert got == ["0", "2", "3"]


def test_few_distinct_words_means_the_same_at_every_length():
    rule = next(r for r in quality_cascade.RULES if r.name == "few_distinct_words")
    rnd = random.Random(4)
    few, many = [f"w{i}" for i in range(90)], [f"w{i}" for i in range(3000)]
    for n in (600, 1900, 2100, 50_000):
        assert rule.rejects(quality_cascade.Text(" ".join(rnd.choices(few, k=n))))
        assert not rule.rejects(quality_cascade.Text(" ".join(rnd.choices(many, k=n))))
