import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa

from tessera.llm import spelling_groups as sg
from tessera.llm.queries import QUERIES
from tessera.llm.text import table

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    # words with the same text once a letter is masked, or one equal to the other without a letter
    masks, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            masks[w[:i] + "\0" + w[i + 1:]].add(w)
            if (v := w[:i] + w[i + 1:]) in n:
                near[w].add(v)
                near[v].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    out = {}
    for w, k in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        out[w] = best if best is not None and n[best] >= 10 * k else None

    def root(w):
        while out[w] is not None:
            w = out[w]
        return w
    return sorted((w, f or "", root(w), n[w], len(near[w]), n[f] if f else -1) for w, f in out.items())


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_groups_match_brute_force_on_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(QUERIES["op11_spelling_groups"](spark, SF)) == want
    assert sum(1 for w in want if w[1]) > 50 and len(want) > 10_000


def variants(rnd, word):
    i, c = rnd.randrange(len(word) + 1), rnd.choice("abcdeéß÷")
    return rnd.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]])


def test_odd_words(spark):
    """Chains of forms, ties, runs of one letter, long words, anagrams, Latin-1 letters, nulls and repeated rows."""
    rnd = random.Random(5)
    rows = [(None, None), (1, ""), (2, "!!"), (3, "short words only"), (None, "bananas bananas"), (4, "×÷éabcdef " * 3 + "ABCDEFG abcdefg")]
    words = ["aaaaaaaa", "aaaaaaaaa", "bananas", "listened", "enlisted", "thingsthings", "x" * 70, "y" * 30 + "z" * 60, "caféterie"]
    for k, w in enumerate(words):
        rows.append((10 + k, " ".join([w] * 300)))
        for _ in range(30):
            v = variants(rnd, w)
            rows.append((rnd.randrange(50), " ".join([v] * rnd.choice([1, 2, 3, 29, 30]))))
            rows.append((rnd.randrange(50), " ".join([variants(rnd, v)] * 2)))
    rows += rows[-40:]
    schema = "doc_id long, text string, word string, n string, form int, root int, key int"
    df = spark.createDataFrame([(d, t, "w", "n", 1, 2, 3) for d, t in rows], schema)
    assert got(sg.group(df)) == brute(rows)
    assert got(sg.group(df.repartition(13))) == brute(rows)


def test_empty_table(spark):
    assert sg.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sg.group(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0


def test_near_words_share_a_signature():
    rnd = random.Random(3)
    for _ in range(3000):
        w = "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(7, 40)))
        a, b = sorted([w.encode("latin-1"), variants(rnd, w).encode("latin-1", "ignore")], key=len)
        if a == b:
            continue
        keys = [{(k, r) for k, r, _, _ in sg.signatures(x)} for x in (a, b)]
        role = len(b) - len(a)
        assert {k for k, r in keys[0] if r == 0} & {k for k, r in keys[1] if r == role}
        assert sg.one_edit(a, b) is not None


def test_each_near_pair_is_found_once():
    """All words under all their keys: every pair comes back exactly once."""
    rnd = random.Random(11)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(7, 9))).encode() for _ in range(1500)} | {b"q" * 66, b"q" * 67, b"q" * 65 + b"r"})
    rows = sorted((k, w, 1, win << 3 | p << 1 | role) for w in words for k, role, win, p in sg.signatures(w))
    key, word, n, meta = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(word, pa.binary()), pa.array(n), pa.array(meta, pa.int32())], names=["key", "word", "n", "meta"])
    out = sg._best(batch)
    got = Counter()
    for w, n_near in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):  # a row a group
        got[w] += n_near
    want = Counter(x for i, a in enumerate(words) for b in words[i + 1:] if sg.one_edit(*sorted((a, b), key=len)) for x in (a, b))
    assert got == want


def test_a_batch_whose_pairs_all_count_elsewhere_gives_nothing():
    words = [b"abcdefg", b"abcdefh"]
    by = [{(r, win, p): k for k, r, win, p in sg.signatures(w)} for w in words]
    shared = [(k, s) for s, k in by[0].items() if by[1].get(s) == k]
    outs = []
    for k, (role, win, p) in shared:
        batch = pa.RecordBatch.from_arrays([pa.array([k, k]), pa.array(words, pa.binary()), pa.array([5, 2]), pa.array([win << 3 | p << 1 | role] * 2, pa.int32())], names=["key", "word", "n", "meta"])
        outs.append(sg._best(batch))
    assert len(shared) > 1 and sum(o is not None for o in outs) == 1
