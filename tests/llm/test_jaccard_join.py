import random
import re

import pytest

from tessera.llm import jaccard_join
from tessera.llm.components import components
from tessera.llm.queries import QUERIES
from tessera.llm.text import table

SF = "/root/testdata/sf0.001"


def brute(rows, t=80):
    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(d, grams(x)) for d, x in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            k = len(x & y)
            if 100 * k >= t * (len(x) + len(y) - k):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return sorted(((d, len(x), None if d is None else find(d)) for d, x in sets), key=str)


def got(df, **more):
    return sorted((tuple(r) for r in jaccard_join.join_components(df, **more).collect()), key=str)


def test_documents_match_brute_force(spark):
    df = table(spark, SF, "documents")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert got(df) == want and any(d != c for d, _, c in want)
    assert sorted(map(tuple, QUERIES["op7_jaccard_join"](spark, SF).collect()), key=str) == want


def edited(rnd, words, share):
    return " ".join(w if rnd.random() >= share else f"e{rnd.randrange(10**9)}" for w in words)


def family_rows(n=120):
    """Near copies at every distance around the threshold, with a common line, chains and exact copies."""
    rnd, rows = random.Random(5), []
    common = "this line is common to very many of the documents here"
    for f in range(4):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([30, 80, 200]))]
        for i in range(n // 4):
            rows.append((len(rows) * 3 + 1, edited(rnd, base, rnd.choice([0, 0, 0.005, 0.01, 0.02, 0.03, 0.05])) + "\n" + common))
    chain = [f"c{i}" for i in range(80)]
    for i in range(12):
        rows.append((len(rows) * 3 + 1, " ".join(chain[i * 3:i * 3 + 44])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent", [jaccard_join.MAX_FREQUENT, 0])
def test_families_match_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", max(1, frequent))
    monkeypatch.setattr(jaccard_join, "FREQUENT_SHARE", 20)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 7)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 9)
    rows = family_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert got(df) == want and 4 < len({c for _, _, c in want}) < len(rows)


def test_shuffled_plan_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST", 0)
    rows = family_rows(40)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, long), (8, long + " tail"), (7, "a b c"), (9, "x y z"), (9, "x y z"), (None, "a b"), (None, long),
            (10, "lone text of its own that nothing else resembles")]
    df = spark.createDataFrame([(d, x, 1, "n") for d, x in rows], "doc_id long, text string, node int, component_id string")
    assert got(df) == brute(rows)
    assert got(df.where("false")) == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (500, 400)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[i] == 100 for i in range(100, 130)) and out[500] == out[400] == 400
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
