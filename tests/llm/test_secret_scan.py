import hashlib
import re
from collections import defaultdict

from tessera.llm import secret_scan as ss
from tessera.llm.queries import QUERIES
from tessera.llm.text import table

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(doc, owner, text) to (n of each kind, digest, spans, n of each verdict), by the definition."""
    pats = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"), re.compile("[A-Za-z0-9+/_-]{20,}")]
    least = [8, 16, 32, 20]
    found, owners = [], defaultdict(set)
    for _, owner, text in rows:
        own = [(m.start(), k, m.end(), m[2] if k == 0 else m[0]) for k in range(3) for m in pats[k].finditer(text or "") if len(m[2] if k == 0 else m[0]) >= least[k]]
        looks = lambda v: re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and not re.search(ss.PLACEHOLDERS, v)
        own += [(m.start(), 3, m.end(), m[0]) for m in pats[3].finditer(text or "") if looks(m[0]) and not any(k < 3 and s < m.end() and e > m.start() for s, k, e, _ in own)]
        found.append(sorted(own))
        for x in own:
            owners[x[3]].add(owner)
    out = []
    for (d, _, _), own in zip(rows, found):
        said = []
        for s, k, e, v in own:
            plain, n = re.search(ss.PLACEHOLDERS, v), len(owners[v])
            verdict = "example" if plain or n >= 3 else "live" if n == 1 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) else "shared"
            if k < 3 or verdict == "live":
                said.append((k, f"{ss.KINDS[k]}:{s}:{e}", verdict))
        out.append((str(d), *(sum(k == i for k, _, _ in said) for i in range(4)), hashlib.sha256(",".join(t for k, t, _ in said if k < 3).encode()).hexdigest(), ",".join(t for _, t, _ in said),
                    *(sum(v == x for _, _, v in said) for x in ("live", "shared", "example"))))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.n_owned, r.base_sha256, r.spans, r.n_live, r.n_shared, r.n_example) for r in df.collect())


def test_scan_matches_brute_force_on_the_tables(spark):
    rows = [(r.doc_id, r.source, r.text) for r in table(spark, SF, "documents").collect()]
    assert got(QUERIES["op12_secret_scan"](spark, SF)) == brute(rows)


HEX, LIVE = "0123456789abcdef" * 2, "Zk3v9QpLr7TnX2mWb8Ys"
ODD = [(1, "a", f'password="hunter2000" token: {LIVE} {LIVE}'), (2, "b", f"x{LIVE}y {HEX} api_key = '{HEX}'"), (3, "a", None), (None, None, f"{HEX}{HEX}"), (4, "c", ""),
       (5, "c", "token=secret:abcdefgh token==abcdefgh TOKEN  =   Abcdefg1 apikey:1234567"), (6, "a", "AKIAAKIA1234 AKIAAKIA12345678 AKIA" + "Z" * 40), (7, "a", f"é😀 {LIVE}A tokKen=abcdefgh1 ſecret=abcdefgh1"),
       (8, "b", f"{LIVE}A"), (9, "d", "passwd:your_example_key1 secret=aaaaaaaaaa"), (10, "e", HEX), (11, "f", HEX), (12, "g", f"token={LIVE}"), (12, "g", f"token={LIVE}"),
       (13, "h", "token=abcdefgh1 " * 4000), (14, "h", "Aa1" * 40000), (15, "h", "pass" * 30000), (16, "i", f"Q9{HEX}zZ" * 2 + f" token={LIVE}Q/{LIVE}")]


def test_odd_texts(spark):
    df = spark.createDataFrame([(d, o, t, "x", 1, 2) for d, o, t in ODD], "doc_id long, source string, text string, row string, kind int, assign int")
    out = ss.scan(df)
    assert out.columns == ["doc_id", "source", "row", "kind", "assign", "secrets"]
    assert got(ss.report(out)) == brute(ODD)


def test_ownership_tells_live_from_copied(spark):
    """A value in many repositories of one owner stays live; one held by three owners is an example."""
    rows = [(i, "me", f"token={LIVE}") for i in range(40)] + [(100 + i, f"o{i}", f"secret: {HEX[1:]}") for i in range(3)] + [(200 + i, f"o{i}", f"key {LIVE[::-1]}") for i in range(2)]
    out = {r.doc_id: r for r in ss.report(ss.scan(spark.createDataFrame(rows, "doc_id long, source string, text string"))).collect()}
    assert all(out[i].n_live == 1 for i in range(40))
    assert all(out[100 + i].n_example == 1 for i in range(3))
    assert all(out[200 + i].spans == "" for i in range(2))  # two owners: no span is added


def test_main_path_is_native(spark):
    df = ss.report(ss.scan(table(spark, SF, "documents")))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_empty_table(spark):
    assert ss.report(ss.scan(spark.createDataFrame([], "doc_id long, source string, text string"))).count() == 0
