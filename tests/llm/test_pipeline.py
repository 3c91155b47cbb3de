import hashlib
import random

import public_tokenizers

import corpus_pipeline
from tessera.llm import byte_bpe, toxicity
from tests_llm_brute import components_of, leaks_of, lines_of


def corpus():
    rnd = random.Random(21)
    vocab = ["".join(rnd.choice("aeiourstlnm") for _ in range(rnd.randint(3, 8))) for _ in range(800)]
    words = lambda n: " ".join(rnd.choices(vocab, k=n))
    item = words(30)
    rows = []
    for i in range(160):  # toxic every fourth; a header and a footer on all
        body = words(60) + (" scumbag" if i % 4 == 0 else "") + "\n" + words(40)
        rows.append((i, f"Header of page {i} on this site\n{body}\nfooter " + "z" * (i + 1)))
    base = words(120)
    rows += [(200 + k, base.replace(base.split()[k * 7], "changed", 1)) for k in range(9)]
    rows += [(300, f"{words(300)} {item} {words(300)}"), (301, item), (302, None), (303, ""), (None, words(50)), (304, "you scumb4g " + words(40)), (305, words(9000))]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)]
    return rows, labels, [(1, item), (2, words(25)), (3, None)]


def write(spark, path, rows, labels, items):
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    write(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).scorer()
    kept = [(d, t) for d, t in rows if score(t) < 0.5]
    assert {d for d, _ in rows} - {d for d, _ in kept} == {i for i in range(0, 160, 4)} | {304}
    lined = lines_of(kept)
    assert sum(a != b for a, b in zip(kept, lined)) >= 100
    comp = components_of(lined)
    single = [(d, t) for d, t in lined if d is None or comp[d] == d]
    assert len(single) < len(lined)
    clean = [(d, t) for d, t in single if not leaks_of(t, items)]
    assert {d for d, _ in single} - {d for d, _ in clean} == {300, 301}
    enc = byte_bpe.load_encoding(public_tokenizers.path(byte_bpe.RANKS))
    want = []
    for d, t in clean:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_stages_return_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
