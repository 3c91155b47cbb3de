"""CSV files read in many byte ranges against the whole text at once; sparse row tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import from_dense, to_dense
from tessera.session import shared_dir
from tessera.sources.io import read_csv_matrix, read_lines, read_sparse_cells, write_sparse_rows

END = {"newline": "\n", "none": "", "blanks": "\n\n  \n", "crlf": "\r\n"}


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def whole(text):
    return [line.rstrip() for line in text.rstrip().replace("\r\n", "\n").split("\n")] if text.strip() else []


@pytest.mark.parametrize("end", sorted(END))
def test_many_ranges_of_one_file(spark, tmp_path, small_ranges, end):
    m = np.random.default_rng(5).integers(0, 100_000, (300, 9))
    sep = "\r\n" if end == "crlf" else "\n"
    text = sep.join(" , ".join(f"{v / 100_000:.5f}" for v in row) for row in m) + END[end]
    (tmp_path / "m.csv").write_bytes(text.encode())
    path = f"file://{tmp_path}/m.csv"
    assert spark.read.text(path).select(F.spark_partition_id()).distinct().count() > 4
    lines = read_lines(spark, path).orderBy("i").collect()
    assert [(r.i, r.line) for r in lines] == list(enumerate(whole(text)))
    assert (to_dense(read_csv_matrix(spark, path), m.shape) == m).all()


def test_several_files_long_lines_and_empty_ones(spark, tmp_path, small_ranges):
    texts = {"a": "1,2\n\n3,4\n", "b": "", "c": " \n \n", "d": ",".join(map(str, range(4000))) + "\n5", "e": "\n".join(map(str, range(3000)))}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = {}
    for r in read_lines(spark, f"file://{tmp_path}/").orderBy("f", "i").collect():
        got.setdefault(r.f[-5], []).append((r.i, r.line))
    assert got == {n: list(enumerate(whole(t))) for n, t in texts.items() if t.strip()}


def test_sparse_rows_roundtrip_with_long_rows(spark):
    rows = [(1, j, j + 1) for j in range(0, 400_000, 7)] + [(5, 65_536, 3), (5, 65_535, -2), (9, 10 ** 12, 4), (9, 3, 0)]
    cells = spark.createDataFrame(rows, "i bigint, j bigint, v bigint")
    path = f"{shared_dir(spark)}/test-sparse-{np.random.default_rng().integers(1 << 40)}"
    write_sparse_rows(cells, path)
    back = read_sparse_cells(spark, path, "bigint")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert spark.read.parquet(path).agg(F.max(F.size("js"))).first()[0] <= 65_536
    assert "PushedFilters: [IsNotNull(i), LessThan(i,5)]" in back.where("i < 5")._jdf.queryExecution().toString()
    write_sparse_rows(from_dense(spark, np.zeros((2, 2))), path + "-empty")
    assert read_sparse_cells(spark, path + "-empty").count() == 0
