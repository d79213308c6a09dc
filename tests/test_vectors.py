"""Numbered matrices: cut into shards, read up to the first gap, with the lines beside them."""

import glob
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillrank.sources import vectors


@pytest.fixture
def rows(spark):
    data = [(i * 7 % 100, [float(i), i / 3, -1.0], f"c {i}\n«x»" if i % 3 else None) for i in range(100)]
    return spark.createDataFrame(data, "id int, e array<float>, cite string").repartition(7)


def want(rows):
    return [(i, r["id"], r["cite"], list(r["e"])) for i, r in enumerate(sorted(rows.collect(), key=lambda r: r["id"]))]


def test_round_trip_and_gap(spark, rows, tmp_path):
    path = str(tmp_path / "v")
    vectors.write(rows, path, ["id"], "e", "id", ["id", "cite"], size=16)
    assert sorted(os.listdir(path)) == sorted([f"{i}.npy" for i in range(7)] + ["parent.txt", "meta.jsonl"])
    assert [np.load(f"{path}/{i}.npy").shape for i in (0, 6)] == [(16, 3), (4, 3)]
    all_ = want(rows)
    for most in (3, 16, 1000):  # rows of a partition
        got = vectors.read(spark, path, True, "id int, cite string", rows=most)
        assert sorted((r["row"], r["id"], r["cite"], list(r["v"])) for r in got.collect()) == all_
        assert got.where("parent_id != id").isEmpty()
    os.rename(f"{path}/3.npy", f"{path}/later.npy")
    got = vectors.read(spark, path, True, "id int, cite string")
    assert sorted((r["row"], r["parent_id"], r["cite"], list(r["v"])) for r in got.collect()) == all_[:48]
    os.rename(f"{path}/0.npy", f"{path}/none.npy")
    assert vectors.read(spark, path, True).isEmpty()


def test_foreign_files(spark, tmp_path):
    """As NumPy writes them, in halves and doubles, with one plain file of parents."""
    x = np.arange(30, dtype=np.float64).reshape(10, 3)
    np.save(tmp_path / "0.npy", x[:4].astype(np.float16))
    np.save(tmp_path / "1.npy", x[4:4])
    np.save(tmp_path / "2.npy", x[4:])
    (tmp_path / "parent.txt").write_text("".join(f" {i // 2} \n" for i in range(12)))
    got = sorted((r["row"], r["parent_id"], list(r["v"])) for r in vectors.read(spark, f"file:{tmp_path}", True, rows=3).collect())
    assert got == [(i, i // 2, list(x[i])) for i in range(10)]
    (tmp_path / "parent.txt").write_text("0\n" * 9)
    with pytest.raises(PySparkException, match="no line for vector 9"):
        vectors.read(spark, str(tmp_path), True).collect()
    np.save(tmp_path / "1.npy", np.arange(3))
    with pytest.raises(PySparkException, match="matrix of floats"):
        vectors.read(spark, str(tmp_path)).collect()


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    texts = [f"line {i}" if i % 5 else "" for i in range(200)]
    for n in range(4):
        (tmp_path / f"part-{n}.txt").write_text("\n".join(texts[n * 50 : n * 50 + 50]) + "\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("37b", "100b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = sorted(map(tuple, vectors.numbered_lines(spark, str(tmp_path)).collect()))
            assert got == list(enumerate(texts)), size
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_what_a_failed_write_leaves(spark, rows, tmp_path):
    path = str(tmp_path / "v")
    for bad in (F.expr("if(id = 50, null, e)"), F.expr("if(id = 50, array(1f), e)"), F.expr("if(id = 50, array(1f, null, 2f), e)")):
        with pytest.raises(PySparkException):
            vectors.write(rows.withColumn("e", bad), path, ["id"], "e", size=16)
        assert not glob.glob(f"{path}/**", recursive=True) or os.listdir(path) == []
    vectors.write(rows, path, ["id"], "e", size=16)
    with pytest.raises(PySparkException, match="holds shards"):
        vectors.write(rows, path, ["id"], "e", size=16)
    vectors.write(rows.where("id < 20"), path, ["id"], "e", size=16, overwrite=True)
    assert sorted(os.listdir(path)) == ["0.npy", "1.npy"]
    vectors.write(rows, path, ["id"], "e", size=16, overwrite=True)
    os.remove(f"{path}/2.npy")
    vectors.write(rows.withColumn("e", F.expr("transform(e, x -> 0f)")), path, ["id"], "e", size=16, skip_existing=True)
    got = {r["row"]: list(r["v"]) for r in vectors.read(spark, path).collect()}
    assert got == {i: [0.0] * 3 if 32 <= i < 48 else v for i, _, _, v in want(rows)}


def test_empty_table_and_clashing_names(spark, rows, tmp_path):
    vectors.write(rows.where("false"), str(tmp_path / "none"), ["id"], "e", "id", ["cite"])
    assert vectors.read(spark, str(tmp_path / "none"), True, "cite string").isEmpty()
    clash = rows.withColumnsRenamed({"id": "row", "e": "at", "cite": "v"})
    vectors.write(clash, str(tmp_path / "clash"), ["row"], "at", "row", ["v"], size=64)
    got = vectors.read(spark, str(tmp_path / "clash"), True)
    assert sorted((r["row"], r["parent_id"], list(r["v"])) for r in got.collect()) == [(i, k, v) for i, k, _, v in want(rows)]
