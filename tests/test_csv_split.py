"""Records of CSV files cut at every byte, against the reader that takes a file as a whole and Python's own."""

import csv
import io

import pytest

from quillrank.sources import csv_split

ROWS = [["citation", "text"], ["a", 'one "two"\n"three"'], ["b", ""], ["c,d", "\n\n"], ["é", 'x\ny""z,"'], ["last", "no break"], ['"', "ü\n" * 9]]


def write(path, rows, end="\n", tail=""):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)
    path.write_bytes((out.getvalue() + tail).encode())
    return len(out.getvalue().encode())


@pytest.fixture
def splits(spark):
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}

    def cut(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield cut
    for k, v in kept.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_cut_at_every_byte(spark, splits, tmp_path):
    size = write(tmp_path / "a.csv", ROWS)
    read = lambda: sorted(map(tuple, csv_split.read_csv(spark, str(tmp_path / "a.csv"), ["citation", "text"]).collect()))
    want = sorted(map(tuple, ROWS[1:]))
    splits(1 << 20)
    assert read() == want == sorted((r[0], r[1] or "") for r in spark.read.csv(str(tmp_path / "a.csv"), header=True, multiLine=True, escape='"').collect())
    for n in [*range(1, 12), *range(12, size, 7)]:  # every byte is a border of some
        splits(n)
        assert read() == want, n


def test_several_files_and_odd_records(spark, splits, tmp_path):
    write(tmp_path / "a.csv", ROWS, "\r\n")
    write(tmp_path / "b.csv", [["citation", "text", "more"], ["one"], ["x", "y", "z"]], tail="\n\n")
    write(tmp_path / "c.csv", [["citation", "text"]], tail='open,"never closed\n1\n2')
    (tmp_path / "d.csv").write_text("")
    want = sorted([tuple(r) for r in ROWS[1:]] + [("x", "y"), ("open", "never closed\n1\n2")])
    for n in (5, 17, 1 << 20):
        splits(n)
        got = csv_split.read_csv(spark, str(tmp_path), ["citation", "text"], least=2)
        assert sorted(map(tuple, got.collect())) == want
    one = csv_split.read_csv(spark, str(tmp_path / "b.csv"), ["citation", "text", "more", "none"], header=False)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted([("citation", "text", "more", None), ("one", None, None, None), ("x", "y", "z", None)], key=repr)


def test_many_splits_without_broadcast(spark, splits, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_split, "FEW_SPLITS", 1)
    write(tmp_path / "a.csv", ROWS)
    splits(9)
    assert sorted(map(tuple, csv_split.read_csv(spark, str(tmp_path), ["citation", "text"]).collect())) == sorted(map(tuple, ROWS[1:]))
