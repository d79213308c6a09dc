"""Readers and writers against Python's own, with quotes, line breaks, letters beyond ASCII, nulls and empty tables."""

import csv
import glob
import json
import zipfile

import pytest
from pyspark.errors import PySparkException

from quillrank.sources import io

ODD = ["plain", 'a "quoted" one', "two\nlines", "Ärger, größer; «né»", "", " blanks "]


def part(path, end):
    (name,) = glob.glob(f"{path}/part-*{end}")
    return name


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate([*ODD, None])), "id int, text string")
    io.write_jsonl(rows, str(tmp_path / "out"))
    lines = [x for f in glob.glob(f"{tmp_path}/out/part-*") for x in open(f, encoding="utf-8")]
    assert sorted((json.loads(x)["id"], json.loads(x).get("text")) for x in lines) == list(enumerate([*ODD, None]))
    assert any("größer" in x for x in lines)  # not escaped
    assert sorted(map(tuple, io.read_jsonl(spark, str(tmp_path / "out"), "id int, text string").collect())) == list(enumerate([*ODD, None]))
    (tmp_path / "blank.jsonl").write_text('{"id": 1}\n\n   \n{"id": 2, "other": []}\n')
    assert sorted(r["id"] for r in io.read_jsonl(spark, str(tmp_path / "blank.jsonl"), "id int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id int").collect()


def test_lines(spark, tmp_path):
    rows = spark.createDataFrame([(t,) for t in [*ODD, "x\r\n\ny"]], "text string")
    io.write_lines(rows, str(tmp_path / "out"))
    got = sorted(r["text"] for r in io.read_lines(spark, str(tmp_path / "out")).collect())
    assert got == sorted(["plain", 'a "quoted" one', "two lines", "Ärger, größer; «né»", " blanks ", "x y"])
    io.write_lines(rows.where("false"), str(tmp_path / "none"))
    assert io.read_lines(spark, str(tmp_path / "none")).isEmpty()


def test_submission(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{9 - i}", t, i) for i, t in enumerate(ODD) if t], "query_id string, predicted_citations string, more int").repartition(3)
    io.write_submission(rows, str(tmp_path / "out"))
    with open(part(tmp_path / "out", ".csv"), newline="", encoding="utf-8") as f:
        got = list(csv.reader(f))
    assert got[0] == ["query_id", "predicted_citations"] and [r[0] for r in got[1:]] == sorted(r[0] for r in got[1:])
    assert [r[1] for r in got[1:]] == [t.strip() for t in reversed(ODD) if t]


def test_csv(spark, tmp_path):
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([["citation", "text"], *([str(i), t] for i, t in enumerate(ODD))])
    got = io.read_csv(spark, str(tmp_path / "a.csv"), io.CORPUS)
    assert sorted((r["citation"], r["text"] or "") for r in got.collect()) == [(str(i), t) for i, t in enumerate(ODD)]
    assert sorted(r["citation"] for r in io.read_csv(spark, str(tmp_path / "a.csv"), io.CORPUS, least_columns=2).collect()) == ["0", "1", "2", "3", "5"]
    assert io.read_csv(spark, str(tmp_path / "a.csv"), io.CORPUS, limit=2).count() == 2
    assert io.read_csv(spark, str(tmp_path / "a.csv"), io.CORPUS, header=False).count() == 7


def test_hits_and_their_texts(spark, tmp_path):
    hits = spark.createDataFrame([("q", "a", "dense", 0.5, 1), ("q", "b", "sparse", 0.25, 1), ("r", "a", "sparse", 1.0, 1)], io.HITS)
    corpus = spark.createDataFrame([("a", "A"), ("b", None), ("c", "C")], io.CORPUS)
    path = str(tmp_path / "hits")
    io.write_hits(hits, path)
    got = io.read_hits(spark, path, corpus)
    assert sorted((r["query_id"], r["doc_id"], r["source"], r["score"], r["text"]) for r in got.collect()) == [("q", "a", "dense", 0.5, "A"), ("q", "b", "sparse", 0.25, None), ("r", "a", "sparse", 1.0, "A")]
    with pytest.raises(PySparkException, match="no text for b"):
        io.read_hits(spark, path, corpus.where("citation != 'b'")).collect()
    assert "source=dense" in str(glob.glob(f"{path}/*"))


def test_embeddings(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, [0.5, 1.0]), (2, None, [])], io.EMBEDDINGS)
    rows.write.parquet(str(tmp_path / "e"))
    assert sorted(map(tuple, io.read_embeddings(spark, str(tmp_path / "e")).collect())) == [(1, 7, [0.5, 1.0]), (2, None, [])]


def sheet(rows):
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{t}</t></is></c>' if not isinstance(t, int) else f'<c r="{chr(65 + k)}{i}" t="s"><v>{t}</v></c>' for k, t in enumerate(r) if t is not None) + "</row>" for i, r in enumerate(rows, 1))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'


def test_synonyms(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="README" sheetId="1"/><sheet name="Terms" sheetId="2"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Kauf</t></si><si><r><t>Er</t></r><r><t>werb; Ankauf</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet([["not", "read"]]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([[0, 1, "Handel"], ["Miete", None, "Pacht; "], [None, "lost"]]))
    got = {tuple(r) for r in io.read_synonyms(spark, str(tmp_path / "s.xlsx")).collect()}
    one_way = {("kauf", "erwerb"), ("kauf", "ankauf"), ("kauf", "handel"), ("miete", "pacht")}
    assert got == one_way | {(b, a) for a, b in one_way}
