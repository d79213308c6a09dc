"""Readers and writers. Schemas are declared; nothing is inferred."""

from __future__ import annotations

import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "citation STRING, text STRING"
LAWS = "citation STRING, title STRING, text STRING"
QUERIES = "query_id STRING, query STRING, query2 STRING, gold_citations STRING"
IDF = "citation STRING, idf DOUBLE"
RANKING = "query_id STRING, gold_citations ARRAY<STRING>, cc_list ARRAY<STRUCT<cc_id: STRING, dense_score: DOUBLE, sparse_score: DOUBLE, rerank_score: DOUBLE, text: STRING>>"
SENTENCES = "query_id STRING, query STRING, gold_citations ARRAY<STRING>, cc_list ARRAY<STRUCT<cc_id: STRING, rerank_score: DOUBLE, cc_sentences: ARRAY<STRUCT<sent_id: INT, text: STRING>>>>"
EMBEDDINGS = "chunk_id BIGINT, parent_id BIGINT, embedding ARRAY<FLOAT>"
HITS = "query_id STRING, doc_id STRING, source STRING, score DOUBLE, rank INT"
POSTINGS = "doc_id STRING, term STRING, weight DOUBLE, bucket INT"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, least_columns: int = 0, limit: int | None = None) -> DataFrame:
    """CSV with quoted line breaks. Rows whose first ``least_columns`` columns hold a null go; limit is the reader's own."""
    df = spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    if least_columns:
        df = df.na.drop(subset=df.columns[:least_columns])
    return df if limit is None else df.limit(limit)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "text")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDINGS).parquet(path)


def read_hits(spark: SparkSession, path: str, corpus: DataFrame) -> DataFrame:
    """Hits with their texts; a hit without a text is an error."""
    hits = spark.read.schema(HITS).parquet(path)
    joined = hits.join(corpus.select(F.col("citation").alias("doc_id"), "text", F.lit(True).alias("_known")), "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("_known"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no text for "), F.col("doc_id"))).cast("string"))).drop("_known")


def write_hits(hits: DataFrame, path: str) -> None:
    """Without texts, which are joined when read."""
    hits.select("query_id", "doc_id", "source", "score", "rank").write.mode("overwrite").partitionBy("source").parquet(path)


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Sparse index: partitioned by the term's bucket, so that a search reads its terms' buckets alone."""
    postings.withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = 64) -> DataFrame:
    df = spark.read.parquet(path)
    if terms is not None:
        import zlib

        df = df.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % buckets for t in terms})) & F.col("term").isin(terms))
    return df.drop("bucket")


def write_submission(answers: DataFrame, path: str) -> None:
    """One CSV with query_id and predicted_citations; an answer is a row a query."""
    answers.select("query_id", "predicted_citations").orderBy("query_id").coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_lines(rows: DataFrame, path: str, column: str = "text") -> None:
    rows.select(F.regexp_replace(F.col(column).cast("string"), r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def append_missing(rows: DataFrame, path: str, key: str, compute) -> None:
    """Resume: compute(rows that path lacks by key) is appended."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    compute(rows).write.mode("append").parquet(path)


def read_synonyms(spark: SparkSession, path: str, skip: tuple[str, ...] = ("README", "Instructions")) -> DataFrame:
    """(term, synonym), symmetric, from a workbook: each row of each sheet has a main term and ";"-lists of synonyms and of
    related terms. Read on the driver: workbooks are small and no store splits them."""
    pairs = set()
    for name, rows in _workbook(path).items():
        if name in skip:
            continue
        for row in rows:
            cells = [[x.strip().lower() for x in (c or "").split(";") if x.strip()] for c in row[:3]]
            if cells and cells[0]:
                for other in {x for c in cells[1:] for x in c}:
                    pairs |= {(cells[0][0], other), (other, cells[0][0])}
    return spark.createDataFrame(sorted(pairs), "term STRING, synonym STRING")


def _workbook(path: str) -> dict[str, list[list[str]]]:
    """Sheets of an XLSX file as rows of texts."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns)]
        out = {}
        for i, name in enumerate(sheets, 1):
            rows = []
            for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{ns['m']}}}row"):
                cells: dict[int, str] = {}
                for c in r.findall("m:c", ns):
                    letters = "".join(x for x in c.get("r", "A") if x.isalpha())
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    v, inline = c.find("m:v", ns), c.find("m:is", ns)
                    text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else (v.text or "" if v is not None else "")
                    cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text else text
                rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            out[name] = rows
    return out
