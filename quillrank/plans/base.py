"""What the queries share: the test tables in the roles of corpus, hits, citation graph and gold, in both engines.

hits: orders as documents, scored, for 200 groups of customers as queries. edge: lineitem as citations of orders by
parts. gold: parts returned in quantity by a query's customers. legal: a text for each order, put together from its
line items, with citations of all families.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HITS = "hits AS (SELECT o_custkey % 200 AS query_id, o_orderkey AS doc_id, o_totalprice / 312347 AS score FROM orders)"
EDGE = "edge AS (SELECT l_orderkey AS doc_id, l_partkey AS citation, l_linenumber - 1 AS pos, l_extendedprice / 70001 AS price FROM lineitem)"
GOLD = "gold AS (SELECT DISTINCT o_custkey % 200 AS query_id, l_partkey AS citation FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45)"
SENTENCE = """CASE CAST(l_suppkey % 5 AS INT)
 WHEN 0 THEN concat('Gemäss Art. ', CAST(l_partkey % 400 + 1 AS VARCHAR(9)), ' Abs. ', CAST(l_linenumber AS VARCHAR(9)), ' OR gilt dies.')
 WHEN 1 THEN concat('Nach SR 220 Art. ', CAST(l_partkey % 90 + 1 AS VARCHAR(9)), ' ist dies zu prüfen!')
 WHEN 2 THEN concat('Vgl. dazu BGE ', CAST(100 + l_partkey % 40 AS VARCHAR(9)), ' II ', CAST(l_partkey % 300 + 1 AS VARCHAR(9)), ' E. ', CAST(l_linenumber AS VARCHAR(9)), '.')
 WHEN 3 THEN concat('Art. ', CAST(l_partkey % 60 + 1 AS VARCHAR(9)), ' ZGB und Art. 8 Abs. 2 StPO sind anwendbar.')
 ELSE 'Kein Verweis steht in diesem Satz?' END"""
LEGAL = f"legal AS (SELECT l_orderkey AS doc_id, string_agg(s, ' ' ORDER BY l_linenumber, s) AS text FROM (SELECT l_orderkey, l_linenumber, {SENTENCE} AS s FROM lineitem) GROUP BY l_orderkey)"
SCORES = "scores AS (SELECT query_id, citation, round(max(score), 6) AS score FROM hits JOIN edge USING (doc_id) GROUP BY query_id, citation)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS rank FROM scores)"
IDFS = "idfs AS (SELECT citation, count(DISTINCT doc_id) AS df, ln((SELECT count(DISTINCT doc_id) FROM edge) / (1.0 + count(DISTINCT doc_id))) AS idf FROM edge GROUP BY citation)"
FIRST = "firsts AS (SELECT doc_id, citation, min(pos) AS pos FROM edge GROUP BY doc_id, citation)"
QS = "qs AS (SELECT DISTINCT query_id FROM hits)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("query_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice") / 312347).alias("score"))


def edge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("citation"), (F.col("l_linenumber") - 1).alias("pos"), (F.col("l_extendedprice") / 70001).alias("price"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select((F.col("o_custkey") % 200).alias("query_id"), F.col("l_partkey").alias("citation")).distinct()


def legal(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").selectExpr("l_orderkey as doc_id", "l_linenumber as n", f"{SENTENCE} as s")
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), " ").alias("text"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).join(edge(spark, d), "doc_id").groupBy("query_id", "citation").agg(F.round(F.max("score"), 6).alias("score"))


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("query_id").distinct()


def shaped(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, fractions rounded to six digits: the same in both engines."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((c.cast("long") if kind in ("int", "smallint", "tinyint", "boolean") else F.round(c.cast("double"), 6) if kind in ("float", "double") or kind.startswith("decimal") else c).alias(name))
    return df.select(*out)


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, d, f=f: shaped(f(spark, d))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def with_(*parts: str) -> str:
    return "WITH " + re.sub(r"(\w+) AS \((?=SELECT|WITH)", r"\1 AS MATERIALIZED (", ", ".join(parts)) + " "
