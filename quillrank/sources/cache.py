"""A cache of slow scores and encodings, by content.

A row's key is the MD5 of what was scored and the scorer's name. New rows are written as a run of their own, which readers see
only when its number stands in the manifest; that is one small file, written last. A task that is lost or a run that
ends early leaves nothing to see, and of rows that two runs have both computed readers take those of the run that is first by
name, so nothing is double.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Cache:
    def __init__(self, spark: SparkSession, path: str, scorer: str, kind: str = "double"):
        """scorer: a name with a version; another one has keys of its own. kind: the type of a value."""
        self.spark, self.path, self.scorer, self.kind = spark, path.rstrip("/"), scorer, kind

    def key(self, *parts: Column) -> Column:
        """Null parts differ from empty ones, and a part's end is no part of the next."""
        each = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in (c.cast("string") for c in parts)]
        return F.md5(F.concat(F.lit(f"{len(self.scorer)}:{self.scorer}"), *each))

    def known(self) -> DataFrame:
        """(key, value) of all published runs."""
        try:
            runs = [r["value"] for r in self.spark.read.text(f"{self.path}/manifest").distinct().collect()]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            runs = []
        schema = f"key string, value {self.kind}, run string"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/runs/{r}" for r in sorted(runs)]) if runs else self.spark.createDataFrame([], schema)
        return rows.groupBy("key").agg(F.min_by("value", "run").alias("value"))

    def fill(self, rows: DataFrame, parts: list[str], score: Callable[[DataFrame], DataFrame]) -> str | None:
        """Scores what no published run has. score: rows (key, parts), each key once -> (key, value). Returns the run's name, or
        None if nothing was new."""
        new = rows.select(self.key(*map(F.col, parts)).alias("key"), *parts).dropDuplicates(["key"]).join(self.known().select("key"), "key", "left_anti")
        run = uuid.uuid4().hex
        score(new).select("key", F.col("value").cast(self.kind).alias("value"), F.lit(run).alias("run")).write.parquet(f"{self.path}/runs/{run}")
        if self.spark.read.schema("key string").parquet(f"{self.path}/runs/{run}").isEmpty():
            return None
        self.publish(run)
        return run

    def publish(self, run: str) -> None:
        self.spark.createDataFrame([(run,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")

    def scored(self, rows: DataFrame, parts: list[str], score: Callable[[DataFrame], DataFrame], name: str = "score") -> DataFrame:
        """rows with their values, of which only unknown ones are computed."""
        self.fill(rows, parts, score)
        keyed = rows.withColumn("_key", self.key(*map(F.col, parts)))
        return keyed.join(self.known().select(F.col("key").alias("_key"), F.col("value").alias(name)), "_key", "left").drop("_key")
