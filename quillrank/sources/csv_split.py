"""CSV with quoted line breaks, read in splits.

The reader's own multiLine option makes a file one task. Here files are read as lines, in splits by byte ranges, in two passes:
the first counts each split's quotes, whose running parity tells if a split starts within quotes; the second cuts records at
true line ends. A record that goes on over a split's end comes in fragments, at most two a split, which are put together by
their order.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits up to which the parities are broadcast: some tens of megabytes.
FEW_SPLITS = 200_000
WHOLE, OPENS, WITHIN, CLOSES = range(4)
_ROWS = "file string, block long, seq long, kind int, body string, fields array<string>"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _quotes(quote: str) -> Column:
    return F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))


def parities(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(file, block, within): whether a split starts within quotes."""
    each = lines.groupBy("file", "block").agg((F.sum(_quotes(quote)) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("within"))


def fields(record: str, separator: str, quote: str) -> list[str]:
    """The fields of one record; none of an empty one."""
    csv.field_size_limit((1 << 31) - 1)
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=separator, quotechar=quote), [])


def _records(separator: str, quote: str, whole: bool):
    """For rows (file, block, within, value), a split's lines in order and next to each other: its whole records, parsed, or
    else its fragments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seq, inside, kind, held, out = None, 0, False, WHOLE, [], []

        def end() -> None:
            """The split's last record goes on in the next one."""
            if inside and not whole:
                out.append((*at, seq, WITHIN if kind == CLOSES else OPENS, "\n".join(held), None))

        for pdf in batches:
            for file, block, within, value in zip(pdf["file"], pdf["block"], pdf["within"], pdf["value"], strict=True):
                if (file, block) != at:
                    end()
                    at, seq, inside, held = (file, block), 0, within, []
                    kind = CLOSES if within else WHOLE
                held.append(value)
                inside ^= value.count(quote) % 2 == 1
                if not inside:
                    if kind == WHOLE and whole:
                        out.append((*at, seq, kind, None, fields("\n".join(held), separator, quote)))
                    elif kind == CLOSES and not whole:
                        out.append((*at, seq, kind, "\n".join(held), None))
                    seq, kind, held = seq + 1, WHOLE, []
            yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "body", "fields"])
            out = []
        if at:
            end()
        yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "body", "fields"])

    return run


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str], header: bool = True, least: int = 1, separator: str = ",", quote: str = '"') -> DataFrame:
    """Records as string columns, by position: a missing field is null, a further one is left out; records of fewer than ``least``
    fields are skipped, blank lines with them. A quote within quotes is doubled; quotes must not stand in fields without
    quotes. header: each file's first record is none. A file whose last quote isn't closed ends with a record."""
    lines = _lines(spark, path)
    starts = parities(lines, quote)
    if starts.count() <= FEW_SPLITS:
        rows = lines.join(F.broadcast(starts), ["file", "block"])
    else:
        rows = lines.withColumn("n", F.monotonically_increasing_id()).join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "n")
    rows = rows.select("file", "block", "within", "value")
    records = rows.mapInPandas(_records(separator, quote, True), _ROWS).select("file", "block", "seq", "fields")
    parts = rows.mapInPandas(_records(separator, quote, False), _ROWS)
    number = F.sum((F.col("kind") == OPENS).cast("int")).over(Window.partitionBy("file").orderBy("block", "seq"))
    together = parts.withColumn("number", number).groupBy("file", "number").agg(F.min(F.struct("block", "seq")).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "body"))), lambda x: x["body"]), "\n").alias("body"))

    @F.pandas_udf("array<string>")
    def parsed(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: fields(b, separator, quote))

    every = records.unionByName(together.select("file", "at.block", "at.seq", parsed("body").alias("fields")))
    if header:
        every = every.where("not (block = 0 and seq = 0)")
    return every.where(F.size("fields") >= max(least, 1)).select(*[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)])
