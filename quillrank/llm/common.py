"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one, but only if all runs in
    one process: on a cluster the others don't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quillrank-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again; this ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


class Collector:
    """Gathers arrays and gives them to ``flush`` as a whole when there are many."""

    def __init__(self, flush: Callable, most: int = 1_000_000):
        self.flush, self.most, self.held, self.n = flush, most, [], 0

    def add(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.held.append(arrays)
            self.n += len(arrays[0])

    def taken(self) -> list[np.ndarray]:
        whole = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.n = [], 0
        return whole

    def out(self, force: bool = False):
        if not self.held or self.n < self.most and not force:
            return None
        return self.flush(*self.taken())


def by_key(flush: Callable, types: tuple, most: int = 400_000, weigh: int | None = None, most_bytes: int = 32 << 20):
    """A step for map_batches over rows sorted by their first column: flush gets the columns of whole keys, as many
    as make about ``most`` rows, so that a task never holds its partition. types: numpy types, object for bytes.
    weigh: a column of bytes of which at most about ``most_bytes`` are held."""
    got = Collector(flush, most)
    size = 0

    def step(*columns):
        nonlocal size
        arrays = []
        for c, t in zip(columns, types, strict=True):
            if t is object:
                x = np.empty(len(c), object)
                x[:] = c
            else:
                x = np.array(c, t)
            arrays.append(x)
        got.add(*arrays)
        if weigh is not None:
            size += sum(len(x) for x in columns[weigh] if x is not None)
        if not got.held or got.n < got.most and size < most_bytes:
            return None
        whole = got.taken()
        cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last key may go on
        got.add(*(x[cut:] for x in whole))
        size = sum(len(x) for x in whole[weigh][cut:] if x is not None) if weigh is not None else 0
        return flush(*(x[:cut] for x in whole)) if cut else None

    step.rest = lambda: got.out(True)
    return step


def routed(df: DataFrame, key: str) -> DataFrame:
    """Dealt by key and sorted within partitions, for by_key; Spark's sort spills."""
    return df.repartition(shuffle_parts(df.sparkSession), key).sortWithinPartitions(key)


def hot_values(big: DataFrame, on: str, share: int = 1024) -> DataFrame | None:
    """Values of a column of a saved table that more than 1/share of its rows have, fewer than ``share`` ones; None for
    none."""
    total = big.count()
    hot = big.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > max(total // share, 1000)).select(on).collect()
    return big.sparkSession.createDataFrame(hot, StructType([big.schema[on]])).withColumn("_hot", F.lit(True)) if hot else None


def spread_join(big: DataFrame, small: DataFrame, on: str, hot: DataFrame | None, how: str = "inner", parts: int = 64) -> DataFrame:
    """big join small on one column, of which small has one row a value. The rows of hot values are spread over ``parts``
    tasks. how: inner or left."""
    if hot is None:
        return big.join(small, on, how)
    some = big.join(F.broadcast(hot), on, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(parts)).cast("int")).otherwise(0)).drop("_hot")
    every = small.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return some.join(every, [on, "_part"], how).drop("_part")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most some rows, without copies: Python objects are made for so many at once only, whatever the session
    says of batches."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release() -> None:
    """Gives freed memory back: Spark keeps a task's Python worker for the next one, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str, rows: int = 2000) -> DataFrame:
    """Maps Arrow batches of at most ``rows``. make() runs once in a task and returns the function that gets one list for
    each column of df and returns one list or array for each column of schema, or None for no rows. If that
    function has an attribute ``rest``, it is called without arguments after the last batch.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in sliced(batches, rows):
            if (out := step(*[c.to_pylist() for c in b.columns])) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
        if (rest := getattr(step, "rest", None)) and (out := rest()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
        del step, rest
        out = b = None
        release()

    return df.mapInArrow(run, kind)


def with_columns(df: DataFrame, on: list[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """df with more columns, from Arrow batches: make() gives the function that gets a list for each column in ``on``
    and returns one for each column of schema. Rows stay in their tasks and the other columns aren't touched. A column of df
    with the name of a new one is an error."""
    if clash := {f.name.lower() for f in StructType.fromDDL(schema).fields} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    more = to_arrow_schema(StructType.fromDDL(schema))
    kind = StructType([*df.schema.fields, *StructType.fromDDL(schema).fields])
    arrow, at = to_arrow_schema(kind), [df.columns.index(c) for c in on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in sliced(batches, 1000):
            out = step(*[b.column(i).to_pylist() for i in at])
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, arrow)), *(pa.array(x, type=f.type) for x, f in zip(out, more, strict=True))], schema=arrow)
        del step
        out = b = None
        release()

    return df.mapInArrow(run, kind)


def most_frequent(counted: DataFrame, most: int) -> list[tuple]:
    """The most frequent rows (key, n) of counted (a key, n), by falling n and key: as many counts from the top as have at most
    ``most`` rows together, so that ties go or stay together and the driver never gets more rows. Counts from 1024 on
    are compared by classes of a hundredth."""
    counted = saved(counted, "counted")
    n = F.col("n")
    classes = counted.groupBy(F.when(n < 1024, n).otherwise(1024 + F.floor(F.log2(n / 1024) * 64)).alias("class")).agg(F.count("*").alias("rows"), F.min("n").alias("low")).collect()
    least, total = None, 0
    for c in sorted(classes, key=lambda c: -c["class"]):
        total += c["rows"]
        if total > most:
            break
        least = c["low"]
    if least is None:
        return []
    got = counted.where(n >= least).toArrow()  # columns, not a Python object for each row
    return sorted(zip(got.column(0).to_pylist(), got.column("n").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
