"""Vectors in numbered NumPy files, with a line of text for each vector beside them.

A folder holds the shards 0.npy, 1.npy, 2.npy and so on, of which those up to the first missing number count, and may hold
parent.txt, a parent's id in each line, and meta.jsonl, a JSON object in each line. Line i belongs to vector i, counted
over all shards. parent.txt and meta.jsonl may be folders of part files, in order of their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import shared

SHARD = "row BIGINT, v ARRAY<FLOAT>"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Rows(InputPartition):
    """Rows ``start`` to ``end`` of a shard whose first row is row ``first`` of all."""

    shard: int
    start: int
    end: int
    first: int


def _header(file) -> tuple[tuple[int, int], np.dtype, int]:
    """(shape, type, where the data begins) of a matrix in rows."""
    read = {(1, 0): npy.read_array_header_1_0, (2, 0): npy.read_array_header_2_0}[npy.read_magic(file)]
    shape, by_column, kind = read(file)
    if len(shape) != 2 or by_column and min(shape) > 1 or kind.kind != "f":
        raise ValueError(f"a shard must be a matrix of floats in rows, not {kind} of shape {shape}")
    return shape, kind, file.tell()


class ShardReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Rows]:
        """Only headers are read here. A shard of more than ``most`` rows is several partitions."""
        store, folder = _opened(self.path)
        out, shard, first = [], 0, 0
        while store.get_file_info(f"{folder}/{shard}.npy").type == fs.FileType.File:
            with store.open_input_file(f"{folder}/{shard}.npy") as f:
                n = _header(f)[0][0]
            out += [Rows(shard, at, min(at + self.most, n), first + at) for at in range(0, n, self.most)]
            shard, first = shard + 1, first + n
        return out or [Rows(-1, 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.shard < 0:
            return
        store, folder = _opened(self.path)
        with store.open_input_file(f"{folder}/{part.shard}.npy") as f:
            (_, width), kind, data = _header(f)
            for at in range(part.start, part.end, 4096):
                n = min(4096, part.end - at)
                f.seek(data + at * width * kind.itemsize)
                x = np.frombuffer(f.read(n * width * kind.itemsize), kind).astype(np.float32)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                rows = pa.array(np.arange(n, dtype=np.int64) + part.first + at - part.start)
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(offsets, pa.array(x))], names=["row", "v"])


@dataclass
class Written(WriterCommitMessage):
    shards: list[int]
    names: list[str]


class ShardWriter(DataSourceArrowWriter):
    """Rows come sorted, a shard's all in one task. A task writes under names of its own; commit moves what the tasks that
    count have written, so lost and doubled tasks show nothing."""

    def __init__(self, path: str, size: int, overwrite: bool, skip: bool):
        self.path, self.size, self.overwrite, self.skip = path, size, overwrite, skip
        self.run = uuid.uuid4().hex
        store, folder = _opened(path)
        if not overwrite and not skip and store.get_file_info(f"{folder}/0.npy").type != fs.FileType.NotFound:
            raise ValueError(f"{path} holds shards")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _opened(self.path)
        done, shard, parts = Written([], []), -1, []

        def end() -> None:
            if not parts or self.skip and store.get_file_info(f"{folder}/{shard}.npy").type == fs.FileType.File:
                return
            name = f"{folder}/_run-{self.run}/{shard}-{uuid.uuid4().hex}"
            store.create_dir(f"{folder}/_run-{self.run}", recursive=True)
            with store.open_output_stream(name) as f:
                rows = np.concatenate(parts)
                npy.write_array_header_1_0(f, {"descr": npy.dtype_to_descr(rows.dtype), "fortran_order": False, "shape": rows.shape})
                f.write(rows.tobytes())
            done.shards.append(shard)
            done.names.append(name)

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            widths = np.unique(np.diff(v.offsets.to_numpy()))
            if v.null_count or v.flatten().null_count or len(widths) != 1 or parts and parts[0].shape[1] != widths[0]:
                raise ValueError("vectors of a shard must be whole and of one length")
            x = v.flatten().to_numpy().astype(np.float32).reshape(-1, widths[0])
            mine = batch.column("row").to_numpy() // self.size
            for s in np.unique(mine):
                if s != shard:
                    end()
                    shard, parts = int(s), []
                parts.append(x[mine == s])
        end()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _opened(self.path)
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.extension == "npy" and f.base_name[:-4].isdigit():
                    store.delete_file(f.path)
        for m in messages:
            for shard, name in zip(m.shards, m.names, strict=True) if m else ():
                store.move(name, f"{folder}/{shard}.npy")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _opened(self.path)
        if store.get_file_info(f"{folder}/_run-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_run-{self.run}")


class VectorShards(DataSource):
    """Options: path; rows, of a partition when reading and of a shard when writing; skip_existing, which leaves shards
    that are there as they are."""

    @classmethod
    def name(cls) -> str:
        return "vector_shards"

    def schema(self) -> str:
        return SHARD

    def _rows(self) -> int:
        return int(self.options.get("rows", 1 << 14))

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options["path"], self._rows())

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], self._rows(), overwrite, self.options.get("skip_existing", "false") == "true")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): lines numbered from 0 over a text file, or over a folder's files in order of their names. Files are read
    in splits; how many lines are before a split is summed up over splits."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    kept = shared.written(lines, "lines")
    splits = kept.groupBy("f", "b").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = splits.withColumn("before", F.sum("n").over(Window.orderBy("f", "b")) - F.col("n"))  # a row a split
    return kept.join(before, ["f", "b"]).select((F.col("before") + F.col("m") - F.col("first")).alias("row"), "value")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``row``, from 0 in an order that must be total, without one task for all."""
    kept = shared.written(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("_m", 33)
    sizes = kept.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).drop("_n")  # a row a task
    return kept.withColumn("_task", task).join(F.broadcast(before), "_task").withColumn("row", F.col("_before") + F.col("_m") - F.col("_first")).drop("_task", "_m", "_before", "_first")


def write(rows: DataFrame, path: str, order: list[str], vector: str, parent: str | None = None, meta: list[str] = (), size: int = 1 << 14, overwrite: bool = False, skip_existing: bool = False) -> None:
    """rows as shards of ``size`` vectors in a total order, with parents' ids and metadata. A null or ragged vector is an error,
    and so is a null parent. skip_existing goes on with the same rows after a run that ended early."""
    spark = rows.sparkSession
    spark.dataSource.register(VectorShards)
    whole = lambda c, kind, what: F.coalesce(c.cast(kind), F.raise_error(F.lit(f"a {what} is null")).cast(kind))
    parts = [F.struct(*order).alias("at"), whole(F.col(vector), "array<float>", "vector").alias("v")]
    parts += [whole(F.col(parent), "string", "parent").alias("parent")] if parent else []
    parts += [F.to_json(F.struct(*meta), {"ignoreNullFields": "false"}).alias("meta")] if meta else []
    all_ = numbered(rows.select(*parts), "at")
    shards = all_.select("row", "v", F.floor(F.col("row") / size).alias("shard")).repartition("shard").sortWithinPartitions("row").drop("shard")
    writer = shards.write.format("vector_shards").mode("overwrite" if overwrite else "append").option("rows", size).option("skip_existing", str(skip_existing).lower())
    writer.save(path)
    for column, name in (("parent", "parent.txt"), ("meta", "meta.jsonl")):
        if column in all_.columns:
            all_.orderBy("row").select(F.col(column).alias("value")).write.mode("overwrite" if overwrite or skip_existing else "error").text(f"{path}/{name}")


def read(spark: SparkSession, path: str, parents: bool = False, meta: str | None = None, rows: int = 1 << 14) -> DataFrame:
    """(row, v), with parent_id and the columns of the schema ``meta`` where asked for. Lines after the last vector don't
    count; a vector without its line is an error, and so is a line that is no number or no JSON object."""
    spark.dataSource.register(VectorShards)
    out = spark.read.format("vector_shards").option("rows", rows).load(path)
    known = lambda c: F.when(F.col("value").isNull(), F.raise_error(F.concat(F.lit("no line for vector "), F.col("row").cast("string"))).cast(c[1])).otherwise(c[0])
    if parents:
        lines = numbered_lines(spark, f"{path}/parent.txt")
        out = out.join(lines, "row", "left").withColumn("parent_id", known((F.trim("value").cast("long"), "long"))).drop("value")
    if meta:
        lines = numbered_lines(spark, f"{path}/meta.jsonl")
        kind = StructType.fromDDL(meta).simpleString()
        out = out.join(lines, "row", "left").withColumn("_meta", known((F.from_json("value", meta, {"mode": "FAILFAST"}), kind))).select(*out.columns, "_meta.*")
    return out
