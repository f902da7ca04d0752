"""Packed binary edge files: records of two unsigned 32-bit integers and, if weighted, a 32-bit float.

Little-endian, without a header. Reading is a Python data source, `packed_edges`, whose partitions are
ranges of whole records, so that one large file is read by many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, about.
SPLIT = 64 << 20
#: Records of a batch.
BATCH = 1 << 16


def record(weighted: bool) -> np.dtype:
    return np.dtype([("src", "<u4"), ("dst", "<u4")] + ([("weight", "<f4")] if weighted else []))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Span(InputPartition):
    def __init__(self, path: str, start: int, length: int):
        self.path, self.start, self.length = path, start, length


class PackedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.weighted = options["path"], str(options.get("weighted", "false")).lower() == "true"
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Span]:
        store, path = opened(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        size = record(self.weighted).itemsize
        step = max(size, self.split // size * size)
        for f in files:
            if f.size % size:
                raise ValueError(f"{f.path} doesn't hold whole records of {size} bytes")
        return [Span(f.path, at, min(step, f.size - at)) for f in files for at in range(0, f.size, step)] or [Span(path, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.length:
            return
        store, _ = opened(self.path)
        kind = record(self.weighted)
        with store.open_input_file(partition.path) as f:
            for at in range(partition.start, partition.start + partition.length, BATCH * kind.itemsize):
                n = min(BATCH * kind.itemsize, partition.start + partition.length - at)
                rows = np.frombuffer(f.read_at(n, at), kind)
                columns = [rows["src"].astype(np.int64), rows["dst"].astype(np.int64)] + ([rows["weight"].astype(np.float64)] if self.weighted else [])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(kind.names))


class PackedEdges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_edges"

    def schema(self) -> str:
        return "src bigint, dst bigint" + (", weight double" if str(self.options.get("weighted", "false")).lower() == "true" else "")

    def reader(self, schema) -> PackedReader:
        return PackedReader(dict(self.options))


def read_packed(spark: SparkSession, path: str, weighted: bool = False, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(PackedEdges)
    return spark.read.format("packed_edges").option("path", path).option("weighted", str(weighted).lower()).option("split", str(split)).load()


def write_packed(edges: DataFrame, path: str, weighted: bool = False) -> int:
    """Writes a file for each partition of edges to a folder; how many edges were written.

    A task writes under a name that starts with a dot and renames the file when it is whole: a task that
    dies leaves nothing that is read. Speculative execution must be off.
    """
    names = ["src", "dst", *(["weight"] if weighted else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = opened(path)
        store.create_dir(folder, recursive=True)
        hidden, final, n = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part-{TaskContext.get().partitionId():06d}", 0
        with store.open_output_stream(hidden) as f:
            for b in batches:
                rows = np.empty(b.num_rows, record(weighted))
                for i, name in enumerate(names):
                    column = b.column(i).to_numpy(zero_copy_only=False)
                    if name != "weight" and len(column) and not (column.min() >= 0 and column.max() < 1 << 32):
                        raise ValueError("vertex ids must be unsigned 32-bit integers")
                    rows[name] = column
                f.write(rows.tobytes())
                n += len(rows)
        store.move(hidden, final)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return edges.select(*names).mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0
