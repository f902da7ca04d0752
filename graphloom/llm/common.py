"""What the text operators share: scratch tables, words, Arrow loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.store import Store as Scratch

__all__ = ["SPACE", "Scratch", "byte_words", "column", "join_counted", "map_rows", "rows", "small_batches", "table", "words"]

#: One character of white space; words are what lies between.
SPACE = r"[\x20\x09-\x0D]"

#: Keys that are joined apart hold more than one in this many rows.
HEAVY = 1000

#: Rows of an Arrow batch: texts may hold 100,000 characters and more.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches for Python hold few rows, so that long texts fit."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever dots or cases other columns have."""
    return df["`" + name.replace("`", "``") + "`"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function that yields dicts of columns."""
    small_batches(df.sparkSession)
    names: list[str] = []
    types: list[pa.DataType] = []
    for part in schema.split(","):
        name, kind = part.split()
        names.append(name)
        types.append({"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def join_counted(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of a table with a side that has a row for each key and n, how often df has it at most.

    Keys of more than one in HEAVY of all rows are fewer than HEAVY: they go to all executors, and their rows
    stay where they are. The others are left to an ordinary join, in which no key is large. Both are read twice.
    """
    most = max(1, df.count() // HEAVY)
    heavy, light = side.where(F.col("n") > most), side.where(F.col("n") <= most)
    return df.join(F.broadcast(heavy), keys).unionByName(df.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)).drop("n")


def rows(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[tuple]:
    """Rows of some columns, by their numbers, one after another."""
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in columns), strict=True)


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split parts at the same six characters as SPACE."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
