"""Primitives on a sequence: a table of pos (0, 1, ...) and value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from .scan import positions, scan


def reduce(seq: DataFrame, map_: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """sum, least, most and xor of the mapped values."""
    v = map_(F.col("value"))
    return seq.agg(F.sum(v).cast("long").alias("sum"), F.min(v).alias("least"), F.max(v).alias("most"), F.bit_xor(v).alias("xor"))


def fold(seq: DataFrame, merge: Callable[[Column, Column], Column], store, block: int = 1024) -> DataFrame:
    """value: all values in order, merged by any associative function (which need not commute); no row for none.

    Blocks of positions are folded each, then blocks of blocks: a row never holds more than `block` values.
    """
    bits, level = block.bit_length() - 1, store.table(seq.select("pos", "value"), "fold")
    while (top := level.agg(F.max("pos")).first()[0]) is not None and top > 0:
        blocks = level.groupBy(F.shiftright("pos", bits).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("xs"))
        value = F.aggregate(F.slice("xs", 2, F.size("xs")), F.col("xs")[0]["value"], lambda a, x: merge(a, x["value"]))
        level = store.table(blocks.select("pos", value.alias("value")), "fold")
    return level.select("value")


def count_flags(seq: DataFrame, flag: Column) -> DataFrame:
    return seq.agg(F.count_if(flag).alias("flags"))


def pack(seq: DataFrame, flag: Column) -> DataFrame:
    """slot, pos, value: the flagged elements, moved together in order."""
    slots = scan(seq.withColumn("flag", flag), "pos", F.col("flag").cast("long"), "slot")
    return slots.where("flag").select("slot", "pos", "value")


def pack_index(seq: DataFrame, flag: Column) -> DataFrame:
    """slot, pos of the flagged elements."""
    return pack(seq, flag).select("slot", "pos")


def dedup(seq: DataFrame) -> DataFrame:
    """pos, value: the first of equal values stays."""
    return seq.groupBy("value").agg(F.min("pos").alias("pos")).select("pos", "value")


def sort(seq: DataFrame, store, key: Column | None = None) -> DataFrame:
    """position, pos, value: stably sorted by a key (the value)."""
    keyed = seq.withColumn("sort_key", F.col("value") if key is None else key)
    return positions(keyed, ["sort_key", "pos"], "position", store).select("position", "pos", "value")


def bucket_offsets(seq: DataFrame, buckets: int) -> DataFrame:
    """bucket, offset: where each of the keys 0 .. buckets-1 begins among the sorted values."""
    counts = seq.groupBy(F.col("value").alias("bucket")).agg(F.count("*").alias("n"))
    all_ = seq.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    return scan(all_, "bucket", F.coalesce("n", F.lit(0)), "offset").select("bucket", "offset")


def transpose(seq: DataFrame, rows: int, columns: int) -> DataFrame:
    """The sequence read as a matrix of rows times columns, transposed: pos, value. The last row may be short."""
    i, j = X.div(F.col("pos"), columns), F.col("pos") % columns
    return seq.select((j * rows + i).cast("long").alias("pos"), "value")


def bitmap(ids: DataFrame, n: int) -> DataFrame:
    """word, bits: how many of the numbers 64 * word .. 64 * word + 63 are among the ids, for all below n."""
    words = ids.select(X.div(F.col("id"), 64).cast("long").alias("word"), "id").distinct().groupBy("word").agg(F.count("*").alias("bits"))
    all_ = ids.sparkSession.range(-(-n // 64)).withColumnRenamed("id", "word")
    return all_.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))


def bit() -> Column:
    """The bit of a number in its word of 64."""
    return F.expr("shiftleft(1L, cast(id % 64 as int))")


def bitmap_fill(spark, n: int, on: bool = False) -> DataFrame:
    """word, bits (64 in a long): all of n bits off, or on."""
    words = spark.range(-(-n // 64)).withColumnRenamed("id", "word")
    last = F.lit((1 << n % 64) - 1 if n % 64 else -1)
    return words.select("word", (F.when(F.col("word") == n // 64, last).otherwise(F.lit(-1)) if on else F.lit(0)).cast("long").alias("bits"))


def masks(ids: DataFrame) -> DataFrame:
    return ids.select(X.div(F.col("id"), 64).cast("long").alias("word"), bit().alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def bitmap_set(bitmap_: DataFrame, ids: DataFrame) -> DataFrame:
    return bitmap_.join(masks(ids), "word", "left").select("word", F.col("bits").bitwiseOR(F.coalesce("mask", F.lit(0))).alias("bits"))


def bitmap_clear(bitmap_: DataFrame, ids: DataFrame) -> DataFrame:
    return bitmap_.join(masks(ids), "word", "left").select("word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0).cast("long")))).alias("bits"))


def bitmap_get(bitmap_: DataFrame, ids: DataFrame) -> DataFrame:
    """id, is_set."""
    asked = ids.withColumn("word", X.div(F.col("id"), 64).cast("long")).join(bitmap_, "word")
    return asked.select("id", (F.col("bits").bitwiseAND(bit()) != 0).alias("is_set"))
