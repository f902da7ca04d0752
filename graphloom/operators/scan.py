"""Positions and running aggregates over a whole table, without a task that sees it all.

Two levels: blocks of the table are aggregated (or counted) each, a short table of blocks is scanned, and
each block adds what is before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Positions of a block.
BLOCK = 1 << 16
#: Below the bit at which monotonically_increasing_id keeps the partition.
LOCAL = (1 << 33) - 1

FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}
COMBINE = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def positions(df: DataFrame, keys: Sequence[str | Column], name: str, store) -> DataFrame:
    """df in ranges of keys, sorted, with its place (from 0) in that order. Ties are placed arbitrarily."""
    at = F.monotonically_increasing_id()
    sorted_ = store.table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("scan_at", at), "sorted")
    part = F.shiftright("scan_at", 33)
    counts = sorted_.groupBy(part.alias("scan_part")).agg(F.count("*").alias("scan_n"))
    # a row for each partition
    before = F.sum("scan_n").over(W.Window.orderBy("scan_part").rowsBetween(W.Window.unboundedPreceding, -1))
    base = counts.select("scan_part", F.coalesce(before, F.lit(0)).alias("scan_base"))
    out = sorted_.withColumn("scan_part", part).join(F.broadcast(base), "scan_part")
    return out.withColumn(name, F.col("scan_base") + F.col("scan_at").bitwiseAND(F.lit(LOCAL))).drop("scan_at", "scan_part", "scan_base")


def following(df: DataFrame, keys: Sequence[str], value: str, name: str, store) -> DataFrame:
    """df with the value of the row that follows in the order of keys; null for the last."""
    placed = positions(df, keys, "scan_pos", store)
    next_ = placed.select((F.col("scan_pos") - 1).alias("scan_pos"), F.col(value).alias(name))
    return placed.join(next_, "scan_pos", "left").drop("scan_pos")


def scan(df: DataFrame, at: str, value: str | Column, name: str, op: str = "sum", inclusive: bool = False, backward: bool = False, zero: object = None, block: int = BLOCK) -> DataFrame:
    """df with the running aggregate of value in order of at, a column of distinct non-negative integers.

    exclusive scans begin with zero (0 for a sum, null otherwise, unless given).
    """
    value = F.col(value) if isinstance(value, str) else value
    fold, combine = FOLDS[op], COMBINE[op]
    zero = F.lit(0 if zero is None and op == "sum" else zero)
    df = df.withColumns({"scan_value": value, "scan_block": F.shiftright(F.col(at).cast("long"), block.bit_length() - 1)})
    order = lambda c: F.col(c).desc() if backward else F.col(c).asc()
    first, last = W.Window.unboundedPreceding, W.Window.currentRow
    blocks = df.groupBy("scan_block").agg(fold("scan_value").alias("scan_total"))
    before = fold("scan_total").over(W.Window.orderBy(order("scan_block")).rowsBetween(first, -1))
    blocks = blocks.select("scan_block", before.alias("scan_before"))
    here = fold("scan_value").over(W.Window.partitionBy("scan_block").orderBy(order(at)).rowsBetween(first, last if inclusive else -1))
    out = df.withColumn("scan_here", here).join(blocks, "scan_block")
    both = F.when(F.col("scan_here").isNull(), F.col("scan_before")).when(F.col("scan_before").isNull(), F.col("scan_here")).otherwise(combine(F.col("scan_before"), F.col("scan_here")))
    return out.withColumn(name, F.coalesce(both, zero)).drop("scan_value", "scan_block", "scan_here", "scan_before")
