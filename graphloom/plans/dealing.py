"""Edges dealt out by their source, once for all rounds, with heavy sources in several slices."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of one source in a slice.
HUB = 1_000_000


@dataclass(frozen=True)
class Dealt:
    """Edges in memory or on disk, partitioned by source (and slice), recomputed from their origin if lost.

    hubs: src, slices of the sources of more than HUB edges, fewer than one in HUB of all edges; None without any.
    """

    kept: DataFrame
    hubs: DataFrame | None

    def join(self, sent: DataFrame) -> DataFrame:
        """The edges whose source sends (column src, once each), with what it sends: only that moves."""
        if self.hubs is None:
            return self.kept.join(sent, "src")
        slices = F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)
        sent = sent.join(self.hubs, "src", "left").withColumn("slice", F.explode(slices)).drop("slices")
        return self.kept.join(sent, ["src", "slice"]).drop("slice")


@dataclass(frozen=True)
class Near:
    """Edges that stay as they are, while what vertices send goes to all executors."""

    kept: DataFrame

    def join(self, sent: DataFrame) -> DataFrame:
        return self.kept.join(F.broadcast(sent), "src")


@contextmanager
def near(edges: DataFrame, key: str | None) -> Iterator[Near]:
    """For senders of a checked number; edges are partitioned by a key if there is one."""
    kept = (edges.repartition(key) if key else edges).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Near(kept)
    finally:
        kept.unpersist()


@contextmanager
def dealt(edges: DataFrame, store) -> Iterator[Dealt]:
    heavy = edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
    hubs = store.table(heavy.select("src", F.ceil(F.col("n") / HUB).cast("int").alias("slices")), "hubs")
    if hubs.isEmpty():
        kept, hubs = edges.repartition("src"), None
    else:
        slice_ = F.pmod(F.xxhash64("dst"), F.coalesce("slices", F.lit(1))).cast("int")
        kept = edges.join(hubs, "src", "left").withColumn("slice", slice_).drop("slices").repartition("src", "slice")
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Dealt(kept, hubs)
    finally:
        kept.unpersist()


def frontier_degree(frontier: DataFrame, degree: DataFrame) -> DataFrame:
    """How many edges leave the frontier: degree."""
    return frontier.select("id").join(degree, "id").agg(F.coalesce(F.sum("out_degree"), F.lit(0)).cast("long").alias("degree"))
