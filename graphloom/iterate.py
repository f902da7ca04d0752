"""Fixpoint loops whose state is a table in the shared checkpoint folder, written anew each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, store, u: str = "u", v: str = "v") -> DataFrame:
    """id, component (the smallest id reached), for every id that an edge names.

    Alternating large-star and small-star contractions: O(log n) rounds in practice, each of a few
    aggregations on ids, a row for each edge, and never more edges than at the start. `store` keeps the tables of
    a round; a group's size only shows in partial minima and in a join that AQE may split.
    """
    edges = edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct()
    edges = store.table(edges, "edges")  # a <= b
    ids = store.table(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    edges = edges.where("a < b")
    last = before = None
    while True:
        # large star: each neighbour above an id moves to the least of its neighbourhood, which is the id itself
        # unless there are neighbours below it
        least = edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "a")
        large = edges.join(least, "a", "left").select(F.coalesce("m", "a").alias("a"), "b").distinct()
        large = store.table(large, "large")
        # small star: each neighbour below an id, and the id itself, move to the least of them; the edge to the
        # least stands for the id
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        down = large.join(least, "b").select("m", F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("y"))
        small = store.table(down.select(F.col("m").alias("a"), F.col("y").alias("b")).distinct(), "small")
        store.drop(large, *([before] if before else []))
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last, edges, before = now, small, small
    return ids.join(small.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
