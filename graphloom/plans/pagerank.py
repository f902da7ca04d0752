"""PageRank: rank'(v) = (1 - d) / n + d * sum of rank(u) / out_degree(u) over edges (u, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..graph import Graph
from .dealing import dealt, near

#: Ranks of up to this many vertices are sent to all executors (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Rounds between tables written: plans stay short.
EVERY = 5


def pagerank(graph: Graph, store, strategy: str = "push", rounds: int = 10, damping: float = 0.85, init: float = 0.15, p: int | None = None) -> DataFrame:
    """id, rank of every vertex. Vertices without outgoing edges pass nothing on.

    Edges never move in a round. They are dealt by their source, heavy sources in slices, and ranks come to
    them; for pull and edge they lie by target or as they come, and ranks go to all executors, up to
    BROADCAST_ROWS vertices. Sums are made by target; for grid by cell of a grid first, for range by the range
    that owns the target first. The strategies give the same sums in different orders.
    """
    n, p = graph.n, p or X.grid_dimension(graph.n)
    graph = graph.known().in_range()
    degree = graph.edges.groupBy("src").agg(F.count("*").alias("out_degree"))
    edges = graph.edges.select("src", "dst").join(degree, "src")
    groups = {"grid": {"row_part": X.partition_id("src", n, p), "col_part": X.partition_id("dst", n, p)}, "range": {"owner": X.partition_id("dst", n, p)}}.get(strategy, {})
    ranks = graph.vertices.withColumn("rank", F.lit(init))
    small = strategy in ("pull", "edge") and n <= BROADCAST_ROWS
    with near(edges, "dst" if strategy == "pull" else None) if small else dealt(edges.withColumns(groups) if groups else edges, store) as kept:
        for i in range(rounds):
            share = kept.join(ranks.select(F.col("id").alias("src"), "rank")).withColumn("share", F.col("rank") / F.col("out_degree"))
            if groups:
                share = share.groupBy(*groups, "dst").agg(F.sum("share").alias("share"))
            sums = share.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("sum"))
            ranks = graph.vertices.join(sums, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("sum", F.lit(0.0))).alias("rank"))
            if (i + 1) % EVERY == 0 or i + 1 == rounds:
                ranks = store.table(ranks, "ranks")
        return ranks
