"""Sparse matrix times vector, the vector being x(i) = i unless given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def spmv(graph: Graph, strategy: str = "edge", scale: float | None = None, x: DataFrame | None = None) -> DataFrame:
    """id, y. strategy: edge and push sum over outgoing edges, pull over incoming ones.

    scale: each product is scale * x, cut to a whole number before it is added (0.001 for push and pull);
    none: x itself. x: id, x of other vectors. A weight column multiplies if the graph has one and x is given.
    """
    graph = graph.known().in_range()
    to, of = ("dst", "src") if strategy == "pull" else ("src", "dst")
    if scale is None and strategy != "edge":
        scale = 0.001
    edges, value = graph.edges, F.col(of)
    if x is not None:
        edges, value = edges.join(x.select(F.col("id").alias(of), "x"), of), F.col("x") * (F.col("weight") if graph.weighted else F.lit(1))
    product: Column = value if scale is None else F.floor(F.lit(scale) * value)
    sums = edges.groupBy(F.col(to).alias("id")).agg(F.sum(product).alias("y"))
    kind = "double" if x is not None and graph.weighted else "long"
    return graph.vertices.join(sums, "id", "left").select("id", F.coalesce("y", F.lit(0)).cast(kind).alias("y"))
