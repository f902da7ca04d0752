"""Weakly connected components, and the spread of least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..graph import Graph
from ..iterate import connected_components
from . import program


def components(graph: Graph, store, strategy: str = "edge", p: int | None = None) -> DataFrame:
    """id, component (the least vertex that it is connected with) of every vertex.

    strategy: edge (contraction of the edge list), grid (the same after each grid cell has dropped its
    parallel edges), frontier (labels spread from what has changed; rounds go with the diameter).
    """
    graph = graph.known().in_range()
    if strategy == "frontier":
        return least_labels(graph.undirected(), store)
    edges = graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if strategy == "grid":
        p = p or X.grid_dimension(graph.n)
        edges = edges.groupBy(X.partition_id("u", graph.n, p).alias("row_part"), X.partition_id("v", graph.n, p).alias("col_part"), "u", "v").agg(F.lit(1)).select("u", "v")
    found = connected_components(edges, store)
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def least_labels(graph: Graph, store) -> DataFrame:
    """id, component: the least vertex from which directed edges lead there (itself included)."""
    return program.run(program.labels(), graph, store).withColumnRenamed("value", "component")


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def summary(labels: DataFrame) -> DataFrame:
    """components, largest."""
    return sizes(labels).agg(F.count("*").alias("components"), F.max("size").alias("largest"))


def violations(graph: Graph, labels: DataFrame) -> DataFrame:
    """violations: edges whose ends have different labels."""
    a = labels.select(F.col("id").alias("src"), F.col("component").alias("a"))
    b = labels.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    return graph.known().in_range().edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("a") != F.col("b")).alias("violations"))
