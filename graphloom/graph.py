"""A graph: edges in a DataFrame, vertices 0 .. n-1."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as X


@dataclass(frozen=True)
class Graph:
    """A directed multigraph. edges: src, dst (long) and, if weighted, weight (double).

    The number of vertices is declared, as isolated ones exist. Parallel edges and self-loops are kept and
    counted. Edges that name null are ignored.
    """

    edges: DataFrame
    n: int

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    @property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.n)

    @property
    def is_known(self) -> F.Column:
        return F.col("src").isNotNull() & F.col("dst").isNotNull()

    def known(self) -> Graph:
        return replace(self, edges=self.edges.where(self.is_known))

    def edge_count(self) -> DataFrame:
        return self.edges.agg(F.count("*").alias("edges"))

    def in_range(self) -> Graph:
        """Without the edges whose target isn't a vertex."""
        return replace(self, edges=self.edges.where(F.col("dst").between(0, self.n - 1)))

    def reverse(self) -> Graph:
        names = [c for c in self.edges.columns if c not in ("src", "dst")]
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *names))

    def undirected(self) -> Graph:
        """Each edge and its reverse; a self-loop counts twice."""
        return replace(self, edges=self.edges.unionByName(self.reverse().edges))

    def with_weights(self) -> Graph:
        """With the synthetic weight src % 10 + dst % 10, unless there are weights."""
        return self if self.weighted else replace(self, edges=self.edges.withColumn("weight", X.synthetic_weight("src", "dst")))

    def degree(self, end: str, name: str) -> DataFrame:
        """id and how many edges have it at this end, zero included."""
        count = self.edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
        return self.vertices.join(count, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def out_degree(self) -> DataFrame:
        return self.degree("src", "out_degree")

    def in_degree(self) -> DataFrame:
        return self.degree("dst", "in_degree")

    def neighbors(self, end: str, other: str) -> DataFrame:
        """id and neighbor, a row for each edge, over all vertices that have one."""
        return self.vertices.join(self.edges, F.col("id") == F.col(end)).select("id", F.col(other).alias("neighbor"))

    def out_neighbors(self) -> DataFrame:
        return self.neighbors("src", "dst")

    def in_neighbors(self) -> DataFrame:
        return self.neighbors("dst", "src")

    def both_neighbors(self) -> DataFrame:
        return self.undirected().out_neighbors()
