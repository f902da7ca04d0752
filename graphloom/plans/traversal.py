"""Breadth-first search and shortest paths, level by level.

A round's new vertices are written to the shared folder; what was visited is the union of the rounds. The
edges are dealt out by their source once, and kept so: a round moves the frontier and the vertices that it
reaches, not the edges. Reached vertices are brought together before they meet the visited ones, by an outer
join, which the optimizer doesn't move below the aggregate and back to the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..graph import Graph
from . import program
from .dealing import dealt, frontier_degree

#: Part of the edges that a frontier may touch before the search pulls.
SWITCH = 20


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def reached(edges: DataFrame) -> DataFrame:
    """id, parent: where edges lead, once each, with their least source."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))


def push(found: DataFrame, visited: DataFrame, graph: Graph) -> DataFrame:
    """Of the vertices found, those that weren't visited."""
    return found.join(visited.select("id", F.lit(True).alias("seen")), "id", "left").where("seen is null").drop("seen")


def pull(found: DataFrame, visited: DataFrame, graph: Graph) -> DataFrame:
    """The unvisited vertices that have been found."""
    open_ = graph.vertices.join(visited.select("id", F.lit(True).alias("seen")), "id", "left").where("seen is null").select("id")
    return open_.join(found, "id")


def bfs(graph: Graph, store, root: int = 0, strategy: str = "auto", p: int | None = None) -> DataFrame:
    """id, level (1 for the root), parent (the least vertex of the level above that leads there; the root's
    own) of all vertices that the root reaches.

    strategy: push, pull (from the unvisited vertices), auto (pull while the frontier touches much), edge (the
    flat edge list), grid (skip grid rows without active vertices), range (by the range that owns the target).
    All agree.
    """
    graph = graph.known().in_range()
    p = p or X.grid_dimension(graph.n)
    edges = graph.edges.select("src", "dst", X.partition_id("src", graph.n, p).alias("row_part"))
    levels = [store.table(graph.spark.createDataFrame([(root, 1, root)], "id long, level long, parent long"), "level")]
    visited, rows, parts = levels[0], 1, levels[:]
    with dealt(edges, store) as kept:
        total, degree = (kept.kept.count(), store.table(graph.out_degree(), "degree")) if strategy == "auto" else (0, None)
        while True:
            frontier = levels[-1]
            step = pull if strategy == "pull" else push
            if strategy == "auto":
                touched = frontier_degree(frontier, degree).first()["degree"]
                step = pull if rows + touched > total // SWITCH else push
            some = kept.join(frontier.select(F.col("id").alias("src")))
            if strategy == "grid":
                active = [r[0] for r in frontier.select(X.partition_id("id", graph.n, p)).distinct().collect()]  # p at most
                some = some.where(F.col("row_part").isin(active))
            if strategy == "range":
                some = some.groupBy(X.partition_id("dst", graph.n, p).alias("owner"), "dst").agg(F.min("src").alias("src"))
            new = step(reached(some), visited, graph)
            new = store.table(new.select("id", F.lit(len(levels) + 1).cast("long").alias("level"), "parent"), "level")
            rows = new.count()
            if not rows:
                return visited
            levels.append(new)
            parts.append(new)
            if len(parts) == 16:  # one table again, so that plans stay short
                visited = store.table(union(parts), "visited")
                store.drop(*parts[:-1])
                parts = [visited]
            else:
                visited = visited.unionByName(new)


def shortest_paths(graph: Graph, store, root: int = 0, weight: str = "unit", strategy: str = "push") -> DataFrame:
    """id, dist of all vertices that the root reaches; weight: unit, or edge (the edges', whole numbers).

    strategy: push, pull, auto, as vertex programs have them."""
    graph = graph if weight == "unit" else graph.with_weights()
    graph = Graph(graph.edges.where("src <> dst"), graph.n)
    return program.run(program.distances(root, weight), graph, store, strategy).withColumnRenamed("value", "dist")


def path_parents(graph: Graph, dist: DataFrame, weight: str = "edge") -> DataFrame:
    """id, parent: the least vertex before each on a shortest path (none for the root)."""
    graph = graph.known().in_range().with_weights()
    w = F.lit(1) if weight == "unit" else F.col("weight")
    a = dist.select(F.col("id").alias("src"), F.col("dist").alias("before"))
    b = dist.select(F.col("id").alias("dst"), F.col("dist").alias("after"))
    on = graph.edges.where("src <> dst").select("src", "dst", w.alias("w")).join(a, "src").join(b, "dst")
    return on.where("cast(before + w as bigint) = after and after > 0").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))


def path_violations(graph: Graph, dist: DataFrame, weight: str = "edge") -> DataFrame:
    """violations: edges that would shorten a path, and parents that are farther than their child."""
    graph = graph.known().in_range().with_weights()
    w = F.lit(1) if weight == "unit" else F.col("weight")
    a = dist.select(F.col("id").alias("src"), F.col("dist").alias("before"))
    b = dist.select(F.col("id").alias("dst"), F.col("dist").alias("after"))
    edges = graph.edges.where("src <> dst").select("src", "dst", w.alias("w")).join(a, "src").join(b, "dst", "left")
    return edges.agg(F.count_if(F.expr("after is null or cast(before + w as bigint) < after")).alias("violations"))
