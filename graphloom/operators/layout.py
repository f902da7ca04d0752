"""Layouts of a graph: sorted edge lists, compressed rows, adjacency lists, grids, vertex ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..graph import Graph
from .scan import positions, scan

#: Neighbours in one row of an adjacency list.
CHUNK = 4096


def csr(graph: Graph, end: str = "src") -> DataFrame:
    """id, degree, offset: where a vertex's edges begin if all are sorted by this end."""
    return scan(graph.degree(end, "degree"), "id", "degree", "offset").select("id", "degree", "offset")


def csr_by_boundary(graph: Graph, store, end: str = "src") -> DataFrame:
    """id, offset, from the sorted edges: where their end changes, or the next vertex's offset."""
    other = "dst" if end == "src" else "src"  # splits the edges of a heavy vertex
    first = positions(graph.edges.select(F.col(end).alias("id"), F.col(other).alias("other")), ["id", "other"], "at", store).groupBy("id").agg(F.min("at").alias("first"))
    total = graph.edges.count()
    marks = graph.vertices.join(first, "id", "left")
    return scan(marks, "id", F.coalesce("first", F.lit(total)), "offset", "min", inclusive=True, backward=True).select("id", "offset")


def adjacency(graph: Graph, store, end: str = "src", other: str = "dst") -> DataFrame:
    """id, chunk, neighbors: sorted lists, in chunks, so that no row holds all edges of a heavy vertex."""
    placed = positions(graph.edges.select(F.col(end).alias("id"), F.col(other).alias("neighbor")), ["id", "neighbor"], "at", store)
    offsets = placed.groupBy("id").agg(F.min("at").alias("first"))
    chunks = placed.join(offsets, "id").withColumn("chunk", X.div(F.col("at") - F.col("first"), CHUNK).cast("long"))
    return chunks.groupBy("id", "chunk").agg(F.array_sort(F.collect_list("neighbor")).alias("neighbors"))


def edge_list(graph: Graph, store, *keys: str) -> DataFrame:
    """The edges with their position when sorted by keys, ties by both ends."""
    order = [*keys, *(k for k in ("src", "dst") if k not in keys)]
    return positions(graph.edges, order, "position", store)


def grid(graph: Graph, p: int) -> DataFrame:
    """The edges with their cell of a p by p grid over the vertices."""
    row, column = (X.partition_id(end, graph.n, p) for end in ("src", "dst"))
    return graph.edges.withColumns({"row_part": row, "col_part": column}).withColumn("cell", F.col("row_part") * p + F.col("col_part"))


def transposed_grid(graph: Graph, p: int) -> DataFrame:
    """The same cells, numbered column by column."""
    return grid(graph, p).withColumn("cell", F.col("col_part") * p + F.col("row_part"))


def cell_sizes(graph: Graph, p: int) -> DataFrame:
    """row_part, col_part, edges for every cell, and where it begins if the edges are sorted by cell."""
    sizes = grid(graph, p).groupBy("cell").agg(F.count("*").alias("edges"))
    cells = graph.spark.range(p * p).withColumnRenamed("id", "cell")
    all_ = cells.join(sizes, "cell", "left").select("cell", F.coalesce("edges", F.lit(0)).alias("edges"))
    return scan(all_, "cell", "edges", "offset").select(X.div(F.col("cell"), p).cast("long").alias("row_part"), (F.col("cell") % p).alias("col_part"), "edges", "offset")


def sorted_cells(graph: Graph, p: int, store) -> DataFrame:
    """The edges with their slot in their cell, sorted by (src, dst) there."""
    placed = positions(grid(graph, p), ["cell", "src", "dst"], "position", store)
    begin = placed.groupBy("cell").agg(F.min("position").alias("begin"))
    return placed.join(begin, "cell").withColumn("slot", F.col("position") - F.col("begin")).drop("position", "begin")


def cells(graph: Graph, p: int, store) -> DataFrame:
    """row_part, col_part, chunk, edges: what each cell holds, sorted, in chunks, so that no row holds a heavy cell."""
    chunk = X.div(F.col("slot"), CHUNK).cast("long").alias("chunk")
    return sorted_cells(graph, p, store).groupBy("row_part", "col_part", chunk).agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))


def load(graph: Graph, mode: int, store, p: int) -> DataFrame:
    """The layout of a number: 0 sorted grid, 1 grid of cells, 2 and 4 outgoing adjacency, 3 incoming adjacency,
    5 adjacency of both directions, 6 grid with sorted cells, 7 and 8 edges sorted by source or both ends, 9 edges as they are."""
    layouts = {
        0: lambda: positions(grid(graph, p), ["cell", "src", "dst"], "position", store),
        1: lambda: cells(graph, p, store),
        2: lambda: adjacency(graph, store),
        3: lambda: adjacency(graph, store, "dst", "src"),
        4: lambda: adjacency(graph, store),
        5: lambda: adjacency(graph.undirected(), store),
        6: lambda: sorted_cells(graph, p, store),
        7: lambda: edge_list(graph, store, "src"),
        8: lambda: edge_list(graph, store, "src", "dst"),
        9: lambda: graph.edges,
    }
    if mode not in layouts:
        raise ValueError(f"no layout has the number {mode}")
    return layouts[mode]()


def equal_ranges(n: int, parts: int) -> list[int]:
    """Boundaries of ranges with equally many vertices: parts + 1 numbers."""
    return [i * n // parts for i in range(parts + 1)]


def balanced_ranges(graph: Graph, parts: int, page: int, store) -> list[int]:
    """Boundaries of ranges with about equally many incoming edges, at multiples of a page.

    Each range takes vertices until its edges exceed its share of what is left. A query for each range.
    """
    prefix = store.table(scan(graph.in_degree(), "id", "in_degree", "before").select("id", "in_degree", "before"), "prefix")
    total = graph.in_range().edges.count()
    before = lambda v: total if v >= graph.n else prefix.where(F.col("id") == v).first()["before"]
    bounds = [0]
    for i in range(parts - 1):
        done = before(bounds[-1])
        share = (total - done) // (parts - i)
        over = prefix.where((F.col("id") >= bounds[-1]) & (F.col("before") + F.col("in_degree") - done > share)).agg(F.min("id")).first()[0]
        bounds.append(max(bounds[-1], (graph.n if over is None else over) // page * page))
    return [*bounds, graph.n]


def owner(v: F.Column | str, bounds: list[int]) -> F.Column:
    """Which half-open range holds a vertex."""
    at = F.lit(0)
    for b in bounds[1:-1]:
        at = at + F.when(X.col(v) >= b, 1).otherwise(0)
    return at.cast("long")


def range_degrees(graph: Graph, bounds: list[int], end: str) -> DataFrame:
    """part (the range of the target), id (the edge's end of that name), degree."""
    return graph.edges.groupBy(owner("dst", bounds).alias("part"), F.col(end).alias("id")).agg(F.count("*").alias("degree"))


def range_csr(graph: Graph, bounds: list[int], end: str = "src") -> DataFrame:
    """range_degrees with the offset of each vertex's edges among those of its part."""
    degrees = range_degrees(graph, bounds, end).withColumn("at", F.col("part") * graph.n + F.col("id"))
    running = scan(degrees, "at", "degree", "before")
    begin = running.groupBy("part").agg(F.min("before").alias("begin"))
    return running.join(begin, "part").select("part", "id", "degree", (F.col("before") - F.col("begin")).alias("offset"))


def ranges(spark, bounds: list[int]) -> DataFrame:
    """part, begin, end of half-open ranges."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))], "part long, begin long, end long")


