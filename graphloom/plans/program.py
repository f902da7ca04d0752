"""Vertex programs: one loop for algorithms that are told by what a vertex starts with, sends, adds up and does.

The edges are dealt out by their source once and kept; a round moves what vertices send and what arrives,
never the edges. Changes are appended to the state, which is compacted from time to time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .dealing import dealt, frontier_degree

#: Part of the edges that a frontier may touch before all known vertices send.
SWITCH = 20
#: Tables of changes between two compactions of the state.
EVERY = 8


@dataclass(frozen=True)
class VertexProgram:
    """start: id, value of the vertices that send at first. message: what goes along an edge, from the sender's
    value and the edge's columns. combine: one aggregate over what arrives. apply: a vertex's value from its
    old one and what arrived (either may be null); null changes nothing. rounds: how many at most.

    everyone: all vertices send and apply in every round; else those do that changed, until none does, and the
    new value must be one that combine chooses over the old.
    """

    start: Callable[[Graph], DataFrame]
    message: Callable[[Column], Column]
    combine: Callable[[Column], Column]
    apply: Callable[[Column, Column], Column]
    rounds: int | None = None
    everyone: bool = False


def run(program: VertexProgram, graph: Graph, store, strategy: str = "push") -> DataFrame:
    """id, value. strategy: push (vertices that changed send), pull (all known ones do, and every vertex takes
    the best anew), auto (pull in rounds whose frontier touches much)."""
    graph = graph.known().in_range()
    state = store.table(program.start(graph), "state")
    with dealt(graph.edges, store) as edges:
        if program.everyone:
            return everyone(program, graph, edges, state, store)
        total, degree = (edges.kept.count(), store.table(graph.out_degree(), "degree")) if strategy == "auto" else (0, None)
        parts, frontier, n = [state], state, 0
        while program.rounds is None or n < program.rounds:
            n += 1
            all_ = strategy == "pull"
            if strategy == "auto":
                touched = frontier_degree(frontier, degree).first()["degree"]
                all_ = frontier.count() + touched > total // SWITCH
            got = arrived(program, edges, state if all_ else frontier)
            new = got.join(state, "id", "left").select("id", "value", program.apply(F.col("value"), F.col("got")).alias("new"))
            new = store.table(new.where("new is not null and (value is null or new <> value)").select("id", F.col("new").alias("value")), "changed")
            if new.isEmpty():
                break
            parts.append(new)
            state, frontier = best(program, parts), new
            if len(parts) == EVERY:
                state = store.table(state, "state")
                store.drop(*parts[:-1])
                parts = [state]
        return store.table(state, "state")


def best(program: VertexProgram, parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(program.combine(F.col("value")).alias("value"))


def arrived(program: VertexProgram, edges, senders: DataFrame) -> DataFrame:
    """id, got."""
    sent = edges.join(senders.select(F.col("id").alias("src"), "value"))
    return sent.groupBy(F.col("dst").alias("id")).agg(program.combine(program.message(F.col("value"))).alias("got"))


def everyone(program: VertexProgram, graph: Graph, edges, state: DataFrame, store) -> DataFrame:
    for i in range(program.rounds or 1):
        both = graph.vertices.join(state, "id", "left").join(arrived(program, edges, state), "id", "left")
        state = both.select("id", program.apply(F.col("value"), F.col("got")).alias("value"))
        if (i + 1) % 5 == 0 or i + 1 == program.rounds:
            state = store.table(state, "state")
    return state


def least(old: Column, got: Column) -> Column:
    return F.least(old, got)


def at_root(root: int, value: int) -> Callable[[Graph], DataFrame]:
    return lambda graph: graph.spark.createDataFrame([(root, value)], "id long, value long")


def levels(root: int = 0) -> VertexProgram:
    return VertexProgram(at_root(root, 1), lambda v: v + 1, F.min, least)


def distances(root: int = 0, weight: str = "unit") -> VertexProgram:
    """weight: unit, or edge (column weight, whole numbers that aren't negative)."""
    return VertexProgram(at_root(root, 0), lambda v: (v + (F.lit(1) if weight == "unit" else F.col("weight"))).cast("long"), F.min, least)


def labels() -> VertexProgram:
    return VertexProgram(lambda graph: graph.vertices.select("id", F.col("id").alias("value")), lambda v: v, F.min, least)


def ranks(n: int, rounds: int = 10, damping: float = 0.85, init: float = 0.15) -> VertexProgram:
    """Edges have the column out_degree."""
    start = lambda graph: graph.vertices.withColumn("value", F.lit(init))
    return VertexProgram(start, lambda v: v / F.col("out_degree"), F.sum, lambda _, got: (1 - damping) / n + damping * F.coalesce(got, F.lit(0.0)), rounds, True)


def sums() -> VertexProgram:
    """The sum of the ids of the sources of a vertex's incoming edges."""
    return VertexProgram(lambda graph: graph.vertices.select("id", F.col("id").alias("value")), lambda v: v, F.sum, lambda _, got: F.coalesce(got, F.lit(0)).cast("long"), 1, True)
