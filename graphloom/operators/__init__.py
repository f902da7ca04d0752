"""Operators: layouts of a graph, frontiers, and primitives on sequences."""
