"""Frontier operators, reductions and transforms."""

from tidegraph.operators.edge_map import edge_map, gather_apply_scatter, merge
from tidegraph.operators.frontier import Frontier
from tidegraph.operators.vertex_map import vertex_filter, vertex_map

__all__ = ["Frontier", "edge_map", "gather_apply_scatter", "merge", "vertex_filter", "vertex_map"]
